"""Connected groups of ids that share keys and pass a check of their values, without all pairs of a key.

Ids that share a key and pass a cheap condition are candidates; a check of both values decides. Only connectivity is
asked for. First every id is checked against the leader that it shares most keys with, twice, with other leaders the
second time; groups are merged after each. Then keys that still lie in several groups are compared whole: all
their pairs between groups pass the cheap condition in numpy, where no pair becomes a row, and the nearest pairs of each
two groups are checked; groups that had more are done again with a larger number, until nothing is left over. So no
candidate between groups stays unchecked, and the groups are those of all checked pairs.

Keys travel packed (see `packed`), as four bytes beside their lane: a chance meeting of two of them only adds a candidate. A key that many ids of a task have is represented by one of them on its way, and
a key of many ids is compared in blocks of BLOCK, so no task holds all ids of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import components, discard, mixed, sliced, stored
from glimmer.llm.packed import SCHEMA, by_lane, dealt, flat, gathered, heads, lane_count, lane_of, lanes, rows_of, shuffled, through

BLOCK, MOST = 4096, 8
#: Pairs of entries whose attributes a task compares at a time, and near ones that it holds before it keeps the nearest alone.
PART, FOUND = 1 << 14, 1 << 18
#: Near(attributes, attributes, wide): whether pairs are candidates, and how far apart they are.
Near = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
_KEY = np.dtype([("key", "<u8"), ("id", "<i8")])
_SENT = np.dtype([("key", "<u4"), ("id", "<i8")])
_BACK = np.dtype([("id", "<i8"), ("key", "<u8"), ("lead", "<i8")])


def _rank(ids: np.ndarray, seed: int) -> np.ndarray:
    return ids if not seed else mixed(ids.view(np.uint64) ^ np.uint64(seed)).view(np.int64)


def _short(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys as their lane and 32 bits in it, of which the last says whether a key is odd."""
    lane = lane_of(keys, n).astype(np.uint64)
    return lane << np.uint64(32) | mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32) & ~np.uint64(1) | keys & np.uint64(1)


def _sent(entries: np.ndarray, n: int, kind: int) -> pa.RecordBatch:
    """Entries of keys as `_short` gives them, packed by lane."""
    out = np.empty(len(entries), _SENT)
    out["key"], out["id"] = entries["key"] & np.uint64(2**32 - 1), entries["id"]
    return by_lane(out, (entries["key"] >> np.uint64(32)).astype(np.uint16), n, kind)


def _alone(keys: np.ndarray) -> np.ndarray:
    """Whether each of sorted keys occurs once."""
    head = heads(keys)
    return head & np.append(head[1:], True)[: len(head)]


def _voted(ids: np.ndarray, keys: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by id: each id's most frequent lead other than itself (itself if there is none), and whether
    an odd key is among those shared with it."""
    first = np.flatnonzero(heads(ids))
    best, wide = ids[first].copy(), np.zeros(len(first), bool)
    some = np.flatnonzero(lead != ids)
    if len(some):
        order = some[np.lexsort((lead[some], ids[some]))]
        i, x, odd = ids[order], lead[order], (keys[order] & np.uint64(1)).astype(np.int64)
        start = np.flatnonzero(heads(i, x))
        count, odd = np.diff(np.append(start, len(i))), np.add.reduceat(odd, start) > 0
        i, x = i[start], x[start]
        pick = np.lexsort((x, -count, i))
        pick = pick[heads(i[pick])]
        at = np.searchsorted(ids[first], i[pick])
        best[at], wide[at] = x[pick], odd[pick]
    return best, wide


def shared_keys(rows: DataFrame, take: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(id, keys, lead, wide): of each id the keys that other ids have too, and the leader that it shares most with.

    rows: a stored table, as tasks that are run again must meet the same rows in the same order; take gives the
    (key, id) entries of a batch, one for each key of an id. Keys that are odd count as wide.
    """
    n = lane_count(rows.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in gathered(batches, take):
            e["key"] = _short(e["key"], n)
            e = e[np.argsort(e["key"])]
            alone = _alone(e["key"])
            if not alone.all():
                rest = e[~alone]
                rest = rest[np.lexsort((rest["id"], rest["key"]))]
                rest = rest[heads(rest["key"], rest["id"])]
                apart = _alone(rest["key"])
                e = np.concatenate([e[alone], rest[apart]])
                rest = rest[~apart]
            yield _sent(e, n, 0)
            if not alone.all() and len(rest):
                e, head = rest, heads(rest["key"])
                back = np.empty(len(e), _BACK)
                back["id"], back["key"] = e["id"], e["key"]
                back["lead"] = e["id"][np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))]
                yield _sent(e[head], n, 2)
                yield dealt(back, back["id"], n, 1)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, got in lanes(batches, {0: _SENT, 1: _BACK, 2: _SENT}):
            if len(got[1]):
                yield through(lane, 0, got[1])
            e = np.empty(len(got[0]) + len(got[2]), _KEY)
            e["key"] = np.concatenate([got[0]["key"], got[2]["key"]]).astype(np.uint64) | np.uint64(lane << 32)
            e["id"] = np.concatenate([got[0]["id"], got[2]["id"]])
            e = e[np.lexsort((e["id"], e["key"]))]
            e = e[heads(e["key"], e["id"])]
            e = e[~_alone(e["key"])]
            if len(e):
                head = heads(e["key"])
                back = np.empty(len(e), _BACK)
                back["id"], back["key"] = e["id"], e["key"]
                back["lead"] = e["id"][np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))]
                yield dealt(back, back["id"], n, 0)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in lanes(batches, {0: _BACK}):
            e = got[0]
            e = e[np.lexsort((e["lead"] == e["id"], e["key"], e["id"]))]  # a key's other leader first
            e = e[heads(e["id"], e["key"])]
            best, wide = _voted(e["id"], e["key"], e["lead"])
            first = np.flatnonzero(heads(e["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(e["id"][first]), rows_of(e["key"], first), pa.array(best), pa.array(wide)], names=["id", "keys", "lead", "wide"])

    return shuffled(shuffled(rows.mapInArrow(spread, SCHEMA)).mapInArrow(met, SCHEMA)).mapInArrow(owned, "id long, keys binary, lead long, wide boolean")


_PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("wide", "?")])
_MORE = np.dtype([("component", "<i8")])
_OWN = np.dtype([("chunk", "<i8"), ("key", "<u8"), ("id", "<i8"), ("component", "<i8")])
_FOR = np.dtype([("key", "<u8"), ("chunk", "<i8"), ("n", "<i8"), ("low", "<i8"), ("high", "<i8"), ("lead", "<i8"), ("group", "<i8")])
_SAY = np.dtype([("chunk", "<i8"), ("key", "<u8"), ("blocks", "<i8"), ("lead", "<i8"), ("group", "<i8")])


def mixed_keys(rows: DataFrame, seed: int) -> DataFrame:
    """(id, component, keys, blocks, lead, wide): of each id the keys that lie in several components, and of each key
    the number of blocks that its ids make. rows: a stored table (id, component, keys), an id once.

    A chunk of rows sends one entry for each of its keys and gets one back, however many of its ids have the key.
    """
    n = lane_count(rows.sparkSession)

    def take(b: pa.RecordBatch) -> np.ndarray:
        keys, counts = flat(b.column(2), np.uint64)
        out = np.empty(len(keys), _OWN)
        out["key"] = keys
        for at, name in enumerate(("id", "component")):
            out[name] = np.repeat(b.column(at).to_numpy(), counts)
        return out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        for e in gathered(batches, take):
            e["chunk"] = chunk = chunk + 1
            e = e[np.lexsort((_rank(e["id"], seed), e["key"]))]
            start = np.flatnonzero(heads(e["key"]))
            out = np.empty(len(start), _FOR)
            out["key"], out["chunk"], out["lead"], out["group"] = e["key"][start], chunk, e["id"][start], e["component"][start]
            out["n"] = np.diff(np.append(start, len(e)))
            out["low"], out["high"] = np.minimum.reduceat(e["component"], start), np.maximum.reduceat(e["component"], start)
            yield dealt(out, out["key"], n, 0)
            yield dealt(e, e["chunk"], n, 1)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, got in lanes(batches, {0: _FOR, 1: _OWN}):
            if len(got[1]):
                yield through(lane, 1, got[1])
            e = got[0]
            if not len(e):
                continue
            e = e[np.lexsort((_rank(e["lead"], seed), e["key"]))]
            start = np.flatnonzero(heads(e["key"]))
            several = np.minimum.reduceat(e["low"], start) != np.maximum.reduceat(e["high"], start)
            of = np.cumsum(heads(e["key"])) - 1
            out = np.empty(len(e), _SAY)
            out["chunk"], out["key"] = e["chunk"], e["key"]
            out["blocks"] = -(-np.add.reduceat(e["n"], start) // BLOCK)[of]
            out["lead"], out["group"] = e["lead"][start][of], e["group"][start][of]
            out = out[several[of]]
            if len(out):
                yield dealt(out, out["chunk"], n, 0)

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in lanes(batches, {0: _SAY, 1: _OWN}):
            say, e = got[0], got[1]
            if not len(say) or not len(e):
                continue
            name = mixed(say["key"] ^ mixed(say["chunk"].view(np.uint64)))
            order = np.argsort(name)
            say, name = say[order], name[order]
            own = mixed(e["key"] ^ mixed(e["chunk"].view(np.uint64)))
            at = np.minimum(np.searchsorted(name, own), len(name) - 1)
            there = name[at] == own
            e, at = e[there], at[there]
            order = np.argsort(e["id"], kind="stable")
            e, say = e[order], say[at[order]]
            if not len(e):
                continue
            lead = np.where(say["group"] != e["component"], say["lead"], e["id"])
            best, wide = _voted(e["id"], e["key"], lead)
            first = np.flatnonzero(heads(e["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(e["id"][first]), pa.array(e["component"][first]), rows_of(e["key"], first), rows_of(say["blocks"].astype("<u4"), first), pa.array(best), pa.array(wide)], names=["id", "component", "keys", "blocks", "lead", "wide"])

    return shuffled(shuffled(rows.mapInArrow(spread, SCHEMA)).mapInArrow(met, SCHEMA)).mapInArrow(owned, "id long, component long, keys binary, blocks binary, lead long, wide boolean")


def compared(rows: DataFrame, kind: np.dtype, near: Near, most: int) -> DataFrame:
    """(a, b, wide), each pair once: of each lane of keys the nearest candidates of each two components (see `_best`); where there
    were more, a row with a component as a, and no b, for each of the two. rows: (id, component, keys, blocks, attr).

    A pair comes from each lane in which it shares a key, so pairs travel packed, and are told apart before they are rows."""
    n = lane_count(rows.sparkSession, 1)
    entry = np.dtype([("key", "<u8"), ("wide", "?"), ("id", "<i8"), ("component", "<i8"), ("attr", kind)])

    def take(b: pa.RecordBatch) -> np.ndarray:
        keys, counts = flat(b.column(2), np.uint64)
        blocks, _ = flat(b.column(3), np.uint32)
        row = np.repeat(np.arange(b.num_rows), counts)
        ids, groups, attr = b.column(0).to_numpy(), b.column(1).to_numpy(), flat(b.column(4), kind)[0]
        mine = (mixed(ids.view(np.uint64))[row] % np.maximum(blocks, 1)).astype(np.uint32)
        # an id of block i takes part in the pairs of blocks (i, j) for every j
        times = blocks.astype(np.int64)
        which = np.repeat(np.arange(len(keys)), times)
        other = (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
        own = mine[which].astype(np.uint64)
        pair = np.minimum(own, other) << np.uint64(32) | np.maximum(own, other)
        out = np.empty(len(which), entry)
        out["key"] = np.where(times[which] > 1, mixed(keys[which] ^ mixed(pair)), keys[which])
        out["wide"] = (keys[which] & np.uint64(1)).astype(bool)
        out["id"], out["component"], out["attr"] = ids[row[which]], groups[row[which]], attr[row[which]]
        return out

    meets = np.dtype([("key", "<u8"), ("wide", "?"), ("id", "<i8")])
    member = np.dtype([("id", "<i8"), ("component", "<i8"), ("attr", kind)])

    def picked(e: np.ndarray, dtype: np.dtype) -> np.ndarray:
        out = np.empty(len(e), dtype)
        for name in dtype.names:
            out[name] = e[name]
        return out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in gathered(batches, take, 64):
            lane = lane_of(e["key"], n)
            yield by_lane(picked(e, meets), lane, n, 0)
            # an id with many keys in a lane sends its attributes there once
            order = np.lexsort((e["id"], lane))
            order = order[heads(lane[order], e["id"][order])]
            yield by_lane(picked(e[order], member), lane[order], n, 1)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in lanes(batches, {0: meets, 1: member}):
            keys, members = got[0], got[1][np.argsort(got[1]["id"], kind="stable")]
            e = np.empty(len(keys), entry)
            e["key"], e["wide"], e["id"] = keys["key"], keys["wide"], keys["id"]
            at = np.searchsorted(members["id"], keys["id"])
            e["component"], e["attr"] = members["component"][at], members["attr"][at]
            (a, b, wide), more = nearest(e, near, most)
            if len(a):
                out = np.empty(len(a), _PAIR)
                out["a"], out["b"], out["wide"] = a, b, wide
                yield dealt(out, out["a"], n, 0)
            if len(more):
                yield dealt(more.view(_MORE), more, n, 1)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("wide", pa.bool_())])
        for _, got in lanes(batches, {0: _PAIR, 1: _MORE}):
            e, more = got[0], np.unique(got[1]["component"])
            e = e[np.lexsort((~e["wide"], e["b"], e["a"]))]
            e = e[heads(e["a"], e["b"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(e["a"], more)), pa.concat_arrays([pa.array(e["b"]), pa.nulls(len(more), pa.int64())]), pa.concat_arrays([pa.array(e["wide"]), pa.nulls(len(more), pa.bool_())])], schema=arrow)

    return shuffled(shuffled(rows.mapInArrow(spread, SCHEMA)).mapInArrow(pairs, SCHEMA)).mapInArrow(once, "a long, b long, wide boolean")


def nearest(e: np.ndarray, near: Near, most: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """(a, b, wide) of the candidates of entries (key, id, component, wide, attr) that `_best` keeps, and the components of those left out."""
    e = e[np.lexsort((e["id"], e["key"]))]
    start = np.flatnonzero(heads(e["key"]))
    left = np.repeat(np.append(start[1:], len(e)), np.diff(np.append(start, len(e)))) - np.arange(len(e))
    ids, groups = np.ascontiguousarray(e["id"]), np.ascontiguousarray(e["component"])
    at, step = np.flatnonzero(left > 1), 1
    found: list[tuple[np.ndarray, ...]] = []
    more = np.empty(0, np.int64)
    held, limit = 0, FOUND
    while len(at):
        for part in np.array_split(at, -(-len(at) // PART)):
            part = part[(groups[part] != groups[part + step]) & (ids[part] != ids[part + step])]
            x, y = e[part], e[part + step]
            ok, far = near(x["attr"], y["attr"], x["wide"])
            x, y = part[ok], part[ok] + step
            found.append((ids[x], ids[y], e["wide"][x], far[ok], groups[x], groups[y]))
            held += len(x)
            if held > limit:
                best, cut = _best(found, most)
                found, held, more = [best], len(best[0]), np.union1d(more, cut)
                limit = max(FOUND, 2 * held)
        step += 1
        at = at[left[at] > step]
    if not held:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)), more
    best, cut = _best(found, most)
    return best[:3], np.union1d(more, cut)


def _best(found: list[tuple[np.ndarray, ...]], most: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Different pairs that are among the nearest of their two components (an eighth of `most`) and among the `most`
    nearest of either id, and the components of pairs that were left out."""
    a, b, wide, far, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
    turned = a > b
    a, b, left, right = (np.where(turned, y, x) for x, y in ((a, b), (b, a), (left, right), (right, left)))
    order = np.lexsort((far, ~wide, b, a))
    order = order[heads(a[order], b[order])]
    a, b, wide, far, left, right = (x[order] for x in (a, b, wide, far, left, right))
    first = _leading((np.minimum(left, right), np.maximum(left, right)), (far, a, b), -(-most // 8))
    kept = np.zeros(len(a), bool)
    for side, other in ((a, b), (b, a)):
        kept[first[_leading((side[first],), (far[first], other[first]), most)]] = True
    cut = np.unique(np.concatenate([left[~kept], right[~kept]]))
    return tuple(x[kept] for x in (a, b, wide, far, left, right)), cut


def _leading(group: tuple[np.ndarray, ...], by: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """The places of the first `most` rows of each group."""
    order = np.lexsort((*by[::-1], *group[::-1]))
    head = heads(*(x[order] for x in group))
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(head, at, 0)) < most]


def nearby(pairs: DataFrame, attrs: DataFrame, kind: np.dtype, near: Near) -> DataFrame:
    """The pairs (a, b, wide) that pass the cheap condition. attrs: (id, attr)."""
    left, right = (attrs.select(F.col("id").alias(x), F.col("attr").alias(f"{x}m")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ok, _ = near(flat(b.column("am"), kind)[0], flat(b.column("bm"), kind)[0], b.column("wide").to_numpy(zero_copy_only=False).astype(bool))
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "wide", "am", "bm").mapInArrow(run, "a long, b long")


def in_python(make_check: Callable[[], Callable]) -> Callable[[DataFrame], DataFrame]:
    """A check of (a, b, av, bv) by a function of two values, made once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = make_check()
        for b in sliced(batches):
            found = [check(x, y) for x, y in zip(b.column("av").to_pylist(), b.column("bv").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return lambda pairs: pairs.mapInArrow(run, "a long, b long")


def linked(found: DataFrame, attrs: DataFrame, kind: np.dtype, near: Near, values: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) of every id with a link.

    found: as `shared_keys` gives it, stored. attrs: (id, attr) of all its ids, attr as packed `kind`. values makes
    (id, value), stored, for a table of ids (id); it is asked for those of near pairs alone. check keeps the pairs
    (a, b) of (a, b, av, bv) whose values pass; no pair is checked twice.
    """
    links: DataFrame | None = None
    tried: DataFrame | None = None
    groups = found.sparkSession.createDataFrame([], "id long, component long")
    made: list[DataFrame] = []

    def merge(pairs: DataFrame, surely: bool = False) -> None:
        """Check pairs and merge groups. surely: they are known to pass the cheap condition."""
        nonlocal links, groups, tried
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "wide")
        new = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        close = stored(new.select("a", "b") if surely else nearby(new, attrs, kind, near), "near")
        made.append(close)
        if close.isEmpty():
            return
        ids = close.select(F.col("a").alias("id")).distinct().unionByName(close.select(F.col("b").alias("id")).distinct()).distinct()
        tried = close if tried is None else tried.unionByName(close)
        found = values(ids)
        # values are dealt by id, and of each pair one of them is dealt anew
        left, right = (found.select(F.col("id").alias(x), F.col("value").alias(f"{x}v")).hint("shuffle_hash") for x in "ab")
        new = stored(check(close.join(right, "b").join(left, "a").select("a", "b", "av", "bv")), "links", (found,))
        made.append(new)
        if not new.isEmpty():
            links = new if links is None else links.unionByName(new)
            groups = components(links)

    def led(rows: DataFrame) -> DataFrame:
        return rows.where("lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b"), "wide")

    def regrouped(rows: DataFrame, old: DataFrame, seed: int) -> DataFrame:
        """mixed_keys of rows (id, keys), which are made of the stored table `old`, in the present groups."""
        named = rows.select("id", "keys").join(groups, "id", "left")
        members = stored(named.select("id", F.coalesce("component", "id").alias("component"), "keys"), "members", (old,))
        return stored(mixed_keys(members, seed), "mixed", (members,))

    merge(led(found))
    rows, most = regrouped(found, found, 1), MOST
    if not rows.isEmpty():
        merge(led(rows))
        rows = regrouped(rows, rows, 2)
    while not rows.isEmpty():
        pairs = stored(compared(rows.join(attrs, "id").select("id", "component", "keys", "blocks", "attr"), kind, near, most), "pairs")
        merge(pairs.where("b IS NOT NULL"), surely=True)
        more = pairs.where("b IS NULL").select(F.col("a").alias("component")).distinct()
        last = more.isEmpty()
        if not last:
            rows, most = regrouped(rows.join(more, "component", "left_semi"), rows, 2), most * 32
        discard(pairs)
        if last:
            break
    out = stored(groups, "groups")
    discard(rows, *made)
    return out
