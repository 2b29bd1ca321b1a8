"""Substring dedup with prefix-partitioned suffix trees.

A repeat is a run of `width` words that also starts earlier (smaller doc_id, or same document and earlier start).
Equal runs hold the same anchor: the leftmost position among their first starts whose `order`-word prefix has the
smallest hash. So only suffixes at anchors are indexed, each with the words of all runs that it anchors. They are
partitioned by prefix: of `order` words at first, and where more than `group` suffixes share one, of the whole
run's words, so that every group fits in memory. In a group the sorted suffixes are the leaves of the prefix's
subtree, the common prefixes of neighbours give its internal nodes, and nodes of depth `width` or more are the repeats;
a prefix of a whole run is such a node by itself, of which only the earliest leaf is looked for. Overlapping runs cover
longer repeats word by word; a repeat's maximal length is not a result of its own.

Documents that equal an earlier one in full are settled first. Prefixes that occur once are dropped before any
words are sent. Null and empty texts have no words; texts of fewer than `width` words have no runs; texts may be of any
length. Rows that share a doc_id are told apart, and ordered, by a 64-bit hash of their texts; fully equal rows get the same result. A null
doc_id counts as the smallest integer. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import mixed, signed, sliced, window_hashes, word_hashes
from glimmer.llm.packed import SCHEMA, dealt, gathered, heads, lane_count, lanes, rows_of, shuffled, through

#: A group of 16,384 suffixes takes about 4 MB, and some 40 MB while its tree is made.
WIDTH, ORDER, GROUP = 20, 8, 16_384
NO_ID = -(2**63)


def anchors(h: np.ndarray, width: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: prefix keys, anchor places, first and last run start of each anchor."""
    g, span = window_hashes(h, order), width - order + 1
    n = len(h) - width + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    least, reach = g, 1
    while 2 * reach <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    low = np.minimum(least[:n], least[span - reach : span - reach + n])
    place = np.full(n, -1, np.int64)
    at = np.arange(n)
    for off in range(span):
        place = np.where((place < 0) & (g[off : off + n] == low), at + off, place)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], n) - 1
    return g[place[first]], place[first], first, last


def common_prefixes(leaves: np.ndarray) -> np.ndarray:
    """How many words each of sorted suffixes has in common with the one before; 0 for the first."""
    same = leaves[1:] == leaves[:-1]
    return np.concatenate([[0], np.where(same.all(axis=1), leaves.shape[1], same.argmin(axis=1))])


def deep_nodes(suffixes: np.ndarray, depth: int) -> np.ndarray:
    """A number for each suffix: those of one number are the leaves below one internal node of that depth at least.

    Sorted suffixes are the leaves of the tree in its order; between two leaves the common prefix of neighbours is at
    least as long as their own, so a node's leaves are a run of them whose common prefixes reach its depth.
    """
    wide = np.ascontiguousarray(suffixes).view(np.dtype((np.void, suffixes.dtype.itemsize * suffixes.shape[1]))).ravel()
    order = np.argsort(wide, kind="stable")
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(common_prefixes(suffixes[order]) < depth)
    return node


def _earliest(node: np.ndarray, rank: tuple[np.ndarray, ...]) -> np.ndarray:
    """Whether each member is its node's first by rank (most significant last, as lexsort takes them)."""
    order = np.lexsort((*rank, node))
    start = np.concatenate([[True], node[order][1:] != node[order][:-1]])
    lead = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    # members of equal rank stand for equal rows and are first together
    head = np.logical_and.reduce([r[order] == r[order][lead] for r in rank])
    out = np.empty(len(node), bool)
    out[order] = head
    return out


_SUFFIX = pa.schema([("key", pa.int64()), ("d", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("runs", pa.int32()), ("off", pa.int32()), ("words", pa.binary())])
_SUFFIX_SQL = "key long, d long, th long, start int, runs int, off int, words binary"


def _resolved(rows: pa.RecordBatch | pa.Table, width: int) -> pa.RecordBatch:
    """(d, th, start, mask): of each suffix of whole prefix groups, the runs that also start earlier."""
    n = rows.num_rows
    key, d, th, start, runs, off = (rows.column(c).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(c).to_numpy() for c in ("key", "d", "th", "start", "runs", "off"))
    flat = np.frombuffer(b"".join(rows.column("words").to_pylist()), np.uint64)
    sizes = runs.astype(np.int64) + width - 1
    begin = np.cumsum(sizes) - sizes
    member = np.repeat(np.arange(n), runs)
    step = np.arange(len(member)) - np.repeat(np.cumsum(runs) - runs, runs)
    suffixes = np.empty((len(member), width + 2), np.uint64)
    suffixes[:, 0] = key.astype(np.int64).view(np.uint64)[member]
    suffixes[:, 1] = (off[member] - step).astype(np.uint64)  # equal runs hold their anchor at the same place
    suffixes[:, 2:] = flat[(begin[member] + step)[:, None] + np.arange(width)]
    first = _earliest(deep_nodes(suffixes, width + 2), (start[member] + step, th[member], d[member]))
    mask = np.zeros(n, np.int64)
    np.bitwise_or.at(mask, member, np.where(first, 0, 1 << step))
    hit = np.flatnonzero(mask)
    return pa.RecordBatch.from_arrays([pa.array(d[hit], pa.int64()), pa.array(th[hit], pa.int64()), pa.array(start[hit], pa.int32()), pa.array(mask[hit], pa.int64())], names=["d", "th", "start", "mask"])


def repeats(docs: DataFrame, width: int = WIDTH, order: int = ORDER, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """docs as (d, th, text, copy), and (d, th, hits, starts): the starts of its repeats, as places and bit masks and as places."""
    if not 0 < width - order < 60:
        raise ValueError("a run needs between 1 and 59 words more than its prefix")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    full = rows.select("d", "th", F.sha2("text", 256).alias("sha"))
    first = full.groupBy("sha").agg(F.min("d").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    copies = full.join(first, "sha").where("d > first").select("d", "th", F.lit(True).alias("copy")).distinct()
    # every join below is by (d, th) and reads the same columns, so that the texts are shuffled once
    marked = rows.join(copies.hint("shuffle_hash"), ["d", "th"], "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    once = marked.where("NOT copy").select("d", "th", "text")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[list[np.ndarray]] = [[], [], [], []]
            for d, th, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                k, n = np.unique(anchors(word_hashes(t.encode().split()), width, order)[0], return_counts=True)
                for x, y in zip(out, (signed(k), np.full(len(k), d), np.full(len(k), th, np.int64), np.minimum(n, 1 << 30).astype(np.int32)), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) if x else pa.array([], t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["key", "d", "th", "n"])

    prefixes = once.mapInArrow(keys, "key long, d long, th long, n int").where("key IS NOT NULL AND d IS NOT NULL AND th IS NOT NULL AND n > 0").repartition("key")
    # bounds that always hold keep both uses of the prefixes at the same columns, so that they are made once
    often = prefixes.groupBy("key").agg(F.sum("n").alias("total"), F.max("d").alias("_d"), F.max("th").alias("_th")).where("total > 1")
    both = prefixes.join(often.hint("shuffle_hash"), "key").where("d <= _d AND th <= _th AND n <= total")
    shared = both.groupBy("d", "th").agg(F.collect_list(F.when(F.col("total") <= group, F.col("key"))).alias("few"), F.collect_list(F.when(F.col("total") > group, F.col("key"))).alias("many"))
    wanted = once.join(shared.hint("shuffle_hash"), ["d", "th"])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out: list[tuple] = []
            size = 0
            for d, th, t, keep in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if not keep:
                    continue
                h = word_hashes(t.encode().split())
                k, place, a, z = anchors(h, width, order)
                for i in np.flatnonzero(np.isin(signed(k), np.array(keep, np.int64))).tolist():
                    words = h[a[i] : z[i] + width].tobytes()
                    out.append((int(signed(k[i : i + 1])[0]), d, th, int(a[i]), int(z[i] - a[i] + 1), int(place[i] - a[i]), words))
                    size += len(words)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SUFFIX, strict=True)], schema=_SUFFIX)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SUFFIX, strict=True)], schema=_SUFFIX)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0  # the last group may go on
            for part in _groups(table.slice(0, cut), 8192):
                yield _resolved(part, width)
            held = table.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield _resolved(held, width)

    few = wanted.select("d", "th", "text", "few").mapInArrow(suffixes, _SUFFIX_SQL).repartition("key").sortWithinPartitions("key")
    found = few.mapInArrow(trees, "d long, th long, start int, mask long")
    few_hits = found.groupBy("d", "th").agg(F.collect_list(F.struct("start", "mask")).alias("hits"))
    late = _late_runs(wanted.where("size(many) > 0").select("d", "th", "text", "many"), width, order)
    # a document has a row in either where it has hits there
    return marked, few_hits.join(late, ["d", "th"], "full")


_RUN = np.dtype([("run", "<u8"), ("d", "<i8"), ("th", "<i8"), ("start", "<i4")])


def _is_late(e: np.ndarray) -> np.ndarray:
    """Of sorted runs, those that don't lie where the first of their run lies."""
    head = heads(e["run"])
    lead = e[np.maximum.accumulate(np.where(head, np.arange(len(e)), 0))]
    return (e["d"] != lead["d"]) | (e["th"] != lead["th"]) | (e["start"] != lead["start"])


def _late_runs(rows: DataFrame, width: int, order: int) -> DataFrame:
    """(d, th, starts): the starts of runs that also start earlier, of the prefixes that too many suffixes share.

    Such prefixes are lengthened to the whole run: its suffixes need no tree, only their earliest. A task keeps the
    earliest that it meets of a run and sends that one on, so what meets of a run is an entry a task at most.
    """
    n = lane_count(rows.sparkSession)

    def take(b: pa.RecordBatch) -> np.ndarray:
        out = [np.empty(0, _RUN)]
        for d, th, t, keep in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            h = word_hashes(t.encode().split())
            k, _, a, z = anchors(h, width, order)
            some = np.flatnonzero(np.isin(signed(k), np.array(keep, np.int64)))
            if len(some):
                size = z[some] - a[some] + 1
                start = np.repeat(a[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                e = np.empty(len(start), _RUN)
                # a run is known by 64 bits, mixed of its anchor's prefix and of all its words
                e["run"], e["d"], e["th"], e["start"] = mixed(np.repeat(k[some], size) ^ window_hashes(h, width)[start]), d, th, start
                out.append(e)
        return np.concatenate(out)

    def sent(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield dealt(e, mixed(e["d"].view(np.uint64)) ^ e["th"].astype(np.uint64), n, 1)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for e in gathered(batches, take, 64):
            e = e[np.lexsort((e["start"], e["th"], e["d"], e["run"]))]
            late = _is_late(e)
            first = e[heads(e["run"])]
            yield dealt(first, first["run"], n, 0)
            yield from sent(e[late])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, got in lanes(batches, {0: _RUN, 1: _RUN}):
            if len(got[1]):
                yield through(lane, 1, got[1])
            e = got[0][np.lexsort((got[0]["start"], got[0]["th"], got[0]["d"], got[0]["run"]))]
            if len(e):
                yield from sent(e[_is_late(e)])

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in lanes(batches, {1: _RUN}):
            e = got[1][np.lexsort((got[1]["start"], got[1]["th"], got[1]["d"]))]
            at = np.flatnonzero(heads(e["d"], e["th"]))
            yield pa.RecordBatch.from_arrays([pa.array(e["d"][at]), pa.array(e["th"][at]), rows_of(np.ascontiguousarray(e["start"]), at)], names=["d", "th", "starts"])

    return shuffled(shuffled(rows.mapInArrow(spread, SCHEMA)).mapInArrow(met, SCHEMA)).mapInArrow(owned, "d long, th long, starts binary")


def _groups(table: pa.Table, size: int) -> Iterator[pa.Table]:
    """Slices of about size rows that end where a key ends."""
    key, at = table.column("key").to_numpy(), 0
    while at < len(key):
        end = min(at + size, len(key))
        if end < len(key):
            end = int(np.searchsorted(key, key[end - 1], "right"))
        yield table.slice(at, end - at)
        at = end


def removed(words: int, hits: list[dict] | None, more: bytes | None, copy: bool, width: int) -> np.ndarray:
    """Whether each word lies in a repeat."""
    gone = np.zeros(words, bool)
    if copy and words >= width:
        gone[:] = True
    elif hits or more:
        starts = [h["start"] + np.flatnonzero([h["mask"] >> k & 1 for k in range(h["mask"].bit_length())]) for h in hits or ()]
        starts = np.concatenate([*starts, np.frombuffer(more or b"", "<i4")]).astype(np.int64)
        edge = np.zeros(words + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + width, -1)
        gone = np.cumsum(edge)[:words] > 0
    return gone


def digests(docs: DataFrame, width: int = WIDTH, order: int = ORDER, group: int = GROUP, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row, and with texts what is kept of it."""
    marked, hits = repeats(docs, width, order, group)
    joined = marked.join(hits.hint("shuffle_hash"), ["d", "th"], "left").select("d", "th", "text", "copy", "hits", "starts")
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("text", pa.string())] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            out = []
            for i, t, copy, found, more in zip(*(b.column(c).to_pylist() for c in ("d", "text", "copy", "hits", "starts")), strict=True):
                words = t.encode().split()
                gone = removed(len(words), found, more, copy, width)
                kept = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                out.append((None if i == NO_ID else i, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts else [])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)
