"""N-gram Jaccard join by grouped prefixes.

A text is the set of its distinct `size`-word shingles. Shingles are ordered by rising frequency (counted by hash
bucket over all texts, so that the order is a table of fixed size) and then by hash. Two sets whose Jaccard
similarity reaches the threshold share a shingle among the first |x| - ceil(t |x|) + 1 of each. Texts with the same
prefix and set size form a group, which sends its prefix once: groups are joined on prefix shingles, each with the
group that it shares most of them with, and a pair of groups is expanded to the members of the one and the other's
representative, members of a group to their own. What those pairs leave apart is compared whole (see `linkage`):
a candidate needs a size in range and, by parity bitmaps of the shingles (which differ in at most as many bits as the
sets in shingles), an overlap that may reach the threshold; it is then verified on whole sets. Equal sets are one class.
Shingles, prefixes and sets are compared as 64-bit hashes.

Nulls, empty texts and texts without words have empty sets and no link; a text of fewer words than `size` is one
shingle; texts may be of any length. Rows that share a doc_id are one document, linked if any of them is, and fully
equal rows give equal results; rows without an id aren't linked. Other columns are not read.

Components need no more links than connect them. With `links` a row's n_links is the number of documents whose sets
reach the threshold with its own, those with an equal set among them and itself not; a document whose rows have
several sets counts once for each. All pairs of a component's different sets are counted for that, as products of
0/1 matrices of blocks of sets, so no pair becomes a row; the work still grows with the square of a group of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import components, count_vector, mixed, sliced, stored, wanted_rows, window_hashes, word_hashes
from glimmer.llm.linkage import in_python, linked, shared_keys
from glimmer.llm.packed import flat

SIZE, PERCENT, COUNTS = 5, 75, 1 << 18
#: Bits of a set's parity bitmap; sets and shingles of a block, and of a piece of it, whose links are counted at a time.
BITS, SETS, SHINGLES = 2048, 4096, 1 << 21
PIECE, SOME = 1024, 1 << 19
#: Shingles of sets that a task remembers while it checks pairs, and eighths of their texts' packed bytes.
HELD = 1 << 21
ATTR = np.dtype([("n", "<u4"), ("bits", "<u8", BITS // 64)])
#: A-Z to lower case, other bytes as they are.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    h = word_hashes(text.encode().translate(_LOWER).split()) if text else np.empty(0, np.uint64)
    if 0 < len(h) < size:
        return mixed(window_hashes(h, len(h)) ^ np.uint64(len(h)))
    return np.unique(window_hashes(h, size))


def prefix(found: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The set's first shingles in the global order."""
    n = len(found)
    order = np.argsort(counts[found & np.uint64(len(counts) - 1)], kind="stable")
    return found[order[: n - -(-percent * n // 100) + 1]] if n else found


def _name(x: np.ndarray, n: int) -> int:
    return xxhash.xxh3_64_intdigest(x.tobytes(), n) - (1 << 63)


def described(sets: list[np.ndarray]) -> np.ndarray:
    """Size and parity bitmap of each set."""
    out = np.empty(len(sets), ATTR)
    for i, s in enumerate(sets):
        out[i] = len(s), np.packbits((np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(bool)).view(np.uint64)
    return out


def nearness(percent: int):
    def near(x: np.ndarray, y: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = x["n"].astype(np.int64) + y["n"]
        far = np.bitwise_count(x["bits"] ^ y["bits"]).sum(axis=1, dtype=np.int64)
        common = np.minimum((n - far) // 2, np.minimum(x["n"], y["n"]))
        return (common > 0) & (100 * common >= percent * (n - common)), far / np.maximum(n, 1)

    return near


def checker(size: int, percent: int):
    """Whether the sets of two packed texts reach the threshold; remembers sets of up to HELD shingles together."""

    def make():
        sets: dict[bytes, np.ndarray] = {}
        held = 0

        def known(value: bytes) -> np.ndarray:
            nonlocal held
            if value not in sets:
                found = shingles(unpacked(value), size)
                held += len(found) + len(value) // 8
                if held > HELD:
                    sets.clear()
                    held = len(found) + len(value) // 8
                sets[value] = found
            return sets[value]

        def check(a: bytes, b: bytes) -> bool:
            x, y = known(a), known(b)
            common = len(np.intersect1d(x, y, assume_unique=True))
            return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)

        return check

    return make


def packed(text: str) -> bytes:
    return zstandard.compress(text.encode(), 1)


def unpacked(value: bytes) -> str:
    return zstandard.decompress(value).decode()


def _signed_rows(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, th, n, group, set, attr, prefix) of every row, stored."""

    def count(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(COUNTS, np.int64)
        held, n = [], 0
        for t in [*b.column(0).to_pylist(), None]:
            held.append(shingles(t, size) & np.uint64(COUNTS - 1))
            n += len(held[-1])
            if n > 1 << 20 or t is None:
                out += np.bincount(np.concatenate(held).astype(np.int64), minlength=COUNTS)
                held, n = [], 0
        return out

    counts = rows.sparkSession.sparkContext.broadcast(count_vector(rows.select("text"), count, COUNTS))
    arrow = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("group", pa.int64()), ("set", pa.int64()), ("prefix", pa.binary()), ("attr", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if not b.num_rows:
                continue
            sets = [shingles(t, size) for t in b.column(2).to_pylist()]
            firsts = [prefix(s, counts.value, percent) for s in sets]
            names = [(len(s), _name(p, len(s)), _name(s, len(s)), p.tobytes()) for s, p in zip(sets, firsts, strict=True)]
            attr = [x.tobytes() for x in described(sets)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, f.type) for c, f in zip([*zip(*names, strict=True), attr], list(arrow)[2:], strict=True))], schema=arrow)

    return stored(rows.select("doc_id", "th", "text").mapInArrow(sign, "doc_id long, th long, n long, group long, set long, prefix binary, attr binary"), "signatures")


def _candidates(signs: DataFrame, classes: DataFrame) -> DataFrame:
    """What `linked` takes, of classes: the shared prefix shingles of each class's group, and the class to check it with."""

    def take(b: pa.RecordBatch) -> np.ndarray:
        keys, counts = flat(b.column(1), np.uint64)
        out = np.empty(len(keys), [("key", "<u8"), ("id", "<i8")])
        out["key"], out["id"] = keys, np.repeat(b.column(0).to_numpy(), counts)
        return out

    groups = stored(shared_keys(signs.where("n > 0 AND doc_id IS NOT NULL").select("group", "prefix"), take), "groups")
    chief = classes.groupBy("group").agg(F.min("set").alias("chief"), F.count("*").alias("sets"))
    ahead = chief.select(F.col("group").alias("lead"), F.col("chief").alias("ahead"))
    led = groups.withColumnRenamed("id", "group").join(ahead, "lead", "left").drop("lead")
    named = classes.select("set", "group").join(chief, "group").join(led, "group", "left").where("keys IS NOT NULL OR sets > 1")

    # sets of one group share their whole prefix, of which only what other groups have too is in its keys
    def with_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [(k or b"") + (np.int64(g).tobytes() if n > 1 else b"") for k, g, n in zip(*(b.column(c).to_pylist() for c in ("keys", "group", "sets")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("set"), pa.array(keys, pa.binary()), b.column("lead"), pa.array([False] * b.num_rows)], names=["id", "keys", "lead", "wide"])

    lead = F.when(F.col("set") != F.col("chief"), F.col("chief")).otherwise(F.coalesce("ahead", "set"))
    return stored(named.select("set", "group", "keys", "sets", lead.alias("lead")).mapInArrow(with_group, "id long, keys binary, lead long, wide boolean"), "candidates", (groups,))


def _texts(rows: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, value) of each class among ids, stored: a text that has its set, packed."""
    wanted = stored(classes.join(ids.withColumnRenamed("id", "set"), "set", "left_semi").select(F.col("set").alias("id"), "source.doc_id", "source.th"), "wanted")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([packed(t) for t in b.column(2).to_pylist()], pa.binary())], names=["doc_id", "th", "value"])

    maybe = wanted_rows(rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "th", "text"), "doc_id", wanted.select("doc_id"))
    found = maybe.mapInArrow(pack, "doc_id long, th long, value binary").join(wanted, ["doc_id", "th"])
    return stored(found.groupBy("id").agg(F.min("value").alias("value")), "texts", (wanted,))


def _linked(rows: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, set) of every row, classes (set, n, source, doc_id, docs), and (id, component) of linked classes, all stored."""
    signs = _signed_rows(rows, size, percent)
    filled = signs.where("n > 0 AND doc_id IS NOT NULL")
    counted = filled.groupBy("set", "group", "n").agg(F.min(F.struct("doc_id", "th")).alias("source"), F.min("attr").alias("attr"), F.countDistinct("doc_id").alias("docs"))
    classes = stored(counted.withColumn("doc_id", F.col("source.doc_id")), "classes")
    found = _candidates(signs, classes)
    attrs = classes.select(F.col("set").alias("id"), "attr")
    signs = stored(signs.select("doc_id", "n", "set"), "sets", (signs,))
    groups = linked(found, attrs, ATTR, nearness(percent), lambda ids: _texts(rows, classes, ids), in_python(checker(size, percent)))
    return signs, stored(classes.drop("group", "attr"), "classes", (classes,)), groups


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, with links also n_links."""
    return _joined(docs, size, percent, links)[0]


def _joined(docs: DataFrame, size: int, percent: int, links: bool = False) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """What `join` returns, and the stored tables that it reads."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").alias("text"))
    signs, classes, groups = _linked(rows, size, percent)
    # sets of rows that share a doc_id hang together
    one = signs.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "set")
    split = one.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("_b")).where("a <> _b").select("doc_id", "a")
    same = stored(one.join(split, "doc_id").where("set <> a").select("a", F.col("set").alias("b")).distinct(), "same")
    whole = groups
    if not same.isEmpty():
        whole = components(same.unionByName(groups.select(F.col("component").alias("a"), F.col("id").alias("b"))))
    named = classes.select("set", "doc_id", "docs").join(whole.withColumnRenamed("id", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    label = named.join(least, "component").select("set", "least", "docs")
    out = signs.select("doc_id", "n", "set")
    if links:
        label = label.join(_links(_texts(rows, classes, groups.select("id")), classes, groups, size, percent), "set", "left").withColumn("n_links", F.col("docs") - 1 + F.coalesce("others", F.lit(0)))
    out = out.join(label, "set", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    columns = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")]
    return out.select(*columns, *([F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links")] if links else [])), (signs, classes, groups, same)


def _links(texts: DataFrame, classes: DataFrame, groups: DataFrame, size: int, percent: int) -> DataFrame:
    """(set, others): of each class with links, how many documents the classes linked with it have."""
    members = groups.join(classes.select(F.col("set").alias("id"), "n", "docs"), "id")
    sizes = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / SETS, F.sum("n") / SHINGLES)).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("i", F.expr("CAST(pmod(xxhash64(id), blocks) AS int)"))
    # a class of block i takes part in the pairs of blocks (i, j) for every j
    pairs = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).selectExpr("component", "least(i, j) AS x", "greatest(i, j) AS y", "i", "id", "docs")
    dealt = pairs.join(texts, "id").repartition("component", "x", "y").sortWithinPartitions("component", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in sliced(batches) for r in zip(*(b.column(c).to_pylist() for c in ("component", "x", "y", "i", "id", "docs", "value")), strict=True))
        ids, others = [], []
        for (_, x, y), group in groupby(rows, key=lambda r: r[:3]):
            part = list(group)
            sets = [shingles(unpacked(r[6]), size) for r in part]
            docs = np.array([r[5] for r in part], np.int64)
            ids += [r[4] for r in part]
            others += counted(sets, docs, np.array([r[3] for r in part]) if x != y else None, percent).tolist()
            if len(ids) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64())], names=["set", "others"])
                ids, others = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64())], names=["set", "others"])

    return dealt.mapInArrow(run, "set long, others long").groupBy("set").agg(F.sum("others").alias("others"))


def counted(sets: list[np.ndarray], docs: np.ndarray, side: np.ndarray | None, percent: int) -> np.ndarray:
    """The documents (docs: how many each set has) of the other sets that each set is linked with; where sets have a side, of
    those of the other side. Sets are compared by pieces, so that memory is bounded."""
    out = np.zeros(len(sets), np.int64)
    sizes = np.array([len(s) for s in sets])
    sides = [np.arange(len(sets))] if side is None else [np.flatnonzero(side == s) for s in np.unique(side)]
    pieces = [[rows[p] for p in _pieces(sizes[rows])] for rows in sides]
    if side is None:
        pairs = [(a, b) for i, a in enumerate(pieces[0]) for b in pieces[0][i:]]
    else:
        pairs = [(a, b) for a in pieces[0] for b in pieces[1]] if len(pieces) > 1 else []
    for a, b in pairs:
        if a is b:
            near = linked_sets([sets[i] for i in a], percent)
            np.fill_diagonal(near, False)
            out[a] += _sums(near, docs[a])
        else:
            near = linked_sets([sets[i] for i in (*a, *b)], percent, len(a))
            out[a] += _sums(near, docs[b])
            out[b] += _sums(near.T, docs[a])
    return out


def _pieces(sizes: np.ndarray) -> list[slice]:
    """Slices of sets, of PIECE sets and SOME shingles at most, one set at least."""
    ends, out, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SOME, "right"))
        out.append(slice(at, max(at + 1, min(end, at + PIECE))))
        at = out[-1].stop
    return out


def _sums(near: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return np.concatenate([near[rows] @ docs for rows in strips(len(near))])


def linked_sets(sets: list[np.ndarray], percent: int, split: int | None = None) -> np.ndarray:
    """[i, j]: whether the sets i and j reach the threshold; with split, i of the first `split` sets and j of the rest.
    Overlaps come from products of 0/1 matrices."""
    sizes = np.array([len(s) for s in sets])
    left, right = (slice(None), slice(None)) if split is None else (slice(split), slice(split, None))
    tall, broad = sizes[left], sizes[right]
    common = np.zeros((len(tall), len(broad)), np.float32)
    if len(sets) == 2:
        both = np.diag(sizes)
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        common[:] = both[left, right]
    else:
        _, row, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times > 1  # what one set has alone is in no overlap
        place = np.cumsum(several) - 1
        owner = np.repeat(np.arange(len(sets)), sizes)
        owner, at = owner[several[row]], place[row[several[row]]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        step = 1024
        for start in range(0, int(several.sum()), step):
            a, b = np.searchsorted(at, [start, start + step])
            part = np.zeros((len(sets), step), np.float32)
            part[owner[a:b], at[a:b] - start] = 1
            for rows in strips(len(tall)):
                common[rows] += part[left][rows] @ part[right].T
    near = np.empty(common.shape, bool)
    for rows in strips(len(tall)):
        both = common[rows].astype(np.int64)
        near[rows] = (both > 0) & (100 * both >= percent * (tall[rows, None] + broad[None, :] - both))
    return near


def strips(n: int, size: int = 512) -> list[slice]:
    """Slices of n rows: what is made of a large matrix is made of a strip at a time."""
    return [slice(at, at + size) for at in range(0, n, size)]


def kept(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that are first of their component, and all rows without an id; columns as they were."""
    out, tables = _joined(docs, size, percent)
    gone = stored(out.where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "copies", tables)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
