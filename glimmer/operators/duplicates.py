"""Near duplicates by Hamming distance, grouped by connectivity."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.sources.scratch import scratch_path

#: Bytes of hashes in a packed row, groups of packs that are compared with each other, entries of a comparison that are in memory at a time.
PACK, GRID, TILE = 8192, 24, 1 << 16
_HEX = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), "S2")
_NEAR = pa.schema([("x", pa.string()), ("y", pa.string()), ("distance", pa.int64())])


def _near_hashes(rows: DataFrame, key: str, phash: str, threshold: int, digits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, h) of rows with a hash, (h) different hashes, and (x, y, distance) of those x < y at most threshold bits apart.

    Of threshold + 1 bands of a hash, such a pair has one in common. Each task packs its hashes by band and value;
    packs of a value meet in a join, pack by pack, and are compared as whole arrays, so that a candidate pair
    costs an exclusive or and never is a row. A pair counts in the first band that it has in common. Packs are written
    before they meet: computed once for each side, they could hold other hashes under the same number. Where bands are so
    narrow that nearly all pairs meet, packs are dealt to groups instead, and each pair of groups is compared once, by one task.
    """
    # a value that optimizers don't copy into the filters, so that each hash is computed once
    once = rows.select(F.col(key).alias("id"), F.when(F.monotonically_increasing_id() >= 0, F.lower(phash)).alias("h"))
    clean = once.where((F.length("h") == digits) & F.col("h").rlike("^[0-9a-f]*$"))
    hashes = clean.select("h").distinct()
    bits, bands = 4 * digits, min(threshold + 1, 4 * digits)
    if bands >= 2 ** (bits // bands):
        return clean, hashes, _all_near(hashes, threshold, digits)
    edges, width = [bits * i // bands for i in range(bands + 1)], -(-digits // 16) * 8
    masks = np.zeros((bands, 8 * width), np.uint8)
    for k in range(bands):
        masks[k, edges[k] : edges[k + 1]] = 1
    masks = np.packbits(masks, axis=1).view(np.uint64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for raw in _gathered(batches, width):
            cut = np.unpackbits(raw, axis=1)
            for band in range(bands):
                values = np.packbits(cut[:, edges[band] : edges[band + 1]], axis=1)
                order = np.lexsort(values.T[::-1])
                values = values[order]
                begin = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]).any(axis=1)]))
                starts = _cut(begin, len(order), PACK // width)
                columns = [pa.array(np.full(len(starts), band, np.int32)), _binary(values[starts], np.arange(len(starts) + 1)), pa.array(number + np.arange(len(starts))), _binary(raw[order], np.append(starts, len(order)))]
                yield pa.RecordBatch.from_arrays(columns, names=["band", "value", "pack", "hs"])
                number += len(starts)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(p: np.ndarray, q: np.ndarray, band: np.ndarray) -> pa.RecordBatch:
            """Of pairs of rows of p and q, those that are near and have no earlier band in common."""
            x = p ^ q
            distance = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            ok = distance <= threshold
            x, p, q, band, distance = x[ok], p[ok], q[ok], band[ok], distance[ok]
            first = np.ones(len(x), bool)
            for k in range(bands):
                first &= (k >= band) | (x & masks[k]).any(axis=1)
            return _pairs(p[first], q[first], distance[first], digits)

        for b in batches:
            if not b.num_rows:
                continue
            band, one, two = (b.column(i).to_numpy() for i in (0, 1, 3))
            sides = [_words(b.column(i), width) for i in (2, 4)]
            (p, p_at), (q, q_at) = sides
            sizes = np.diff(p_at) * np.diff(q_at)
            at = 0
            while at < len(sizes):  # rows of about TILE pairs in all are compared at once; one row has no more than a pack's square
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at : at + TILE]), TILE, "right")))
                row = np.repeat(np.arange(at, end), sizes[at:end])
                inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes[at:end]) - sizes[at:end], sizes[at:end])
                i, j = inside // (q_at[row + 1] - q_at[row]), inside % (q_at[row + 1] - q_at[row])
                ok = (one[row] != two[row]) | (i < j)
                row, i, j = row[ok], i[ok], j[ok]
                yield near(p[p_at[row] + i], q[q_at[row] + j], band[row])
                at = end

    place = scratch_path(rows.sparkSession, "packs")
    hashes.mapInArrow(packed, "band int, value binary, pack long, hs binary").write.parquet(place)
    packs = rows.sparkSession.read.schema("band int, value binary, pack long, hs binary").parquet(place)
    left, right = (packs.select("band", "value", F.col("pack").alias(f"{n}_pack"), F.col("hs").alias(f"{n}_hs")) for n in ("x", "y"))
    met = left.join(right, ["band", "value"]).where("x_pack <= y_pack").where(f"x_pack < y_pack OR length(x_hs) > {width}")
    near = met.select("band", "x_pack", "x_hs", "y_pack", "y_hs").mapInArrow(compared, "x string, y string, distance long")
    return clean, hashes, near


def _all_near(hashes: DataFrame, threshold: int, digits: int) -> DataFrame:
    """(x, y, distance) of near hashes, by comparing all. Of each two groups of packs one is held and the other goes by."""
    width = -(-digits // 16) * 8

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for raw in _gathered(batches, width):
            starts = _cut(np.zeros(1, np.int64), len(raw), PACK // width)
            yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(len(starts))), _binary(raw, np.append(starts, len(raw)))], names=["pack", "hs"])
            number += len(starts)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            low, high, group = (b.column(i).to_numpy() for i in range(3))
            hs, at = _words(b.column(3), width)
            for r in range(len(low)):
                if (low[r], high[r]) != cell:
                    cell, held = (low[r], high[r]), []
                q = hs[at[r] : at[r + 1]]
                if group[r] == low[r]:
                    held.append(q.copy())
                if group[r] == high[r]:
                    for n, p in enumerate(held):
                        same = low[r] == high[r] and n == len(held) - 1
                        for found in _tiles(p, q, threshold, same):
                            yield _pairs(*found, digits)

    n = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packs = hashes.mapInArrow(packed, "pack long, hs binary").select("hs", F.pmod(F.xxhash64("pack"), F.lit(GRID)).cast("int").alias("g"))
    cells = packs.select("hs", "g", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("o")).select(F.least("g", "o").alias("low"), F.greatest("g", "o").alias("high"), "g", "hs")
    return cells.repartition(n, "low", "high").sortWithinPartitions("low", "high", "g").mapInArrow(compared, "x string, y string, distance long")


def _tiles(p: np.ndarray, q: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The near pairs of rows of p and rows of q, with their distances; same: p is q, each pair once."""
    step, kind = max(1, TILE // len(q)), np.uint8 if p.shape[1] < 4 else np.uint16
    for at in range(0, len(p), step):
        part = p[at : at + step]
        distance = np.bitwise_count(part[:, :1] ^ q[:, 0]).astype(kind, copy=False)
        for w in range(1, p.shape[1]):
            distance += np.bitwise_count(part[:, w, None] ^ q[:, w])
        flat = np.flatnonzero(distance <= threshold)
        i, j = flat // len(q), flat % len(q)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if len(i):
            yield part[i], q[j], distance[i, j].astype(np.int64)


def _pairs(p: np.ndarray, q: np.ndarray, distance: np.ndarray, digits: int) -> pa.RecordBatch:
    names = []
    for side in (p, q):
        text = _HEX[np.ascontiguousarray(side).view(np.uint8)].view(f"S{16 * side.shape[1]}").ravel() if len(side) else np.empty(0, f"S{16 * side.shape[1]}")
        names.append(text.astype(f"S{digits}"))
    low = names[0] < names[1]
    columns = [np.where(low, *names), np.where(low, *names[::-1])]
    return pa.RecordBatch.from_arrays([*(pa.array(c.astype(f"U{digits}"), pa.string()) for c in columns), pa.array(distance, pa.int64())], schema=_NEAR)


def _words(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all packs of a column as rows of 64-bit words, and where each pack's begin, and the end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(-1, width // 8), (ends - ends[0]) // width


def _binary(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of rows of bytes as binary values; starts of runs, and the end."""
    offsets = (starts * rows.shape[1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _cut(begin: np.ndarray, n: int, most: int) -> np.ndarray:
    """Starts of runs of at most `most` rows, of runs that begin at `begin` and end at n."""
    parts = -(-np.diff(np.append(begin, n)) // most)
    return np.repeat(begin, parts) + most * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))


def _gathered(batches: Iterator[pa.RecordBatch], width: int, size: int = 50_000) -> Iterator[np.ndarray]:
    """Hashes of the first column as rows of bytes, from the first bit on, filled up to whole words; about size at a time."""
    held: list[str] = []

    def taken() -> np.ndarray:
        return np.frombuffer(b"".join(bytes.fromhex(h.ljust(2 * width, "0")) for h in held), np.uint8).reshape(-1, width)

    for b in batches:
        held += b.column(0).to_pylist()
        if len(held) >= size:
            yield taken()
            held = []
    if held:
        yield taken()


def similar_pairs(rows: DataFrame, key: str, phash: str, threshold: int = 10, digits: int = 64) -> DataFrame:
    """(a, b, distance) of all pairs a < b at most threshold bits apart, equal hashes among them."""
    clean, hashes, near = _near_hashes(rows, key, phash, threshold, digits)
    equal = hashes.select(F.col("h").alias("x"), F.col("h").alias("y"), F.lit(0).cast("long").alias("distance"))
    members = clean.withColumnRenamed("h", "x").withColumnRenamed("id", "p")
    other = clean.withColumnRenamed("h", "y").withColumnRenamed("id", "q")
    pairs = near.unionByName(equal).join(members, "x").join(other, "y").where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


def near_groups(rows: DataFrame, key: str, phash: str, threshold: int = 10, digits: int = 64) -> DataFrame:
    """(id, component) of all ids with a similar one. Copies are linked to the smallest id of their hash, and hashes by
    those ids, so the pairs of copies are never made."""
    clean, _, near = _near_hashes(rows, key, phash, threshold, digits)
    chief = clean.groupBy("h").agg(F.min("id").alias("chief"))
    copies = clean.join(chief, "h").where("id <> chief").select(F.col("chief").alias("a"), F.col("id").alias("b"))
    x, y = (chief.select(F.col("h").alias(n), F.col("chief").alias(m)) for n, m in (("x", "a"), ("y", "b")))
    return connected(near.join(x, "x").join(y, "y").select("a", "b").unionByName(copies))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges that this task gets, by union-find."""
    above: dict = {}

    def top(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = top(u), top(v)
            above[max(u, v)] = min(u, v)
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(list(above), kind), pa.array([top(x) for x in list(above)], kind)], names=["id", "component"])


def connected(edges: DataFrame, rounds: int = 60, small: int = 100_000) -> DataFrame:
    """(id, component) of all ids in edges (a, b); a component is named by its smallest id.

    At most `small` edges, a few MB, go to one task. Beyond that labels fall to the smallest neighbour's and then to that one's own label, until none changes; every round is
    checkpointed to the shared folder.
    """
    spark = edges.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix=f"glimmer-{uuid.uuid4().hex}"))
    once = edges.select("a", "b").where("a <> b").distinct().checkpoint()
    if once.count() <= small:
        kind = once.schema["a"].dataType.simpleString()
        return once.coalesce(1).mapInArrow(_united, f"id {kind}, component {kind}")
    edges = once
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("component")).checkpoint()
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("n"))
        lower = labels.join(seen.withColumnRenamed("a", "id"), "id").select("id", F.col("component").alias("old"), F.least("component", "n").alias("c"))
        jump = lower.join(labels.select(F.col("id").alias("c"), F.col("component").alias("top")), "c", "left")
        stepped = jump.select("id", "old", F.least("c", F.coalesce("top", "c")).alias("component")).checkpoint()
        labels = stepped.select("id", "component")
        if stepped.where("old <> component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def members(labels: DataFrame) -> DataFrame:
    """(component, ids): sorted members of each group of several."""
    return labels.groupBy("component").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def groups(pairs: DataFrame) -> DataFrame:
    """(component, ids) of pairs (a, b): sorted members of each connected group."""
    return connected(pairs).groupBy("component").agg(F.array_sort(F.collect_set("id")).alias("ids"))
