"""Helpers that the corpus operators share: shared scratch tables, Arrow maps, word hashes, components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U64 = np.uint64
#: Where stored tables lie.
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs in one process (tests)."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if configured is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="glimmer-checkpoints-"))
    return configured or str(sc._jsc.sc().getCheckpointDir().get())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/glimmer-{uuid.uuid4().hex}/{name}"
    atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    try:
        parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by now; the folder is scratch
        pass


def stored(df: DataFrame, name: str, instead: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df written as a table to the shared folder and read again: cuts lineage and survives lost executors.

    Shuffle files that it was made of are let go now, not whenever the driver happens to collect its garbage. The stored
    tables `instead` are deleted: nothing may read them any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    discard(*instead)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables, which nothing may read any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            _removed(df.sparkSession, path)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Memo(dict):
    """A bounded cache of make(key). It is emptied when full, so memory stays bounded and results don't change."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value


def wanted_rows(df: DataFrame, key: str, keys: DataFrame, slots: int = 1 << 21) -> DataFrame:
    """The rows of df whose long `key` may be among keys (one column of that name), and some more.

    A table of at most slots / 64 words, whose bits are taken by key hashes, is sent to the tasks, so that rows that can't be
    wanted need no shuffle; where it is full it lets all rows through, and a join decides after it in either case.
    """
    slot = F.xxhash64(key).bitwiseAND(F.lit(slots - 1).cast("long"))
    word, bits = "_word", "_bits"
    while word in df.columns or bits in df.columns:
        word, bits = f"_{word}", f"_{bits}"
    taken = keys.select(slot.alias(word)).selectExpr(f"{word} DIV 64 AS {word}", f"shiftleft(1L, CAST({word} % 64 AS int)) AS {bits}")
    taken = taken.groupBy(word).agg(F.bit_or(bits).alias(bits))
    there = F.getbit(bits, slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
    return df.withColumn(word, F.shiftright(slot, 6)).join(F.broadcast(taken), word).where(there).select(*df.columns)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive 64-bit hashes of all windows of `size` consecutive word hashes; empty if there are fewer."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, _U64)
    out = np.zeros(n, _U64)
    for k in range(size):
        out *= _U64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
    return mixed(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges (u, v) that this task gets, by union-find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((root(u), root(v)))
            parent[high] = low
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "component"])


def components(edges: DataFrame, rounds: int = 60, small: int = 200_000) -> DataFrame:
    """(id, component): connected components of edges (a, b), named by their smallest id. Only ids with an edge appear.

    Alternates large-star and small-star steps; each step is a shuffle of the edges, written to the shared folder,
    until a step leaves the edges as they were. A hub's edges are never gathered: minima are pre-aggregated
    and joined back. At most `small` edges, a few MB, go to one task instead; the result is the same.
    """
    both = edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct()
    current = stored(both, "edges")
    if current.count() <= small:
        return current.coalesce(1).mapInArrow(_united, "id long, component long")
    before = None
    for _ in range(rounds):
        sym = current.unionByName(current.selectExpr("v AS u", "u AS v"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # a node keeps an edge to its smallest neighbour and gives that one to its other neighbours
        small = large.join(least, "u").selectExpr("IF(v = m, u, v) AS u", "m AS v").where("u <> v").distinct()
        current = stored(small, "edges", (current,))
        sums = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(sums):
            break
        before = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    labels = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = current.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return labels.unionByName(roots)


def count_vector(df: DataFrame, fn: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of fn(batch), an integer vector of fixed size, over all of df.

    Every task sums its batches and sends a row for each slice; slices are added in two levels, so that a group
    stays small however many tasks there are. What reaches the driver has the vector's size.
    """
    step = 1024

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in sliced(batches):
            total += fn(b)
        at = [k for k in range(0, size, step) if total[k : k + step].any()]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([total[k : k + step].tobytes() for k in at], pa.binary())], names=["at", "counts"])

    def add(group):
        return group.iloc[:1].assign(counts=[np.sum([np.frombuffer(x, np.int64) for x in group["counts"]], axis=0).tobytes()])

    slices = df.mapInArrow(partial, "at long, counts binary").withColumn("lane", F.spark_partition_id() % 256)
    lanes = slices.groupBy("at", "lane").applyInPandas(add, "at long, counts binary, lane int").drop("lane")
    total = np.zeros(size, np.int64)
    for row in lanes.groupBy("at").applyInPandas(add, "at long, counts binary").collect():
        total[row.at : row.at + step] = np.frombuffer(row.counts, np.int64)
    return total
