"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest query set, in values, that goes to every executor at once.
BROADCAST_VALUES = 4_000_000
#: Scores that a task holds at a time.
SCORES = 1 << 21


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def same_length(a: Column, b: Column, value: Column) -> Column:
    """value, and an error where two vectors differ in length; null where one is null."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.concat(F.lit("vectors of lengths "), F.size(a), F.lit(" and "), F.size(b))).cast("double")).otherwise(value)


def checked(vectors: DataFrame, dimension: int, column: str = "embedding", distance: str = "Cosine") -> DataFrame:
    """vectors as a collection of one dimension takes them: others, and unknown metrics, are errors."""
    if distance not in METRICS or dimension < 1:
        raise ValueError(f"no collection of {dimension} values by {distance}")
    wrong = F.raise_error(F.concat(F.lit(f"a collection of {dimension} values got "), F.size(column))).cast(vectors.schema[column].dataType)
    return vectors.withColumn(column, F.when(F.size(column) != dimension, wrong).otherwise(F.col(column)))


def dot(a: Column, b: Column) -> Column:
    return same_length(a, b, _dot(a, b))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def euclid(a: Column, b: Column) -> Column:
    return same_length(a, b, F.sqrt(F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))


def normalized(v: Column) -> Column:
    """v at length 1; a zero vector as it is."""
    return F.when(norm(v) == 0, _double(v)).otherwise(F.transform(_double(v), lambda x: x / norm(v)))


METRICS = {"Cosine": (cosine, False), "Dot": (dot, False), "Euclid": (euclid, True)}


def metric(name: str) -> tuple:
    """The score function and whether lower is better; unknown names mean cosine."""
    return METRICS.get(name, METRICS["Cosine"])


def _literal(query: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in query))


def passed(df: DataFrame, threshold: float | None, lower: bool) -> DataFrame:
    """Rows that pass a threshold; none, 0 and less let all pass. Above a top-k it keeps a prefix of the order, so the
    score isn't computed again below the sort."""
    if not threshold or threshold <= 0:
        return df
    return df.where(F.col("score") <= threshold if lower else F.col("score") >= threshold)


def ranked(df: DataFrame, key: str, lower: bool = False) -> DataFrame:
    """Rank from 1 of a page that is in hand (at most a page's rows meet in the window)."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").asc() if lower else F.col("score").desc(), key)).cast("long"))


def topk(vectors: DataFrame, query: Sequence[float] | Column, key: str, column: str = "embedding", distance: str = "Cosine", limit: int | None = None, offset: int = 0, threshold: float | None = None) -> DataFrame:
    """(key, score, rank): the limit best after the first offset, ranked from 1 on this page; ties by key.

    Each task keeps its best offset + limit rows; no limit, or 0, means 200.
    """
    fn, lower = metric(distance)
    score = fn(F.col(column), query if isinstance(query, Column) else _literal(query))
    order = [F.col("score").asc() if lower else F.col("score").desc(), F.col(key)]
    page = vectors.select(key, score.alias("score")).orderBy(*order).offset(offset).limit(limit or 200)
    return ranked(passed(page, threshold, lower), key, lower)


def stored_vector(vectors: DataFrame, key: str, value, column: str = "embedding") -> list[float] | None:
    """One row's vector, or None."""
    row = vectors.where(F.col(key) == value).select(column).first()
    return None if row is None or row[0] is None else list(row[0])


def similar(vectors: DataFrame, key: str, value, column: str = "embedding", exclude_self: bool = False, limit: int | None = None, **kw) -> DataFrame:
    """The neighbours of an indexed row, itself included unless told otherwise; empty if there is no such row."""
    query = stored_vector(vectors, key, value, column)
    if query is None:
        return vectors.where("false").select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
    rows = vectors.where(F.col(key) != value) if exclude_self else vectors
    return topk(rows, query, key, column, limit=limit, **kw)


def topk_many(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, column: str = "embedding", limit: int = 10, block: int | None = None) -> DataFrame:
    """(query_key, key, score, rank) by cosine for a stated set of queries, in blocks that executors can hold.

    Each task takes matrix products of its batches with the block and keeps `limit` rows a query, so the shuffle
    has tasks x queries x limit rows, whatever the number of vectors.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    rows, found, size = [], None, 0
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}

    def part(rows: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], _units(np.array([r[1] for r in rows], np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            worst = np.full(len(names), -np.inf)  # of the rows that a query keeps, once it has `limit`
            for b in batches:
                keys, m = b.column(0).to_pylist(), b.column(1)
                if not keys:
                    continue
                units = _units(np.array(m.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(keys), -1)).T
                step = max(1, SCORES // len(keys))
                for at in range(0, len(names), step):
                    scores = q[at : at + step] @ units
                    hit = (scores >= worst[at : at + step, None]).any(axis=1)
                    for i in np.flatnonzero(hit).tolist():
                        row = scores[i]
                        edge = max(worst[at + i], np.partition(row, len(row) - limit)[len(row) - limit] if len(row) > limit else -np.inf)
                        best[at + i] = sorted([*best[at + i], *((-row[j], keys[j]) for j in np.flatnonzero(row >= edge))])[:limit]
                        if len(best[at + i]) == limit:
                            worst[at + i] = -best[at + i][-1][0]
            out = [(n, k, -s) for n, rows in zip(names, best, strict=True) for s, k in rows]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out]) for i in range(3)], names=[query_key, key, "score"])

        return vectors.select(key, column).where(F.col(column).isNotNull()).mapInArrow(run, f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, score double")

    for row in queries.select(query_key, column).where(F.col(column).isNotNull()).toLocalIterator():
        rows.append(row)
        size += len(row[1])
        if size >= (block or BROADCAST_VALUES):
            found = part(rows) if found is None else found.unionByName(part(rows))
            rows, size = [], 0
    if rows or found is None:
        if not rows:
            return spark.createDataFrame([], f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, score double, rank long")
        found = part(rows) if found is None else found.unionByName(part(rows))
    order = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)


def _units(m):
    import numpy as np

    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)
