"""Lookups and counts over the photos table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def by_key(photos: DataFrame, value, key: str = "photo_id") -> DataFrame:
    return photos.where(F.col(key) == value)


def by_path(photos: DataFrame, path: str, column: str = "path", key: str = "photo_id") -> DataFrame:
    """One row of a path, the one with the smallest key."""
    return photos.where(F.col(column) == path).orderBy(key).limit(1)


def uncaptioned(photos: DataFrame, key: str = "photo_id", limit: int | None = None) -> DataFrame:
    """Keys without a caption; an empty one is none."""
    rows = photos.where(F.nullif(F.col("caption"), F.lit("")).isNull()).select(key)
    return rows.orderBy(key).limit(limit) if limit else rows


def paths_to_ids(photos: DataFrame, path: str = "path", key: str = "photo_id") -> DataFrame:
    """(path, key): the greatest key of each path."""
    return photos.groupBy(path).agg(F.max(key).alias(key))


def counts(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count("*").alias("photos"), F.count(F.nullif(F.col("caption"), F.lit(""))).alias("captioned"))


def index_stats(photos: DataFrame, vectors: DataFrame, thumbnails: DataFrame) -> DataFrame:
    """One row of all tables' counts; thumbnails have (size)."""
    one = counts(photos).crossJoin(vectors.agg(F.count("*").alias("vectors")))
    return one.crossJoin(thumbnails.agg(F.count("*").alias("thumbnails"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("thumbnail_bytes")))


def exact_hash(photos: DataFrame, phash: str) -> DataFrame:
    return photos.where(F.col("phash") == phash)


def config_value(config: DataFrame, key: str, default: str | None = None) -> str | None:
    row = config.where(F.col("key") == key).select("value").first()
    return default if row is None or row[0] is None else row[0]


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The `size` rows that follow the key `after` (None: from the first), in the order of unique keys."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def paged(df: DataFrame, key: str, size: int = 1000):
    """All rows in pages by key, each a list. One sort for all pages; partitions of its ranges come one after the other."""
    page = []
    for row in df.orderBy(key).toLocalIterator(prefetchPartitions=True):
        page.append(row)
        if len(page) == size:
            yield page
            page = []
    if page:
        yield page


def ordered_copy(df: DataFrame, path: str, key: str) -> str:
    """df in order of unique keys, to be read by pages: each file has a range of keys, so a page's filter skips the others."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return path


def pages_of_copy(spark: SparkSession, path: str, key: str, size: int = 1000, after=None):
    """Pages of an ordered_copy from the key `after` on, which is a cursor that any later run can go on from. A page reads
    the files whose range of keys meets it; ranges are read once, from the files' own statistics of the key."""
    copy = spark.read.parquet(path)
    bounds = copy.groupBy(F.input_file_name().alias("f")).agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count("*").alias("n")).orderBy("a").collect()  # a row a file
    waiting = [r for r in bounds if after is None or r.b > after]
    page = []
    for r in waiting:
        rows = spark.read.schema(copy.schema).parquet(r.f)
        for row in (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).toLocalIterator():
            page.append(row)
            if len(page) == size:
                yield page
                page = []
    if page:
        yield page
