"""Row types of the library's tables and results."""

from __future__ import annotations

from pyspark.sql import types as T

PHOTOS = T.StructType(
    [
        T.StructField("photo_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("caption", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("phash", T.StringType()),
        T.StructField("embedded_at", T.DoubleType()),
        T.StructField("captioned_at", T.DoubleType()),
    ]
)
FTS = T.StructType([T.StructField("photo_id", T.StringType()), T.StructField("text", T.StringType())])
VECTORS = T.StructType([T.StructField("photo_id", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType()))])
CONFIG = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType())])
SCANNED = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("photo_id", T.StringType()),
        T.StructField("extension", T.StringType()),
    ]
)
PROCESSED = T.StructType(
    [
        T.StructField("photo_id", T.StringType()),
        T.StructField("relative_path", T.StringType()),
        T.StructField("mtime", T.DoubleType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("phash", T.StringType()),
        T.StructField("thumbnail_path", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
RANKED = T.StructType([T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType())])
#: Columns that an upsert overwrites, and those where a null keeps the old value.
OVERWRITTEN, MERGED = ("path", "mtime"), ("caption", "tags", "phash", "embedded_at", "captioned_at")
