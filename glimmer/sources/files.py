"""Files as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.functions import paths
from glimmer.sources.scratch import scratch_path

#: Folders that one task lists before it hands out what is left.
WALK = 1000
_ENTRY = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("is_folder", pa.bool_())])


def _walked(folders: list[str]) -> Iterator[tuple[str, int, float, bool]]:
    """Files below the folders, and the folders that are left after WALK of them. Hidden ones aren't entered."""
    from pyarrow import fs

    waiting, n = list(folders), 0
    while waiting:
        if n >= WALK:
            yield from ((f, 0, 0.0, True) for f in waiting)
            return
        folder, n = waiting.pop(), n + 1
        scheme, sep, _ = folder.partition("://")
        system, place = fs.FileSystem.from_uri(folder) if sep else (fs.LocalFileSystem(), folder)
        for entry in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            path = f"{scheme}://{entry.path}" if sep and scheme != "file" else entry.path
            if entry.base_name.startswith("."):
                continue
            if entry.type == fs.FileType.Directory:
                if not os.path.islink(entry.path):  # a link to a folder above would never end
                    waiting.append(path)
            elif entry.type == fs.FileType.File:
                seconds, rest = divmod(entry.mtime_ns or 0, 10**9)
                yield path, entry.size, seconds + 1e-9 * rest, False


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all visible files below root, which all executors must reach; names may begin with anything
    but a dot. Tasks walk folders and hand out what one of them alone would take long for; each round is written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in _walked(b.column(0).to_pylist()):
                held.append(row)
                if len(held) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ENTRY, strict=True)], schema=_ENTRY)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ENTRY, strict=True)], schema=_ENTRY)

    schema, place, rounds = "path string, size long, mtime double, is_folder boolean", scratch_path(spark, "listing"), []
    frontier = spark.createDataFrame([(root if root == "/" else root.rstrip("/"),)], "path string")
    while True:
        frontier.mapInArrow(run, schema).write.parquet(f"{place}/{len(rounds)}")
        rounds.append(f"{place}/{len(rounds)}")
        left = spark.read.schema(schema).parquet(rounds[-1]).where("is_folder").select("path")
        if left.isEmpty():
            return spark.read.schema(schema).parquet(*rounds).where("NOT is_folder").drop("is_folder")
        frontier = left.repartition(4 * spark.sparkContext.defaultParallelism)


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all visible files below root; a file is read by one task."""
    return _read(listed(spark, root).select("path"))


def _read(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with system.open_input_stream(place) as f:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])

    return files.mapInArrow(run, "path string, content binary")


def single(spark: SparkSession, file: str, root: str, skip_shadowed: bool = True) -> DataFrame:
    """The scan of one file; empty if it is unsupported, hidden, shadowed or outside root. Its folder alone is listed."""
    from glimmer.operators import ingest

    folder = file.rsplit("/", 1)[0]
    every = ingest.scanned(_siblings(spark, folder), root)
    return ingest.without_shadowed(every, skip=skip_shadowed).where(F.col("path") == file)


def _siblings(spark: SparkSession, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for place in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
                found = [e for e in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if e.type == fs.FileType.File]
                names = [f"{place.rstrip('/')}/{e.base_name}" for e in found]
                times = [e.mtime_ns // 10**9 + 1e-9 * (e.mtime_ns % 10**9) for e in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([e.size for e in found], pa.int64()), pa.array(times, pa.float64())], names=["path", "size", "mtime"])

    return spark.createDataFrame([(folder,)], "path string").mapInArrow(run, "path string, size long, mtime double")


def thumbnails(spark: SparkSession, root: str) -> DataFrame:
    """(photo_id, size) of cached thumbnails."""
    return listed(spark, root).where(F.col("path").endswith(".webp")).select(F.regexp_replace(paths.name(F.col("path")), r"\.webp$", "").alias("photo_id"), "size")
