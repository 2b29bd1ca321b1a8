"""Incremental ingest: which files to process, and what became of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import hashes, paths
from glimmer.options import JPEG_SUFFIXES, RAW_SUFFIXES


def scanned(files: DataFrame, root: str = "", portable_ids: bool = False) -> DataFrame:
    """(path, relative_path, size, mtime, photo_id, extension) of supported, visible files of (path, size, mtime)."""
    below = paths.relative(F.col("path"), root) if root else F.col("path")
    make = hashes.photo_id_portable if portable_ids else hashes.photo_id
    rows = files.select("path", below.alias("relative_path"), "size", "mtime").where("relative_path IS NOT NULL")
    rows = rows.where(paths.is_supported(F.col("relative_path")) & ~paths.is_hidden(F.col("relative_path")))
    return rows.withColumn("photo_id", make(F.col("relative_path"), F.col("size"), F.col("mtime"))).withColumn("extension", F.lower(paths.suffix(F.col("relative_path"))))


def _raw_stems(files: DataFrame, path: str) -> DataFrame:
    """Folder and stem of raw files whose suffix is all lower or all upper case, as probes for either find them."""
    written = paths.suffix(F.col(path))
    names = [*RAW_SUFFIXES, *(s.upper() for s in RAW_SUFFIXES)]
    return files.where(written.isin(*names)).select(paths.folder(F.col(path)).alias("_dir"), paths.stem(F.col(path)).alias("_stem")).distinct()


def _shadowed(files: DataFrame, path: str, how: str, raw: DataFrame | None) -> DataFrame:
    side = _raw_stems(files if raw is None else raw, path)
    keyed = files.withColumn("_dir", paths.folder(F.col(path))).withColumn("_stem", F.when(F.lower(paths.suffix(F.col(path))).isin(*JPEG_SUFFIXES), paths.stem(F.col(path))))
    return keyed.join(side, ["_dir", "_stem"], how).drop("_dir", "_stem").select(*files.columns)


def without_shadowed(files: DataFrame, path: str = "relative_path", skip: bool = True, raw: DataFrame | None = None) -> DataFrame:
    """files without images that have a raw file of the same folder and stem (in `raw`, by default in files)."""
    return _shadowed(files, path, "left_anti", raw) if skip else files


def shadowed(files: DataFrame, path: str = "relative_path", raw: DataFrame | None = None) -> DataFrame:
    """The images that have one: what a purge deletes."""
    return _shadowed(files, path, "left_semi", raw)


def purged(photos: DataFrame, texts: DataFrame, vectors: DataFrame, path: str = "path", key: str = "photo_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The three tables without images that have a raw file, and a row of how many rows go from each."""
    gone = shadowed(photos, path).select(key).distinct()
    kept = [t.join(gone, key, "left_anti") for t in (photos, texts, vectors)]
    counts = [t.join(gone, key, "left_semi").agg(F.count("*").alias(name)) for t, name in ((photos, "photos"), (texts, "texts"), (vectors, "vectors"))]
    return *kept, counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # a row each


def pending(files: DataFrame, *done: DataFrame, path: str = "relative_path") -> DataFrame:
    """files whose path is in none of the tables of paths."""
    skip = None
    for d in done:
        skip = d.select(path) if skip is None else skip.union(d.select(path))
    return files if skip is None else files.join(skip.distinct(), path, "left_anti")


def changed(files: DataFrame, photos: DataFrame, path: str = "relative_path", key: str = "photo_id") -> DataFrame:
    """files that are new or whose id differs from the stored one."""
    return files.join(photos.select(path, key).distinct(), [path, key], "left_anti")


def superseded(processed: DataFrame, photos: DataFrame, path: str = "relative_path", key: str = "photo_id") -> DataFrame:
    """Stored ids of processed paths that now have another id: they are to be deleted."""
    new = processed.select(path, F.col(key).alias("_new"))
    return photos.select(path, key).join(new, path).where(F.col(key) != F.col("_new")).select(key).distinct()


def missing(photos: DataFrame, files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Stored rows whose file is gone."""
    return photos.join(files.select(path).distinct(), path, "left_anti")


def outcomes(processed: DataFrame) -> DataFrame:
    """Counts of processed, skipped (no vector, no error) and failed rows."""
    failed, embedded = F.col("error").isNotNull(), F.col("embedding").isNotNull()
    return processed.agg(
        F.count("*").alias("scanned"), F.count_if(~failed & embedded).alias("processed"), F.count_if(~failed & ~embedded).alias("skipped"), F.count_if(failed).alias("errors")
    )


def dead_letters(processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that went well, and failures; failures stay pending."""
    return processed.where("error IS NULL"), processed.where("error IS NOT NULL")


def progress(done: DataFrame, total: int) -> DataFrame:
    """Count, total and percentage of a checkpoint of paths."""
    n = F.count("*")
    return done.agg(n.alias("processed_count"), F.lit(total).cast("long").alias("total_count"), F.floor(100 * n / F.lit(max(total, 1))).cast("long").alias("percent"))
