"""Path functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glimmer.options import JPEG_SUFFIXES, RAW_SUFFIXES


def absolute(relative: Column, root: str) -> Column:
    """root without trailing separators, then the path; all separators backslashes where root has one."""
    base = root.rstrip("/\\")
    joined = F.concat(F.lit(base + "/"), relative)
    return F.translate(joined, "/", "\\") if "\\" in base else joined


def relative(path: Column, root: str) -> Column:
    """The path below root with forward slashes; null where it doesn't start with root, in any case."""
    base = root.replace("\\", "/").rstrip("/") + "/"
    slashed = F.translate(path, "\\", "/")
    inside = F.lower(F.substring(slashed, 1, len(base))) == F.lit(base.lower())
    return F.when(inside, F.substring(slashed, len(base) + 1, 1 << 30))


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """From the name's last dot on, as written; empty for names without one or whose only dot comes first or last."""
    return F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"^(.+)\.[^.]+$", "$1")


def is_raw(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*RAW_SUFFIXES)


def is_jpeg(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*JPEG_SUFFIXES)


def is_supported(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*JPEG_SUFFIXES, *RAW_SUFFIXES)


def is_hidden(path: Column) -> Column:
    """Whether a folder's or the file's name starts with a dot."""
    return path.rlike(r"(^|/)\.")


def thumbnail(photo_id: Column) -> Column:
    return F.concat(photo_id, F.lit(".webp"))


def fitted(width: Column, height: Column, target: int = 512) -> Column:
    """(width, height) with the long side at target; smaller images stay; the short side is cut to an integer."""
    fits = F.greatest(width, height) <= target
    wide = width >= height
    w = F.when(fits, width).when(wide, F.lit(target)).otherwise(F.floor(width * target / height))
    h = F.when(fits, height).when(wide, F.floor(height * target / width)).otherwise(F.lit(target))
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))


def duration(seconds: Column) -> Column:
    """Seconds, minutes and seconds, or hours and minutes."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    return (
        F.when(seconds < 60, F.format_string("%ds", whole))
        .when(seconds < 3600, F.format_string("%dm %ds", minutes, whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(seconds / 3600).cast("long"), minutes % 60))
    )
