"""Image files as rows: pixels, sizes, perceptual hashes and thumbnails.

A codec is a pair of functions, bytes to upright RGB pixels (or None) and pixels to bytes; the default one decodes with
what is installed. Files are read by Spark's binaryFile source and decoded where they are read, batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions import images, paths
from glimmer.options import RAW_SUFFIXES

Decode = Callable[[bytes], "np.ndarray | None"]
#: Long sides of what is embedded and of what is shown.
EMBEDDING_SIDE, THUMBNAIL_SIDE = 512, 300


def resized(pixels: np.ndarray, target: int) -> np.ndarray:
    """Pixels whose long side is at most target, each the mean of the area that it stands for."""
    height, width = pixels.shape[:2]
    if max(height, width) <= target:
        return pixels
    w, h = (max(1, x) for x in images.fitted_size(width, height, target))
    rows, columns = images.area_weights(height, h), images.area_weights(width, w)
    return np.clip(np.rint(np.einsum("hy,yxc,wx->hwc", rows, pixels.astype(float), columns, optimize=True)), 0, 255).astype(np.uint8)


def _pixels(path: str, data: bytes, decode: Decode | None) -> np.ndarray | None:
    if decode is not None:
        return decode(data)
    raw = path.lower().endswith(tuple(RAW_SUFFIXES))
    return images.ppm_decoded(data) if data[:2] == b"P6" else images.decoded(data, raw=raw)


def described(contents: DataFrame, decode: Decode | None = None, side: int = EMBEDDING_SIDE) -> DataFrame:
    """(path, width, height, orientation, phash, pixels, error) of rows (path, content): upright size and hash of the
    whole image, and pixels with a long side of at most `side`, as bytes of rows of RGB with their own width and height."""
    arrow = pa.schema([("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.int32()), ("phash", pa.string()), ("small_width", pa.int32()), ("small_height", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                rows = []
                for path, data in zip(*(b.slice(at, 16).column(i).to_pylist() for i in (0, 1)), strict=True):
                    p = None if data is None else _pixels(path or "", data, decode)
                    if p is None or not p.size:
                        rows.append({"path": path, "error": "no pixels"})
                        continue
                    small = resized(p, side)
                    rows.append({"path": path, "width": p.shape[1], "height": p.shape[0], "orientation": images.exif_orientation(data), "phash": images.phash(p), "small_width": small.shape[1], "small_height": small.shape[0], "pixels": np.ascontiguousarray(small).tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return contents.select("path", "content").mapInArrow(run, "path string, width int, height int, orientation int, phash string, small_width int, small_height int, pixels binary, error string")


def thumbnails(contents: DataFrame, folder: str, key: str = "photo_id", decode: Decode | None = None, encode: Callable[[np.ndarray], bytes] | None = None, side: int = THUMBNAIL_SIDE) -> DataFrame:
    """Write a thumbnail for each row (key, path, content) to folder, which executors share; (key, thumbnail_path, size, error).

    A file is written under a name of its own and renamed, so a task may be run again. The rows are lazy: an action on
    the result writes. A thumbnail that is there already is left alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import re
        import uuid

        from pyarrow import fs

        uri = re.sub("^file:/+", "/", folder)
        store, base = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        pack = encode or images.webp_encoded
        for b in batches:
            rows = []
            for k, path, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                target = f"{base}/{k}.webp"
                if (info := store.get_file_info(target)).type == fs.FileType.File:
                    rows.append({"k": k, "thumbnail_path": target, "size": info.size})
                    continue
                p = None if data is None else _pixels(path or "", data, decode)
                out = None if p is None or not p.size else pack(resized(p, side))
                if out is None:
                    rows.append({"k": k, "error": "no pixels"})
                    continue
                part = f"{base}/_{os.path.basename(str(k))}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write(out)
                store.move(part, target)
                rows.append({"k": k, "thumbnail_path": target, "size": len(out)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("k", pa.string()), ("thumbnail_path", pa.string()), ("size", pa.int64()), ("error", pa.string())]))

    rows = contents.select(F.col(key).cast("string").alias("k"), "path", "content")
    return rows.mapInArrow(run, "k string, thumbnail_path string, size long, error string").withColumnRenamed("k", key)


def missing_thumbnails(photos: DataFrame, cached: DataFrame, key: str = "photo_id") -> DataFrame:
    """Photos without a cached thumbnail, and where theirs is to go: what get-or-generate has to make."""
    return photos.join(cached.select(key).distinct(), key, "left_anti").withColumn("thumbnail", paths.thumbnail(F.col(key).cast("string")))
