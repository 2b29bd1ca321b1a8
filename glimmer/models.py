"""Batch model inference in Arrow batches, with whatever model is plugged in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Embed = Callable[[Sequence], np.ndarray]
#: Rows whose items and vectors are Python objects at a time.
ROWS = 512
#: A loader runs once in each Python worker and gives the model.
_loaded: dict[str, object] = {}


def model(name: str, load: Callable[[], object]) -> object:
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def unload(name: str) -> None:
    _loaded.pop(name, None)


def unit(vectors: np.ndarray) -> np.ndarray:
    """float32 rows of length 1; zero rows stay."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors, dtype=np.float64), where=length > 0).astype(np.float32)


def hashing_embedder(dimension: int = 64) -> Embed:
    """A deterministic stand-in for a model: signed feature hashing of tokens (of bytes in fours, for bytes)."""

    def embed(items: Sequence) -> np.ndarray:
        out = np.zeros((len(items), dimension))
        for row, item in zip(out, items, strict=True):
            parts = item.lower().encode().split() if isinstance(item, str) else [bytes(item[i : i + 4]) for i in range(0, len(item or b""), 4)]
            for p in parts:
                h = int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little")
                row[h % dimension] += 1 if h >> 63 else -1
        return out

    return embed


def in_batches(items: Sequence, embed: Embed, size: int = 128, least: int = 32, most: int = 256, grow: int = 4) -> tuple[list[np.ndarray | None], int]:
    """A vector or None for each item, and the batch size to go on with. Out of memory, a batch is halved down to
    `least`, then taken one by one; what still fails is None. Each success lets the next batch grow."""
    out: list[np.ndarray | None] = []
    at = 0
    while at < len(items):
        tries = sorted({size, max(least, size // 2), least, 1}, reverse=True)
        for n in (x for x in tries if x <= size or x == 1):
            part = items[at : at + n]
            try:
                out += list(unit(np.asarray(embed(part), np.float64)))
                size = min(most, n + grow) if n >= least else least
                at += len(part)
                break
            except MemoryError:
                continue
        else:
            out.append(None)
            at += 1
    return out, size


def embedded(rows: DataFrame, key: str, column: str, load: Callable[[], Embed], name: str = "embedder", batch: int = 128) -> DataFrame:
    """(key, embedding, error): a vector for each row, or what went wrong with it."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, size = model(name, load), batch
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            values = b.column(1).to_pylist()
            here = [i for i, v in enumerate(values) if v is not None]
            try:
                found, size = in_batches([values[i] for i in here], embed, size)
                error = "out of memory"
            except Exception as e:  # noqa: BLE001  a batch that fails otherwise is taken apart
                found, error = [], str(e)
                for i in here:
                    try:
                        found.append(unit(np.asarray(embed([values[i]]), np.float64))[0])
                    except Exception as x:  # noqa: BLE001  the row becomes a dead letter
                        found.append(None)
                        error = str(x)
            vectors: list = [None] * len(values)
            for i, v in zip(here, found, strict=True):
                vectors[i] = v
            errors = [None if v is not None else "nothing to embed" if values[i] is None else error for i, v in enumerate(vectors)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if v is None else v.tolist() for v in vectors], pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[key, "embedding", "error"])

    return rows.select(key, column).mapInArrow(run, f"{key} {kind}, embedding array<float>, error string")


def captioned(rows: DataFrame, key: str, column: str, load: Callable[[], Callable[[Sequence], list[tuple[str, str]]]], name: str = "captioner", batch: int = 8) -> DataFrame:
    """(key, caption, tags array): the model gives a short and a detailed text an item; a failed batch gives nulls,
    which count as uncaptioned and are tried again."""
    from pyspark.sql import functions as F

    from glimmer.functions.text import tags

    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describe = model(name, load)
        for b in batches:
            values, out = b.column(1).to_pylist(), []
            for i in range(0, len(values), batch):
                part = values[i : i + batch]
                try:
                    out += describe(part)
                except Exception:  # noqa: BLE001  see above
                    out += [(None, None)] * len(part)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())], names=[key, "caption", "detail"])

    described = rows.select(key, column).mapInArrow(run, f"{key} {kind}, caption string, detail string")
    return described.select(key, F.nullif(F.col("caption"), F.lit("")).alias("caption"), tags(F.col("detail")).alias("tags"))
