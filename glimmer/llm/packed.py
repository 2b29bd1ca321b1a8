"""Shuffles of packed arrays: many small fixed-width entries travel as one binary row for each lane and batch.

A lane is a share of a 64-bit key's hash. Entries of a kind are numpy records; `dealt` packs a batch's entries by
lane, `shuffled` brings a lane's rows together, and `lanes` gives each lane's entries back, kind by kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from glimmer.llm.kit import mixed

SCHEMA = "lane int, kind int, data binary"
_ARROW = pa.schema([("lane", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
#: Entries that a task packs at a time, and their bytes (packing needs a few times as many).
BATCH, BYTES = 1 << 20, 32 << 20


def lane_count(spark: SparkSession, share: int = 4) -> int:
    """share: lanes for each partition of a shuffle."""
    return min(1 << 16, share * int(spark.conf.get("spark.sql.shuffle.partitions")))


def lane_of(key: np.ndarray, lanes: int) -> np.ndarray:
    return (mixed(key.view(np.uint64)) % np.uint64(lanes)).astype(np.uint16)


def dealt(entries: np.ndarray, key: np.ndarray, lanes: int, kind: int = 0) -> pa.RecordBatch:
    """The entries, packed by the lane of their keys."""
    return by_lane(entries, lane_of(key, lanes), lanes, kind)


def by_lane(entries: np.ndarray, lane: np.ndarray, lanes: int, kind: int = 0) -> pa.RecordBatch:
    order = np.argsort(lane, kind="stable")
    sizes = np.bincount(lane, minlength=lanes)
    there = np.flatnonzero(sizes)
    ends = np.concatenate([[0], np.cumsum(sizes[there])]) * entries.dtype.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(entries[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(np.full(len(there), kind), pa.int32()), data], schema=_ARROW)


def through(lane: int, kind: int, entries: np.ndarray) -> pa.RecordBatch:
    """Entries that stay in their lane."""
    return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([kind], pa.int32()), pa.array([entries.tobytes()], pa.binary())], schema=_ARROW)


def shuffled(df: DataFrame) -> DataFrame:
    return df.repartition("lane").sortWithinPartitions("lane")


def lanes(batches: Iterator[pa.RecordBatch], dtypes: dict[int, np.dtype]) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
    """(lane, entries of each kind) of rows sorted by lane."""
    held: dict[int, list[bytes]] = {k: [] for k in dtypes}
    current = None

    def taken() -> tuple[int, dict[int, np.ndarray]]:
        out = current, {k: np.frombuffer(b"".join(x), dtypes[k]) for k, x in held.items()}
        for x in held.values():
            x.clear()
        return out

    for b in batches:
        data = b.column(2)
        for i, (lane, kind) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            if lane != current and current is not None:
                yield taken()
            current = lane
            held[kind].append(data[i].as_py())
    if current is not None:
        yield taken()


def flat(column: pa.Array, dtype: np.dtype | type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed arrays, and how many each row has."""
    n = len(column)
    if not n:
        return np.empty(0, dtype), np.empty(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    width = np.dtype(dtype).itemsize
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return np.ascontiguousarray(data).view(dtype), np.diff(ends) // width


def rows_of(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A column of packed arrays that begin at `starts`."""
    ends = np.append(starts, len(values)) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def gathered(batches: Iterator[pa.RecordBatch], take: Callable[[pa.RecordBatch], np.ndarray], step: int = 1024) -> Iterator[np.ndarray]:
    """take's entries of slices of the batches, in arrays of about BATCH entries or BYTES."""
    held, n = [], 0
    for b in batches:
        for at in range(0, b.num_rows, step):
            held.append(take(b.slice(at, step)))
            n += len(held[-1])
            if n >= BATCH or n * held[-1].itemsize >= BYTES:
                yield np.concatenate(held)
                held, n = [], 0
    if n:
        yield np.concatenate(held)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out
