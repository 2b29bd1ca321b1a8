"""Benchmark decontamination with a positional inverted index.

The index is cut into segments of whole documents: a segment has the sorted terms of its texts, and for each term
the places where it occurs, counted through the segment and stored as differences. A query takes each phrase's
terms from rarest to most common, shifts every list by the term's offset and intersects; nothing is scored or
sampled, so phrase matches are exact. A query set that is too large to send to executors goes in blocks.

Null and empty texts have no words and match nothing; an item without words or without an id is no query. Repeated rows and
rows that share an id, or have none, are rows of their own; items that share an id count as one. Texts may be of any length:
a text is never cut, so a segment has its words at least. Other columns are not read. Terms are compared as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import sliced, stored, word_hashes

#: A-Z to lower case; 0-9, a-z and all bytes from 0x80 on are word bytes; all others separate words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENT_WORDS, BLOCK_WORDS = 1 << 21, 1 << 20
_SEGMENT = pa.schema([("segment", pa.int64()), ("docs", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of docs, a row a segment, stored in the shared folder."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []
        total = 0
        number = TaskContext.get().partitionId() << 32  # a segment's number, the same if the task is run again
        for b in sliced(batches):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = word_hashes(words(t))
                keys.append(k)
                sizes.append(len(h))
                held.append(h)
                total += len(h)
                if total >= SEGMENT_WORDS or len(keys) >= 1 << 17:
                    yield _segment(number, keys, sizes, held)
                    keys, sizes, held, total = [], [], [], 0
                    number += 1
        if keys:
            yield _segment(number, keys, sizes, held)

    return stored(rows.mapInArrow(run, "segment long, docs array<long>, words array<long>, terms binary, counts binary, places binary"), "postings")


def _segment(number: int, keys: list, sizes: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
    h = np.concatenate(held) if held else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable").astype(np.uint32)
    terms, first, counts = np.unique(h[order], return_index=True, return_counts=True)
    gaps = np.diff(order, prepend=np.uint32(0))
    gaps[first] = order[first]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (terms, counts.astype("<u4"), gaps))], schema=_SEGMENT)


class Segment:
    """A segment's lists, each expanded when it is first asked for."""

    def __init__(self, terms: bytes, counts: bytes, places: bytes):
        self.terms, n = np.frombuffer(terms, "<u8"), np.frombuffer(counts, "<u4").astype(np.int64)
        self.ends = np.cumsum(n)
        self.counts, self.gaps, self.lists = n, np.frombuffer(places, "<u4"), {}

    def rank(self, wanted: np.ndarray) -> np.ndarray:
        """Each wanted term's row in this segment, or -1."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def places(self, row: int) -> np.ndarray:
        if row not in self.lists:
            self.lists[row] = np.cumsum(self.gaps[self.ends[row] - self.counts[row] : self.ends[row]], dtype=np.int64)
        return self.lists[row]

    def phrase(self, rows: np.ndarray) -> np.ndarray:
        """Where the phrase of these terms starts: lists shifted by their offsets, intersected from the rarest on."""
        order = np.argsort(self.counts[rows], kind="stable")
        starts = self.places(rows[order[0]]) - order[0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.places(rows[k])
            at = np.minimum(np.searchsorted(other, starts + k), len(other) - 1)
            starts = starts[other[at] == starts + k]
        return starts[starts >= 0]

    def near(self, rows: np.ndarray, span: int) -> np.ndarray:
        """Places of the rarest term that have every other term within span words of it."""
        order = np.argsort(self.counts[rows], kind="stable")
        at = self.places(rows[order[0]])
        for k in order[1:]:
            other = self.places(rows[k])
            near = np.searchsorted(other, at + span, "right") > np.searchsorted(other, at - span, "left")
            at = at[near]
        return at


def item_windows(items: list[tuple[int, str | None]], size: int) -> list[tuple[int, np.ndarray]]:
    """(item, its terms) of each window of size words; an item of fewer words, but not none, is one window."""
    out = []
    for item, text in items:
        h = word_hashes(words(text))
        out += [(item, h[i : i + size]) for i in range(max(1, len(h) - size + 1)) if len(h)]
    return out


def blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[int, str | None]]]:
    """The query items in blocks of about limit words, so that what is sent to executors stays bounded."""
    block, held = [], 0
    for row in items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where("k IS NOT NULL").toLocalIterator():
        block.append((row.k, row.t))
        held += 1 + len(row.t or "") // 4
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, size: int = 10, span: int | None = None, item_key: str = "item_id", text: str = "text", limit: int = BLOCK_WORDS) -> DataFrame:
    """(doc, item, place, length): every occurrence of every window of the items, or with span, every place of a
    window's rarest term that has all its other terms within span words in the same document (length 1)."""
    spark = index.sparkSession
    out = spark.createDataFrame([], "doc long, item long, place long, length int")
    arrow = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("place", pa.int64()), ("length", pa.int32())])
    for block in blocks(items, item_key, text, limit):
        sent = spark.sparkContext.broadcast(item_windows(block, size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for _, docs, _, matches in _matched(batches, sent.value, span):
                rows = [(docs[d], item, place, n) for d, item, place, n in matches]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        out = out.unionByName(index.mapInArrow(run, "doc long, item long, place long, length int"))
    return out


def _matched(batches: Iterator[pa.RecordBatch], windows: list[tuple[int, np.ndarray]], span: int | None = None) -> Iterator[tuple[int, list, np.ndarray, list[tuple[int, int, int, int]]]]:
    """Of each segment: its number, its documents, their lengths, and (row of the document, item, place, length) of each match."""
    wanted = np.unique(np.concatenate([w for _, w in windows])) if windows else np.empty(0, np.uint64)
    local = [(item, np.searchsorted(wanted, w)) for item, w in windows]
    # windows of one length as a matrix, so that a segment is asked for all of them at once
    by_length: dict[int, list[int]] = {}
    for at, (_, w) in enumerate(local):
        by_length.setdefault(len(w), []).append(at)
    grids = [(np.array(at), np.stack([local[i][1] for i in at])) for at in by_length.values()]
    for b in batches:
        for number, docs, sizes, terms, counts, places in zip(*(b.column(n).to_pylist() for n in _SEGMENT.names), strict=True):
            segment, sizes = Segment(terms, counts, places), np.array(sizes, np.int64)
            ends = np.cumsum(sizes)
            rows = segment.rank(wanted)
            there, matches = rows >= 0, []
            whole_there = np.sort(np.concatenate([at[there[grid].all(axis=1)] for at, grid in grids])) if grids else []
            for item, w in (local[i] for i in whole_there):
                length = len(w) if span is None else 1
                starts = segment.phrase(rows[w]) if span is None else segment.near(rows[w], span)
                owner = np.searchsorted(ends, starts, "right")
                begin = (ends - sizes)[owner]
                if span is None:
                    whole = starts + length <= ends[owner]  # a match lies within one document
                else:
                    whole = np.ones(len(starts), bool)
                    for r in rows[w]:  # and so do its neighbours
                        other = segment.places(r)
                        whole &= np.searchsorted(other, np.minimum(starts + span, ends[owner] - 1), "right") > np.searchsorted(other, np.maximum(starts - span, begin), "left")
                matches += [(int(d), item, int(s - f), length) for d, s, f, ok in zip(owner, starts, begin, whole, strict=True) if ok]
            yield number, docs, sizes, matches


def contaminated(index: DataFrame, items: DataFrame, size: int = 10, limit: int = BLOCK_WORDS) -> DataFrame:
    """Per document of the index: doc_id, n_words, n_hit (words inside any occurrence of a window), items (sorted).

    One row for each row that was indexed. One pass over the index for each block of items; a row is known by its segment
    and its place there, by which its hits of all blocks are merged, whatever its id.
    """
    spark = index.sparkSession
    schema = "segment long, row long, doc_id long, n_words long, n_hit long, hit binary, items array<long>"
    arrow = pa.schema([("segment", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.int64()))])
    parts = []
    for block in blocks(items, "item_id", "text", limit):
        sent = spark.sparkContext.broadcast(item_windows(block, size))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for number, docs, sizes, matches in _matched(batches, sent.value):
                hit = np.zeros(int(sizes.sum()), bool)
                begin = np.cumsum(sizes) - sizes
                found: list[set[int]] = [set() for _ in docs]
                for d, item, place, length in matches:
                    hit[begin[d] + place : begin[d] + place + length] = True
                    found[d].add(item)
                spans = [hit[a : a + n] if f else None for a, n, f in zip(begin, sizes, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.int64()), pa.array(sizes), pa.array([0 if s is None else int(s.sum()) for s in spans], pa.int64()), pa.array([None if s is None else np.packbits(s).tobytes() for s in spans], pa.binary()), pa.array([sorted(f) for f in found], pa.list_(pa.int64()))], schema=arrow
                )

        parts.append(index.mapInArrow(run, schema))
    if not parts:  # no item at all
        empty = index.select(F.explode(F.arrays_zip("docs", "words")).alias("x"))
        return empty.selectExpr("x.docs AS doc_id", "x.words AS n_words", "0L AS n_hit", "CAST(array() AS array<long>) AS items")
    if len(parts) == 1:
        return parts[0].drop("segment", "row", "hit")
    merge = F.udf(lambda spans: int(np.unpackbits(np.bitwise_or.reduce([np.frombuffer(s, np.uint8) for s in spans])).sum()) if spans else 0, "long")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    same = [F.first(c).alias(c) for c in ("doc_id", "n_words")]
    merged = every.groupBy("segment", "row").agg(*same, merge(F.collect_list("hit")).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.drop("segment", "row")


def digests(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = contaminated(build(docs), items, size)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs in which no window of any item occurs, columns as they were. Each row is judged by its own text,
    whatever its id: verdicts come back by 64 bits of its id and text, so no copy of the texts is made to number them."""
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    named = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    index = build(named, key=row)
    bad = stored(contaminated(index, items, size).where("n_hit > 0").select(F.col("doc_id").alias("_bad")).distinct(), "hits", (index,))
    return named.join(bad, named[row] == bad["_bad"], "left_anti").drop(row)
