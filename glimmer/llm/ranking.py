"""Ranked lexical search: every item's best documents of a whole corpus, by integer BM25-like scores.

Documents are indexed in shards of whole texts. A shard has its documents in order of their ids, and for each term a
list of their places in that order with the term's occurrences, as differences in variable-length bytes. A query set
goes in blocks of bounded size. For a block the shards' document frequencies are added up first; then each shard is
searched for all items of the block: a heap of cursors, keyed by the next document of each of the item's lists, hands
out windows of consecutive documents; scores of a window are added up list by list, windows whose lists' greatest shares
can't reach the item's worst kept score are stepped over, and what is good enough goes to the item's bounded heap, keyed
by score and then by id. The heaps live on from shard to shard of a task; the tasks' best rows are merged in two levels.

Defined cases: null texts and texts without terms count nowhere and are never found; documents without an id come after
all others of an equal score; documents that share an id, and repeated rows, are rows of their own. Items that share an
id are one item with the terms of all of them; items without an id or without terms have no result. Texts may be of any
length (a shard has one text at least). Other columns are not read. Terms are compared as 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.kit import sliced, stored, word_hashes
from glimmer.llm.postings import words

SHARD_WORDS, SHARD_DOCS, BLOCK_TERMS, WINDOW, LANES = 1 << 21, 1 << 17, 1 << 19, 1 << 12, 64
#: Fixed values of the score: a term's share is w * ((SHARE * tf) div (TF * tf + LENGTH * m)), m is 100 for a text of mean length.
SHARE, TF, LENGTH, SLOPE = 1_000_000_000, 1000, 20, 50
_SHARD = pa.schema([("keys", pa.list_(pa.int64())), ("sizes", pa.binary()), ("texts", pa.int64()), ("words", pa.int64()), ("terms", pa.binary()), ("counts", pa.binary()), ("lengths", pa.binary()), ("lists", pa.binary())])


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as variable-length bytes, seven bits each, the last without its high bit; and each value's number of bytes."""
    v = values.astype(np.uint64)
    width = np.ones(len(v), np.int64)
    for bits in range(7, 64, 7):
        width += v >= np.uint64(1 << bits)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        some = width > k
        out[(ends - width)[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)) | np.where(width[some] > k + 1, 128, 0).astype(np.uint64)
    return out, width


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    width = ends - starts + 1
    out = np.zeros(len(ends), np.int64)
    for k in range(int(width.max(initial=0))):
        some = width > k
        out[some] |= (data[starts[some] + k] & 127).astype(np.int64) << (7 * k)
    return out


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of docs, a row a shard, stored in the shared folder."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        total = 0
        for b in sliced(batches):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(h := word_hashes(words(t))):
                    keys.append(k)
                    held.append(h)
                    total += len(h)
                if total >= SHARD_WORDS or len(keys) >= SHARD_DOCS:
                    yield _shard(keys, held)
                    keys, held, total = [], [], 0
        if keys:
            yield _shard(keys, held)

    return stored(rows.mapInArrow(run, "keys array<long>, sizes binary, texts long, words long, terms binary, counts binary, lengths binary, lists binary"), "shards")


def _shard(keys: list[int | None], held: list[np.ndarray]) -> pa.RecordBatch:
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0))
    keys, held = [keys[i] for i in order], [held[i] for i in order]
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    h, doc = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
    by_term = np.argsort(h, kind="stable")
    h, doc = h[by_term], doc[by_term]
    # the first occurrence of each term in each document
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    times = np.diff(first, append=len(h))
    h, doc = h[first], doc[first]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    gaps = np.diff(doc, prepend=0)
    gaps[begin] = doc[begin]
    data, width = packed(np.stack([gaps, times], 1).ravel())
    lengths = np.add.reduceat(width, 2 * begin)
    cells = [h[begin].tobytes(), np.diff(begin, append=len(h)).astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), data.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.int64())), pa.array([sizes.astype("<u4").tobytes()], pa.binary()), pa.array([len(keys)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()), *(pa.array([c], pa.binary()) for c in cells)], schema=_SHARD)


def queries(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, terms): each item's different terms, as hashes."""
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            terms = [np.unique(word_hashes(words(t))).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    found = rows.mapInArrow(run, "item long, terms array<long>")
    return found.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def blocks(found: DataFrame, limit: int = BLOCK_TERMS) -> Iterator[tuple[np.ndarray, list[tuple[int, np.ndarray]]]]:
    """Query items in blocks of about limit terms: a block's different terms, sorted, and each item's places in them."""
    block: list[tuple[int, np.ndarray]] = []
    held = 0

    def made() -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        wanted = np.unique(np.concatenate([t for _, t in block]))
        return wanted, [(item, np.searchsorted(wanted, t)) for item, t in block]

    for row in found.toLocalIterator():
        block.append((row["item"], np.sort(np.array(row.terms, np.int64).view(np.uint64))))
        held += 1 + len(row.terms)
        if held >= limit:
            yield made()
            block, held = [], 0
    if block:
        yield made()


def _places(terms: bytes, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the wanted terms that a shard has: their places in wanted, and in the shard."""
    there = np.frombuffer(terms, "<u8")
    at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
    found = np.flatnonzero(there[at] == wanted)
    return found, at[found]


def _frequencies(index: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How many documents have each of the wanted terms."""
    sent = index.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for b in sliced(batches, 1):
            found, at = _places(b.column(0)[0].as_py(), sent.value)
            total[found] += np.frombuffer(b.column(1)[0].as_py(), "<u4")[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["at", "df"])

    out = np.zeros(len(wanted), np.int64)
    for row in index.select("terms", "counts").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["at"]] = row.df  # a number for each term of the block
    return out


def weight(texts: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * texts + 2) / (2 * df + 1)))


def merge(lists: list[tuple[np.ndarray, np.ndarray, int]], keys: list[int | None], kept: list[tuple[int, float]], limit: int) -> None:
    """Add a shard's documents to the heap of an item's best (score, negative id): lists of (documents, shares, greatest share)."""
    cursors = [(int(docs[0]), i, 0) for i, (docs, _, _) in enumerate(lists)]
    heapq.heapify(cursors)
    scores = np.zeros(WINDOW, np.int64)
    while cursors:
        begin = cursors[0][0]
        end, opened = begin + WINDOW, []
        while cursors and cursors[0][0] < end:
            opened.append(heapq.heappop(cursors))
        least = kept[0][0] if len(kept) == limit else 1
        reachable = sum(lists[i][2] for _, i, _ in opened) >= least
        for _, i, at in opened:
            docs, shares, _ = lists[i]
            stop = at + int(np.searchsorted(docs[at : at + WINDOW], end))
            if reachable:
                scores[docs[at:stop] - begin] += shares[at:stop]
            if stop < len(docs):
                heapq.heappush(cursors, (int(docs[stop]), i, stop))
        if not reachable:
            continue
        good = np.flatnonzero(scores >= least)
        if len(good) > limit:  # no more than these can stay, with all that equal the last of them
            good = good[scores[good] >= np.partition(scores[good], -limit)[-limit]]
        for doc, score in zip((begin + good).tolist(), scores[good].tolist(), strict=True):
            entry = (score, -math.inf if keys[doc] is None else -keys[doc])
            if len(kept) < limit:
                heapq.heappush(kept, entry)
            elif entry > kept[0]:
                heapq.heapreplace(kept, entry)
        scores[:] = 0


def _length_factor(sizes: np.ndarray, texts: int, words_: int) -> np.ndarray:
    """m of each text, in integers that can't overflow."""
    if int(sizes.max()) * SLOPE * texts >= 1 << 63:
        return np.array([100 - SLOPE + SLOPE * int(n) * texts // words_ for n in sizes], np.int64)
    return 100 - SLOPE + SLOPE * sizes * texts // words_


def search(index: DataFrame, items: DataFrame, limit: int = 50, key: str = "item_id", text: str = "text", block: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `limit` best documents with a score above 0, equal scores by id."""
    spark = index.sparkSession
    total = index.agg(F.sum("texts").alias("texts"), F.sum("words").alias("words")).first()
    parts = [spark.createDataFrame([], "item_id long, doc_id long, score long, lane int")]
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
    for wanted, asked in blocks(queries(items, key, text), block) if total.texts else ():
        weights = np.array([weight(total.texts, int(df)) for df in _frequencies(index, wanted)], np.int64)
        sent = spark.sparkContext.broadcast((wanted, weights, asked))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, texts=total.texts, n_words=total.words) -> Iterator[pa.RecordBatch]:
            wanted, weights, asked = sent.value
            kept: list[list[tuple[int, float]]] = [[] for _ in asked]
            for b in sliced(batches, 1):
                keys, sizes, terms, lengths, data = (b.column(c)[0].as_py() for c in ("keys", "sizes", "terms", "lengths", "lists"))
                factor = _length_factor(np.frombuffer(sizes, "<u4").astype(np.int64), texts, n_words)
                widths = np.frombuffer(lengths, "<u4").astype(np.int64)
                ends, data = np.cumsum(widths), np.frombuffer(data, np.uint8)
                lists: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
                for i, at in zip(*(x.tolist() for x in _places(terms, wanted)), strict=True):
                    pairs = unpacked(data[ends[at] - widths[at] : ends[at]]).reshape(-1, 2)
                    docs, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
                    shares = weights[i] * (SHARE * tf // (TF * tf + LENGTH * factor[docs]))
                    lists[i] = docs, shares, int(shares.max())
                for heap, (_, places) in zip(kept, asked, strict=True):
                    merge([lists[i] for i in places.tolist() if i in lists], keys, heap, limit)
            rows = [(item, None if k == -math.inf else -k, score) for (item, _), heap in zip(asked, kept, strict=True) for score, k in heap]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        parts.append(index.select("keys", "sizes", "terms", "lengths", "lists").mapInArrow(run, "item_id long, doc_id long, score long").withColumn("lane", F.spark_partition_id() % LANES))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)

    def best(df: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    return best(best(every, "item_id", "lane").drop("rank"), "item_id").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """search() over a new index of docs."""
    return search(build(docs), items, limit)
