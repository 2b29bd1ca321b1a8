"""Quality rules: the log-likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

Features of a text are its words and its pairs of neighbouring words, hashed into two tables of BUCKETS counts. The
raw multinomial counts every text of the corpus; the target multinomial counts texts whose label is trusted, at most SAMPLE
of them, those with the smallest hashes of their ids, and a share MIX of its mass is spread as in the raw corpus
(so what the target hasn't seen costs the same for every text). A text's score is its mean log ratio per feature; it is
kept if that reaches the threshold. Of the trusted ids about every HELDth is held out of the target; the threshold is
the cut with the fewest errors between held-out labelled texts of good and of bad quality (at most SAMPLE of each). No random
choice is involved. Without any trusted text, or held-out texts of both kinds, the base rules alone decide. The ratios
take one pass over the corpus; the held-out scores take another, in which only labelled rows are scored.

Null and empty texts have no words and fail the base rules, which apply to every text. Repeated rows are judged each
and count each; a label that is repeated is as bad as its worst row. Scores that tie with the threshold are kept. Long
texts are counted whole, in parts of bounded size. Extra columns are not read, and `filtered` keeps them, `kept` included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import count_vector, mixed, sliced, window_hashes, word_hashes

BUCKETS, SAMPLE, HELD, PRIOR, MIX = 1 << 16, 20_000, 5, 0.5, 0.1
_SYMBOLS, _SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
_PART = 1 << 20


def features(words: list[bytes]) -> np.ndarray:
    """Rows of the two tables: words in the first, pairs of words in the second."""
    return _rows(word_hashes(words))


def _rows(h: np.ndarray) -> np.ndarray:
    low = np.uint64(BUCKETS - 1)
    return np.concatenate([mixed(h) & low, (window_hashes(h, 2) & low) + np.uint64(BUCKETS)]).astype(np.int64)


def base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return _base(text or "", word_hashes((text or "").encode().split()))


def _base(text: str, h: np.ndarray) -> tuple[int, int, int, int, int]:
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(h), chars, symbols, len(lines) - len(set(lines)), _repeated(h)


def _failed(n: int, again: int) -> bool:
    return n < 50 or 100 * again > 50 * n


def repeated(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of three that occur twice or more."""
    return _repeated(word_hashes(words), size)


def _repeated(words: np.ndarray, size: int = 3) -> int:
    h = window_hashes(words, size)
    if len(h) < 2:
        return 0
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(size):
        covered[k : k + len(h)] |= twice
    return int(covered.sum())


def _first(ids: DataFrame, sample: int) -> list[int]:
    """The ids with the smallest hashes, at most `sample`."""
    return [r.doc_id for r in ids.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]


def trusted(labels: DataFrame, sample: int = SAMPLE) -> tuple[frozenset[int], dict[int, bool]]:
    """Ids of the target, and the quality of ids held out of it; of each kind at most `sample`."""
    worst = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    worst = worst.withColumn("held", F.expr(f"pmod(xxhash64(doc_id, 'held'), {HELD}) = 0"))
    target = frozenset(_first(worst.where("q = 1 AND t = 0 AND NOT held"), sample) or _first(worst.where("q = 1 AND t = 0"), sample))
    held = dict.fromkeys(_first(worst.where("q = 1 AND (t = 1 OR held)"), sample), True) | dict.fromkeys(_first(worst.where("q = 0"), sample), False)
    return target, {k: v for k, v in held.items() if k not in target}


def ratios(docs: DataFrame, target: frozenset[int]) -> np.ndarray:
    """The log ratio of each table row."""
    sent = docs.sparkSession.sparkContext.broadcast(target)

    def count(b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((2, 2 * BUCKETS), np.int64)
        waiting: list[list[np.ndarray]] = [[], []]

        def add(kind: int) -> None:
            if waiting[kind]:
                out[kind] += np.bincount(np.concatenate(waiting[kind]), minlength=2 * BUCKETS)
                waiting[kind].clear()

        size = 0
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if t:
                found = features(t.encode().split())
                waiting[k in sent.value].append(found)
                size += len(found)
                if size > _PART:
                    add(0)
                    add(1)
                    size = 0
        add(0)
        add(1)
        out[0] += out[1]  # the raw corpus has the target's texts as well
        return out.ravel()

    total = count_vector(docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t")), count, 4 * BUCKETS).astype(float)
    out = np.empty(2 * BUCKETS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        raw, wanted = total[: 2 * BUCKETS][part] + PRIOR, total[2 * BUCKETS :][part]
        raw /= raw.sum()
        spread = MIX * max(wanted.sum(), 1)
        out[part] = np.log((wanted + spread * raw) / (wanted.sum() + spread)) - np.log(raw)
    return out


def best_cut(good: list[float], bad: list[float]) -> float:
    """The cut between neighbouring scores with the fewest texts on its wrong sides; the lowest of equal ones."""
    if not good or not bad:
        return -np.inf
    g, b = np.sort(good), np.sort(bad)
    seen = np.unique(np.concatenate([g, b]))
    cuts = np.concatenate([seen[:1], (seen[1:] + seen[:-1]) / 2])
    wrong = np.searchsorted(g, cuts, "left") + len(b) - np.searchsorted(b, cuts, "left")
    return float(cuts[np.argmin(wrong)])


def threshold_of(docs: DataFrame, held: dict[int, bool], table: np.ndarray) -> float:
    """The threshold that held-out labelled texts ask for, of those past the base rules."""
    sc = docs.sparkSession.sparkContext
    ids, sent = sc.broadcast(held), sc.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            mine = [i for i, k in enumerate(b.column(0).to_pylist()) if k in ids.value]
            for k, t in zip(b.column(0).take(mine).to_pylist(), b.column(1).take(mine).to_pylist(), strict=True) if mine else ():
                h = word_hashes((t or "").encode().split())
                if not _failed(len(h), _repeated(h)):
                    found.append((k, float(sent.value[_rows(h)].mean())))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())], names=["k", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t")).mapInArrow(run, "k long, score double")
    scores = rows.groupBy("k").agg(F.min("score").alias("score")).collect()  # at most a row for each held-out id
    return best_cut([r.score for r in scores if held[r.k]], [r.score for r in scores if not held[r.k]])


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None, sample: int = SAMPLE, carry: bool = False) -> DataFrame:
    """Base counts, score and verdict of every row; with carry, all columns of docs besides a boolean `kept`.

    threshold: a cut of the caller's own instead of that of the held-out labels.
    """
    target, held = trusted(labels, sample)
    table = ratios(docs, target) if target else None
    cut = threshold if threshold is not None or table is None else threshold_of(docs, held, table)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def verdict(text: str | None) -> tuple:
        h = word_hashes((text or "").encode().split())
        counts = _base(text or "", h)
        failed = _failed(counts[0], counts[4])
        score = float(sent.value[_rows(h)].mean()) if len(h) and sent.value is not None else None
        return (*counts, failed, score, not failed and (score is None or score >= cut))

    if carry:
        judged = F.udf(lambda t: verdict(t)[-1], "boolean", useArrow=True)
        return docs.withColumn("kept", judged("text"))
    arrow = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if b.num_rows:
                found = zip(*map(verdict, b.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(found, list(arrow)[1:], strict=True))], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")


def filtered(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """The rows of docs that are kept, all their columns as they were."""
    name = "kept"
    while name in docs.columns:
        name = f"_{name}"
    if name != "kept":
        docs = docs.withColumnRenamed("kept", name)
    out = judge(docs, labels, threshold, carry=True).where("kept").drop("kept")
    return out.withColumnRenamed(name, "kept") if name != "kept" else out
