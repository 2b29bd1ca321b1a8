"""Work on large Arrow batches is done in parts of bounded size, with the same results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glimmer import models
from glimmer.functions.porter import stem, stemmed
from glimmer.operators import vector
from glimmer.plans import text_index


def test_a_model_never_sees_a_whole_batch_as_objects(spark):
    sizes = spark.range(3000, numPartitions=1).select("id", F.col("id").cast("string").alias("text"))

    def load():
        import sys

        def embed(items):
            held = sys._getframe(2).f_locals.get("values", items)
            return np.array([[len(held), 1.0]] * len(items))

        return embed

    rows = models.embedded(sizes, "id", "text", load, name="test_sizes").collect()
    assert len(rows) == 3000 and all(r.error is None for r in rows)
    assert max(r.embedding[0] / r.embedding[1] for r in rows) <= models.ROWS * 1.01


def test_stems_keep_nulls_and_lengths(spark):
    words = [["running", "a1s", "ponies"], None, [], ["running", "running"]]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, w array<string>").coalesce(1)
    got = {r.id: r.s for r in df.select("id", stemmed(F.col("w")).alias("s")).collect()}
    assert got == {i: None if w is None else [stem(x) for x in w] for i, w in enumerate(words)}


def test_many_queries_in_steps(spark):
    random = np.random.default_rng(5)
    m = random.integers(-2, 3, (700, 4)).astype(float)  # many ties and some zero vectors
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>").repartition(3)
    seen = vector.topk_many(df, df.select(F.col("id").alias("q"), "embedding"), "id", "q", limit=7)
    got: dict = {}
    for r in seen.collect():
        got.setdefault(r.q, {})[r["rank"]] = (r.id, r.score)
    u = vector._units(m)
    scores = u @ u.T
    for q in range(700):
        found = [got[q][k] for k in range(1, 8)]
        wanted = np.sort(scores[q])[::-1][:7]
        assert np.allclose([s for _, s in found], wanted) and np.allclose([scores[q, i] for i, _ in found], wanted)


def test_postings_of_cut_blocks_add_up(monkeypatch):
    random = np.random.default_rng(6)
    texts = [[f"w{k}" for k in random.integers(0, 9, n)] for n in random.integers(0, 30, 50)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([f"k{i}" for i in range(50)]), pa.array([len(t) for t in texts], pa.int32()), pa.array(texts, pa.list_(pa.string())), pa.array([i // 20 for i in range(50)], pa.int64()), pa.array([i % 20 for i in range(50)], pa.int32())],
        names=["key", "dl", "t", "block", "ord"],
    )
    wanted = {(w, i // 20, i % 20, f"k{i}", len(t), t.count(w), tuple(k for k, x in enumerate(t) if x == w)) for i, t in enumerate(texts) for w in t}
    for lot in (1, 100, 1 << 20):
        monkeypatch.setattr(text_index, "LOT", lot)
        got = []
        for part in text_index._inverted(iter([batch.slice(0, 30), batch.slice(30)])):
            for r in part.to_pylist():
                assert r["n"] == len(r["keys"]) and r["max_tf"] == max(r["tfs"]) and r["min_dl"] == min(r["dls"])
                got += [(r["term"], r["block"], o, k, d, tf, tuple(p)) for o, k, d, tf, p in zip(r["ords"], r["keys"], r["dls"], r["tfs"], r["positions"], strict=True)]
        assert len(got) == len(wanted) and set(got) == wanted
