"""Tables in parts: keyed ones and vectors by cluster."""

from __future__ import annotations

import random

import pytest
from glimmer import schemas
from glimmer.operators import vector
from glimmer.operators.vector_store import VectorStore
from glimmer.sources.parts import Keyed
from glimmer.sources.snapshots import Snapshots
from pyspark.sql import functions as F


def test_a_small_batch_writes_its_buckets(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/lib")
    table = Keyed(store, "photos", schemas.PHOTOS, buckets=16)
    assert table.rows().count() == 0 and table.lookup("p1").count() == 0
    photos = spark.createDataFrame([(f"p{i}", f"{i}.jpg", 1.0, None, None, None, None, None) for i in range(200)], schemas.PHOTOS)
    table = table.upsert(photos, schemas.OVERWRITTEN, schemas.MERGED)
    before = table.note["parts"]
    one = spark.createDataFrame([("p7", "x.jpg", 2.0, "a dog", None, None, None, None)], schemas.PHOTOS)
    old = table.rows()
    table = table.upsert(one, schemas.OVERWRITTEN, schemas.MERGED)
    assert sum(table.note["parts"][p] != v for p, v in before.items()) == 1
    assert table.rows().count() == 200 and [(r.path, r.caption) for r in table.lookup("p7").collect()] == [("x.jpg", "a dog")]
    assert old.where("photo_id = 'p7'").first().path == "7.jpg"  # readers of the commit before go on
    again = spark.createDataFrame([("p7", "y.jpg", 3.0, None, None, None, None, None), ("q", "q.jpg", 1.0, None, None, None, None, None)], schemas.PHOTOS)
    table = table.upsert(again, schemas.OVERWRITTEN, schemas.MERGED, removed=spark.createDataFrame([("p1",), ("nobody",)], "photo_id string"))
    assert (table.lookup("p7").first().path, table.lookup("p7").first().caption) == ("y.jpg", "a dog")
    assert table.rows().count() == 200 and table.lookup("p1").count() == 0
    assert Keyed(store, "photos", schemas.PHOTOS, buckets=3).buckets == 16
    assert table.delete(table.rows().select("photo_id")).rows().count() == 0


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around ten places, copies, zero vectors and a null."""
    r = random.Random(1)
    places = [[r.gauss(0, 5) for _ in range(12)] for _ in range(10)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in places[i % 10]]) for i in range(3000)]
    rows += [(5000 + i, rows[3][1]) for i in range(300)] + [(6000, [0.0] * 12), (6001, [0.0] * 12), (7000, None)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def as_rows(df):
    return [(r.id, round(r.score, 5), r["rank"]) for r in df.collect()]


@pytest.mark.parametrize("metric, distances", [("Cosine", ["Cosine"]), ("Euclid", ["Euclid", "Dot"])])
def test_pruned_search_is_exact(spark, clustered, tmp_path, metric, distances):
    store = VectorStore(Snapshots(spark, f"file://{tmp_path}/lib"), kind="bigint").rebuild(clustered, "id", metric=metric)
    shares = []
    for distance in distances:
        for q in (vector.stored_vector(clustered, "id", 17), vector.stored_vector(clustered, "id", 3), [0.0] * 12, [1.0] + [0.0] * 11):
            for kw in ({"limit": 20}, {"limit": 5, "offset": 7, "threshold": 0.9}):
                report: dict = {}
                assert as_rows(store.topk(q, "id", distance, report=report, **kw)) == as_rows(vector.topk(clustered.where("embedding IS NOT NULL"), q, "id", distance=distance, **kw)), (distance, kw)
                shares.append(report["rows_read"] / report["rows"])
    assert min(shares) < 0.2
    with pytest.raises(ValueError):
        store.topk([1.0] * 12, "id", "Euclid" if metric == "Cosine" else "Cosine")
    with pytest.raises(ValueError):
        store.topk([1.0], "id")


def test_vector_changes_write_their_parts(spark, clustered, tmp_path):
    store = VectorStore(Snapshots(spark, f"file://{tmp_path}/lib"), kind="bigint").rebuild(clustered, "id")
    before = store.note["parts"]
    far = vector.stored_vector(clustered, "id", 5)
    store = store.upsert(spark.createDataFrame([(4, far), (9999, far)], clustered.schema), "id", removed=spark.createDataFrame([(5,)], "id long"))
    after = store.note["parts"]
    assert 1 <= sum(after.get(p) != v for p, v in before.items()) <= 3
    now = clustered.where("id NOT IN (4, 5, 7000)").unionByName(spark.createDataFrame([(4, far), (9999, far)], clustered.schema))
    assert as_rows(store.topk(far, "id", limit=10)) == as_rows(vector.topk(now, far, "id", limit=10))
    with pytest.raises(Exception, match="values"):
        store.upsert(spark.createDataFrame([(1, [1.0])], clustered.schema), "id")


def test_a_store_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    store = VectorStore(Snapshots(spark, f"file://{tmp_path}/lib")).rebuild(none, "id")
    assert store.topk([1.0, 2.0], "id").count() == 0
    assert store.topk([1.0, 2.0], "id").withColumn("x", F.lit(1)).count() == 0
