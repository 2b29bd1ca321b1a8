"""The maintained full-text index against scans, and commits of several writers."""

from __future__ import annotations

import pytest
from glimmer import schemas
from glimmer.plans import fts, text_index
from glimmer.plans.text_index import TextIndex
from glimmer.sources.snapshots import Conflict, Snapshots
from pyspark.sql import functions as F

QUERIES = ("run", "runs NOT c", '"a b"', '"a b a"', "NEAR(a b, 0)", 'NEAR("a b" runs, 2)', "ru* OR the", "title: a OR c", "the the", "nowhere", "and OR (licensed AND the)", "the AND and", '"of the"')


def same(spark, index, texts, stem=False, limit=30):
    for q in QUERIES[stem :: 1 + stem]:
        want = [(r.doc_id, round(r.score, 9)) for r in fts.search(texts, q, "doc_id", limit=limit, stem=stem).collect()]
        report: dict = {}
        got = [(r.doc_id, round(r.score, 9)) for r in index.search(q, "doc_id", limit=limit, report=report).collect()]
        assert got == want, q
        assert report.get("scored", 0) <= report.get("blocks", 0)


@pytest.fixture(scope="module")
def rows(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return df.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "runs a b a b a"), (-4, "running a c b")], df.schema))


@pytest.mark.parametrize("stem, block", [(False, 1024), (True, 8)])
def test_batches_equal_a_new_index(spark, rows, tmp_path, monkeypatch, stem, block):
    """Updates, deletes and merges; small blocks and waves, so that bounds decide."""
    if block < 1024:
        monkeypatch.setattr(text_index, "BLOCK", 64)
        monkeypatch.setattr(text_index, "WAVE", 1)
    parts = [rows.where(f"pmod(doc_id, 7) = {i}") for i in range(7)]
    index = TextIndex(Snapshots(spark, f"file://{tmp_path}/lib"), "words").rebuild(parts[0].unionByName(parts[1]).unionByName(parts[2]), "doc_id", stem=stem)
    held = {r.doc_id: r.text for p in parts[:3] for r in p.collect()}
    for i in range(3, 7):
        changed = {r.doc_id: r.text for r in parts[i].collect()} | {k: f"the a b {i} {held[k] or ''}" for k in sorted(held)[i :: 4 + i]}
        gone = sorted(set(held) - set(changed))[:: 5 + i]
        batch = spark.createDataFrame(list(changed.items()), rows.schema)
        index = index.upsert(batch, "doc_id", removed=spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        held = {k: v for k, v in (held | changed).items() if k not in gone}
        assert sum(s["texts"] - s["gone"] for s in index.note["segments"]) == len(held)
    same(spark, index, spark.createDataFrame(list(held.items()), rows.schema), stem)
    assert len(index.note["segments"]) < text_index.FAN + 2
    index = index.delete(spark.createDataFrame([(k,) for k in held], "doc_id long"), "doc_id")
    assert index.note["segments"] == [] and index.search("the", "doc_id").count() == 0
    assert index.vacuum() > 0


def test_bounds_spare_blocks(spark, tmp_path, monkeypatch):
    """Of many blocks only those are scored whose bound reaches the worst result kept."""
    monkeypatch.setattr(text_index, "WAVE", 2)
    texts = [(i, "tree " * (9 if i < 1024 else 1) + "leaf " * (i % 7)) for i in range(8 * 1024)] + [(i, "stone") for i in range(10000, 30000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(text_index.TextIndex, "_tokens", staticmethod(lambda t, k, c, s: df.selectExpr("doc_id AS key", "split(trim(text), ' ') AS t").coalesce(1)))
    index = TextIndex(Snapshots(spark, str(tmp_path / "lib"))).rebuild(df, "doc_id")
    report: dict = {}
    got = index.search("tree", "doc_id", limit=20, report=report).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in fts.search(df, "tree", "doc_id", limit=20).collect()]
    assert report["blocks"] >= 8 > report["scored"]


def test_index_in_an_ingest(spark, tmp_path):
    """One commit changes photos and index; of a missing index a search says so."""
    from glimmer.streaming import ingest as stream

    store = Snapshots(spark, f"file://{tmp_path}/lib")
    with pytest.raises(LookupError):
        TextIndex(store).search("a", "photo_id")
    batch = [(f"p{i}", f"{i}.jpg", 1.0, [1.0], None, None, None) for i in range(4)]
    stream.merged(store, spark.createDataFrame(batch, schemas.PROCESSED), 5.0)
    photos = store.read("photos", schemas.PHOTOS).withColumn("caption", F.concat_ws(" ", F.lit("dogs running"), "photo_id"))
    stream.described(store, photos.select("photo_id", "caption", "tags"), 6.0)
    index = TextIndex(store)
    assert sorted(r.photo_id for r in index.search("dog runs", "photo_id").collect()) == ["p0", "p1", "p2", "p3"]
    stream.merged(store, spark.createDataFrame([("p9", "0.jpg", 2.0, [1.0], None, None, None)], schemas.PROCESSED), 7.0)
    assert sorted(r.photo_id for r in TextIndex(store).search("dog", "photo_id").collect()) == ["p1", "p2", "p3"]
    assert sorted(r.photo_id for r in index.search("dog", "photo_id").collect()) == ["p0", "p1", "p2", "p3"]  # an opened view stays


def test_interleaved_commits(spark, tmp_path):
    store, other = (Snapshots(spark, f"file://{tmp_path}/lib") for _ in range(2))

    def config(value):
        return spark.createDataFrame([("k", value)], schemas.CONFIG)

    store.commit({"config": config("0")})
    seen = store.view()
    other.commit({"other": config("1")}, {"note": {"a": 1}})
    store.commit({"config": config("2")}, since=seen)  # nothing of its own was changed: both stay
    assert store.read("config", schemas.CONFIG).first().value == "2" and store.read("other", schemas.CONFIG).first().value == "1"
    assert store.view().notes == {"note": {"a": 1}}
    for a, kind in ((2, {"config": config("3")}), (4, {})):
        seen = store.view()
        other.commit({"config": config("4")}, {"note": {"a": a}})
        with pytest.raises(Conflict):
            store.commit(kind, {"note": {"a": 3}}, since=seen)
    with pytest.raises(Conflict):
        store.commit({"third": config("5")}, since=seen, read=["config"])
    assert store.read("config", schemas.CONFIG).first().value == "4" and "third" not in store.current()
    old = store.read("config", schemas.CONFIG)
    store.commit({"config": config("6")})
    assert store.vacuum(keep=2) >= 1 and old.first().value == "4"
    assert store.vacuum() == 1


def test_a_late_pointer_is_caught_up(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/lib")
    store.commit({"config": spark.createDataFrame([("k", "0")], schemas.CONFIG)})
    pointer = (tmp_path / "lib" / "CURRENT").read_bytes()
    check = (tmp_path / "lib" / ".CURRENT.crc").read_bytes()
    store.commit({"config": spark.createDataFrame([("k", "1")], schemas.CONFIG)})
    (tmp_path / "lib" / "CURRENT").write_bytes(pointer)  # its writer ended before it came to this
    (tmp_path / "lib" / ".CURRENT.crc").write_bytes(check)
    assert store.read("config", schemas.CONFIG).first().value == "1"
    store.commit({"other": spark.createDataFrame([("k", "2")], schemas.CONFIG)})
    assert set(store.current()) == {"config", "other"} and store.view().number == 3


def test_writers_at_work_are_spared(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/lib")
    store.commit({"config": spark.createDataFrame([("k", "0")], schemas.CONFIG)})
    spark.createDataFrame([("k", "1")], schemas.CONFIG).write.parquet(f"file://{tmp_path}/lib/config/atwork")
    (tmp_path / "lib" / "_writing").mkdir(exist_ok=True)
    (tmp_path / "lib" / "_writing" / "atwork").write_bytes(b"")
    assert store.vacuum() == 0 and store.vacuum(abandoned=-1.0) == 1
