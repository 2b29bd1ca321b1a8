"""Images as rows, checkpoints, purges, pages, and what may not pass silently."""

from __future__ import annotations

import numpy as np
import pytest
from glimmer import api, schemas
from glimmer.functions import images as pixels
from glimmer.models import hashing_embedder
from glimmer.operators import duplicates, images, ingest, metadata, vector
from glimmer.options import Options
from glimmer.sources import files
from glimmer.sources.checkpoints import Checkpoint
from glimmer.sources.snapshots import Snapshots
from glimmer.streaming import ingest as stream


def picture(seed: int, height: int, width: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    return np.kron(r.integers(0, 255, (4, 5, 3)), np.ones((height // 4, width // 5, 1))).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pictures")
    for i, (h, w) in enumerate([(40, 50), (400, 500), (800, 1000)]):
        (at / f"p{i}.ppm").write_bytes(pixels.ppm_encoded(picture(1, h, w)))
    (at / "other.ppm").write_bytes(pixels.ppm_encoded(picture(2, 40, 50)))
    (at / "bad.ppm").write_bytes(b"P6 5 5 255\nshort")
    return at


def test_images_as_rows(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in images.described(files.contents(spark, str(folder)), side=100).collect()}
    assert (got["p2.ppm"].width, got["p2.ppm"].height, got["p2.ppm"].small_width, got["p2.ppm"].small_height) == (1000, 800, 100, 80)
    assert len(got["p2.ppm"].pixels) == 100 * 80 * 3 and got["bad.ppm"].error == "no pixels"

    def apart(a, b):
        return (int(got[a].phash, 16) ^ int(got[b].phash, 16)).bit_count()

    assert apart("p0.ppm", "p2.ppm") <= 10 < apart("p0.ppm", "other.ppm")


def test_thumbnails_are_written_once(spark, folder, tmp_path):
    from pyspark.sql import functions as F

    rows = files.contents(spark, str(folder)).withColumn("photo_id", F.element_at(F.split("path", "/"), -1))
    for _ in range(2):
        made = images.thumbnails(rows, f"file://{tmp_path}/cache", encode=pixels.ppm_encoded, side=50).collect()
        assert sorted(r.photo_id for r in made if r.error is None) == ["other.ppm", "p0.ppm", "p1.ppm", "p2.ppm"]
    cached = files.thumbnails(spark, f"{tmp_path}/cache")
    assert {r.photo_id for r in cached.collect()} == {"other.ppm", "p0.ppm", "p1.ppm", "p2.ppm"}
    small = pixels.ppm_decoded((tmp_path / "cache" / "p2.ppm.webp").read_bytes())
    assert small.shape == (40, 50, 3) and np.abs(small.astype(int) - picture(1, 40, 50)).max() <= 1
    assert [r.photo_id for r in images.missing_thumbnails(rows.select("photo_id"), cached).collect()] == ["bad.ppm"]


def test_checkpoints(spark, tmp_path):
    c = Checkpoint(spark, f"file://{tmp_path}/run")
    assert c.status() is None and c.read() is None
    done = spark.createDataFrame([("a",), ("b",), ("b",)], "relative_path string")
    assert c.write(done, 8) == {"processed_count": 2, "total_count": 8, "percent": 25, "complete": False}
    assert {r[0] for r in c.read().collect()} == {"a", "b"}
    c.write(done, 2, complete=True)
    assert c.read() is None and c.status()["complete"]
    (tmp_path / "run" / "CURRENT").write_text("{")
    assert c.status() is None and c.read() is None
    c.clear()
    assert c.status() is None


def test_damaged_pointers_are_errors(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/lib")
    s.commit({"config": spark.createDataFrame([("k", "v")], schemas.CONFIG)})
    (tmp_path / "lib" / "CURRENT").write_text("not json")
    with pytest.raises(ValueError, match="damaged"):
        s.commit({"other": spark.createDataFrame([("k", "v")], schemas.CONFIG)})


def test_vectors_of_other_lengths_are_errors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", None)], "id string, embedding array<float>")
    for distance in vector.METRICS:
        with pytest.raises(Exception, match="lengths"):
            vector.topk(v, [1.0, 0.0], "id", distance=distance).collect()
    assert vector.checked(v, 3).count() == 2
    with pytest.raises(Exception, match="collection of 2"):
        vector.checked(v, 2).collect()
    with pytest.raises(ValueError):
        vector.checked(v, 3, distance="Manhattan")


def test_versions_of_a_path_in_one_batch(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/lib")
    batch = spark.createDataFrame([("A", "p.jpg", 1.0, [1.0], None, None, None), ("B", "p.jpg", 2.0, [2.0], None, None, None)], schemas.PROCESSED)
    stream.merged(store, batch, 5.0)
    from pyspark.sql import functions as F

    photos = store.read("photos", schemas.PHOTOS)
    assert [r.photo_id for r in photos.collect()] == ["B"]
    store.commit({"photos": photos.withColumn("caption", F.lit("a dog")), "fts": spark.createDataFrame([("B", "a dog")], schemas.FTS)})
    stream.merged(store, batch, 6.0)
    assert [(r.photo_id, r.caption) for r in store.read("photos", schemas.PHOTOS).collect()] == [("B", "a dog")]
    assert [tuple(r) for r in store.read("fts", schemas.FTS).collect()] == [("B", "a dog")]
    stream.merged(store, spark.createDataFrame([("C", "p.jpg", 3.0, [3.0], None, None, None)], schemas.PROCESSED), 7.0)
    assert [r.photo_id for r in store.read("photos", schemas.PHOTOS).collect()] == ["C"]
    assert store.read("fts", schemas.FTS).count() == 0


def test_purge_and_pages(spark):
    photos = spark.createDataFrame([("1", "a/x.CR2"), ("2", "a/x.jpg"), ("3", "b/x.jpg")], "photo_id string, path string")
    texts, vectors = photos.select("photo_id"), photos.where("photo_id <> '2'").select("photo_id")
    *kept, report = ingest.purged(photos, texts, vectors)
    assert [sorted(r.photo_id for r in t.collect()) for t in kept] == [["1", "3"]] * 3
    assert tuple(report.first()) == (1, 1, 0)
    assert [[r.photo_id for r in p] for p in metadata.paged(photos, "photo_id", 2)] == [["1", "2"], ["3"]]


def test_copies_are_grouped_without_pairs(spark):
    rows = [(i, "0" * 16) for i in range(50)] + [(60, "0" * 15 + "3"), (70, "f" * 16), (80, "f" * 16), (90, "5" * 16)]
    df = spark.createDataFrame(rows, "id long, h string")
    got = {r.id: r.component for r in duplicates.near_groups(df, "id", "h", 2, 16).collect()}
    assert got == {**{i: 0 for i in range(50)}, 60: 0, 70: 70, 80: 70}
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert {tuple(r) for r in duplicates.connected(edges).collect()} == {tuple(r) for r in duplicates.connected(edges, small=0).collect()}


def test_search_by_image_and_stems(spark, folder):
    embed = hashing_embedder(8)
    content = {n: (folder / f"{n}.ppm").read_bytes() for n in ("p0", "p1", "other")}
    photos = spark.createDataFrame([(n, f"{n}.ppm", 1.0, "dogs running" if n == "p0" else None, None, None, None, None) for n in content], schemas.PHOTOS)
    vectors = spark.createDataFrame([(n, [float(x) for x in embed([c])[0]]) for n, c in content.items() if n != "p1"], schemas.VECTORS)
    texts = spark.createDataFrame([("p0", "dogs running")], schemas.FTS)
    lib = api.Library(photos, vectors, texts, embed=embed, embed_image=embed, options=Options(photo_root=str(folder)))
    assert lib.like_file(f"{folder}/p0.ppm", mode="vector").first().photo_id == "p0"
    assert [r.photo_id for r in lib.search("dog runs", mode="text").collect()] == ["p0"]
    assert lib.similar("p1.ppm").count() >= 1
