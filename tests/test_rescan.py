"""Listings, rescans of a folder, control from outside, previews of raw files, pages."""

from __future__ import annotations

import struct

import pytest
from glimmer import schemas
from glimmer.functions import images
from glimmer.operators import ingest, metadata
from glimmer.plans.text_index import TextIndex
from glimmer.sources import files
from glimmer.sources.snapshots import Snapshots
from glimmer.streaming import ingest as stream
from pyspark.sql import functions as F


def put(root, *names, data=b"x"):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(data)


@pytest.mark.parametrize("walk", [1000, 2])
def test_names_that_begin_with_anything(spark, tmp_path, monkeypatch, walk):
    monkeypatch.setattr(files, "WALK", walk)
    put(tmp_path, "a/x.jpg", "a/_DSC1.nef", "_dir/w.jpg", "_MG_2.CR2", "a/b/c/d/e.png", "a/b/=x.jpg", "é ü/1.jpg", ".h/x.jpg", "a/.x.jpg")
    want = sorted(str(tmp_path / n) for n in ("a/x.jpg", "a/_DSC1.nef", "_dir/w.jpg", "_MG_2.CR2", "a/b/c/d/e.png", "a/b/=x.jpg", "é ü/1.jpg"))
    for root in (str(tmp_path), f"{tmp_path}/"):
        assert sorted(r.path for r in files.listed(spark, root).collect()) == want
    one = files.listed(spark, str(tmp_path)).where(F.col("path").endswith("_DSC1.nef")).first()
    assert (one["size"], one.mtime) == (1, (tmp_path / "a/_DSC1.nef").stat().st_mtime)
    assert sorted(r.path for r in files.contents(spark, f"file://{tmp_path}").collect()) == want
    assert files.single(spark, f"{tmp_path}/a/_DSC1.nef", str(tmp_path)).count() == 1
    assert files.listed(spark, str(tmp_path / "none")).count() == 0


def processed(df):
    """A stand-in for models: a vector from the size; files named bad fail."""
    failed = F.col("relative_path").contains("bad")
    return df.select("photo_id", "relative_path", "mtime", F.when(~failed, F.array(F.col("size").cast("float"))).alias("embedding"), F.lit(None).cast("string").alias("phash"), F.lit(None).cast("string").alias("thumbnail_path"), F.when(failed, "unreadable").alias("error"))


def test_rescans_take_each_file_once(spark, tmp_path):
    root, store = tmp_path / "photos", Snapshots(spark, f"file://{tmp_path}/lib")
    put(root, *(f"d{i % 3}/_{i}.jpg" for i in range(20)), "bad.jpg", "d0/_0.nef")
    seen: list[dict] = []

    def run(batch=10_000, **kw):
        seen.clear()
        return stream.rescan(spark, str(root), store, processed, lambda: 5.0, batch, progress=seen.append, poll=0.01, **kw)

    # told to stop before the first batch, then after one of three, then to go on
    stream.control(store, stream.CANCEL)
    assert run(8)["state"] == "cancelled" and store.read("photos", schemas.PHOTOS).count() == 0
    stream.control(store, "run")

    def stop(state, n=[0]):
        n[0] += 1
        if n[0] == 1:
            stream.control(store, stream.CANCEL)

    first = stream.rescan(spark, str(root), store, processed, lambda: 5.0, 8, progress=stop)
    assert first["state"] == "cancelled" and 0 < first["scanned"] < first["total"] == 21
    stream.control(store, stream.PAUSE)
    seen.clear()

    def waited(state):
        if state["state"] == "paused":
            seen.append(state)
            stream.control(store, "run")

    rest = stream.rescan(spark, str(root), store, processed, lambda: 5.0, 8, progress=waited, poll=0.01)
    assert len(seen) == 1 and rest["state"] == "done"
    assert rest["total"] in (21 - first["processed"], 22 - first["processed"]) and rest["percent"] == 100
    assert first["processed"] + rest["processed"] == 20 and store.read("dead", schemas.PROCESSED).count() == 1
    # nothing new but the failure; then a changed, a new and a deleted file
    again = run()
    assert (again["total"], again["errors"], again["processed"]) == (1, 1, 0)
    put(root, "d0/_3.jpg", "new/y.jpg", data=b"longer")
    (root / "d1/_1.jpg").unlink()
    later = run(prune=True)
    assert (later["processed"], later["errors"]) == (2, 1)
    photos = {r.path for r in store.read("photos", schemas.PHOTOS).collect()}
    assert len(photos) == 20 and "new/y.jpg" in photos and "d1/_1.jpg" not in photos and "d0/_0.jpg" not in photos
    assert store.read("vectors", schemas.VECTORS).count() == 20 and TextIndex(store).note is not None
    assert ingest.missing(store.read("photos", schemas.PHOTOS).withColumnRenamed("path", "relative_path"), ingest.scanned(files.listed(spark, str(root)), str(root))).count() == 0


def jpeg(body: bytes, thumbnail: bytes = b"") -> bytes:
    app1 = b"Exif\0\0" + thumbnail
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda\x00\x04\x01\x01" + body.replace(b"\xff", b"\xff\x00") + b"\xff\xd3" + body.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def test_previews_of_raw_files():
    small = jpeg(b"t" * 20)
    big = jpeg(b"\xffscan\xff" * 400, thumbnail=small)
    assert images.embedded_preview(b"raw" * 9 + big + b"rest" + small) == big
    assert images.jpeg_end(big, 0) == len(big) and images.jpeg_end(big[:-9], 0) is None
    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        # a first directory with a strip of raw data and a sub-directory that names the preview, and a decoy after it
        def directory(*entries, after=0, order=order):
            return struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHII", *e) for e in entries) + struct.pack(order + "I", after)

        sub = 8 + len(directory((0x014A, 4, 1, 0), (0x0111, 4, 1, 9), (0x0117, 4, 1, 4)))
        at = sub + len(directory((0x0201, 4, 1, 0), (0x0202, 4, 1, 0)))
        head = mark + struct.pack(order + "I", 8) + directory((0x014A, 4, 1, sub), (0x0111, 4, 1, 9), (0x0117, 4, 1, 4), after=8)
        raw = head + directory((0x0201, 4, 1, at), (0x0202, 4, 1, len(big))) + big + jpeg(b"decoy" * 2000)
        assert images.embedded_preview(raw) == big
        assert images.embedded_preview(raw[:at] + b"\0" * 50 + small) == small  # a named place without a JPEG
    raf = b"FUJIFILMCCD-RAW".ljust(84, b"\0") + struct.pack(">II", 100, len(big)) + b"\0" * 8 + big
    assert images.embedded_preview(raf) == big
    assert images.embedded_preview(b"nothing") is None and images.embedded_preview(b"II*\0\xff\xff\xff\xff") is None


def test_pages_of_an_ordered_copy(spark, tmp_path):
    df = spark.range(0, 5000, 2).withColumn("x", F.lit("y")).repartition(5)
    path = metadata.ordered_copy(df, f"file://{tmp_path}/copy", "id")
    pages = list(metadata.pages_of_copy(spark, path, "id", 700))
    assert [len(p) for p in pages] == [700, 700, 700, 400] and [r.id for p in pages for r in p] == list(range(0, 5000, 2))
    rest = list(metadata.pages_of_copy(spark, path, "id", 700, after=pages[1][-1].id))
    assert rest == pages[2:]
    assert [len(p) for p in metadata.paged(df, "id", 1000)] == [1000, 1000, 500]
