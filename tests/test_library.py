"""The library without the corpus operators."""

from __future__ import annotations

import math
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer import api, models, schemas
from glimmer.functions import hashes, images, paths, porter
from glimmer.functions import text as T
from glimmer.operators import duplicates, fusion, ingest, merge, metadata, vector
from glimmer.options import Options, limited
from glimmer.plans import fts, text_index
from glimmer.sources import files
from glimmer.sources.snapshots import Snapshots


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


# --- text


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("", ""),
        (" ,;! ", ""),
        ("red sunset", "red sunset"),
        ("it's a b-c", '"it\'s" a "b-c"'),
        ('say "hi"', 'say """hi"""'),
        ("red OR blue, green", "red OR blue, green"),
        ("OR", "OR"),
        ("well, known: thing?", "well known thing"),
        ("e.g. x", '"e.g." x'),
    ],
)
def test_normalized_query(spark, query, want):
    assert fts.normalized(query) == want
    assert one(spark, query, T.normalized_query) == want


def test_tags(spark):
    text = "The photo shows a Red car, a red house and two trees; trees' shade. " + " ".join(f"word{chr(97 + i)}" for i in range(26))
    found = one(spark, text, T.tags)
    assert found[:6] == ["red", "car", "house", "two", "trees", "shade"] and len(found) == 20


@pytest.mark.parametrize(("text", "want"), [("<CAPTION> a cat </caption>", "a cat"), ("<X>a\ncat</X> b ", "a\ncat b"), ("plain", "plain"), ("<CAPTION>a\nb</CAPTION><CAPTION>c</CAPTION>", "a\nb")])
def test_parsed_output(spark, text, want):
    assert one(spark, text, lambda c: T.parsed_output(c, "<CAPTION>")) == want


def test_caption_text(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", ""), (None, "b"), ("", None)], "c string, t string")
    assert [r[0] for r in rows.select(T.caption_text(F.col("c"), F.col("t"))).collect()] == ["a b", "a", "b", None]


STEMS = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat troubling:troubl sized:size hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat vietnamization:vietnam hopefulness:hope triplicate:triplic electrical:electr revival:reviv adoption:adopt probate:probat rate:rate controll:control dying:dy generously:gener photographer:photograph 2024s:2024 be:be"


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    word, want = pair.split(":")
    assert porter.stem(word) == want


QUERIES = ["sunset", "sunset beach", "sunset OR mountain", "sunset NOT beach", '"red sunset"', "moun*", "(sunset OR mountain) AND beach", "running", "cafe", "sunset sunset", "NEAR(red beach, 2)", '"red sunset" OR run*']


def test_search_agrees_with_fts5(spark):
    r = random.Random(7)
    words = "red sunset beach mountain running runs ran café cafe photography photographer ocean blue tree trees hills hill".split()
    rows = [(f"id{i}", " ".join(r.choice(words) for _ in range(r.randrange(1, 25)))) for i in range(120)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(photo_id, text, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "photo_id string, text string")
    for q in QUERIES:
        want = dict(con.execute("SELECT photo_id, -bm25(f) FROM f WHERE f MATCH ?", (q,)).fetchall())
        got = {x.photo_id: x.score for x in fts.search(df, q, "photo_id", limit=1000, stem=True).collect()}
        assert set(got) == set(want), q
        if "NEAR" not in q:
            assert all(math.isclose(got[k], want[k], rel_tol=1e-6, abs_tol=1e-9) for k in want), q


@pytest.mark.parametrize("query", ["", "AND", "NOT x", "(a", "a)", "R&B", "x@y", '"a'])
def test_strict_queries_fail(query):
    with pytest.raises(fts.QueryError):
        fts.parse(query, strict=True)


def test_lenient_queries(spark):
    df = spark.createDataFrame([(1, "r b"), (2, "x y")], "id long, text string")
    assert [r.id for r in fts.search(df, "R&B", "id").collect()] == [1]
    assert fts.search(df, "", "id").count() == 0
    assert fts.search(df, " ?! ", "id").count() == 0


def test_index(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "id long, text string")
    terms, lengths = fts.build_index(df, "id")
    assert sorted(tuple(r) for r in terms.collect()) == [(1, "a", 2), (1, "b", 1)]
    assert sorted(tuple(r) for r in lengths.collect()) == [(1, 3), (2, 0)]


def test_stored_index_equals_scan(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    df = rows.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "runs a b a b a"), (-4, "running a c b")], rows.schema))
    for stem in (False, True):
        path = text_index.write(df, str(tmp_path / f"index{stem}"), "doc_id", stem=stem)
        for q in ("run", "runs NOT c", '"a b"', '"a b a"', "NEAR(a b, 0)", 'NEAR("a b" runs, 2)', "ru* OR the", "text: a", "title: a", "title: a OR c", "the the", "nowhere", "", " ?! ", "and OR (licensed AND the)"):
            want = [(r.doc_id, round(r.score, 9)) for r in fts.search(df, q, "doc_id", limit=500, stem=stem).collect()]
            assert [(r.doc_id, round(r.score, 9)) for r in text_index.search(spark, path, q, "doc_id", limit=500).collect()] == want, (stem, q)


def test_stored_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id string, text string")
    path = text_index.write(df, str(tmp_path / "index"), "id")
    found = text_index.search(spark, path, "a", "id")
    assert found.count() == 0 and found.schema["id"].dataType.simpleString() == "string"
    with pytest.raises(fts.QueryError):
        text_index.search(spark, path, "a AND", "id", strict=True)


# --- vectors and fusion


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(f"p{i}", [float(x) for x in np.random.default_rng(i).normal(size=8)]) for i in range(50)]
    return spark.createDataFrame([*rows, ("zero", [0.0] * 8)], schemas.VECTORS)


def test_topk(vectors):
    rows = {r.photo_id: np.array(r.embedding, float) for r in vectors.collect()}
    q = rows["p3"]
    want = sorted(rows, key=lambda k: (-(rows[k] @ q / (np.linalg.norm(rows[k]) * np.linalg.norm(q)) if rows[k].any() else 0.0), k))
    got = vector.topk(vectors, q, "photo_id", limit=60).collect()
    assert [r.photo_id for r in got] == want and [r.rank for r in got] == list(range(1, 52))
    page = vector.topk(vectors, q, "photo_id", limit=5, offset=5).collect()
    assert [r.photo_id for r in page] == want[5:10] and page[0]["rank"] == 1
    assert vector.topk(vectors, q, "photo_id", limit=0).count() == 51
    near = vector.topk(vectors, q, "photo_id", distance="Euclid", threshold=2.0).collect()
    assert near[0].photo_id == "p3" and all(r.score <= 2 for r in near)
    assert vector.metric("nonsense") == vector.METRICS["Cosine"]


def test_many_queries_in_blocks(vectors):
    queries = vectors.selectExpr("photo_id AS q", "embedding")
    whole = sorted(tuple(r) for r in vector.topk_many(vectors, queries, "photo_id", "q", limit=3).collect())
    parts = sorted(tuple(r) for r in vector.topk_many(vectors, queries, "photo_id", "q", limit=3, block=20).collect())
    assert [r[:2] for r in whole] == [r[:2] for r in parts] and len(whole) == 51 * 3
    for i in (0, 7):
        alone = vector.similar(vectors, "photo_id", f"p{i}", limit=3).collect()
        assert [r.photo_id for r in alone] == [r[1] for r in sorted((x for x in whole if x[0] == f"p{i}"), key=lambda x: x[3])]


def test_rrf_order(spark):
    def ranked(ids):
        return spark.createDataFrame([(x, 1.0 / i, i) for i, x in enumerate(ids, 1)], "id string, score double, rank long")

    a, b = ["x", "y", "z", "w"], ["w", "z", "q"]
    sums: dict = {}
    for ids in (a, b):
        for i, x in enumerate(ids, 1):
            sums[x] = sums.get(x, 0.0) + 1 / (60 + i)
    want = sorted(sums, key=lambda x: -sums[x])
    got = fusion.rrf([ranked(a), ranked(b)], "id", 0).orderBy(*fusion.order(2)).collect()
    assert [r.id for r in got] == want and all(math.isclose(r.score, sums[r.id]) for r in got)
    assert fusion.widened(500) == (500, 200) and fusion.widened(10, 50, 20) == (50, 20)


# --- merges


def test_upsert_folds_in_order(spark):
    r = random.Random(1)

    def row(i, s=None):
        maybe = [r.choice([None, "", f"v{r.randrange(9)}"]) for _ in range(4)]
        return (f"k{i}", *maybe, *([s] if s is not None else []))

    old, new = [row(i) for i in range(0, 40, 2)], [row(r.randrange(40), s) for s in range(150)]
    state = {k: list(v) for k, *v in old}
    for k, path, mtime, caption, tag, _ in new:
        before = state.get(k, [None] * 4)
        state[k] = [path, mtime, caption if caption is not None else before[2], tag if tag is not None else before[3]]
    schema = "photo_id string, path string, mtime string, caption string, tags string"
    args = ("photo_id", ["path", "mtime"], ["caption", "tags"], "s")
    table, changes = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema + ", s long")
    once = merge.upsert(table, changes, *args)
    assert {k: v for k, *v in map(tuple, once.collect())} == state
    assert {k: v for k, *v in map(tuple, merge.upsert(once, changes, *args).collect())}.keys() == state.keys()


def test_text_follows_merged_rows(spark):
    photos = spark.createDataFrame([("a", "cap", "tag"), ("b", "", None), ("c", "x", None)], "photo_id string, caption string, tags string")
    texts = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "x")], schemas.FTS)
    changed = photos.where("photo_id <> 'c'")
    assert sorted(map(tuple, merge.refreshed_text(texts, photos, changed).collect())) == [("a", "cap tag"), ("c", "x")]


# --- ingest


def test_scan(spark, tmp_path):
    names = ["a/IMG_1.CR2", "a/IMG_1.jpg", "a/IMG_2.JPG", "a/IMG_3.Cr2", "a/IMG_3.jpg", "b/IMG_1.png", ".hidden/x.jpg", "b/.x.jpg", "b/notes.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x" * len(n))
    found = ingest.scanned(files.listed(spark, str(tmp_path)), str(tmp_path))
    kept = ingest.without_shadowed(found)
    assert sorted(r.relative_path for r in kept.collect()) == ["a/IMG_1.CR2", "a/IMG_2.JPG", "a/IMG_3.Cr2", "a/IMG_3.jpg", "b/IMG_1.png"]
    assert [r.relative_path for r in ingest.shadowed(found).collect()] == ["a/IMG_1.jpg"]
    assert ingest.without_shadowed(found, skip=False).count() == 6
    assert {f.name for f in found.schema} == {f.name for f in schemas.SCANNED}
    assert files.single(spark, f"{tmp_path}/a/IMG_1.jpg", str(tmp_path)).count() == 0
    assert files.single(spark, f"{tmp_path}/a/IMG_2.JPG", str(tmp_path)).count() == 1


def test_portable_ids(spark):
    import xxhash

    rows = spark.createDataFrame([("a/b.jpg", 12, 1700000000.123), ("é", 0, 1e17)], "p string, s long, m double")
    got = [r[0] for r in rows.select(hashes.photo_id_portable(F.col("p"), F.col("s"), F.col("m"))).collect()]
    assert got == [xxhash.xxh64_hexdigest("a/b.jpg121700000000.123"), xxhash.xxh64_hexdigest("é01e+17")]


def test_paths(spark):
    assert one(spark, "a/b.jpg", lambda c: paths.absolute(c, "C:\\x\\")) == "C:\\x\\a\\b.jpg"
    assert one(spark, "a/b.jpg", lambda c: paths.absolute(c, "/x//")) == "/x/a/b.jpg"
    assert one(spark, "c:\\X\\a\\b.jpg", lambda c: paths.relative(c, "C:\\x")) == "a/b.jpg"
    assert one(spark, "/y/a", lambda c: paths.relative(c, "/x")) is None
    assert one(spark, "a b/ä", T.percent_encoded) == "a%20b%2F%C3%A4"
    times = spark.createDataFrame([(5.9,), (65.0,), (3600.0,), (7325.0,)], "s double")
    assert [r[0] for r in times.select(paths.duration(F.col("s"))).collect()] == ["5s", "1m 5s", "1h 0m", "2h 2m"]


def test_stream_is_idempotent(spark, tmp_path):
    from glimmer.streaming import ingest as stream

    store = Snapshots(spark, f"file://{tmp_path}/index")
    source, check = f"file://{tmp_path}/in", f"file://{tmp_path}/check"
    good = [("p1", "a.jpg", 1.0, [1.0, 0.0], "00", None, None), ("p2", "b.jpg", 1.0, None, None, None, "unreadable")]
    spark.createDataFrame(good, schemas.PROCESSED).write.parquet(source + "/1")

    def go():
        stream.stream(spark, source + "/*", schemas.PROCESSED, lambda df: df, store, check, lambda: 5.0).awaitTermination()

    go()
    assert [r.photo_id for r in store.read("photos", schemas.PHOTOS).collect()] == ["p1"]
    assert [r.photo_id for r in store.read("dead", schemas.PROCESSED).collect()] == ["p2"]
    stream.merged(store, spark.createDataFrame(good, schemas.PROCESSED), 5.0)
    spark.createDataFrame([("p3", "a.jpg", 2.0, [0.0, 1.0], "11", None, None), ("p2", "b.jpg", 2.0, [1.0, 1.0], "22", None, None)], schemas.PROCESSED).write.parquet(source + "/2")
    go()
    assert sorted(r.photo_id for r in store.read("photos", schemas.PHOTOS).collect()) == ["p2", "p3"]
    assert sorted(r.photo_id for r in store.read("vectors", schemas.VECTORS).collect()) == ["p2", "p3"]
    assert store.read("dead", schemas.PROCESSED).count() == 0
    store.vacuum()
    assert store.read("photos", schemas.PHOTOS).count() == 2
    store.clear()
    assert store.read("photos", schemas.PHOTOS).count() == 0


# --- duplicates


def test_duplicates(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        base = random.Random(i % 12).getrandbits(256)
        for k in r.sample(range(256), r.randrange(0, 9)):
            base ^= 1 << k
        rows.append((i, f"{base:064x}"))
    rows += [(100, rows[0][1]), (101, None), (102, "short")]
    df = spark.createDataFrame(rows, "id long, h string")
    clean = [(i, int(h, 16)) for i, h in rows if h and len(h) == 64]
    want = {(a, b, (x ^ y).bit_count()) for a, x in clean for b, y in clean if a < b and (x ^ y).bit_count() <= 10}
    pairs = duplicates.similar_pairs(df, "id", F.col("h"))
    assert {tuple(p) for p in pairs.collect()} == want
    root = {i: i for i, _ in clean}
    for _ in root:
        for a, b, _ in want:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.id: x.component for x in duplicates.connected(pairs).collect()}
    assert got == {i: root[i] for p in want for i in p[:2]}
    assert all(len(g.ids) > 1 for g in duplicates.groups(pairs).collect())


def test_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in duplicates.connected(edges).collect()} == {0}


# --- models, images, options


def test_out_of_memory_ladder():
    def embed(items):
        if len(items) > 40 or "bad" in items:
            raise MemoryError
        return np.ones((len(items), 2))

    found, size = models.in_batches(["x"] * 100 + ["bad"] + ["x"] * 20, embed)
    assert [i for i, v in enumerate(found) if v is None] == [100] and len(found) == 121 and size >= 32


def test_embedding_failures_become_rows(spark):
    def load():
        def embed(items):
            if "boom" in items:
                raise ValueError("boom")
            return models.hashing_embedder(8)(items)

        return embed

    rows = spark.createDataFrame([(1, "a b"), (2, "boom"), (3, None), (4, "c")], "id long, t string").coalesce(1)
    got = {r.id: r for r in models.embedded(rows, "id", "t", load, name="failing").collect()}
    assert got[2].error == "boom" and got[3].embedding is None and got[1].error is None
    assert math.isclose(sum(x * x for x in got[4].embedding), 1, rel_tol=1e-6)


def test_captions(spark):
    def load():
        return lambda items: [("" if x == "none" else f"a {x}", f"the {x} and the {x} house") for x in items]

    rows = spark.createDataFrame([(1, "cat"), (2, "none")], "id long, c string")
    got = {r.id: r for r in models.captioned(rows, "id", "c", load).collect()}
    assert got[1].caption == "a cat" and got[1].tags == ["cat", "house"] and got[2].caption is None


def test_orientation_and_size():
    p = np.arange(6).reshape(2, 3)
    assert images.oriented(p, 6).tolist() == [[3, 0], [4, 1], [5, 2]]
    assert images.oriented(p, 8).tolist() == [[2, 5], [1, 4], [0, 3]]
    for o in (2, 3, 4, 5, 7):
        assert images.oriented(images.oriented(p, o), o).tolist() == p.tolist()
    assert images.oriented(p, 9) is p
    tiff = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    assert images.exif_orientation(tiff) == 6 and images.exif_orientation(b"") == 1
    jpeg = b"\xff\xd8\xff\xe1" + (8 + len(tiff)).to_bytes(2, "big") + b"Exif\0\0" + tiff
    assert images.exif_orientation(jpeg) == 6
    assert images.fitted_size(1000, 333, 512) == (512, 170) and images.fitted_size(300, 200, 512) == (300, 200)
    assert images.embedded_preview(b"xx\xff\xd8\xff1\xff\xd9yy\xff\xd8\xff22\xff\xd9") == b"\xff\xd8\xff22\xff\xd9"
    assert images.decoded(b"not an image") is None


def test_phash_of_alike_images():
    r = np.random.default_rng(0)
    x = np.cumsum(np.cumsum(r.normal(size=(180, 180)), 0), 1)
    x = 255 * (x - x.min()) / (x.max() - x.min())
    a, b, c = images.phash(x), images.phash(x + r.normal(0, 0.5, x.shape)), images.phash(r.integers(0, 255, x.shape))

    def distance(p, q):
        return (int(p, 16) ^ int(q, 16)).bit_count()

    assert len(a) == 64 and distance(a, b) <= 10 < distance(a, c)


def test_options(tmp_path):
    f = tmp_path / "o.json"
    f.write_text('{"rrf_k": 10, "batch": 7, "unknown": 1}')
    assert Options.load(f, {"GLIMMER_BATCH": "9", "GLIMMER_SKIP_SHADOWED": "no"}, results=5) == Options(rrf_k=10, batch=9, skip_shadowed=False, results=5)
    assert Options.load(tmp_path / "none.json", {}) == Options()
    for bad in (0, 501):
        with pytest.raises(ValueError):
            limited(bad)


def test_library(spark, vectors):
    photos = spark.createDataFrame([(f"p{i}", f"d/{i}.jpg", 1.0, f"photo of tree {i}" if i % 2 else None, None, None, 1.0, None) for i in range(40)], schemas.PHOTOS)
    texts = photos.where("caption IS NOT NULL").select("photo_id", F.col("caption").alias("text"))
    lib = api.Library(photos, vectors, texts, spark.createDataFrame([("p1", 10)], "photo_id string, size long"), models.hashing_embedder(8), Options(photo_root="/r"))
    hits = lib.search("tree", limit=10).collect()
    assert len(hits) == 10 and all(h.absolute_path is None or h.absolute_path.startswith("/r/") for h in hits)
    assert {h.photo_id for h in lib.search("tree", limit=50, mode="text").collect()} == {f"p{i}" for i in range(1, 40, 2)}
    assert lib.similar("d/3.jpg", 5).first().photo_id == "p3"
    with pytest.raises(LookupError):
        lib.similar("none")
    with pytest.raises(ValueError):
        lib.search("x", limit=501)
    assert lib.photo("p2").first().absolute_path == "/r/d/2.jpg"
    assert tuple(lib.stats().first()) == (40, 20, 51, 1, 10)
    assert lib.search("tree", limit=50, mode="text").where("photo_id = 'p1'").first().thumbnail_url == "/thumbnail/p1"
    import json

    body = json.loads(api.response("tree", lib.search("tree", limit=3)).first().json)
    assert body["total"] == 3 and body["results"][0]["score"] >= body["results"][-1]["score"]
    assert metadata.uncaptioned(photos, limit=3).count() == 3


def test_library_with_an_index(spark, vectors, tmp_path):
    photos = spark.createDataFrame([(f"p{i}", f"d/{i}.jpg", 1.0, "photos of trees" if i % 2 else "a tree, photographed", None, None, 1.0, None) for i in range(12)], schemas.PHOTOS)
    texts = photos.select("photo_id", F.col("caption").alias("text"))
    path = text_index.write(texts, str(tmp_path / "index"), "photo_id", stem=True)
    scanned, indexed = (api.Library(photos, vectors, texts, embed=models.hashing_embedder(8), index=i) for i in (None, path))
    for query, mode in (("tree", "text"), ("photo trees", "hybrid"), ("tree & photo", "text"), ("none", "text")):
        assert [tuple(r) for r in indexed.search(query, mode=mode).collect()] == [tuple(r) for r in scanned.search(query, mode=mode).collect()]
