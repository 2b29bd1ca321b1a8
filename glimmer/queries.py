"""The library's registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.functions import hashes, paths
from glimmer.functions import text as T
from glimmer.operators import duplicates, fusion, ingest, merge, metadata, vector
from glimmer.operators.vector_store import VectorStore
from glimmer.plans import fts
from glimmer.plans.text_index import TextIndex
from glimmer.sources.parts import Keyed
from glimmer.sources.scratch import scratch_path
from glimmer.sources.snapshots import Snapshots

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- vectors -----------------------------------------------------------------------------------------------------


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _topk_sql(score: str, descending: bool, at: int = 0, limit: int = 50, offset: int = 0, where: str = "", after: str = "") -> str:
    way = "DESC" if descending else "ASC"
    return f"""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {at}),
s AS (SELECT vec_id, {score} AS raw FROM embeddings, q {where}),
p AS (SELECT * FROM s ORDER BY raw {way}, vec_id LIMIT {limit} OFFSET {offset})
SELECT vec_id, round(raw, 6) AS score, row_number() OVER (ORDER BY raw {way}, vec_id) AS rank FROM p {after}"""


COS, DOT, L2 = "list_cosine_similarity(embedding::DOUBLE[], v)", "list_inner_product(embedding::DOUBLE[], v)", "list_distance(embedding::DOUBLE[], v)"


@query(_topk_sql(COS, True))
def vector_topk_cosine(spark, sf):
    v = vec(spark, sf)
    return rounded(vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id", limit=50), "score")


@query(_topk_sql(DOT, True))
def vector_topk_dot(spark, sf):
    v = vec(spark, sf)
    return rounded(vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id", distance="Dot", limit=50), "score")


@query(_topk_sql(L2, False))
def vector_topk_l2(spark, sf):
    v = vec(spark, sf)
    return rounded(vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id", distance="Euclid", limit=50), "score")


@query(_topk_sql(COS, True, limit=200, after="WHERE raw >= 0.2"))
def vector_threshold(spark, sf):
    v = vec(spark, sf)
    return rounded(vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id", threshold=0.2), "score")


@query(_topk_sql(L2, False, limit=200, after="WHERE raw <= 1.3"))
def vector_threshold_l2(spark, sf):
    v = vec(spark, sf)
    return rounded(vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id", distance="Euclid", threshold=1.3), "score")


@query(_topk_sql(COS, True, limit=10, offset=20))
def vector_page_offset(spark, sf):
    v = vec(spark, sf)
    return rounded(vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id", limit=10, offset=20), "score")


@query(_topk_sql(COS, True, at=7, limit=20))
def similar_by_id(spark, sf):
    return rounded(vector.similar(vec(spark, sf), "vec_id", 7, limit=20), "score")


@query(_topk_sql(COS, True, at=7, limit=20, where="WHERE vec_id <> 7"))
def similar_excluding_self(spark, sf):
    return rounded(vector.similar(vec(spark, sf), "vec_id", 7, limit=20, exclude_self=True), "score")


@query("SELECT vec_id, 0.0::DOUBLE AS score, 0::BIGINT AS rank FROM embeddings WHERE false")
def similar_unknown_id(spark, sf):
    return vector.similar(vec(spark, sf), "vec_id", -1)


@query("""
WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first,
  round(sqrt(list_inner_product(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))), list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))))), 6) AS length
FROM s""")
def vector_normalize(spark, sf):
    tripled = vec(spark, sf).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 3).alias("v"))
    unit = tripled.select("vec_id", vector.normalized(F.col("v")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(vector.norm(F.col("u")), 6).alias("length"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1)
SELECT vec_id, CASE WHEN label = 0 THEN 0.0 ELSE round(list_cosine_similarity(embedding::DOUBLE[], v), 6) END AS score FROM embeddings, q""")
def zero_vector_cosine(spark, sf):
    v = vec(spark, sf)
    q = F.array(*(F.lit(float(x)) for x in vector.stored_vector(v, "vec_id", 1)))
    zeroed = F.when(F.col("label") == 0, F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 0)).otherwise(F.col("embedding").cast("array<double>"))
    return v.select("vec_id", F.round(vector.cosine(zeroed, q), 6).alias("score"))


_stores: dict[tuple[str, str, str], VectorStore] = {}


def _store(spark: SparkSession, sf: str, metric: str, changed: bool = False) -> VectorStore:
    """The stored clusters of embeddings, written once a session; changed: after a batch of negated vectors and deletes."""
    place = spark.sparkContext.applicationId, sf, f"{metric} {changed}"
    if place not in _stores:
        v = vec(spark, sf)
        made = VectorStore(Snapshots(spark, scratch_path(spark, "vector_store"))).rebuild(v, "vec_id", metric=metric)
        if changed:
            new = v.where("label < 3").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
            made = made.upsert(new, "vec_id", removed=v.where("label = 9").select("vec_id"))
        _stores[place] = made
    return _stores[place]


def _pruned(metric: str, distance: str, changed: bool = False) -> Query:
    def run(spark, sf):
        q = vector.stored_vector(vec(spark, sf), "vec_id", 0)
        return rounded(_store(spark, sf, metric, changed).topk(q, "vec_id", distance, limit=50), "score")

    return run


for _name, _metric, _distance, _score, _down in (("cosine", "Cosine", "Cosine", COS, True), ("dot", "Euclid", "Dot", DOT, True), ("l2", "Euclid", "Euclid", L2, False)):
    QUERIES[f"stored_vector_{_name}"], ORACLES[f"stored_vector_{_name}"] = _pruned(_metric, _distance), _topk_sql(_score, _down)
QUERIES["stored_vector_changed"] = _pruned("Euclid", "Euclid", True)
ORACLES["stored_vector_changed"] = f"""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
e AS (SELECT vec_id, CASE WHEN label < 3 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE label <> 9),
p AS (SELECT vec_id, {L2} AS raw FROM e, q ORDER BY raw, vec_id LIMIT 50)
SELECT vec_id, round(raw, 6) AS score, row_number() OVER (ORDER BY raw, vec_id) AS rank FROM p"""


@query("""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS raw FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(raw, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_topk_many(spark, sf):
    """Every row whose id is divisible by 20 as a query, against all rows."""
    v = vec(spark, sf)
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rounded(vector.topk_many(v, queries, "vec_id", "query_id", limit=10), "score")


@query("SELECT label, count(*) AS vectors, min(len(embedding))::BIGINT AS dimension FROM embeddings GROUP BY label")
def vector_counts(spark, sf):
    return vec(spark, sf).groupBy("label").agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).cast("long").alias("dimension"))


# --- full text ---------------------------------------------------------------------------------------------------


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


TOKENS = f"regexp_extract_all(translate(lower(text), '{T.MARKED}', '{T.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(counts: dict[str, str], holds: str, scored: list[str], limit: int = 200) -> str:
    columns = ", ".join(f"({sql})::DOUBLE AS {name}" for name, sql in counts.items())
    stats = ", ".join(f"count(*) FILTER (WHERE {c} > 0) AS {c}_df" for c in counts)

    def part(c: str) -> str:
        idf = f"ln((total - {c}_df + 0.5) / ({c}_df + 0.5))"
        return f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * ({c} * 2.2 / ({c} + 1.2 * (0.25 + 0.75 * dl / average)))"

    return f"""
WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents),
c AS (SELECT doc_id, len(w) + 1 AS dl, {columns} FROM t),
s AS (SELECT count(*) AS total, avg(dl) AS average, {stats} FROM c),
h AS (SELECT doc_id, {' + '.join(part(c) for c in scored)} AS raw FROM c, s WHERE {holds})
SELECT doc_id, round(raw, 6) AS score FROM h ORDER BY raw DESC, doc_id LIMIT {limit}"""


def _count(word: str) -> str:
    return f"len(list_filter(w, lambda x: x = '{word}'))"


def _bm25(query_text: str, limit: int = 200, **kw) -> Query:
    def run(spark, sf):
        return rounded(fts.search(docs(spark, sf), query_text, "doc_id", limit=limit, **kw), "score")

    return run


_PHRASE = "len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"
for _name, _query, _sql in (
    ("text_bm25_and", "the and that", _bm25_sql({"a": _count("the"), "b": _count("and"), "c": _count("that")}, "a > 0 AND b > 0 AND c > 0", ["a", "b", "c"])),
    ("text_bm25_or", "licensed OR pathetic OR clown", _bm25_sql({"a": _count("licensed"), "b": _count("pathetic"), "c": _count("clown")}, "a > 0 OR b > 0 OR c > 0", ["a", "b", "c"])),
    ("text_bm25_not", "the NOT this", _bm25_sql({"a": _count("the"), "b": _count("this")}, "a > 0 AND NOT b > 0", ["a"])),
    ("text_bm25_nested", "(clown OR idiot) AND the NOT licensed", _bm25_sql({"a": _count("clown"), "b": _count("idiot"), "c": _count("the"), "d": _count("licensed")}, "(a > 0 OR b > 0) AND c > 0 AND NOT d > 0", ["a", "b", "c"])),
    ("text_bm25_repeated", "clown clown", _bm25_sql({"a": _count("clown")}, "a > 0", ["a", "a"])),
    ("text_bm25_folded", "ÈTRE", _bm25_sql({"a": _count("etre")}, "a > 0", ["a"])),
    ("text_phrase", '"of the"', _bm25_sql({"a": _PHRASE}, "a > 0", ["a"])),
    ("text_prefix", "theat*", _bm25_sql({"a": "len(list_filter(w, lambda x: starts_with(x, 'theat')))"}, "a > 0", ["a"])),
    (
        "text_near",
        "NEAR(clown the, 3)",
        _bm25_sql({"a": _count("clown"), "b": _count("the"), "n": "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'clown' AND list_contains(w[greatest(i - 4, 1):i + 4], 'the')))"}, "a > 0 AND b > 0 AND n > 0", ["a", "b"]),
    ),
):
    QUERIES[_name] = _bm25(_query)
    ORACLES[_name] = _sql
QUERIES["text_bm25_porter"] = _bm25("licenses OR rights", stem=True)


_indexes: dict[tuple[str, str, str], TextIndex] = {}


def _index(spark: SparkSession, sf: str, stem: bool = False) -> TextIndex:
    """The stored index of documents, written once a session to the folder all executors share."""
    place = spark.sparkContext.applicationId, sf, f"stem {stem}"
    if place not in _indexes:
        _indexes[place] = TextIndex(Snapshots(spark, scratch_path(spark, "text_index"))).rebuild(docs(spark, sf), "doc_id", stem=stem)
    return _indexes[place]


def _maintained(spark: SparkSession, sf: str) -> TextIndex:
    """An index of two thirds of the documents after a batch: the others come, a fifth of all texts change, some go."""
    place = spark.sparkContext.applicationId, sf, "maintained"
    if place not in _indexes:
        rows = docs(spark, sf).select("doc_id", "text")
        first = TextIndex(Snapshots(spark, scratch_path(spark, "maintained"))).rebuild(rows.where("doc_id % 3 <> 0"), "doc_id")
        later = rows.where("(doc_id % 3 = 0 OR doc_id % 5 = 1) AND doc_id % 11 <> 4").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("clown of the and that "), F.col("text"))).otherwise(F.col("text")))
        _indexes[place] = first.upsert(later, "doc_id", removed=rows.where("doc_id % 11 = 4").select("doc_id"))
    return _indexes[place]


_MAINTAINED = "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'clown of the and that ' || text ELSE text END AS text FROM documents WHERE doc_id % 11 <> 4)"


def _stored(query_text: str, stem: bool = False) -> Query:
    def run(spark, sf):
        return rounded(_index(spark, sf, stem).search(query_text, "doc_id"), "score")

    return run


def _after_batches(query_text: str) -> Query:
    def run(spark, sf):
        return rounded(_maintained(spark, sf).search(query_text, "doc_id"), "score")

    return run


for _name, _query in (
    ("and", "the and that"),
    ("or", "licensed OR pathetic OR clown"),
    ("not", "the NOT this"),
    ("nested", "(clown OR idiot) AND the NOT licensed"),
    ("repeated", "clown clown"),
    ("folded", "ÈTRE"),
):
    QUERIES[f"stored_text_{_name}"], ORACLES[f"stored_text_{_name}"] = _stored(_query), ORACLES[f"text_bm25_{_name}"]
for _name, _query in (("phrase", '"of the"'), ("prefix", "theat*"), ("near", "NEAR(clown the, 3)")):
    QUERIES[f"stored_text_{_name}"], ORACLES[f"stored_text_{_name}"] = _stored(_query), ORACLES[f"text_{_name}"]
for _name, _query in (("bm25_and", "the and that"), ("bm25_or", "licensed OR pathetic OR clown"), ("bm25_not", "the NOT this"), ("phrase", '"of the"'), ("prefix", "theat*")):
    QUERIES[f"maintained_text_{_name}"], ORACLES[f"maintained_text_{_name}"] = _after_batches(_query), ORACLES[f"text_{_name}"].replace("FROM documents", _MAINTAINED)
QUERIES["stored_text_column"] = _stored("text: clown OR title: the")
ORACLES["stored_text_column"] = _bm25_sql({"a": _count("clown"), "b": "0 * len(w)"}, "a > 0 OR b > 0", ["a", "b"])


@query("SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false")
def text_empty_query(spark, sf):
    return fts.search(docs(spark, sf), "", "doc_id")


@query(f"""
WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t GROUP BY term""")
def text_index_terms(spark, sf):
    postings, _ = fts.build_index(docs(spark, sf), "doc_id")
    return postings.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").cast("long").alias("occurrences"))


@query(f"SELECT doc_id, len({TOKENS})::BIGINT AS dl FROM documents")
def text_index_lengths(spark, sf):
    return fts.build_index(docs(spark, sf), "doc_id")[1].select("doc_id", F.col("dl").cast("long").alias("dl"))


# --- fusion ------------------------------------------------------------------------------------------------------

_VEC_LIST = "SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS raw FROM embeddings"
_TEXT_LIST = _bm25_sql({"a": _count("the"), "b": _count("and")}, "a > 0 AND b > 0", ["a", "b"]).replace("round(raw, 6) AS score", "raw")


def _lists(spark, sf, offset: int = 0, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    v = vec(spark, sf)
    near = vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id", limit=200, offset=offset, threshold=threshold).withColumnRenamed("vec_id", "id")
    found = vector.ranked(_index(spark, sf).search("the and", "doc_id", limit=200), "doc_id").withColumnRenamed("doc_id", "id")
    return near, found


def _fused_sql(tail: str, offset: int = 0, after: str = "") -> str:
    return f"""
WITH v0 AS ({_VEC_LIST}), v1 AS (SELECT * FROM v0 ORDER BY raw DESC, id LIMIT 200 OFFSET {offset}),
v AS (SELECT id, raw AS score, row_number() OVER (ORDER BY raw DESC, id) AS rank FROM v1 {after}),
x1 AS ({_TEXT_LIST}), x AS (SELECT doc_id AS id, raw AS score, row_number() OVER (ORDER BY raw DESC, doc_id) AS rank FROM x1),
f AS (SELECT coalesce(v.id, x.id) AS id, coalesce(1.0 / (60 + v.rank), 0) + coalesce(1.0 / (60 + x.rank), 0) AS raw, v.score AS vs, v.rank AS vr, x.score AS ts, x.rank AS tr FROM v FULL JOIN x ON v.id = x.id)
{tail}"""


_PAGE = "SELECT id, round(raw, 6) AS score, round(vs, 6) AS vector_score, vr AS vector_rank, round(ts, 6) AS text_score, tr AS text_rank FROM f ORDER BY raw DESC, vr NULLS LAST, tr NULLS LAST, id LIMIT 50"


@query(_fused_sql("SELECT id, round(raw, 6) AS score, vr AS rank_1, tr AS rank_2 FROM f"))
def rrf_fuse_two(spark, sf):
    return rounded(fusion.rrf(list(_lists(spark, sf)), "id"), "score")


@query(_fused_sql("""
, e AS (SELECT user_id AS id, row_number() OVER (ORDER BY sum(value) DESC, user_id) AS rank FROM events GROUP BY user_id), e2 AS (SELECT * FROM e WHERE rank <= 200)
SELECT coalesce(f.id, e2.id) AS id, round(coalesce(raw, 0) + coalesce(1.0 / (60 + e2.rank), 0), 6) AS score, vr AS rank_1, tr AS rank_2, e2.rank AS rank_3 FROM f FULL JOIN e2 ON f.id = e2.id"""))
def rrf_fuse_three(spark, sf):
    spent = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.sum("value").alias("score"))
    third = vector.ranked(spent.orderBy(F.col("score").desc(), "id").limit(200), "id")
    return rounded(fusion.rrf([*_lists(spark, sf), third], "id"), "score")


@query(_fused_sql(_PAGE))
def hybrid_search(spark, sf):
    return rounded(fusion.hybrid(*_lists(spark, sf), "id", 50), "score", "vector_score", "text_score")


@query(_fused_sql(_PAGE, offset=50))
def hybrid_offset(spark, sf):
    return rounded(fusion.hybrid(*_lists(spark, sf, offset=50), "id", 50), "score", "vector_score", "text_score")


@query(_fused_sql(_PAGE, after="WHERE raw >= 0.1"))
def hybrid_threshold(spark, sf):
    return rounded(fusion.hybrid(*_lists(spark, sf, threshold=0.1), "id", 50), "score", "vector_score", "text_score")


@query(_fused_sql("SELECT id, round(raw, 6) AS score FROM f ORDER BY raw DESC, vr NULLS LAST, tr NULLS LAST, id LIMIT 25 OFFSET 25"))
def hybrid_fused_page(spark, sf):
    return rounded(fusion.merged_page(*_lists(spark, sf), "id", 25, 25).select("id", "score"), "score")


@query(_fused_sql("SELECT id, round(score, 6) AS score, NULL::DOUBLE AS vector_score, NULL::BIGINT AS vector_rank, round(score, 6) AS text_score, rank AS text_rank FROM x ORDER BY rank LIMIT 50"))
def hybrid_mode_text(spark, sf):
    return rounded(fusion.hybrid(None, _lists(spark, sf)[1], "id", 50), "score", "vector_score", "text_score")


@query(_fused_sql("SELECT id, round(score, 6) AS score, round(score, 6) AS vector_score, rank AS vector_rank, NULL::DOUBLE AS text_score, NULL::BIGINT AS text_rank FROM v ORDER BY rank LIMIT 50"))
def hybrid_mode_vector(spark, sf):
    return rounded(fusion.hybrid(_lists(spark, sf)[0], None, "id", 50), "score", "vector_score", "text_score")


@query(_fused_sql(f", p AS ({_PAGE}) SELECT p.*, d.lang AS caption, d.source AS tags FROM p LEFT JOIN documents d ON d.doc_id = p.id"))
def image_plus_text(spark, sf):
    """A reference vector and a text, fused, with metadata."""
    page = fusion.hybrid(*_lists(spark, sf), "id", 50)
    photos = docs(spark, sf).select("doc_id", F.col("lang").alias("caption"), F.col("source").alias("tags"))
    return rounded(fusion.with_metadata(page, photos, "id", "doc_id", ["caption", "tags"]), "score", "vector_score", "text_score")


# --- metadata ----------------------------------------------------------------------------------------------------

#: documents as photos: labelled ones have a caption, an empty one where quality is 0.
_PHOTOS = """SELECT d.doc_id AS photo_id, d.source || '/' || d.doc_id AS path, d.n_chars::DOUBLE AS mtime,
  CASE WHEN l.quality = 1 THEN d.lang WHEN l.quality = 0 THEN '' END AS caption, CASE WHEN l.toxic = 1 THEN 'toxic' END AS tags, md5(d.text) AS phash
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""


def photos(spark: SparkSession, sf: str) -> DataFrame:
    joined = docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    caption = F.when(F.col("quality") == 1, F.col("lang")).when(F.col("quality") == 0, F.lit(""))
    return joined.select(F.col("doc_id").alias("photo_id"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("n_chars").cast("double").alias("mtime"), caption.alias("caption"), F.when(F.col("toxic") == 1, "toxic").alias("tags"), F.md5("text").alias("phash"))


@query(f"WITH h AS ({_topk_sql(COS, True, limit=200)}), p AS ({_PHOTOS}) SELECT vec_id, score, rank, path, caption, tags FROM h LEFT JOIN p ON p.photo_id = h.vec_id")
def metadata_left_join(spark, sf):
    v = vec(spark, sf)
    hits = vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id")
    return rounded(fusion.with_metadata(hits, photos(spark, sf), "vec_id", "photo_id", ["path", "caption", "tags"]), "score")


@query(f"SELECT * FROM ({_PHOTOS}) WHERE photo_id = 11")
def photo_by_id(spark, sf):
    return metadata.by_key(photos(spark, sf), 11)


@query(f"SELECT * FROM ({_PHOTOS}) WHERE path = 'src3/23'")
def photo_by_path(spark, sf):
    return metadata.by_path(photos(spark, sf), "src3/23")


@query(f"SELECT photo_id FROM ({_PHOTOS}) WHERE nullif(caption, '') IS NULL")
def uncaptioned(spark, sf):
    return metadata.uncaptioned(photos(spark, sf))


@query(f"SELECT count(*) AS photos, count(nullif(caption, '')) AS captioned FROM ({_PHOTOS})")
def count_stats(spark, sf):
    return metadata.counts(photos(spark, sf))


@query(f"""SELECT (SELECT count(*) FROM documents) AS photos, (SELECT count(nullif(caption, '')) FROM ({_PHOTOS})) AS captioned, (SELECT count(*) FROM embeddings) AS vectors,
  count(*) AS thumbnails, sum(strlen(html))::BIGINT AS thumbnail_bytes FROM pages""")
def index_stats(spark, sf):
    thumbnails = table(spark, sf, "pages").select("page_id", F.octet_length("html").cast("long").alias("size"))
    return metadata.index_stats(photos(spark, sf), vec(spark, sf), thumbnails)


@query("SELECT url, max(page_id) AS page_id FROM pages GROUP BY url")
def path_to_id_map(spark, sf):
    return metadata.paths_to_ids(table(spark, sf, "pages"), "url", "page_id")


@query("SELECT DISTINCT source AS path FROM documents")
def all_paths(spark, sf):
    return docs(spark, sf).select(F.col("source").alias("path")).distinct()


@query("SELECT vec_id FROM embeddings UNION SELECT doc_id FROM documents")
def all_ids(spark, sf):
    return vec(spark, sf).select("vec_id").union(docs(spark, sf).select("doc_id")).distinct()


@query(f"SELECT a.photo_id AS photo_id, b.photo_id AS other FROM ({_PHOTOS}) a JOIN ({_PHOTOS}) b ON a.phash = b.phash AND a.photo_id = 11")
def phash_exact(spark, sf):
    p = photos(spark, sf)
    row = metadata.by_key(p, 11).select("phash").first()
    return metadata.exact_hash(p, row[0] if row else "").select(F.lit(11).cast("long").alias("photo_id"), F.col("photo_id").alias("other"))


@query("SELECT l.doc_id AS photo_id, row_number() OVER (ORDER BY l.doc_id) AS number FROM labels l WHERE quality = 1 ORDER BY l.doc_id LIMIT 100 OFFSET 100")
def page_numbers(spark, sf):
    """The second page of 100, numbered over all rows."""
    page = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("photo_id")).orderBy("photo_id").offset(100).limit(100)
    return page.withColumn("number", (F.row_number().over(Window.orderBy("photo_id")) + 100).cast("long"))


# --- upserts -----------------------------------------------------------------------------------------------------

_KEY = "user_id::VARCHAR || ':' || event_type"
_EVENTS = f"""SELECT {_KEY} AS photo_id, event_id, props AS path, value AS mtime,
  CASE WHEN value > 50 THEN event_type END AS caption, CASE WHEN value < 10 THEN '' WHEN value < 40 THEN props END AS tags FROM events"""


def changes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("photo_id"), "event_id", F.col("props").alias("path"), v.alias("mtime"), F.when(v > 50, F.col("event_type")).alias("caption"), F.when(v < 10, "").when(v < 40, F.col("props")).alias("tags")
    )


_FOLD = """SELECT photo_id, arg_max(struct_pack(path := path, mtime := mtime), event_id) AS l, arg_max(caption, event_id) FILTER (WHERE caption IS NOT NULL) AS caption, arg_max(tags, event_id) FILTER (WHERE tags IS NOT NULL) AS tags FROM c WHERE {} GROUP BY photo_id"""
_MERGED = f"""WITH c AS ({_EVENTS}), m AS (SELECT median(event_id) AS cut FROM events),
o AS ({_FOLD.format("event_id < (SELECT cut FROM m)")}), n AS ({_FOLD.format("event_id >= (SELECT cut FROM m)")}),
u AS (SELECT coalesce(n.photo_id, o.photo_id) AS photo_id, CASE WHEN n.photo_id IS NOT NULL THEN n.l.path ELSE o.l.path END AS path, CASE WHEN n.photo_id IS NOT NULL THEN n.l.mtime ELSE o.l.mtime END AS mtime,
  coalesce(n.caption, o.caption) AS caption, coalesce(n.tags, o.tags) AS tags FROM o FULL JOIN n ON o.photo_id = n.photo_id)"""


def _halves(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The older half of the changes folded into a table, and the newer half as they come."""
    c = changes(spark, sf)
    cut = c.agg(F.median("event_id")).first()[0]
    old = merge.folded(c.where(F.col("event_id") < cut), "photo_id", "event_id", ["path", "mtime"], ["caption", "tags"])
    return old, c.where(F.col("event_id") >= cut)


def _upserted(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    old, new = _halves(spark, sf)
    return merge.upsert(old, new, "photo_id", ["path", "mtime"], ["caption", "tags"], "event_id"), old, new


@query(f"{_MERGED} SELECT * FROM u")
def upsert_merge(spark, sf):
    return _upserted(spark, sf)[0]


@query(f"{_MERGED} SELECT * FROM u")
def bucket_upsert(spark, sf):
    """The same through a table in buckets by key: older changes, then newer ones, each batch writing its buckets."""
    old, new = _halves(spark, sf)
    store = Snapshots(spark, scratch_path(spark, "buckets"))
    table_ = Keyed(store, "photos", old.schema, "photo_id", 16)
    settings = (["path", "mtime"], ["caption", "tags"])
    return table_.upsert(old, *settings).upsert(merge.folded(new, "photo_id", "event_id", *settings), *settings).rows()


@query(f"{_MERGED} SELECT * FROM u WHERE photo_id NOT IN (SELECT {_KEY} FROM events WHERE value < 5)")
def delete_photos(spark, sf):
    gone = changes(spark, sf).where("mtime < 5").select("photo_id")
    return merge.deleted(_upserted(spark, sf)[0], gone, "photo_id")


_TEXT = "nullif(concat_ws(' ', nullif(caption, ''), nullif(tags, '')), '')"


@query(f"""{_MERGED}, f AS (SELECT photo_id, {_TEXT} AS text FROM u WHERE photo_id IN (SELECT photo_id FROM n)), k AS (SELECT photo_id, {_TEXT} AS text FROM o WHERE photo_id NOT IN (SELECT photo_id FROM n))
SELECT * FROM f WHERE text IS NOT NULL UNION ALL SELECT * FROM k WHERE text IS NOT NULL""")
def fts_refresh(spark, sf):
    table_, old, new = _upserted(spark, sf)
    before = old.select("photo_id", T.caption_text(F.col("caption"), F.col("tags")).alias("text")).where("text IS NOT NULL")
    return merge.refreshed_text(before, table_, new)


@query("""WITH n AS (SELECT event_type AS key, arg_max(props, event_id) AS value FROM events GROUP BY event_type), o AS (SELECT r_name AS key, r_regionkey::VARCHAR AS value FROM region)
SELECT key, value FROM n UNION ALL SELECT key, value FROM o WHERE key NOT IN (SELECT key FROM n)""")
def config_upsert(spark, sf):
    old = table(spark, sf, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    new = table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("props").alias("value"), "event_id")
    return merge.upsert(old, new, "key", ["value"], [], "event_id")


@query("""WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: -x) AS e FROM embeddings WHERE label < 3)
SELECT vec_id, round(e[1]::DOUBLE, 6) AS first FROM n UNION ALL SELECT vec_id, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n)""")
def vector_upsert(spark, sf):
    old = vec(spark, sf).select("vec_id", "embedding")
    new = vec(spark, sf).where("label < 3").select("vec_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    return merge.replaced(old, new, "vec_id").select("vec_id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def vector_delete(spark, sf):
    gone = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("vec_id"))
    return merge.deleted(vec(spark, sf).select("vec_id", "label"), gone, "vec_id")


# --- ingest ------------------------------------------------------------------------------------------------------

#: parts as files: folder by size, stem by a number that several share, suffix by brand and type.
_EXTS = ["JPG", "jpg", "CR2", "cr2", "Cr2", "png", "txt", "nef", "webp"]
_FILES_SQL = (
    "SELECT 'd' || p_size || '/IMG_' || (p_partkey % 977) || '.' || (['" + "', '".join(_EXTS) + "'])[(p_partkey // 7 % 9 + 1)::INTEGER] AS relative_path, p_partkey AS size, p_retailprice AS mtime FROM part"
)
_SUFFIX_SQL = "lower(regexp_extract(relative_path, '(\\.[^./]+)$', 1))"
_JPEGS, _RAWS = "('.jpg', '.jpeg', '.png', '.webp')", "('.arw', '.cr2', '.cr3', '.dng', '.nef', '.orf', '.raf', '.rw2')"
_RAW_WRITTEN = "regexp_matches(relative_path, '\\.(arw|cr2|cr3|dng|nef|orf|raf|rw2|ARW|CR2|CR3|DNG|NEF|ORF|RAF|RW2)$')"
_STEM = "regexp_replace(relative_path, '\\.[^./]+$', '')"


def files(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.get(F.array(*map(F.lit, _EXTS)), (F.floor(F.col("p_partkey") / 7) % 9).cast("int"))
    path = F.concat(F.lit("d"), "p_size", F.lit("/IMG_"), F.col("p_partkey") % 977, F.lit("."), ext)
    return table(spark, sf, "part").select(path.alias("relative_path"), F.col("p_partkey").alias("size"), F.col("p_retailprice").alias("mtime"))


@query(f"SELECT relative_path, size, {_SUFFIX_SQL} AS extension FROM ({_FILES_SQL}) WHERE {_SUFFIX_SQL} IN {_JPEGS} OR {_SUFFIX_SQL} IN {_RAWS}")
def extension_filter(spark, sf):
    f = files(spark, sf).withColumnRenamed("relative_path", "path")
    return ingest.scanned(f).select("relative_path", "size", "extension")


@query(f"WITH f AS ({_FILES_SQL}), r AS (SELECT DISTINCT {_STEM} AS s FROM f WHERE {_RAW_WRITTEN}) SELECT * FROM f WHERE NOT ({_SUFFIX_SQL} IN {_JPEGS} AND {_STEM} IN (SELECT s FROM r))")
def raw_jpeg_skip(spark, sf):
    return ingest.without_shadowed(files(spark, sf))


@query(f"WITH f AS ({_FILES_SQL}), r AS (SELECT DISTINCT {_STEM} AS s FROM f WHERE {_RAW_WRITTEN}) SELECT * FROM f WHERE {_SUFFIX_SQL} IN {_JPEGS} AND {_STEM} IN (SELECT s FROM r)")
def raw_jpeg_purge(spark, sf):
    return ingest.shadowed(files(spark, sf))


@query(f"WITH f AS ({_FILES_SQL}), a AS (SELECT relative_path FROM f WHERE size % 7 = 2 UNION SELECT relative_path FROM f WHERE size % 10 = 3) SELECT * FROM f WHERE relative_path NOT IN (SELECT relative_path FROM a)")
def skip_set(spark, sf):
    f = files(spark, sf)
    return ingest.pending(f, f.where("size % 7 = 2"), f.where("size % 10 = 3"))


_STORED = f"SELECT relative_path, max(size)::VARCHAR AS photo_id FROM ({_FILES_SQL}) GROUP BY relative_path"


def _stored(spark, sf) -> DataFrame:
    return files(spark, sf).groupBy("relative_path").agg(F.max("size").cast("string").alias("photo_id"))


def _rescanned(spark, sf) -> DataFrame:
    """Stored files, those before a price changed, and orders' clerks as new ones."""
    f = _stored(spark, sf).withColumn("photo_id", F.when(F.length("photo_id") > 3, F.concat("photo_id", F.lit("x"))).otherwise(F.col("photo_id")))
    new = table(spark, sf, "supplier").select(F.concat(F.lit("new/"), "s_name", F.lit(".jpg")).alias("relative_path"), F.col("s_suppkey").cast("string").alias("photo_id"))
    return f.unionByName(new)


_RESCAN = f"SELECT relative_path, CASE WHEN length(photo_id) > 3 THEN photo_id || 'x' ELSE photo_id END AS photo_id FROM ({_STORED}) UNION ALL SELECT 'new/' || s_name || '.jpg', s_suppkey::VARCHAR FROM supplier"


@query(f"SELECT * FROM ({_RESCAN}) EXCEPT SELECT * FROM ({_STORED})")
def changed_files(spark, sf):
    return ingest.changed(_rescanned(spark, sf), _stored(spark, sf))


@query(f"SELECT DISTINCT s.photo_id FROM ({_STORED}) s JOIN ({_RESCAN}) r ON s.relative_path = r.relative_path AND s.photo_id <> r.photo_id")
def id_replacement(spark, sf):
    return ingest.superseded(_rescanned(spark, sf), _stored(spark, sf))


@query(f"SELECT * FROM ({_STORED}) WHERE relative_path NOT IN (SELECT relative_path FROM ({_FILES_SQL}) WHERE size % 10 <> 3)")
def missing_prune(spark, sf):
    return ingest.missing(_stored(spark, sf), files(spark, sf).where("size % 10 <> 3"))


_OUTCOME = "SELECT count(*) AS scanned, count(*) FILTER (WHERE value >= 5 AND value < 90) AS processed, count(*) FILTER (WHERE value >= 90) AS skipped, count(*) FILTER (WHERE value < 5) AS errors FROM events"


@query(_OUTCOME)
def ingest_outcomes(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events").select(F.when(v < 5, "unreadable").alias("error"), F.when(v < 90, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    return ingest.outcomes(rows)


@query("SELECT event_id, event_type FROM events WHERE value < 5")
def dead_letters(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("value") < 5, "unreadable").alias("error"))
    return ingest.dead_letters(rows)[1].select("event_id", "event_type")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 60 THEN floor(o_totalprice)::BIGINT || 's' WHEN o_totalprice < 3600 THEN floor(o_totalprice / 60)::BIGINT || 'm ' || floor(o_totalprice)::BIGINT % 60 || 's'
  ELSE floor(o_totalprice / 3600)::BIGINT || 'h ' || floor(o_totalprice / 60)::BIGINT % 60 || 'm' END AS eta FROM orders""")
def eta_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", paths.duration(F.col("o_totalprice")).alias("eta"))


@query("SELECT count(*) AS processed_count, (SELECT count(*) FROM orders) AS total_count, floor(100 * count(*) / (SELECT count(*) FROM orders))::BIGINT AS percent FROM orders WHERE o_orderstatus = 'F'")
def checkpoint_progress(spark, sf):
    orders = table(spark, sf, "orders")
    return ingest.progress(orders.where("o_orderstatus = 'F'"), orders.count())


@query("SELECT event_type, count(*) AS n, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS rate FROM events WHERE value < 90 GROUP BY event_type")
def throughput(spark, sf):
    """Rows a second, skipped ones not counted."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf, "events").where("value < 90").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / (F.max(t) - F.min(t)), 6).alias("rate"))


# --- near duplicates ---------------------------------------------------------------------------------------------

_BITS = "list_reduce(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > list_median(embedding::DOUBLE[]) THEN '1' ELSE '0' END), lambda a, b: a || b)"
_HASHED = f"SELECT vec_id, {_BITS} AS bits FROM embeddings"
_NEAR = f"h AS ({_HASHED}), n AS (SELECT a.vec_id AS a, b.vec_id AS b, hamming(a.bits, b.bits)::BIGINT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id)"


def hashed(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with a 64-bit hash: which components exceed the median."""
    return vec(spark, sf).select("vec_id", hashes.bits_to_hex(hashes.median_bits(F.col("embedding").cast("array<double>")), 64).alias("phash"))


@query(f"WITH {_NEAR} SELECT a, b, distance FROM n WHERE distance <= 18")
def hamming_pairs(spark, sf):
    return duplicates.similar_pairs(hashed(spark, sf), "vec_id", F.col("phash"), 18, 16)


@query("SELECT a.doc_id AS a, b.doc_id AS b, 0::BIGINT AS distance FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id")
def similar_hash_pairs(spark, sf):
    """256-bit hashes at the usual threshold of 10: equal texts only, as digests of others are far apart."""
    rows = docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("phash"))
    return duplicates.similar_pairs(rows, "doc_id", F.col("phash"))


@query(f"""WITH RECURSIVE {_NEAR}, e AS (SELECT a, b FROM n WHERE distance <= 18 UNION SELECT b, a FROM n WHERE distance <= 18),
r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other) SELECT id, min(other) AS component FROM r GROUP BY id""")
def duplicate_groups(spark, sf):
    return duplicates.near_groups(hashed(spark, sf), "vec_id", F.col("phash"), 18, 16)


_WIDE = f"SELECT vec_id * 10 + i AS id, CASE WHEN i = 0 THEN b ELSE substr(b, 1, 40 * i) || CASE WHEN b[40 * i + 1] = '1' THEN '0' ELSE '1' END || substr(b, 40 * i + 2) END AS bits FROM (SELECT vec_id, bits || reverse(bits) || bits || reverse(bits) AS b FROM ({_HASHED})), range(3) t(i)"


@query(f"WITH w AS ({_WIDE}) SELECT a.id AS a, b.id AS b, hamming(a.bits, b.bits)::BIGINT AS distance FROM w a JOIN w b ON a.id < b.id AND hamming(a.bits, b.bits) <= 10")
def hamming_pairs_wide(spark, sf):
    """256-bit hashes, each with two neighbours that differ in a bit."""
    half = hashes.median_bits(F.col("embedding").cast("array<double>"))
    wide = vec(spark, sf).select("vec_id", F.concat(half, F.reverse(half), half, F.reverse(half)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    flipped = F.when(F.expr("substr(b, 40 * i + 1, 1)") == "1", "0").otherwise("1")
    bits = F.when(F.col("i") == 0, F.col("b")).otherwise(F.concat(F.expr("substr(b, 1, 40 * i)"), flipped, F.expr("substr(b, 40 * i + 2)")))
    rows = wide.select((F.col("vec_id") * 10 + F.col("i")).alias("id"), hashes.bits_to_hex(bits, 256).alias("phash"))
    return duplicates.similar_pairs(rows, "id", F.col("phash"))


@query(f"""WITH RECURSIVE {_NEAR}, e AS (SELECT a, b FROM n WHERE distance <= 18 UNION SELECT b, a FROM n WHERE distance <= 18),
r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other), c AS (SELECT id, min(other) AS component FROM r GROUP BY id)
SELECT component, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids, count(*) AS n FROM c GROUP BY component HAVING count(*) > 1""")
def duplicate_members(spark, sf):
    found = duplicates.members(duplicates.near_groups(hashed(spark, sf), "vec_id", F.col("phash"), 18, 16))
    return found.select("component", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query(f"""WITH f AS (SELECT relative_path, min(size) AS photo_id FROM ({_FILES_SQL}) GROUP BY relative_path), r AS (SELECT DISTINCT {_STEM} AS s FROM f WHERE {_RAW_WRITTEN}),
g AS (SELECT photo_id FROM f WHERE {_SUFFIX_SQL} IN {_JPEGS} AND {_STEM} IN (SELECT s FROM r))
SELECT (SELECT count(*) FROM g) AS photos, (SELECT count(*) FROM g WHERE photo_id % 2 = 0) AS texts, (SELECT count(*) FROM g WHERE photo_id % 3 = 0) AS vectors""")
def purge_report(spark, sf):
    photos = files(spark, sf).groupBy("relative_path").agg(F.min("size").alias("photo_id"))
    ids = photos.select("photo_id")
    return ingest.purged(photos, ids.where("photo_id % 2 = 0"), ids.where("photo_id % 3 = 0"), "relative_path")[3]


@query("SELECT doc_id, lang FROM documents WHERE doc_id > 40 ORDER BY doc_id LIMIT 25")
def key_page(spark, sf):
    """The page after a key: full scans go on from the last key they have seen."""
    return metadata.page_after(docs(spark, sf).select("doc_id", "lang"), "doc_id", 40, 25)


# --- captions, queries, paths ------------------------------------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TAGS = f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains([{_STOPS}], x)) AS w FROM documents),
t AS (SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:20] AS tags FROM w)"""


@query(f"{_TAGS} SELECT doc_id, array_to_string(tags, ',') AS tags, len(tags)::BIGINT AS n FROM t")
def extract_tags(spark, sf):
    found = docs(spark, sf).select("doc_id", T.tags(F.col("text")).alias("t"))
    return found.select("doc_id", F.array_join("t", ",").alias("tags"), F.size("t").cast("long").alias("n"))


@query(f"{_TAGS} SELECT doc_id, array_to_string(tags, ' ') AS tags FROM t")
def join_tags(spark, sf):
    return docs(spark, sf).select("doc_id", T.joined_tags(T.tags(F.col("text"))).alias("tags"))


@query("""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<h1>(.*?)</h1>') THEN regexp_replace(regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1), '^\\s+|\\s+$', '', 'g')
  ELSE regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') END AS output FROM pages""")
def parse_output(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.parsed_output(F.col("html"), "<H1>").alias("output"))


_ESCAPED = "CASE WHEN regexp_matches(x, '[\"''()*+,:^.-]') THEN '\"' || replace(x, '\"', '\"\"') || '\"' ELSE x END"
_CLEAN_WORDS = f"list_filter(regexp_split_to_array(regexp_replace(text, '[,;:!?]+', ' ', 'g'), '\\s+'), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT doc_id, text AS q, {_CLEAN_WORDS} AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) > 1 AND list_has_any(w, ['AND', 'OR', 'NOT']) THEN q ELSE array_to_string(list_transform(w, lambda x: {_ESCAPED}), ' ') END AS query FROM w""")
def normalize_query_col(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalized_query(F.col("text")).alias("query"))


@query(f"WITH w AS (SELECT page_id, url AS x FROM pages) SELECT page_id, {_ESCAPED} AS word FROM w")
def escape_fts(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.escaped_word(F.col("url")).alias("word"))


@query("SELECT page_id, 'D:\\Photos\\' || replace(regexp_replace(url, '^https?://', ''), '/', '\\') AS windows, '/srv/photos/' || regexp_replace(url, '^https?://', '') AS posix FROM pages")
def build_abs_path(spark, sf):
    below = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf, "pages").select("page_id", paths.absolute(below, "D:\\Photos\\").alias("windows"), paths.absolute(below, "/srv/photos//").alias("posix"))


@query("SELECT page_id, CASE WHEN lower(substr(url, 1, 8)) = 'https://' THEN substr(url, 9) END AS relative_path FROM pages")
def relative_path(spark, sf):
    return table(spark, sf, "pages").select("page_id", paths.relative(F.col("url"), "HTTPS:/").alias("relative_path").cast("string")).withColumn("relative_path", F.expr("CASE WHEN startswith(relative_path, '/') THEN substr(relative_path, 2) ELSE relative_path END"))


@query(f"WITH h AS ({_topk_sql(COS, True, limit=24)}) SELECT h.vec_id, h.score, h.rank, d.source FROM h JOIN documents d ON d.doc_id = h.vec_id WHERE h.vec_id <> 0 ORDER BY rank LIMIT 20")
def overfetch_trim(spark, sf):
    """Fetch a fifth more than asked for, keep what the catalog has but the source itself, cut to what was asked for."""
    v = vec(spark, sf)
    hits = vector.topk(v, vector.stored_vector(v, "vec_id", 0), "vec_id", limit=-(-20 * 6 // 5))
    catalog = docs(spark, sf).select(F.col("doc_id").alias("vec_id"), "source")
    return rounded(hits.where("vec_id <> 0").join(catalog, "vec_id").orderBy("rank").limit(20), "score")


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS caption FROM documents")
def truncate_caption(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncated(F.col("text")).alias("caption"))


_W, _H = "(p_size * 40)", "(p_partkey % 1500 + 1)"


@query(f"""SELECT p_partkey, (CASE WHEN greatest({_W}, {_H}) <= 512 THEN {_W} WHEN {_W} >= {_H} THEN 512 ELSE floor({_W} * 512.0 / {_H}) END)::INTEGER AS width,
  (CASE WHEN greatest({_W}, {_H}) <= 512 THEN {_H} WHEN {_W} >= {_H} THEN floor({_H} * 512.0 / {_W}) ELSE 512 END)::INTEGER AS height FROM part""")
def resize_dims(spark, sf):
    size = paths.fitted(F.col("p_size") * 40, F.col("p_partkey") % 1500 + 1)
    return table(spark, sf, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("SELECT doc_id, ('0x' || substr(md5(text), 1, 16))::UBIGINT::DECIMAL(20,0) AS point FROM documents")
def point_id(spark, sf):
    return docs(spark, sf).select("doc_id", hashes.point_id(F.md5("text")).alias("point"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def percent_encode(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.percent_encoded(F.col("url")).alias("encoded"))


@query("SELECT doc_id, doc_id || '.webp' AS thumbnail, l.doc_id IS NOT NULL AS cached FROM documents LEFT JOIN labels l USING (doc_id)")
def thumbnail_paths(spark, sf):
    cached = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("cached"))
    return docs(spark, sf).join(cached, "doc_id", "left").select("doc_id", paths.thumbnail(F.col("doc_id").cast("string")).alias("thumbnail"), F.coalesce("cached", F.lit(False)).alias("cached"))


@query()
def photo_id_hash(spark, sf):
    """Ids as other tools compute them (XXH64, seed 0), and the JVM's; SQL has no such hash."""
    f = files(spark, sf)
    args = (F.col("relative_path"), F.col("size"), F.col("mtime"))
    return f.select("size", hashes.photo_id(*args).alias("photo_id"), hashes.photo_id_portable(*args).alias("portable_id"))


@query()
def text_embeddings(spark, sf):
    """Texts embedded by the plugged-in model, here the deterministic stand-in."""
    from glimmer.models import embedded, hashing_embedder

    return embedded(docs(spark, sf), "doc_id", "text", lambda: hashing_embedder(64)).select("doc_id", "embedding", "error")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return image_plus_text(spark, sf)

