"""The corpus operators' registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glimmer.llm import bpe, lines, main_text, merkle, ngram_join, pii, postings, quality, ranking, records, repeats, secret_scan, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def queries() -> dict[str, Query]:
    def documents(fn: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf: fn(_table(spark, sf, "documents"))

    return {
        "op1_line_dedup": documents(lambda d: lines.digests(d, bands=lines.BANDS)),
        "op2_decontamination": lambda spark, sf: postings.digests(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")),
        "op3_bpe": documents(lambda d: bpe.digests(d, vocabulary("byte_bpe_50k.json"))),
        "op4_quality": lambda spark, sf: quality.judge(_table(spark, sf, "documents"), _table(spark, sf, "labels")),
        "op5_token_records": documents(lambda d: records.digests(d, vocabulary("word_bpe_49k.json"))),
        "op6_warc": lambda spark, sf: warc.digests(_table(spark, sf, "pages")),
        "op7_substring_dedup": documents(repeats.digests),
        "op8_secret_scan": documents(secret_scan.digests),
        "op9_main_text": lambda spark, sf: main_text.extract(_table(spark, sf, "pages")),
        "op10_ngram_join": documents(lambda d: ngram_join.join(d, links=True)),
        "op11_ranked_search": lambda spark, sf: ranking.ranked(_table(spark, sf, "documents"), _table(spark, sf, "benchmark")),
        "op12_pii": documents(pii.digests),
        "op13_merkle": documents(merkle.digests),
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express over whole tables; brute force in tests holds the others."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
    plain = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(low)
    fold = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def framed(c: str) -> str:
        return f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"

    return {
        "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {plain} AS w FROM documents), i AS (SELECT item_id, {plain} AS w FROM benchmark WHERE item_id IS NOT NULL),
x AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda p: array_to_string(w[p:p + least(10, len(w)) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
s AS (SELECT DISTINCT n FROM x),
y AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS win FROM d, s WHERE len(w) >= n),
h AS (SELECT y.doc_id, y.p, y.n, x.item_id FROM y JOIN x USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)""",
        "op6_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
        "op7_substring_dedup": f"""
WITH d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
y AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, unnest(list_transform(range(1, len(w) - 18), lambda p: sha256(array_to_string(w[p:p + 19], ' ')))) AS win FROM d WHERE len(w) >= 20),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS r FROM y) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM late),
o AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
k AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM o ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
        "op10_ngram_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, {words.format(low)} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda p: array_to_string(w[p:p + 4], ' '))) AS s FROM d WHERE len(w) > 0),
u AS MATERIALIZED (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM s)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT id AS doc_id, min(other) AS component_id FROM r GROUP BY id), k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)""",
        "op11_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {plain} AS w FROM documents),
s AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
f AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
g AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY t, n),
q AS (SELECT DISTINCT item_id, unnest({plain}) AS t FROM benchmark WHERE item_id IS NOT NULL),
h AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(w) * n) // l))))::BIGINT AS score FROM q JOIN g USING (t) JOIN f USING (t) JOIN d USING (r), s GROUP BY item_id, r),
o AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM h JOIN d USING (r) WHERE score > 0)
SELECT * FROM o WHERE rank <= 50""",
        "op13_merkle": f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, source, text,
  list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]), lambda a, u: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc,
  {framed('doc_id')} || {framed('source')} || {framed('lang')} || {framed('n_chars')} AS head FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, source, sha256(head || {framed('text')}) AS leaf,
  CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || {framed(fold)}) ELSE sha256(head || {framed('text')}) END AS bad FROM t),
o AS MATERIALIZED (SELECT *, coalesce('1' || source, '0') AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS c FROM l),
n AS (SELECT g, 0 AS level, idx, leaf AS h, c FROM o UNION ALL
  SELECT g, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (c + 15) // 16 FROM n WHERE c > 1 GROUP BY g, level, idx // 16, c),
s AS MATERIALIZED (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS c FROM n WHERE c = 1),
m AS (SELECT 0 AS level, idx, h, c FROM s UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (c + 15) // 16 FROM m WHERE c > 1 GROUP BY level, idx // 16, c),
top AS (SELECT h AS root FROM m WHERE c = 1),
a AS (SELECT o.r, 0 AS tree, n.level, o.idx // (16::BIGINT ** n.level)::BIGINT AS own, n.idx, n.h FROM o JOIN n ON n.g = o.g AND n.c > 1 AND n.idx // 16 = o.idx // (16::BIGINT ** (n.level + 1))::BIGINT
  UNION ALL SELECT o.r, 1, m.level, s.idx // (16::BIGINT ** m.level)::BIGINT, m.idx, m.h FROM o JOIN s USING (g) JOIN m ON m.c > 1 AND m.idx // 16 = s.idx // (16::BIGINT ** (m.level + 1))::BIGINT),
w AS (SELECT r, tree, level, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < own), '') AS x, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > own), '') AS y FROM a GROUP BY r, tree, level),
p AS (SELECT r, sha256(string_agg(x || y, '' ORDER BY tree, level)) AS proof_sha256, list({{'x': x, 'y': y}} ORDER BY tree, level) AS way FROM w GROUP BY r)
SELECT o.doc_id, o.leaf, s.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256,
  list_reduce(list_prepend({{'x': bad, 'y': ''}}, coalesce(way, [])), lambda v, e: {{'x': sha256(e.x || v.x || e.y), 'y': ''}}).x AS folded_root,
  list_reduce(list_prepend({{'x': bad, 'y': ''}}, coalesce(way, [])), lambda v, e: {{'x': sha256(e.x || v.x || e.y), 'y': ''}}).x = root AS verified
FROM o JOIN s USING (g) LEFT JOIN p USING (r), top""",
    }
