"""Ranked search, personal data and the manifest against plain versions."""

from __future__ import annotations

import random
import string

import brute
import brute_more
import duckdb
import numpy as np
import pytest
from glimmer.llm import merkle, pii, ranking
from glimmer.llm import queries as corpus
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(rows) -> list:
    return sorted(map(tuple, rows), key=repr)


# --- 11


@pytest.mark.parametrize("name", ["op11_ranked_search", "op13_merkle"])
def test_query_equals_its_sql(spark, sf, db, name):
    got = corpus.queries()[name](spark, sf)
    want = db.sql(corpus.oracle_sql()[name])
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert ordered(got.collect()) == ordered([r[i] for i in at] for r in want.fetchall())


@pytest.fixture(scope="module")
def crowded(odd_rows):
    """Odd rows with ids that repeat or are missing, copies of rows, and ties."""
    rows = [*odd_rows, *odd_rows[:3], (None, "one two"), (None, "one two"), (None, None), (-4, "one two"), (10, "two three"), (2**62, "one two")]
    return rows + [(100 + i, "one two three") for i in range(80)]


ITEMS = [(1, "one TWO one"), (2, "three"), (3, None), (4, "?!"), (None, "one"), (5, "same"), (2, "café w17 w18 w19"), (6, "nowhere"), (7, " ".join(f"w{i}" for i in range(60)))]


def test_ranked_is_the_plain_order(spark, crowded):
    docs = spark.createDataFrame(crowded, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item", "terms", "rank", "k", "t", "score")})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "terms", "doc_id")})
    want = brute_more.ranked(crowded, ITEMS)
    assert len(want) > 100
    for parts, block in ((1, ranking.BLOCK_TERMS), (7, 3)):
        found = ranking.search(ranking.build(docs.repartition(parts)), items, block=block)
        assert sorted(map(tuple, found.collect())) == want


def test_ranked_small_windows_and_shards(spark, small, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    want = brute_more.ranked(rows, [tuple(r) for r in items.collect()], 7)
    monkeypatch.setattr(ranking, "SHARD_DOCS", 9)
    monkeypatch.setattr(ranking, "WINDOW", 4)
    assert sorted(map(tuple, ranking.search(ranking.build(small.coalesce(2)), items, 7).collect())) == want


def test_ranked_of_nothing(spark, none, small):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.ranked(none, items).collect() == []
    assert ranking.ranked(small, items.where("false")).collect() == []


def test_heap_merge_against_sums():
    r = random.Random(3)
    for _ in range(200):
        n, limit = r.randrange(1, 9000), r.randrange(1, 30)
        keys = sorted(r.sample(range(-(10**6), 10**6), n))
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(r.randrange(1, 8)):
            docs = np.array(sorted(r.sample(range(n), r.randrange(1, n + 1))))
            shares = np.array([r.randrange(0, 5) for _ in docs])
            total[docs] += shares
            lists.append((docs, shares, int(shares.max())))
        kept: list = []
        ranking.merge(lists, keys, kept, limit)
        want = sorted(((int(s), -k) for s, k in zip(total, keys, strict=True) if s > 0), reverse=True)[:limit]
        assert sorted(kept, reverse=True) == want


@given(st.lists(st.integers(0, 2**40)))
def test_packed_numbers(values):
    data, width = ranking.packed(np.array(values, np.int64))
    assert ranking.unpacked(data).tolist() == values and width.sum() == len(data)


def test_length_factor_has_no_overflow():
    sizes = np.array([1, 10**9], np.int64)
    assert ranking._length_factor(sizes, 10**12, 10**14).tolist() == [50 + 50 * n * 10**12 // 10**14 for n in sizes.tolist()]


# --- 12

PLANTED = {
    "write to joe.doe@mail.example.org now": ["email:9:33"],
    "ftp://bob:pw@host.example.org/x": ["login:0:29", "email:10:29"],
    "call tel:+49-30-1234567 or +49 (30) 123-4567.": ["tel:5:23", "phone:9:23", "phone:27:44"],
    "mary.jane [at] mail [dot] example.org": ["spelled:0:37"],
    "host fe80::1ff:fe23:4567:890a up": ["ip6:5:29"],
    "card 4111 1111 1111 1111, no 4111 1111 1111 1112": ["card:5:24"],
    "MAC 00:1B:44:11:3A:B7.": ["mac:4:21"],
    "IBAN: DE89 3704 0044 0532 0130 00 please": ["iban:6:33"],
    "IBAN: DE88 3704 0044 0532 0130 00 please": [],
    "SSN 123-45-6789; ssn: 000-45-6789": ["ssn:4:15"],
    "Account number: 00123456789, account of it": ["account:16:27"],
    "std::vector<int> at 10:30:15, a::b, version 1.2.3": [],
    "licence 2019 of https://www.example.org/a@b": [],
    "1.2.3.4.5.6.7.8 and 1.2.3.256": ["ip:0:7", "ip:8:15"],
}


@pytest.mark.parametrize("text", PLANTED)
def test_planted_spans(text):
    assert sorted(f"{k}:{a}:{b}" for a, k, b in pii.scan(text)) == sorted(PLANTED[text])


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1Z0.@-+ (%é5", max_size=60) | st.text(alphabet="0123456789 -.+", max_size=90) | st.text(max_size=40))
def test_base_spans_are_the_patterns(text):
    base = [x for x in pii.scan(text) if x[1] in pii.BASE]
    assert pii.joined(base) == brute_more.personal(text)[-1]


def test_personal_data_of_tables(spark, sf, odd, odd_rows, none):
    mine = [(k, f"{t or ''} a.b@c.de 4111-1111-1111-1111 +1 (499) 555-6503 é 10.0.0.1") for k, t in odd_rows]
    for df, rows in ((odd, odd_rows), (spark.createDataFrame(mine * 2, "doc_id long, text string"), mine * 2), (none, []), (sp := spark.read.parquet(f"{sf}/documents.parquet"), [tuple(r) for r in sp.select("doc_id", "text").collect()])):
        want = [(k, *(p := brute_more.personal(t))[:4], brute.sha(p[4])) for k, t in rows]
        got = pii.digests(df).collect()
        assert ordered(r[:6] for r in got) == ordered(want)
        assert all(r.spans.count(":") == 2 * (r.spans.count(",") + 1) for r in got if r.spans)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(pii, "_PIECE", 16)
    text = "x" * 13 + " Social Security 123-45-6789 " + "y" * 14 + " joe@example.org " + "1" * 5000 + "@" + "a." * 3000
    assert [s[1] for s in pii.scan(text)] == ["ssn", "email"] + ["email"] * (brute_more.personal(text)[0] - 1)


def test_long_runs_take_linear_time():
    import time

    began = time.perf_counter()
    for piece in ("a", "1", "1.", "1 ", "+1", "a@", "@a", "a:", "+1(", "://", "account "):
        pii.scan(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 60


def test_masked(spark):
    df = spark.createDataFrame([("a joe@example.org b",), (None,), ("ftp://bob:pw@host.example.org/x",)], "text string")
    assert [r.text for r in pii.masked(df).collect()] == ["a [email] b", None, "[login]/x"]


# --- 13

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def table(n, sources, seed=0):
    r = random.Random(seed)
    return [(i * 3 - 50, r.choice(sources), r.choice(["en", None]), r.choice([None, i]), r.choice([None, "", "Ünï TEXT " * r.randrange(4), "".join(r.choice(string.printable) for _ in range(20))])) for i in range(n)]


@pytest.mark.parametrize("n, sources, chunk", [(700, ["a", "B", "é", None, ""], 4096), (700, ["a"], 40), (1300, ["a", "a", "a", "b"], 33), (90, [str(i) for i in range(60)], 7), (257, ["x"], 4096), (1, ["x"], 4096), (17, ["x"], 16)])
def test_manifest(spark, n, sources, chunk):
    rows = table(n, sources, n)
    docs = spark.createDataFrame(rows, FIELDS).repartition(5).withColumns({c: F.lit("x") for c in ("g", "k", "row", "part", "no", "path", "level", "total")})
    got = merkle.digests(docs, chunk)
    assert ordered(got.collect()) == ordered(brute_more.manifest(rows))


def test_manifest_of_repeated_and_missing_ids(spark):
    rows = table(60, ["a", "b"], 4)
    rows += rows[:20] + [(None, "a", None, None, "Some Text")] * 18 + [(None, None, None, None, None)]
    got = merkle.digests(spark.createDataFrame(rows, FIELDS).repartition(4))
    assert ordered(got.collect()) == ordered(brute_more.manifest(rows))


def test_manifest_of_nothing(spark):
    assert merkle.digests(spark.createDataFrame([], FIELDS)).collect() == []
    assert merkle.manifest(merkle.leaves(spark.createDataFrame([], FIELDS))).root is None


@given(st.integers(0, 5000), st.integers(1, 700))
@settings(max_examples=60, deadline=None)
def test_mountain_peaks_cover_all_leaves(start, n):
    leaves = [bytes([i % 256]) * 32 for i in range(n)]
    nodes, firsts, peaks = merkle.mountain(start, leaves)
    covered = sorted(x for level, i, _ in peaks for x in range(max(start, i * 16**level), min(start + n, (i + 1) * 16**level)))
    assert covered == list(range(start, start + n))
    assert len(peaks) <= 30 * len(nodes) and firsts[0] == start


# --- rows that share an id


@pytest.fixture(scope="module")
def alike(spark):
    """Two texts of 21 words that have nothing in common but a 32-bit hash."""
    text = F.expr("array_join(transform(sequence(1, 21), k -> concat('w', (id * 7919 + k * k * 104729) % 1000003, 'x', k)), ' ')")
    some = spark.range(300_000).select(text.alias("text")).withColumn("h", F.hash("text"))
    pair = some.groupBy("h").agg(F.collect_list("text").alias("t")).where("size(t) = 2").first().t
    assert not set(pair[0].split()) & set(pair[1].split())
    return pair


@pytest.mark.parametrize("key", [-5, None])
def test_rows_of_one_id_are_told_apart(spark, alike, key):
    from glimmer.llm import lines, repeats

    a, b = alike
    docs = spark.createDataFrame([(key, a), (key, b), (-(2**40) if key else None, a), (key, b)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed, r.kept_sha256) for r in repeats.digests(docs).collect() if r.kept_sha256 != brute.sha(a))
    assert sum(g[3] == brute.sha(b) for g in got) == 2  # copies in one row's place are one row's text
    kept = [r.text for r in lines.deduped(docs).collect()]
    assert b in kept and a in kept
