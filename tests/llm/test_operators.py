"""Each operator against a plain version, on odd rows and on the small tables."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from glimmer.llm import bpe, lines, main_text, ngram_join, postings, quality, records, repeats, secret_scan, warc
from glimmer.llm.kit import mixed, window_hashes, word_hashes
from glimmer.llm.queries import vocabulary

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


def by_id(df) -> dict:
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df) -> list:
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["odd", "small"])
def table(request):
    df = request.getfixturevalue(request.param)
    return df, rows_of(df)


# --- 2


def test_decontamination(spark, sf, table):
    df, rows = table
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    given = [tuple(r) for r in items.select("item_id", "text").collect()]
    extra = [(900, " ".join(postings.words(rows[6][1])[i].decode() for i in range(12))), (901, "one two"), (902, None), (903, "?!")]
    items = spark.createDataFrame(given + extra, "item_id long, text string")
    want = dict(brute.decontamination(rows, given + extra))
    assert by_id(postings.digests(df, items)) == want
    assert any(v[-1] for v in want.values())


def test_query_blocks_agree(spark, small, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    index = postings.build(small)
    whole = {r.doc_id: (r.n_hit, list(r["items"])) for r in postings.contaminated(index, items).collect()}
    parts = {r.doc_id: (r.n_hit, list(r["items"])) for r in postings.contaminated(index, items, limit=200).collect()}
    assert whole == parts


def test_query_blocks_keep_rows_apart(spark):
    """Rows that share an id, or have none, and a word count stay rows of their own, in one block and in several."""
    rows = [(7, "a b x y"), (7, "x c d y"), (None, "a b x y"), (None, "p q r s"), (None, "p q r s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(1, "a b"), (2, "c d")], "item_id long, text string")
    index = postings.build(docs)
    want = sorted([(7, 4, 2, [1]), (7, 4, 2, [2]), (-1, 4, 2, [1]), (-1, 4, 0, []), (-1, 4, 0, [])])
    for limit in (postings.BLOCK_WORDS, 1):
        got = postings.contaminated(index, items, 2, limit).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == want


def test_phrases_and_proximity(spark):
    docs = spark.createDataFrame([(1, "a b c d a b"), (2, "b a x x x x c"), (3, None)], "doc_id long, text string")
    index = postings.build(docs)
    found = postings.search(index, spark.createDataFrame([(1, "A b")], "item_id long, text string"))
    assert sorted((r.doc, r.place, r.length) for r in found.collect()) == [(1, 0, 2), (1, 4, 2)]
    near = postings.search(index, spark.createDataFrame([(1, "c a")], "item_id long, text string"), span=2)
    assert {r.doc for r in near.collect()} == {1}
    assert postings.search(index, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_clean_keeps_columns(spark, odd):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = postings.clean(odd, items)
    assert out.columns == odd.columns
    assert {r.doc_id for r in odd.collect()} - {r.doc_id for r in out.collect()} == {10, 11}


def test_clean_judges_each_row(spark):
    rows = [(None, "one two"), (None, "clean"), (7, "one two x"), (7, "other"), (8, None), (8, "y one two"), (8, "y one two"), (None, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("_row", F.lit(1))
    out = postings.clean(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string"))
    assert sorted(map(repr, out.select("doc_id", "text").collect())) == sorted(map(repr, docs.where("text IS NULL OR text NOT LIKE '%one two%'").select("doc_id", "text").collect()))
    assert out.columns == docs.columns


# --- 3


@pytest.mark.parametrize("long", [64, 1000, 1 << 15])
def test_bpe_is_the_librarys(spark, odd, odd_rows, long):
    path = vocabulary(BYTES)
    want = {k: v[1] for k, v in brute.bpe(odd_rows, path)}
    got = {r.doc_id: brute.sha(bytes(r.tokens)) for r in bpe.encode(odd, path, long=long).collect()}
    assert got == want


def test_bpe_round_trip(spark, table):
    df, rows = table
    path = vocabulary(BYTES)
    got = {r.doc_id: bytes(r.text).decode() for r in bpe.decode(bpe.encode(df, path), path).collect()}
    assert got == {k: t or "" for k, t in rows}
    assert by_id(bpe.digests(df, path)) == dict(brute.bpe(rows, path))


def test_joins_agree_with_whole_texts():
    codec, r = bpe.Codec.at(vocabulary(BYTES)), random.Random(5)
    for _ in range(150):
        alphabet = r.choice(["ab ", "a", "ab' s\n", string.printable, "é日  x", "<|endoftext|> "])
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(2, 900)))
        if r.random() < 0.3:
            text = text.replace("x", "<|endoftext|>")
        cut = r.randrange(1, len(text))
        a, b = text[:cut], text[cut:]
        assert codec.joined(a, codec.encode(a), b, codec.encode(b)) == codec.encode(text)
        want = np.array(codec.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert codec.encode(text) == want


# --- 4


def test_quality_base(spark, table, sf):
    df, rows = table
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = by_id(quality.judge(df, labels))
    assert {k: v[:6] for k, v in got.items()} == {k: brute.quality(t) for k, t in rows}
    assert not any(v[7] for v in got.values() if v[5])


def test_quality_follows_labels(spark, small, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id: r.kept for r in quality.judge(small, labels).where("NOT base_failed").collect()}
    good = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in kept}
    assert all(kept[k] == bool(q) for k, q in good.items())
    out = quality.filtered(small, labels)
    assert out.columns == small.columns


def test_quality_without_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(odd, empty).collect()
    assert all(r.kept != r.base_failed and r.score is None for r in got)
    assert quality.judge(none, empty).count() == 0
    assert quality.filtered(odd, empty).columns == odd.columns


def test_quality_of_held_out_labels(spark):
    """Verdicts on labels that the operator never sees."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels.where("doc_id % 2 = 0")).where("NOT base_failed").collect()}
    unseen = [(got[r.doc_id], r.quality) for r in labels.where("doc_id % 2 = 1").collect() if r.doc_id in got]
    right = sum(k and q == 1 for k, q in unseen)
    assert right / sum(k for k, _ in unseen) >= 0.95 and right / sum(q == 1 for _, q in unseen) >= 0.95


def test_quality_scores(spark, sf):
    """Scores against ratios counted apart."""
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality.judge(docs, seen).where("NOT base_failed").collect()}
    target, _ = quality.trusted(seen)
    tables = [[Counter(), Counter()], [Counter(), Counter()]]
    rows = {}
    for r in docs.collect():
        w = re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").encode())
        keys = [int(mixed(word_hashes([x]))[0]) % quality.BUCKETS for x in w], [int(window_hashes(word_hashes(w[i : i + 2]), 2)[0]) % quality.BUCKETS for i in range(len(w) - 1)]
        rows[r.doc_id] = keys
        for n, ks in enumerate(keys):
            tables[n][0].update(ks)
            if r.doc_id in target:
                tables[n][1].update(ks)
    sums = [sum(t[0].values()) + quality.BUCKETS * quality.PRIOR for t in tables]
    mass = [sum(t[1].values()) for t in tables]

    def ratio(n: int, k: int) -> float:
        raw = (tables[n][0][k] + quality.PRIOR) / sums[n]
        return math.log((tables[n][1][k] + quality.MIX * mass[n] * raw) / (mass[n] * (1 + quality.MIX)) / raw)

    for d in sorted(got)[:40]:
        want = [ratio(n, k) for n in (0, 1) for k in rows[d][n]]
        assert abs(got[d].score - sum(want) / len(want)) < 1e-9


def test_quality_cut():
    assert quality.best_cut([1.0, 2.0], [-1.0, 0.0]) == 0.5
    assert quality.best_cut([1.0], []) == quality.best_cut([], [1.0]) == -math.inf
    assert quality.best_cut([0.0] * 9 + [-3.0], [-2.0, -1.0]) == -0.5
    assert quality.best_cut([1.0, 1.0], [1.0]) == 1.0  # ties are kept


def test_quality_of_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    made = [" ".join(rng.choices(string.ascii_letters, k=n)) for n in (3000, 100, 100)]
    rows = [(1, made[0]), (1, made[1]), (None, made[2]), (2, None)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    whole = quality.ratios(df, frozenset([1]))
    monkeypatch.setattr(quality, "_PART", 10)
    assert (quality.ratios(df, frozenset([1])) == whole).all()
    assert quality.trusted(labels)[0] == {1}  # a sole trusted id is the target, held out or not
    assert quality.judge(df, labels).count() == 4


def test_log_ratios():
    words = b"a b c a".split()
    assert len(quality.features(words)) == 7
    assert quality.repeated(b"a b c x a b c".split()) == 6


# --- 5


def test_records(spark, table):
    df, rows = table
    path = vocabulary(WORDS)
    assert by_id(records.digests(df, path)) == dict(brute.records(rows, path))


def test_checksum_and_frames():
    r = random.Random(1)
    assert int(records.crc32c([b"123456789"])[0]) == 0xE3069283
    assert [int(x) for x in records.crc32c([b"\0" * 32, b"\xff" * 32])] == [0x8A9136AA, 0x62A8AB43]
    payloads = [r.randbytes(n) for n in (4, 5, 8, 9, 100, 1000, 4096, 4097)]
    data = b"".join(records.frame(payloads))
    assert records.unframe(data) == payloads
    for at in (0, 9, 20, len(data) - 1):
        with pytest.raises(ValueError):
            records.unframe(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        records.unframe(data[:-1])


def test_shuffled_reads(spark, small, tmp_path):
    folder = f"file://{tmp_path}/records"
    index = records.write(small, vocabulary(WORDS), folder, 2)
    a = [(r.key, bytes(r.ids)) for r in records.read_shuffled(index, folder, 1).collect()]
    b = [(r.key, bytes(r.ids)) for r in records.read_shuffled(index, folder, 2).collect()]
    whole = [(r.key, bytes(r.ids)) for r in records.read(spark, folder).collect()]
    assert sorted(a) == sorted(b) == sorted(whole) and [k for k, _ in a] != [k for k, _ in b]


# --- 6


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    long = "x" * 200
    odd = spark.createDataFrame([(9001, None, None), (9002, "u", long), (9003, "u\r\nv", long), (9004, "u", ""), (9005, "u", "short"), (9006, "u", "short"), (9002, "u", long)], "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").unionByName(odd)
    got = sorted(tuple(r) for r in warc.digests(both).collect())
    want = []
    first = {}
    rows = [tuple(r) for r in both.collect()]
    for p, _, h in sorted(rows, key=lambda r: r[0]):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, p)
    for p, _, h in rows:
        raw = (h or "").encode()
        again = first.get(h, p) != p
        want.append((p, len(raw), brute.sha(raw), "revisit" if again else "response", first[h] if again else None))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))


def test_salvage():
    texts = [b"first " * 30, b"second " * 30, b"third " * 30, b""]
    made = [warc.record(i, f"http://x/{i}", t, brute.sha(t), None) for i, t in enumerate(texts)]
    for pack in (warc.member, bytes):
        parts = [pack(m) for m in made]
        whole = b"".join(parts)
        assert [r["page_id"] for r in warc.salvage(whole)] == [0, 1, 2, 3]
        bad = bytearray(whole)
        for k in range(len(parts[0]) + 15, len(parts[0]) + len(parts[1]) - 8, 9):
            bad[k] ^= 0x5A
        found = list(warc.salvage(bytes(bad)))
        assert [r["page_id"] for r in found if "error" not in r] == [0, 2, 3]
        gaps = [(r["at"], r["end"]) for r in found if "error" in r]
        assert gaps == [(len(parts[0]), len(parts[0]) + len(parts[1]))]
        cut = list(warc.salvage(whole[: len(whole) - len(parts[3]) - 5]))
        assert [r.get("page_id") for r in cut if "error" not in r] == [0, 1] and "error" in cut[-1]
        junk = list(warc.salvage(b"junk" + whole))
        assert (junk[0]["at"], junk[0]["end"]) == (0, 4) and len(junk) == 5
    assert list(warc.salvage(b"")) == []


# --- 7


@pytest.mark.parametrize("group", [1, 4096])
def test_repeats(table, group):
    df, rows = table
    assert by_id(repeats.digests(df, group=group)) == brute.repeats(rows)


def test_repeats_texts_and_copies(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(2, text), (1, text), (1, text), (None, "x y")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed, r.text) for r in repeats.digests(docs, texts=True).collect())
    assert got == [(-1, 0, "x y"), (1, 0, text), (1, 0, text), (2, 30, "")]


# --- 8


def test_secrets(table):
    df, rows = table
    got = by_id(secret_scan.digests(df))
    for k, t in rows:
        want = brute.secrets(t)
        assert got[k][:4] == (*want[:3], brute.sha(want[3]))
        assert set(filter(None, want[3].split(","))) <= set(got[k][4].split(","))


def test_random_strings_stand_out(spark):
    r = random.Random(3)
    alphabet = string.ascii_letters + string.digits
    rows = [(i, "prose and more " + "".join(r.choice(alphabet) for _ in range(40)) + " end") for i in range(300)]
    rows += [(1000 + i, "someVeryLongIdentifierName" + "AndMore" * (i % 5) + " internationalizationandlocalization") for i in range(300)]
    got = {x.doc_id: x.spans for x in secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:15:55" for i in range(300)) > 250
    assert sum("random" in got[1000 + i] for i in range(300)) < 30


def test_random_parts_of_runs(spark):
    """A value behind a name and '=', and keys between separators of the other alphabet, are tested by themselves."""
    r = random.Random(8)

    def key(alphabet=string.ascii_letters + string.digits):
        return "".join(r.choice(alphabet) for _ in range(40))

    rows = [(i, f"export AWS_KEY={key()}") for i in range(300)]
    rows += [(1000 + i, f"see /v1/{key(string.ascii_letters + string.digits + '-_')}/x") for i in range(300)]
    got = {x.doc_id: x.spans for x in secret_scan.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("random:15:55" in got[i] for i in range(300)) > 250
    # with neither - nor _ in the key, base64 holds the path too, and the run stays whole
    mixed = [k for k, t in rows if k >= 1000 and set(t) & set("-_")]
    assert sum("random:8:48" in got[k] for k in mixed) > 0.85 * len(mixed) > 150
    assert secret_scan.parts(b"A" * 30 + b"==") == [(0, 32)]


def test_randomness_is_uniform_for_random_strings():
    r = random.Random(4)
    ps = [secret_scan.randomness([r.randrange(64) for _ in range(48)], 64) for _ in range(2000)]
    assert 0.4 < np.mean(ps) < 0.6
    assert secret_scan.randomness([1] * 30, 64) == 0.0
    assert secret_scan.scan("ſecret = abcdefgh")[0] == []


def archived(kind, block, *head, content="application/http; msgtype=response", version="1.0"):
    lines = [f"WARC/{version}", f"WARC-Type: {kind}", *head, *([f"Content-Type: {content}"] if content else []), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_others():
    """Digests of other algorithms and encodings, several records a member, other types and versions, damage between."""
    import base64
    import hashlib

    body, http = b"<p>hello</p>", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\n<p>he\r\n7\r\nllo</p>\r\n0\r\n\r\n"
    good = [
        archived("warcinfo", b"software: x\r\n", content="application/warc-fields"),
        archived("request", b"GET / HTTP/1.1\r\n\r\n", content="application/http; msgtype=request"),
        archived("response", http + body, f"WARC-Payload-Digest: sha1:{sha1}"),
        archived("response", http + body, f"WARC-Payload-Digest: SHA-1:{hashlib.sha1(body).hexdigest().upper()}", "WARC-Target-URI: http://a/", version="1.1"),
        archived("response", http + body, "WARC-Payload-Digest: blake3:abc", "WARC-Block-Digest: sha1:odd"),
        archived("response", chunked, f"WARC-Payload-Digest: sha1:{sha1}"),
        archived("resource", body, f"WARC-Payload-Digest: md5:{hashlib.md5(body).hexdigest()}", content="text/html", version="0.18"),
        archived("response", http + body, f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha256:{hashlib.sha256(http + body).hexdigest()}", "X-Long: a\r\n b"),
    ]
    bad = archived("response", http + body + b"!", f"WARC-Payload-Digest: sha1:{sha1}")
    kinds = ["warcinfo", "request", *["response"] * 4, "resource", "response"]
    for archive in (b"".join(good), warc.member(b"".join(good)), b"".join(map(warc.member, good))):
        assert [r.get("record_type", r.get("error")) for r in warc.salvage(archive)] == kinds
    got = list(warc.salvage(warc.member(good[0] + bad + good[2]) + b"junk" + warc.member(good[6])))
    assert [r.get("record_type", "gap") for r in got] == ["warcinfo", "gap", "response", "gap", "resource"]
    assert got[1]["error"] == "payload digest differs" and got[4]["payload"] == body
    cut = warc.member(b"".join(good))[:-20]
    assert [r.get("record_type", "gap") for r in warc.salvage(cut + warc.member(good[2]))] == ["gap", "response"]
    assert [r.get("record_type", "gap") for r in warc.salvage(bad + good[2] + warc.member(b""))] == ["gap", "response", "gap"]


def parts_by_comparison(run):
    """The definition of a run's parts, every one compared with all others."""
    out = []
    for m in re.finditer(rb"[^=]+(?:=+\Z)?", run):
        if secret_scan.infer(m[0]):
            found = [m.span()]
        else:
            split = [[x.span() for x in re.compile(p).finditer(run, *m.span())] for p in (rb"[^/+]+", rb"[^_-]+", rb"[^/+_-]+")]
            found = sorted({x for s in split[:2] for x in s if secret_scan.infer(run[x[0] : x[1]])})
            found += [x for x in split[2] if not any(a < x[1] and x[0] < b and b - a >= secret_scan.LEAST for a, b in found)]
            kept = []
            for a, b in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
                if not any(s < b and a < e for s, e in kept):
                    kept.append((a, b))
            found = kept
        out += [x for x in found if x[1] - x[0] >= secret_scan.LEAST]
    return sorted(out)


def test_parts_of_runs():
    r = random.Random(8)
    for _ in range(400):
        run = "".join(r.choice(["/", "+", "-", "_", "=", "a" * r.randrange(30), "Zz9" * r.randrange(9)]) for _ in range(r.randrange(40))).encode()
        assert secret_scan.parts(run) == parts_by_comparison(run)


def test_a_long_run_takes_linear_time():
    import time

    r, began = random.Random(9), time.perf_counter()
    for text in ("".join(r.choice(string.ascii_letters + "/+-_") for _ in range(1_000_000)), ("a" * 25 + "/" + "B" * 22 + "_") * 20_000):
        secret_scan.scan(text)
    assert time.perf_counter() - began < 40


# --- 9


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


LONG = "Words that say something at length, and then go on for a while so that a block has text. " * 2


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        (page(f"<nav><ul><li><a>Home</a></li></ul></nav><article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article><footer>&copy; x</footer>"), f"Head {LONG.strip()} Short."),
        (page(f"<div class='sidebar'>{LONG}</div><div id=main><p>{LONG}<br>a&amp;b &lt;c&gt;&nbsp;d</p></div><div class='comments'><p>{LONG}</p></div>"), f"{LONG.strip()} a&b <c> d"),
        (page(f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>{LONG}<b>bo</b>ld</p><form><p>{LONG}</p></form><aside>no</aside></main>"), f"Title {LONG.strip()} bold"),
        (page(f"<article><p>{LONG}<p class=ad>buy</p><p>more<!-- <p>x</p> --></article>"), f"{LONG.strip()} more"),
        (page(f"<div class='site-header'>{LONG}</div><div class='has-sidebar'><div class='post'><h2>Sub</h2><p>{LONG}</p></div></div><div id='cookie-notice'>{LONG}</div>"), f"Sub {LONG.strip()}"),
        (page(f"<div class='story' style='overflow: hidden' title=\"the hidden cost\"><p>{LONG}</p></div><div hidden><p>{LONG}</p></div><div data-x='a b'aria-hidden=true><p>{LONG}</p></div>"), LONG),
        ("<article><p>cut off <b>here", "cut off here"),
        ("plain text only", "plain text only"),
        (page("<nav>only a menu</nav>"), ""),
    ],
)
def test_main_text(html, want):
    assert main_text.main_text(html) == " ".join(want.split())


def test_main_text_of_pages(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in main_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<(?:p|br|/p|h1|/h1)\b[^>]*>", " ", inner).replace("<b>", "")).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


# --- 10


def test_ngram_join(table):
    df, rows = table
    sets, component = brute.jaccard(rows)
    assert by_id(ngram_join.join(df)) == {d: (len(sets[d]), component[d]) for d in sets}


def test_ngram_join_near_the_threshold(spark):
    """Many variants of a few texts, at all distances around the threshold."""
    r = random.Random(9)
    rows = []
    for base in range(4):
        start = [f"b{base}_{i}" for i in range(60)]
        for _ in range(30):
            w = list(start)
            for k in r.sample(range(60), r.randrange(0, 6)):
                w[k] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w[r.randrange(3) :])))
    sets, component = brute.jaccard(rows)
    got = by_id(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == {d: (len(sets[d]), component[d]) for d in sets}


def test_ngram_links(spark):
    """All links count, not only those that connect: chains, cliques, copies, and rows that share an id or have none."""
    r = random.Random(10)
    rows = []
    for base in range(3):
        start = [f"c{base}_{i}" for i in range(60)]
        for _ in range(25):
            w = list(start)
            for k in r.sample(range(60), r.randrange(0, 4)):
                w[k] = f"y{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(200, rows[0][1]), (201, "alone in this"), (202, None), (203, ""), (None, rows[0][1])]
    sets, _ = brute.jaccard([x for x in rows if x[0] is not None])
    got = {x.doc_id: x.n_links for x in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), links=True).collect()}
    want = {a: sum(b != a and bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for b in sets) for a in sets}
    assert got == want | {None: 0}
    chain = {0: " ".join(f"w{i}" for i in range(40)), 1: " ".join(f"w{i}" for i in range(5, 45)), 2: " ".join(f"w{i}" for i in range(10, 50))}
    out = ngram_join.join(spark.createDataFrame(list(chain.items()), "doc_id long, text string"), links=True).collect()
    assert {x.doc_id: (x.component_id, x.n_links) for x in out} == {0: (0, 1), 1: (0, 2), 2: (0, 1)}


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(0)
    counts = r.integers(0, 9, 64)
    for _ in range(200):
        n = int(r.integers(1, 40))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[int(r.integers(0, 3)) :], r.integers(0, 2**63, int(r.integers(0, 4))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if common and 100 * common >= 75 * (len(x) + len(y) - common):
            assert set(ngram_join.prefix(x, counts)) & set(ngram_join.prefix(y, counts))


def test_kept_rows(odd):
    out = ngram_join.kept(odd)
    assert out.columns == odd.columns
    assert {r.doc_id for r in out.collect()} == {1, 2, 3, 6, 7, 8, 9, 10, 12, 13, 14, 15}


# --- 1


def line_brute(rows, percent=lines.PERCENT, bits=lines.BITS) -> dict:
    places: dict[str, list] = {}
    for d, t in rows:
        for i, w in lines.normal_lines(t):
            places.setdefault(b" ".join(w).decode(), []).append((d, i))
    forms = sorted(places)
    sims = dict(zip(forms, lines.simhashes([f.encode().split() for f in forms]).tolist(), strict=True))
    group = brute.groups(forms, lambda a, b: (sims[a] ^ sims[b]).bit_count() <= bits and 100 * brute.distance(a, b) <= (100 - percent) * max(len(a), len(b)))
    gone: dict = {d: [] for d, _ in rows}
    for g in set(group.values()):
        for d, i in sorted(p for f in forms if group[f] == g for p in places[f])[1:]:
            gone[d].append(i)
    return {d: sorted(x) for d, x in gone.items()}


def test_line_dedup(spark):
    r = random.Random(2)
    vocabulary_ = ["".join(r.choice(string.ascii_lowercase) for _ in range(7)) for _ in range(300)]
    bases = [[r.choice(vocabulary_) for _ in range(90)] for _ in range(4)]
    rows = []
    for d in range(24):
        out = []
        for base in bases:
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(90)] = r.choice(vocabulary_)
            out.append(" ".join(w).capitalize() + "." * r.randrange(2))
        rows.append((d, "\n".join([*out, "short line", "five words are a line"])))
    rows += [(100, None), (101, ""), (102, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: list(x.removed) for x in lines.digests(docs).collect()}
    want = line_brute(rows)
    assert got == want
    assert len({tuple(x) for x in want.values()}) > 3


@pytest.mark.parametrize("n", [5, 8, 12, 30, 80])
def test_line_links_beyond_the_simhash(spark, n):
    """Of pairs in which a word in ten (one at least) changed, nearly all are linked that plain edit similarity links."""
    r = random.Random(n)
    rows, linked = [], set()
    for d in range(0, 400, 2):
        a = ["".join(r.choice(string.ascii_lowercase) for _ in range(r.randrange(4, 9))) for _ in range(n)]
        b = list(a)
        for k in r.sample(range(n), max(1, n // 10)):
            b[k] = "".join(r.choice(string.ascii_lowercase) for _ in range(6))
        rows += [(d, " ".join(a)), (d + 1, " ".join(b))]
        if 100 * brute.distance(rows[-2][1], rows[-1][1]) <= 20 * max(len(rows[-2][1]), len(rows[-1][1])):
            linked.add(d + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {x.doc_id for x in lines.duplicates(docs, bands=lines.BANDS).withColumnRenamed("d", "doc_id").collect()}
    assert len(linked) > 100 and gone <= linked and len(gone) >= 0.95 * len(linked)


def test_short_lines_are_deduped(spark):
    """Repeats of a few words, of a script without spaces and of punctuation go; short lines aren't linked by their likeness."""
    rows = [(1, "Read more\n今日は良い天気です\n---\n \npage 1\nown"), (2, "read  more!\n今日は良い天気です\n---\n \npage 2"), (3, "page 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: list(x.removed) for x in lines.digests(docs).collect()} == {1: [], 2: [0, 1, 2], 3: [0]}


def test_line_dedup_tables(odd, none):
    out = lines.deduped(odd)
    assert out.columns == odd.columns
    ids = {r.doc_id: r.text for r in out.collect()}
    assert 4 not in ids and ids[1] and 2 in ids and 3 in ids
    assert lines.digests(none).count() == 0 and lines.deduped(none).columns == none.columns


def test_bounds_of_edit_distance_agree_with_it():
    """Long lines with a few or many changed words, and lines that end or begin alike: what the bounds decide is right."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh é") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    said = []
    for k in range(120):
        own = [r.choice(words) for _ in range(60)]
        other = [r.choice(words) if r.random() < (k % 12) / 12 else w for w in own]
        a, b = " ".join(own), " ".join(other[k % 3 :] + own[: k % 2])
        want = 100 * brute.distance(a, b) <= 20 * max(len(a), len(b))
        got = lines.quick_similar(a, b, 80)
        assert got is None or got == want
        assert lines.edit_similar(a, b, 80) == want
        said.append((got, want))
    assert sum(got is True for got, want in said) > 0.8 * sum(want for _, want in said)
    assert lines.quick_similar("x" * 300, "", 80) is False and lines.quick_similar("x" * 300, "x" * 300, 80) is True


def test_very_long_lines_are_compared(spark):
    """Lines beyond what the JVM compares: near copies are linked, others aren't."""
    r = random.Random(6)
    own = ["".join(r.choice(string.ascii_lowercase) for _ in range(6)) for _ in range(1200)]
    near = [w if i % 40 else "other" for i, w in enumerate(own)]
    far = [w if i % 2 else "other" + w[:2] for i, w in enumerate(own)]
    docs = spark.createDataFrame([(1, " ".join(own)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert len(" ".join(own)) > lines.LONG
    assert {r.doc_id: r.n_removed for r in lines.digests(docs, bands=lines.BANDS).collect()} == {1: 0, 2: 1, 3: 0}


def test_window_hashes_of_many_rows():
    h = np.arange(1, 40, dtype=np.uint64)
    sizes = np.array([5, 1, 9, 4, 3, 17])
    found, starts = lines.windows(h, sizes, 4)
    ends = np.append(starts[1:], len(found))
    at = 0
    for n, a, b in zip(sizes.tolist(), starts, ends, strict=True):
        assert found[a:b].tolist() == window_hashes(h[at : at + n], min(n, 4)).tolist()
        at += n


def test_edit_similarity():
    r = random.Random(1)
    for _ in range(300):
        a = "".join(r.choice("abc") for _ in range(r.randrange(1, 25)))
        b = list(a)
        for _ in range(r.randrange(4)):
            b.insert(r.randrange(len(b) + 1), r.choice("abc"))
        b = "".join(b)
        assert lines.edit_similar(a, b, 80) == (100 * brute.distance(a, b) <= 20 * max(len(a), len(b)))


def test_blocks_never_lose_a_pair():
    r = random.Random(6)
    from itertools import combinations

    for m in (4, 5, 6):
        edges = [64 * i // m for i in range(m + 1)]
        for _ in range(100):
            x = r.getrandbits(64)
            y = x
            for k in r.sample(range(64), 3):
                y ^= 1 << k
            masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in c) for c in combinations(range(m), m - 3)]
            assert any(x & k == y & k for k in masks)


# --- components


def test_components_either_way(spark):
    from glimmer.llm import kit

    r = random.Random(8)
    for shape in ([(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 50)], [(r.randrange(300), r.randrange(300)) for _ in range(170)], []):
        edges = spark.createDataFrame(shape, "a long, b long")
        touched = {x for e in shape if e[0] != e[1] for x in e}
        linked = {frozenset(e) for e in shape}
        want = {k: v for k, v in brute.groups(sorted(touched), lambda a, b, linked=linked: frozenset((a, b)) in linked).items()}
        assert {x.id: x.component for x in kit.components(edges).collect()} == want
        assert {x.id: x.component for x in kit.components(edges, small=-1).collect()} == want


# --- all


@pytest.mark.parametrize(
    "run",
    [
        lambda spark, e: postings.digests(e, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
        lambda spark, e: bpe.digests(e, vocabulary(BYTES)),
        lambda spark, e: records.digests(e, vocabulary(WORDS)),
        lambda spark, e: repeats.digests(e),
        lambda spark, e: secret_scan.digests(e),
        lambda spark, e: ngram_join.join(e),
        lambda spark, e: ngram_join.kept(e),
    ],
)
def test_empty_tables(spark, none, run):
    assert run(spark, none).count() == 0


def test_empty_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.digests(empty).count() == 0 and main_text.extract(empty).count() == 0


def test_hostile_pages_take_linear_time():
    import time

    for p in ("<a " * 100_000, "<form>" * 50_000, '<a x="' * 50_000, "<p class=ad>" * 20_000, "<nav>x" * 20_000):
        began = time.process_time()
        main_text.main_text(p)
        assert time.process_time() - began < 5


def test_main_text_without_containers(spark, sf):
    """The run between surge and dive finds the text where no article or main element tells of it."""
    import re

    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect()]
    same = sum(main_text.main_text(h) == main_text.main_text(re.sub(r"(?i)<(/?)(article|main)\b", r"<\1div", h)) for h in pages)
    assert same >= 0.95 * len(pages)
    cards = "".join(f"<article><p>Card {i}</p></article>" for i in range(4))
    assert main_text.main_text(page(f"{cards}<div>x</div><div>y</div><div>z</div><div><p>{LONG}</p><p>{LONG}</p></div>")) == " ".join([LONG.strip()] * 2)


def test_index_lies_beside_the_records(spark, small, tmp_path):
    folder = f"file://{tmp_path}/beside"
    index = records.write(small, vocabulary(WORDS), folder, 2)
    again = records.read_index(spark, folder)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, again.collect()))
    assert again.count() == small.count()


def test_many_spans_take_linear_time():
    import time

    r = random.Random(2)
    text = " ".join("".join(r.choice(string.ascii_letters + string.digits) for _ in range(30)) + " password=hunter22" for _ in range(20_000))
    began = time.process_time()
    found, _ = secret_scan.scan(text)
    assert len(found) == 20_000 and time.process_time() - began < 60


def test_gaps_in_own_archives_are_errors(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x" * 300)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archives"
    warc.write(pages, folder)
    name = next((tmp_path / "archives").glob("*.warc.gz"))
    name.write_bytes(name.read_bytes()[:-5])
    rows = warc.read(spark, folder, payloads=False).collect()
    assert [r.error is None for r in rows] == [False]


@pytest.mark.parametrize("alphabet", ["".join(map(chr, range(0x4E00, 0x4F00))), string.ascii_lowercase, "0123456789", "!?#-="])
def test_joins_inside_one_pre_token(alphabet):
    """Text without a boundary is joined by a window of tokens, not encoded again as a whole."""
    codec, r = bpe.Codec.at(vocabulary(BYTES)), random.Random(1)
    text = "".join(r.choice(alphabet) for _ in range(40_000))
    parts = [text[i : i + 10_000] for i in range(0, 40_000, 10_000)]
    before = codec.encoded
    whole, ids = bpe.fold(codec, [(p, codec.encode(p)) for p in parts])
    assert whole == text and ids == np.array(codec.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert 0 < codec.encoded - before < 20_000


def test_long_texts_are_joined_by_levels(spark):
    r = random.Random(4)
    rows = [(1, "".join(r.choice("ab 日本1!") for _ in range(3_000))), (2, "x" * 2_000), (1, " " * 700), (None, "é" * 1_300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = vocabulary(BYTES)
    got = sorted((x.doc_id or -1, brute.sha(bytes(x.tokens))) for x in bpe.encode(docs, path, long=32).collect())
    assert got == sorted((k or -1, v[1]) for k, v in brute.bpe(rows, path))
