"""How many candidate pairs and stored tables linkage makes."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from glimmer.llm import kit, linkage, lines, ngram_join, postings
from glimmer.llm.linkage import MOST, compared, linked, shared_keys

KIND = np.dtype([("value", "<i8")])


def always():
    """Every pair is a candidate. Made inside a function, so that it is sent to the tasks whole."""

    def near(x, y, wide):
        return np.ones(len(x), bool), np.abs(x["value"] - y["value"]).astype(float)

    return near


def packed(n: int) -> bytes:
    return np.int64(n).tobytes()


def test_a_large_group_gives_few_pairs(spark):
    """600 ids of one group and three others share a key: pairs are few, and what was left out is told by group."""
    members = [(i, 0 if i < 600 else i, packed(8), np.uint32(1).tobytes(), packed(i)) for i in range(603)]
    rows = spark.createDataFrame(members, "id long, component long, keys binary, blocks binary, attr binary")
    found = compared(rows, KIND, always(), MOST).collect()
    assert {(r.a, r.b) for r in found if r.b is not None} == {(599, 600), (599, 601), (599, 602), (600, 601), (600, 602), (601, 602)}
    assert {r.a for r in found if r.b is None} == {0, 600, 601, 602}


def test_a_link_behind_many_nearer_failures_is_found(spark):
    """Of ids that share a key, 0 to 299 hang together; 1000 is linked to 0 alone, which is the furthest from it."""
    ids = [*range(300), 1000]
    entries = kit.stored(spark.createDataFrame([(i,) for i in ids], "id long"), "ids")

    def take(b):
        out = np.empty(b.num_rows, [("key", "<u8"), ("id", "<i8")])
        out["key"], out["id"] = 8, b.column(0).to_numpy()
        return out

    attrs = spark.createDataFrame([(i, packed(i)) for i in ids], "id long, attr binary")
    check = lambda p: p.where("(a < 300 AND b < 300) OR (a = 0 AND b = 1000)").select("a", "b")
    values = lambda x: kit.stored(x.selectExpr("id", "id AS value"), "values")
    # leaders would meet at once: the link is left to the comparison of whole keys
    alone = kit.stored(shared_keys(entries, take).selectExpr("id", "keys", "IF(id = 1000, id, lead) AS lead", "wide"), "shared")
    got = {r.id: r.component for r in linked(alone, attrs, KIND, always(), values, check).collect()}
    assert got == dict.fromkeys(ids, 0)


def test_unused_tables_are_deleted(spark):
    """Of line dedup only what its result reads stays, and small tables of links."""
    folder = Path(kit.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    rows = [(i, f"the first line of text number {i // 2} is like others\nanother line {i} of its own with words {i * i}") for i in range(40)]
    out = lines.digests(spark.createDataFrame(rows, "doc_id long, text string"), bands=lines.BANDS)
    left = {q.name for p in folder.iterdir() if p.name not in before for q in p.iterdir()}
    assert left <= {"gone", "edges", "groups"}, left
    assert out.where("n_removed > 0").count() >= 20


def test_a_pair_of_many_keys_is_one_row(spark):
    """Ids that share 40 keys, which lie in several lanes, are one pair."""
    keys = np.arange(8, 88, 2, dtype=np.uint64).tobytes()
    members = [(i, i, keys, np.ones(40, np.uint32).tobytes(), packed(i)) for i in (5, 9)]
    rows = spark.createDataFrame(members, "id long, component long, keys binary, blocks binary, attr binary")
    assert [tuple(r) for r in compared(rows, KIND, always(), MOST).collect()] == [(5, 9, False)]


def test_attributes_travel_once_a_lane(spark, monkeypatch):
    """Two ids with 4,000 keys send no more than their keys, and their attributes once for each lane."""
    wide = np.dtype([("value", "<i8"), ("rest", "V4096")])
    value = packed(1) + bytes(4096)
    keys, blocks = np.arange(8, 8008, 2, dtype=np.uint64).tobytes(), np.ones(4000, np.uint32).tobytes()
    rows = spark.createDataFrame([(i, i, keys, blocks, value) for i in (5, 9)], "id long, component long, keys binary, blocks binary, attr binary").coalesce(1)
    sent = []
    shuffled = linkage.shuffled
    monkeypatch.setattr(linkage, "shuffled", lambda df: sent.append(df) or shuffled(df))
    assert [tuple(r) for r in compared(rows, wide, always(), MOST).collect()] == [(5, 9, False)]
    assert sum(len(r.data) for r in sent[0].collect()) < 400_000


def test_a_task_holds_few_near_pairs(monkeypatch):
    """What is held of near pairs doesn't follow their number: 400 ids of one group and 400 others make 240,000."""
    seen: list[int] = []
    best = linkage._best
    monkeypatch.setattr(linkage, "_best", lambda found, most: seen.append(sum(len(x[0]) for x in found)) or best(found, most))
    ids = np.arange(800)
    entry = np.dtype([("key", "<u8"), ("id", "<i8"), ("component", "<i8"), ("wide", "?"), ("attr", KIND)])
    e = np.zeros(800, entry)
    e["id"], e["component"], e["attr"]["value"] = ids, np.where(ids < 400, 0, ids), ids
    monkeypatch.setattr(linkage, "FOUND", 20_000)
    (a, *_), cut = linkage.nearest(e, always(), MOST)
    assert max(seen) < 60_000 and len(a) and 0 in cut


def test_character_halves_reject_and_never_lose():
    """Strings of equal counts in another order aren't candidates; strings within the distance always are."""
    near = lines.nearness(lines.BITS, lines.PERCENT)

    def candidates(pairs):
        x, y = (lines.described([p[i] for p in pairs]) for i in range(2))
        x["sim"], y["sim"] = 0, 0
        return near(x, y, np.ones(len(pairs), bool))[0]

    a = "ab " * 30 + "cd " * 30
    assert candidates([(a, a), (a, "cd " * 30 + "ab " * 30)]).tolist() == [True, False]
    r = random.Random(3)
    pairs = []
    while len(pairs) < 400:
        p = "".join(r.choice("abc ") for _ in range(r.randrange(10, 120)))
        q = list(p)
        side = r.choice((0, len(p)))
        for _ in range(len(p) // 5):
            at = r.choice((side, r.randrange(len(q) + 1)))
            q[at : at + r.randrange(2)] = r.choice(("", "x", "a"))
        if (q := "".join(q)) and lines.edit_similar(p, q, lines.PERCENT):
            pairs.append((p, q))
    assert candidates(pairs).all()


def test_links_by_pieces_are_those_of_whole_blocks(monkeypatch):
    r = np.random.default_rng(4)
    base = np.arange(60, dtype=np.uint64)
    sets = [np.unique(np.append(r.choice(base, 54, replace=False), r.integers(100, 200, 3).astype(np.uint64))) for _ in range(50)]
    docs = r.integers(1, 5, 50)
    want = ngram_join.linked_sets(sets, 75)
    np.fill_diagonal(want, False)
    assert want.any()
    side = r.integers(0, 2, 50) + 3
    monkeypatch.setattr(ngram_join, "PIECE", 7)
    monkeypatch.setattr(ngram_join, "SOME", 300)
    assert (ngram_join.counted(sets, docs, None, 75) == want @ docs).all()
    across = want & (side[:, None] != side[None, :])
    assert (ngram_join.counted(sets, docs, side, 75) == across @ docs).all()


def test_stages_leave_small_tables(spark):
    """What a stage's result still reads is a list of ids, not signatures or an index."""
    folder = Path(kit.shared_dir(spark).removeprefix("file:"))
    docs = spark.createDataFrame([(i, f"a text of a number of words that is number {i // 2} and has some more") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "of words that is number 3 and has some more")], "item_id long, text string")
    for stage, want in ((lambda: ngram_join.kept(docs), {"copies", "edges"}), (lambda: postings.clean(docs, items), {"hits"})):
        before = {p.name for p in folder.iterdir()}
        out = stage()
        assert {q.name for p in folder.iterdir() if p.name not in before for q in p.iterdir()} <= want
        assert 0 < out.count() < 20
