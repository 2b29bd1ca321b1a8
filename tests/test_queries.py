"""Every registered query that has SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from glimmer.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    return (None if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, db, name):
    df = __spark_entry__.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = db.sql(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in want.fetchall()), key=repr)


def test_queries_without_sql_are_known():
    assert set(QUERIES) - set(ORACLES) == {"photo_id_hash", "text_bm25_porter", "text_embeddings"}


def test_ids_of_files(spark, sf):
    import xxhash
    from glimmer.queries import files

    want = sorted((r["size"], xxhash.xxh64_hexdigest(f"{r.relative_path}{r['size']}{r.mtime}")) for r in files(spark, sf).collect())
    got = QUERIES["photo_id_hash"](spark, sf).collect()
    assert sorted((r["size"], r.portable_id) for r in got) == want and want
    assert all(len(r.photo_id) == 16 and int(r.photo_id, 16) >= 0 for r in got)
    assert len({r.photo_id for r in got}) == len({r.portable_id for r in got})


def test_stemmed_search_is_sqlites(spark, sf, db):
    import sqlite3

    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(doc_id, text, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO f VALUES (?, ?)", db.sql("SELECT doc_id, text FROM documents").fetchall())
    want = {int(k): s for k, s in con.execute("SELECT doc_id, -bm25(f) FROM f WHERE f MATCH 'text: (licenses OR rights)'").fetchall()}
    got = {r.doc_id: r.score for r in QUERIES["text_bm25_porter"](spark, sf).collect()}
    assert set(got) == set(want) and want
    assert all(math.isclose(got[k], want[k], rel_tol=1e-4, abs_tol=2e-6) for k in want)


def test_embedded_texts(spark, sf, db):
    import numpy as np
    from glimmer.models import hashing_embedder

    texts = dict(db.sql("SELECT doc_id, text FROM documents").fetchall())
    got = QUERIES["text_embeddings"](spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts) and not any(r.error for r in got)
    for r in got:
        v = hashing_embedder(64)([texts[r.doc_id]])[0]
        assert np.allclose(r.embedding, v / (np.linalg.norm(v) or 1), atol=1e-6)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 50


def test_library_stands_alone():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__spark_entry__.__file__).parent
    code = "import sys; sys.modules['glimmer.llm'] = None; import __spark_entry__ as e; print(len(e.queries()) > 50, any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False"], out.stderr
