"""Full-text search: a query grammar, planned as column expressions over token arrays, ranked by BM25.

Words stand side by side for AND; there are OR, NOT (with a left side), parentheses, "phrases", prefixes with a
trailing *, column filters `name:` and NEAR(words, n). The whole query is one pass over the texts: no Python but
stemming, no shuffle but the one row of corpus statistics and the top rows of each task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimmer.functions import text as T

K1, B, FLOOR = 1.2, 0.75, 1e-6


class QueryError(ValueError):
    """A query that the grammar doesn't have."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    kind: str  # AND, OR, NOT
    left: object
    right: object


_LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()])|(NEAR)\s*\(|([^\s"()*:,]+)\s*:(?!:)|(\*)|(,)|([^\s"()*:,]+))', re.S)


def _words(raw: str) -> tuple[str, ...]:
    folded = raw.lower().translate(str.maketrans(T.MARKED, T.PLAIN))
    return tuple(re.findall(r"[^\W_]+", folded))


def parse(query: str, strict: bool = False):
    """The query's tree, or None for a query without words. strict: what full-text engines reject raises QueryError."""
    lexemes, at = [], 0
    while at < len(query.rstrip()):
        m = _LEXEME.match(query, at)
        if not m:
            if strict or query[at:].count('"') % 2:
                raise QueryError(f"unexpected {query[at:]!r}")
            at += 1
            continue
        lexemes.append((m.lastindex, m[m.lastindex]))
        at = m.end()
    if strict and not lexemes:
        raise QueryError("empty query")
    if strict and any(kind == 7 and not re.fullmatch(r"[\w\x80-\U0010ffff]+", x) for kind, x in lexemes):
        raise QueryError("a character that needs quotes")
    tree, rest = _either(lexemes, 0)
    if rest != len(lexemes):
        raise QueryError("unbalanced parentheses")
    return tree


def _is(lexemes: list, i: int, word: str) -> bool:
    return i < len(lexemes) and lexemes[i] == (7, word)


def _either(x: list, i: int):
    left, i = _both(x, i)
    while _is(x, i, "OR"):
        right, i = _both(x, i + 1)
        left = _op("OR", left, right)
    return left, i


def _both(x: list, i: int):
    left, i = _without(x, i)
    while i < len(x) and not _is(x, i, "OR") and x[i] != (2, ")"):
        i += _is(x, i, "AND")
        right, i = _without(x, i)
        left = _op("AND", left, right) if left is not None and right is not None else left or right
    return left, i


def _without(x: list, i: int):
    left, i = _term(x, i)
    while _is(x, i, "NOT"):
        right, i = _term(x, i + 1)
        left = _op("NOT", left, right)
    return left, i


def _op(kind: str, left, right):
    if left is None or right is None:
        raise QueryError(f"{kind} needs two sides")
    return Op(kind, left, right)


def _term(x: list, i: int):
    if i >= len(x):
        raise QueryError("the query ends early") if x else QueryError("empty query")
    kind, value = x[i]
    if kind == 2 and value == "(":
        tree, i = _either(x, i + 1)
        if i >= len(x) or x[i] != (2, ")"):
            raise QueryError("unbalanced parentheses")
        return tree, i + 1
    if kind == 3:
        phrases, distance, i = [], 10, i + 1
        while i < len(x) and x[i] != (2, ")"):
            if x[i][0] == 6:
                if i + 1 >= len(x) or not x[i + 1][1].isdigit():
                    raise QueryError("NEAR needs a number after its comma")
                distance, i = int(x[i + 1][1]), i + 2
                continue
            phrase, i = _term(x, i)
            if phrase is not None:
                phrases.append(phrase)
        return Near(tuple(phrases), distance), i + 1
    if kind == 4:
        tree, i = _term(x, i + 1)
        return _in_column(tree, value), i
    if kind in (1, 7):
        if kind == 7 and value in ("AND", "OR", "NOT"):
            raise QueryError(f"{value} needs two sides")
        words = _words(value[1:-1].replace('""', '"') if kind == 1 else value)
        prefix = i + 1 < len(x) and x[i + 1][0] == 5
        return (Phrase(words, prefix) if words else None), i + 1 + prefix
    raise QueryError(f"unexpected {value!r}")


def _in_column(tree, column: str):
    if isinstance(tree, Phrase):
        return Phrase(tree.words, tree.prefix, column)
    if isinstance(tree, Op):
        return Op(tree.kind, _in_column(tree.left, column), _in_column(tree.right, column))
    if isinstance(tree, Near):
        return Near(tuple(_in_column(p, column) for p in tree.phrases), tree.distance)
    return tree


def leaves(tree, scored: bool = True) -> list[tuple[object, bool]]:
    if isinstance(tree, Op):
        return leaves(tree.left, scored) + leaves(tree.right, scored and tree.kind != "NOT")
    return [(tree, scored)] if tree is not None else []


def _starts(tokens: Column, phrase: Phrase) -> Column:
    """Where the phrase starts in an array of tokens, from 0."""
    n = len(phrase.words)
    last = F.size(tokens) - n

    def here(i: Column) -> Column:
        tests = []
        for k, word in enumerate(phrase.words):
            token = F.get(tokens, i + k)
            tests.append(token.startswith(word) if phrase.prefix and k == n - 1 else token == word)
        return reduce(lambda a, b: a & b, tests)

    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def _occurrences(tokens: Column, phrase: Phrase) -> Column:
    if len(phrase.words) == 1:
        word = phrase.words[0]
        return F.size(F.filter(tokens, lambda t: t.startswith(word) if phrase.prefix else t == word))
    return F.size(_starts(tokens, phrase))


def phrases(leaf) -> tuple[Phrase, ...]:
    return leaf.phrases if isinstance(leaf, Near) else (leaf,)


def _near(starts: Callable[[Phrase], Column], near: Near) -> Column:
    """Whether all phrases have an occurrence with at most `distance` tokens between one's end and the next one's start."""
    first, *rest = near.phrases
    tests = [F.exists(starts(first), _close(starts(p), len(first.words), len(p.words), near.distance)) for p in rest]
    return reduce(lambda a, b: a & b, tests, F.size(starts(first)) > 0)


def _once(value: Column) -> Column:
    """value, which filters above it can't be pushed below: they would split and count every text again for each term."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _close(other: Column, n: int, m: int, distance: int):
    return lambda i: F.exists(other, lambda j: (j - i - n <= distance) & (i - j - m <= distance) & (i != j))


def search(texts: DataFrame, query: str, key: str, column: str = "text", limit: int | None = None, stem: bool = False, strict: bool = False, key_tokens: int = 1) -> DataFrame:
    """(key, score): the limit best rows by BM25, ties by key; a row counts key_tokens tokens for its id.

    Terms right of NOT don't score; a term that is repeated counts again. An empty query has no result.
    """
    empty = texts.where("false").select(key, F.lit(0.0).alias("score"))
    if strict:
        tree = parse(query, True)
    else:
        tree = parse(query) if query.strip() else None
    if tree is None:
        return empty
    tokens = T.tokens(F.col(column))
    if stem:
        from glimmer.functions.porter import stem as stem_word
        from glimmer.functions.porter import stemmed

        tokens, tree = stemmed(tokens), mapped(tree, stem_word)
    at = {p: f"_f{i}" for i, p in enumerate(dict.fromkeys(p for x, _ in leaves(tree) for p in phrases(x)))}
    base = texts.select(key, _once(F.coalesce(tokens, F.array().cast("array<string>"))).alias("_t"))
    counted = base.select(key, "_t", _once(F.size("_t") + key_tokens).alias("_n"), *((F.lit(0) if p.column not in (None, column) else _occurrences(F.col("_t"), p)).alias(c) for p, c in at.items()))
    hits = scored(counted, tree, at, lambda p: _starts(F.col("_t"), p))
    return hits.select(key, "score").orderBy(F.col("score").desc(), key).limit(limit or 200)


def scored(counted: DataFrame, tree, at: dict[Phrase, str], starts: Callable[[Phrase], Column]) -> DataFrame:
    """The rows of counted, all texts, that the tree holds for, with a BM25 score.

    counted has a length _n and, in the columns that `at` names, each phrase's number of occurrences; starts gives where
    they are.
    """

    def holds(node) -> Column:
        if isinstance(node, Phrase):
            return F.col(at[node]) > 0
        if isinstance(node, Near):
            return reduce(lambda a, b: a & b, [F.col(at[p]) > 0 for p in node.phrases]) & _near(starts, node)
        left, right = holds(node.left), holds(node.right)
        return left & right if node.kind == "AND" else left | right if node.kind == "OR" else left & ~right

    names = [at[p] for x, counts in leaves(tree) if counts for p in phrases(x)]
    stats = counted.agg(F.count("*").alias("_total"), F.avg("_n").alias("_avg"), *(F.count_if(F.col(c) > 0).alias(f"{c}_df") for c in dict.fromkeys(names)))
    hits = counted.where(holds(tree)).crossJoin(F.broadcast(stats))  # one row
    return hits.withColumn("score", F.expr(" + ".join(share(idf_sql("_total", f"{c}_df"), c, "_n", "_avg") for c in names)))


def idf_sql(total, df) -> str:
    raw = f"ln(({total} - {df} + 0.5D) / ({df} + 0.5D))"
    return f"IF({raw} <= 0, {FLOOR}D, {raw})"


def share(weight: str, count: str, length: str, mean) -> str:
    """A phrase's part of a score, in SQL."""
    return f"({weight} * (CAST({count} AS DOUBLE) * {K1 + 1}D / (CAST({count} AS DOUBLE) + {K1}D * ({1 - B}D + {B}D * {length} / {mean}))))"


def mapped(tree, fn):
    if isinstance(tree, Phrase):
        return Phrase(tuple(w if tree.prefix and i == len(tree.words) - 1 else fn(w) for i, w in enumerate(tree.words)), tree.prefix, tree.column)
    if isinstance(tree, Near):
        return Near(tuple(mapped(p, fn) for p in tree.phrases), tree.distance)
    return Op(tree.kind, mapped(tree.left, fn), mapped(tree.right, fn))


def normalized(query: str) -> str:
    """A query as typed, made safe: see functions.text.normalized_query, which this equals."""
    words = re.sub(f"[{T.DROPPED}]+", " ", query).split()
    if len(words) > 1 and any(w in T.OPERATORS for w in words):
        return query
    return " ".join('"' + w.replace('"', '""') + '"' if any(c in w for c in T.QUOTED) else w for w in words)


def build_index(texts: DataFrame, key: str, column: str = "text", stem: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, term, tf) and (key, dl): postings and lengths, to be stored and searched many times."""
    tokens = T.tokens(F.col(column))
    if stem:
        from glimmer.functions.porter import stemmed

        tokens = stemmed(tokens)
    base = texts.select(key, F.coalesce(tokens, F.array().cast("array<string>")).alias("t"))
    # a row's terms are counted where the row is read, so the shuffle moves each posting once
    terms = base.select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count("*").cast("int").alias("tf"))
    return terms, base.select(key, F.size("t").alias("dl"))


def idf(n: int, df: int) -> float:
    value = math.log((n - df + 0.5) / (df + 0.5))
    return value if value > 0 else FLOOR
