"""Secrets by fixed patterns and by a battery of randomness tests.

Candidates are runs of at least 20 characters of `[A-Za-z0-9+/_=-]` outside the patterns' matches. A run is cut at
each '=' that isn't padding at its end, and a part that no alphabet holds at its separators (`/`, `+`, `-`, `_`), those
of one alphabet first; parts of at least 20 characters are candidates of their own. For each, the
encoding with the smallest alphabet that holds all its characters is inferred (decimal, hex, base32, letters of one
case, base36, base62, base64), and three tests ask whether it is a uniform random string of that alphabet:
chi-squared of symbol classes, runs above and below the alphabet's middle, and serial correlation. Fisher's method
combines them into one p, which is uniform for random strings and near 0 for words and identifiers. False
discoveries are held per encoding and length class over all documents: the count of random strings is taken from
the upper half of p, where nothing else is, and the cut is the lowest one above which at most `rate` of candidates
are more than that. Classes without evidence of random strings give no finding.

Null and empty texts have no spans; repeated rows and rows that share an id have a result each, other columns are not read.
Texts may be of any length. All offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import sliced, stored

LEAST, RATE, BINS = 20, 0.1, 64
KINDS = ("assign", "access", "hex", "random")
#: Either case of ASCII letters only: Unicode case folding would also take other letters.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_HINTS = tuple(w.encode() for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]+")
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]+")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Encodings by rising alphabet size.
ALPHABETS = {
    "decimal": b"0123456789",
    "hex": b"0123456789abcdef",
    "HEX": b"0123456789ABCDEF",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": b"0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": b"+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": b"-_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
}
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}, len(a)) for name, a in ALPHABETS.items()]


def infer(token: bytes) -> tuple[str, list[int], int] | None:
    """Encoding, symbols and alphabet size; None if no alphabet holds the token. Padding at its end doesn't count."""
    body = token.rstrip(b"=")
    seen = set(body)
    for name, members, rank, size in _SETS:
        if seen <= members:
            return name, [rank[c] for c in body], size
    return None


_PADDED, _SEPARATORS = re.compile(rb"[^=]+(?:=+\Z)?"), tuple(re.compile(p) for p in (rb"[^/+]+", rb"[^_-]+", rb"[^/+_-]+"))


def parts(run: bytes) -> list[tuple[int, int]]:
    """(start, end) of a run's candidates: between inner '=', and between separators where no alphabet holds a part."""
    out: list[tuple[int, int]] = []
    for m in _PADDED.finditer(run):
        if infer(m[0]):
            out += [m.span()] if len(m[0]) >= LEAST else []
            continue
        # a part's separators may be symbols of its own alphabet, so cuts at the other alphabet's come first
        split = [[x.span() for x in p.finditer(run, *m.span()) if len(x[0]) >= LEAST] for p in _SEPARATORS]
        first, second = ([x for x in s if infer(run[x[0] : x[1]])] for s in split[:2])
        rest = [x for x in split[2] if not _meets(first, x) and not _meets(second, x)]
        kept: list[tuple[int, int]] = []  # longest first, in order of their places
        for x in sorted({*first, *second, *rest}, key=lambda x: (x[0] - x[1], x[0])):
            if not _meets(kept, x):
                insort(kept, x)
        out += kept
    return sorted(out)


def _meets(spans: list[tuple[int, int]], x: tuple[int, int]) -> bool:
    """Whether x overlaps one of some sorted spans that don't overlap each other."""
    before = bisect_left(spans, (x[1],))
    return before > 0 and spans[before - 1][1] > x[0]


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees >= x), by Wilson and Hilferty's cube root."""
    if k <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(symbols: list[int], size: int) -> float:
    """Fisher's combination of the three tests' p for symbols of range(size); 0 for a token of a single symbol."""
    n = len(symbols)
    if n < 2 or len(set(symbols)) == 1:
        return 0.0
    # symbol classes of an expected count of 4 at least
    classes = max(2, min(size, n // 4))
    counts = [0] * classes
    for s in symbols:
        counts[s * 29 % size * classes // size] += 1
    share = [0] * classes
    for s in range(size):
        share[s * 29 % size * classes // size] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, share, strict=True))
    p1 = _chi_tail(chi, classes - 1)
    up = [2 * s >= size for s in symbols]
    a = sum(up)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p2 = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p2 = 2.0 ** (1 - n)
    mean = sum(symbols) / n
    d = [s - mean for s in symbols]
    r = sum(x * y for x, y in zip(d, d[1:], strict=False)) / sum(x * x for x in d)
    p3 = _normal_tail((r + 1 / n) * math.sqrt(n))
    stat = sum(-2 * math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    half = stat / 2
    return min(1.0, math.exp(-half) * (1 + half + half * half / 2))


def scan(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, int, str, int, float]]]:
    """Base spans (start, kind, end) by start and kind, and candidates (start, end, encoding, length class, p)."""
    if not text:
        return [], []
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []  # start, kind, end in bytes
    low = raw.lower()
    spans: list[tuple[int, int, int]] = []
    if any(h in low for h in _HINTS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    edges = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8)])
    begins, ends = np.concatenate([[0], edges + 1]), np.concatenate([edges, [len(raw)]])
    wide = np.flatnonzero(ends - begins >= LEAST)
    tokens: list[tuple[int, int]] = []
    for a, b in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(raw, a, b) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(raw, a, b) if m.end() - m.start() >= 24]
        tokens += [(m.start() + x, m.start() + y) for m in _RUN.finditer(raw, a, b) if m.end() - m.start() >= LEAST for x, y in parts(m[0])]
    point = _points(raw, text, [x for s in found for x in (s[0], s[2])] + [x for s in tokens for x in s])
    spans += [(point[a], kind, point[b]) for a, kind, b in found]
    spans.sort()
    candidates = []
    starts, reach = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
    for a, b in tokens:
        start, end = point[a], point[b]
        before = bisect_left(starts, end)
        if before and reach[before - 1] > start:
            continue
        token = raw[a:b]
        if (kind := infer(token)) and len(kind[1]) >= LEAST:
            candidates.append((start, end, kind[0], min(9, int(2 * math.log2(len(kind[1]) / LEAST))), randomness(kind[1], kind[2])))
    return [(a, KINDS[k], b) for a, k, b in spans], candidates


def _points(raw: bytes, text: str, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    if len(raw) == len(text) or not offsets:
        return {x: x for x in offsets}
    starts = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return {x: int(starts[x - 1]) if x else 0 for x in offsets}


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def cuts(counts: list[tuple[str, int, int, int]], rate: float = RATE) -> dict[tuple[str, int], int]:
    """The lowest bin to report for each (encoding, length class), from (encoding, class, bin, count) of all candidates."""
    grids: dict[tuple[str, int], np.ndarray] = {}
    for kind, level, at, n in counts:
        grids.setdefault((kind, level), np.zeros(BINS))[at] += n
    out = {}
    for key, grid in grids.items():
        upper = grid[BINS // 2 :].sum() / (BINS - BINS // 2)  # random strings a bin
        for at in range(BINS) if upper else ():
            above, expected = grid[at:].sum(), upper * (BINS - at)
            if above - expected <= rate * above:
                out[key] = at
                break
    return out


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans): spans as kind:start:end, joined by commas, for every row."""
    base = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    entry = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("level", pa.int32()), ("bin", pa.int32())])
    arrow = pa.schema([("k", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("candidates", pa.list_(entry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [scan(t) for t in b.column(1).to_pylist()]
            counts = [[sum(k == kind for _, k, _ in s) for s, _ in rows] for kind in KINDS[:3]]
            found = [[{"start": a, "end": e, "kind": k, "level": lv, "bin": min(BINS - 1, int(p * BINS))} for a, e, k, lv, p in c] for _, c in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([joined(s) for s, _ in rows], pa.string()), pa.array(found, pa.list_(entry))], schema=arrow)

    scanned = stored(base.mapInArrow(run, "k long, n_assign long, n_access long, n_hex long, base string, candidates array<struct<start:long,end:long,kind:string,level:int,bin:int>>"), "scanned")
    # at most encodings x length classes x bins rows come back
    grid = scanned.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.level", "c.bin").count()
    chosen = cuts([tuple(r) for r in grid.collect()], rate)
    out_schema = pa.schema([("k", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for s, found in zip(b.column("base").to_pylist(), b.column("candidates").to_pylist(), strict=True):
                extra = [(c["start"], "random", c["end"]) for c in found if c["bin"] >= chosen.get((c["kind"], c["level"]), BINS)]
                if extra:
                    old = [(int(a), k, int(e)) for k, a, e in (x.split(":") for x in s.split(",") if x)]
                    s = joined(old + extra)
                spans.append(s)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(spans, pa.string())], schema=out_schema)

    return scanned.mapInArrow(choose, "k long, n_assign long, n_access long, n_hex long, base string, spans string").withColumnRenamed("k", key)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    return find(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
