"""Plain versions of ranked search, personal data and the manifest, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter


def ranked(docs, items, limit=50):
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    rows = [(k, Counter(terms(t))) for k, t in docs]
    n, total = sum(bool(c) for _, c in rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for k, c in rows:
            score = 0
            for t in wanted:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    m = 100 - 50 + ((50 * sum(c.values()) * n) // total)
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, math.inf if k is None else k))
        out += [(item, i, None if k == math.inf else k, -s) for i, (s, k) in enumerate(sorted(found)[:limit], 1)]
    return sorted(out, key=lambda r: r[:2])


def personal(text):
    text = text or ""
    email = list(re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text))
    ip = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    card = [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and checks(digits(m[0]))]
    phone = [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    kinds = ("email", "ip", "card", "phone")
    spans = sorted((m.start(), k, m.end()) for k, ms in enumerate((email, ip, card, phone)) for m in ms)
    return len(email), len(ip), len(card), len(phone), ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def digits(s):
    return re.sub("[^0-9]", "", s)


def checks(d):
    twice = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in row))


def tree(nodes):
    """The root, and for each leaf its (left, right) siblings by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, x in enumerate(at):
            run = x // 16 * 16
            ways[i].append(("".join(nodes[run:x]), "".join(nodes[x + 1 : run + 16])))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at = [x // 16 for x in at]
    return nodes[0], ways


def manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text), ids different in a source."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by[s]])
    root, upper = tree([trees[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        sub, ways = trees[s]
        for r, way in zip(by[s], ways, strict=True):
            way = way + upper[k]
            bad = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                bad = (*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4]))
            x = leaf(bad)
            for a, b in way:
                x = h(a, x, b)
            out.append((r[0], leaf(r), sub, root, h(*(a + b for a, b in way)), x, x == root))
    return out
