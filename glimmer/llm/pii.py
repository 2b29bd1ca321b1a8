"""Personal data by anchors: an automaton finds where something may be, small parsers find where it begins and ends.

An Aho-Corasick automaton reads each whole text once and reports at-signs, plus signs, digits, colons, schemes and
identifier cues ("iban", "ssn", "account" and so on). At each anchor a deterministic parser expands to both sides as far
as the kind's characters go and validates what it has: domains of an email address, parts of an IP address, Luhn's
digit of a card, digits of a phone number, the remainder of an IBAN, ranges of a social security number. A parser starts
where the one before it of the same kind ended, so it takes what the kind's pattern would match, leftmost and without
overlaps, in time that grows with the text.

Base kinds: email, ip, card, phone. Added kinds: login (a URL with a user's name), tel (a telephone URL), spelled (an
address with a bracketed at), ip6, mac, iban, ssn, account (a number after a cue). Added spans may overlap base ones.

Null and empty texts have no spans; repeated rows and rows that share an id have a result each, other columns are not
read. Texts may be of any length. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from ipaddress import AddressValueError, IPv6Address

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import sliced

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "tel", "spelled", "ip6", "mac", "iban", "ssn", "account")
#: What the automaton looks for in lower-case text, and whose parser is asked.
ANCHORS = {
    "@": "email", "+": "phone", **dict.fromkeys("0123456789", "digit"), ":": "colon", "://": "scheme", "tel:": "tel", "[at]": "spelled", "(at)": "spelled", "{at}": "spelled",
    "iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account", "passport": "account", "routing": "account", "licence": "account", "license": "account",
}
_PIECE, _OVERLAP = 1 << 20, max(map(len, ANCHORS)) - 1

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED, _GROUPED = re.compile(rb"[0-9]++(?:\.[0-9]++)*+"), re.compile(rb"[0-9](?:[ -]?[0-9])*+")
_DIALLED = re.compile(rb"\+[0-9]([ ().0-9-]++)")
_SCHEME, _AUTHORITY = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-", re.compile(rb"[^\s/?#\"'<>]++")
_TEL = re.compile(rb"\+?[0-9](?:[().-]*[0-9])*+")
_SPELLED = re.compile(rb"[\[({]at[\])}]\x20?([A-Za-z0-9-]++)((?:(?:\x20?[\[({]dot[\])}]\x20?|\.)[A-Za-z0-9-]++)++)", re.I)
_COLONS = b"0123456789abcdefABCDEF:."
_MAC = re.compile(rb"[0-9a-f]{2}(?::[0-9a-f]{2}){5}", re.I)
_IBAN = re.compile(rb"[\s:#=.-]{0,3}(?:number|no\.?)?[\s:#=-]{0,3}([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}+)", re.I)
_SSN = re.compile(rb"[^0-9\n]{0,24}([0-9]{3})[ -]([0-9]{2})[ -]([0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(rb"\x20?(?:number|num\.?|no\.?|nr\.?|id)?\x20?(?:is)?\x20?[:#=]?\x20?([A-Za-z0-9](?:-?[A-Za-z0-9]){5,33}+)(?![A-Za-z0-9])", re.I)


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor, kind in ANCHORS.items():
        found.add_word(anchor, (kind, len(anchor)))
    found.make_automaton()
    return found


def anchors(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of each anchor by its end, in bytes; a piece of the text is searched at a time."""
    for begin in range(0, len(raw), _PIECE):
        held = max(0, begin - _OVERLAP)
        # ASCII letters alone change case, so offsets stay
        for last, (kind, n) in automaton().iter(raw[held : begin + _PIECE].lower().decode("latin-1")):
            if held + last >= begin:
                yield held + last + 1 - n, held + last + 1, kind


def _reach(raw: bytes, end: int, least: int, chars: bytes) -> int:
    """Where the run of chars that ends at end starts, not before least."""
    step = 64
    while True:
        at = max(least, end - step)
        rest = len(raw[at:end].rstrip(chars))
        if rest or at == least:
            return at + rest
        step *= 8


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban(value: bytes) -> int:
    """The length of the longest start of value, cut at spaces only, that has the right remainder; 0 if there is none."""
    while value:
        plain = value.replace(b" ", b"").upper()
        if len(plain) >= 15 and int("".join(str(int(chr(c), 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return len(value)
        value = value.rpartition(b" ")[0]
    return 0


class Scan:
    """The spans of one text, and where each kind's last attempt ended."""

    def __init__(self, raw: bytes):
        self.raw, self.spans = raw, []
        self.ends = dict.fromkeys((*KINDS, "colon"), 0)
        for start, end, kind in anchors(raw):
            getattr(self, kind)(start, end)

    def _add(self, kind: str, start: int, end: int) -> None:
        self.ends[kind] = end
        self.spans.append((start, KINDS.index(kind), end))

    def email(self, at: int, after: int) -> None:
        begin = _reach(self.raw, at, self.ends["email"], _LOCAL)
        if begin < at and (m := _DOMAIN.match(self.raw, after)):
            self._add("email", begin, m.end())

    def digit(self, at: int, after: int) -> None:
        if at >= self.ends["ip"]:
            m = _DOTTED.match(self.raw, at)
            self.ends["ip"] = m.end()
            place, parts = at, m[0].split(b".")
            for i in range(0, len(parts) - 3, 4):
                size = 3 + sum(map(len, parts[i : i + 4]))
                values = [p.lstrip(b"0") for p in parts[i : i + 4]]
                if all(len(v) <= 3 and int(v or b"0") <= 255 for v in values):
                    self.spans.append((place, KINDS.index("ip"), place + size))
                place += size + 1
        if at >= self.ends["card"]:
            m = _GROUPED.match(self.raw, at)
            self.ends["card"] = m.end()
            if m.end() - at >= 14:
                digits = m[0].replace(b" ", b"").replace(b"-", b"")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    self.spans.append((at, KINDS.index("card"), m.end()))

    def phone(self, at: int, after: int) -> None:
        if m := _DIALLED.match(self.raw, at):
            rest = m[1].rstrip(b" ().-")
            if len(rest) >= 2 and 10 <= 1 + sum(map(rest.count, (b"%d" % d for d in range(10)))) <= 15:
                self._add("phone", at, m.start(1) + len(rest))

    def scheme(self, at: int, after: int) -> None:
        begin = _reach(self.raw, at, self.ends["login"], _SCHEME)
        if begin < at and (m := _AUTHORITY.match(self.raw, after)) and m[0].find(b"@") > 0 and m[0][-1:] != b"@":
            self._add("login", begin, m.end())

    def tel(self, at: int, after: int) -> None:
        if (m := _TEL.match(self.raw, after)) and 7 <= sum(48 <= c <= 57 for c in m[0][:64]) <= 15 and len(m[0]) <= 64:
            self._add("tel", at, m.end())

    def spelled(self, at: int, after: int) -> None:
        gap = at - (self.raw[at - 1 : at] == b" ")
        begin = _reach(self.raw, gap, min(gap, self.ends["spelled"]), _LOCAL)
        if begin < gap and (m := _SPELLED.match(self.raw, at)):
            self._add("spelled", begin, m.end())

    def colon(self, at: int, after: int) -> None:
        if at < self.ends["colon"]:
            return
        begin = _reach(self.raw, at, self.ends["colon"], _COLONS)
        end = after
        while self.raw[end : end + 1] and self.raw[end : end + 1] in _COLONS:
            end += 1
        self.ends["colon"] = end
        found = self.raw[begin:end].rstrip(b".")
        if found.endswith(b":") and not found.endswith(b"::"):
            found = found[:-1]
        edges = self.raw[max(0, begin - 1) : begin] + self.raw[begin + len(found) : begin + len(found) + 1]
        if len(found) > 45 or re.search(rb"[A-Za-z0-9_]", edges):
            return
        if _MAC.fullmatch(found):
            self._add("mac", begin, begin + len(found))
        elif len(re.findall(rb"[0-9A-Fa-f]+", found)) >= 4:
            try:
                IPv6Address(found.decode())
            except AddressValueError:
                return
            self._add("ip6", begin, begin + len(found))

    def iban(self, at: int, after: int) -> None:
        if (m := _IBAN.match(self.raw, after)) and (n := _iban(m[1])):
            self._add("iban", m.start(1), m.start(1) + n)

    def ssn(self, at: int, after: int) -> None:
        m = _SSN.match(self.raw, after)
        if m and m.start(1) >= self.ends["ssn"] and m[1] not in (b"000", b"666") and m[1] < b"900" and m[2] != b"00" and m[3] != b"0000":
            self._add("ssn", m.start(1), m.end())

    def account(self, at: int, after: int) -> None:
        m = _ACCOUNT.match(self.raw, after)
        if m and m.start(1) >= self.ends["account"] and sum(48 <= c <= 57 for c in m[1]) >= 6:
            self._add("account", m.start(1), m.end(1))


def scan(text: str | None) -> list[tuple[int, str, int]]:
    """Spans (start, kind, end) in code points, by start, then kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    spans = sorted(Scan(raw).spans)
    if spans and len(raw) != len(text):
        points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        spans = [(int(points[a - 1]) if a else 0, k, int(points[b - 1])) for a, k, b in spans]
    return [(a, KINDS[k], b) for a, k, b in spans]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans): spans as kind:start:end, joined by commas, for every row."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    schema = pa.schema([("k", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [scan(b.column(1)[i].as_py()) for i in range(b.num_rows)]
            counts = [[sum(k == kind for _, k, _ in s) for s in found] for kind in BASE]
            base = [joined([x for x in s if x[1] in BASE]) for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(map(joined, found), pa.string())], schema=schema)

    return rows.mapInArrow(run, "k long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string").withColumnRenamed("k", key)


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its kind in brackets; of spans that overlap the earliest and longest counts."""

    def run(texts):
        return texts.map(_masked, na_action="ignore")

    return docs.withColumn(text, F.pandas_udf(run, "string")(F.col(text)))


def _masked(text: str) -> str:
    out, at = [], 0
    for a, kind, b in sorted(scan(text), key=lambda s: (s[0], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    return find(docs).select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
