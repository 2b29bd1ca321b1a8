"""BPE encoding and decoding by tree concatenation.

Long texts are cut into pieces that executors encode in parallel; neighbours are then joined pairwise, level by
level, FAN of them in a task. At a join the text around the cut is encoded again in a window that grows until its tokens
agree with those of both sides: at a boundary between pre-tokens, from which on both encodings are the same, as the pattern
reads left to right and looks at most one character ahead; or, inside one long pre-token, where the window's first and
last tokens stay apart from the tokens beside them when both are encoded together. Only where neither is found (long
runs of white space or apostrophes, special tokens) does the window grow to the whole of both sides.

Special-token strings in a text become the special token, as the tokenizers library does it by default.
Null and empty texts have no tokens. Repeated rows, rows that share a key and null keys have a result each; other columns
are not read. Texts beyond what the fast splitter covers (white space outside ASCII,
code points beyond U+024F, or `<|`) go to the tokenizers library itself, so ids never differ from it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.llm.kit import Memo, sliced

#: The pre-token pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of only these code points split alike in Python's re, tiktoken and tokenizers.
_PLAIN = re.compile(r"[\t-\r\x20-\x7e¡-ɏ]*").fullmatch
_CUTS = re.compile(r"\s*\S+|\s+")
LONG, WINDOW, FAN = 32_768, 256, 8


def library(path: str):
    """The tokenizers library's reader of a vocabulary file, its truncation and padding unused."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Codec:
    """Encoder and decoder of one byte-level vocabulary file; one per path and Python worker."""

    _open: dict[str, Codec] = {}

    @classmethod
    def at(cls, path: str) -> Codec:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.of_id: list[bytes] = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.of_id[i] = token
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encoded = 0  # bytes that seams have encoded again
        self.memo = Memo(lambda piece: np.array(self.core.encode_ordinary(piece), "<u4").tobytes(), 150_000)

    @cached_property
    def library(self):
        return library(self.path)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) < 2**20 and _PLAIN(text) and "<|" not in text:
            # a cut before white space that follows other text is always a pre-token boundary
            return b"".join(map(self.memo.__getitem__, _CUTS.findall(text)))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.of_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def joined(self, left: str, left_ids: bytes, right: str, right_ids: bytes) -> bytes:
        """Ids of left + right from the ids of both: the window around the cut grows until both sides agree."""
        reach = WINDOW
        while True:
            tail, head = left[-reach:], right[:reach]
            found = self._agreed(tail, left_ids, head, right_ids, len(tail) < len(left), len(head) < len(right))
            if found is not None:
                return found
            if len(tail) == len(left) and len(head) == len(right):
                return self.encode(left + right)
            reach *= 4

    def _agreed(self, tail: str, left_ids: bytes, head: str, right_ids: bytes, more_left: bool, more_right: bool) -> bytes | None:
        """The joined ids, if the window tail + head shows where both sides' tokens stay as they are.

        Either side ends at a boundary between pre-tokens that no text beyond it can move, or, where the window lies
        inside one long pre-token, at a seam: between two tokens that stay apart when they are encoded together. A
        sequence in which that holds for all neighbours is what the whole pre-token encodes to.
        """
        window = tail + head
        plain = "<|" not in window
        p = _first_boundary(tail, plain) if more_left else 0
        q = _last_boundary(head, plain) if more_right else len(head)
        if p is not None and q is not None:
            kept_l = self._split_at(left_ids, len(tail[p:].encode()), from_end=True)
            kept_r = self._split_at(right_ids, len(head[:q].encode()), from_end=False)
            return None if kept_l is None or kept_r is None else left_ids[:kept_l] + self.encode(tail[p:] + head[:q]) + right_ids[kept_r:]
        if not plain:
            return None
        # the parts of the window that lie in the long pre-token, and what lies before or behind it
        start = 0 if p is None else max([p, *(m.start() for m in _BOUNDARY.finditer(window, p) if p <= m.start() <= len(tail))])
        stop = len(window) if q is None else min([len(tail) + q, *(m.start() for m in _BOUNDARY.finditer(window) if m.start() >= len(tail) and m.start() > start)])
        if start > len(tail) or stop < len(tail) or not _RUN.fullmatch(window, start, stop):
            return None
        if (p is None and not _INSIDE.fullmatch(window, 0, stop)) or (q is None and not _INSIDE.fullmatch(window, start + (window[start] == " "))):
            return None
        l_ids, r_ids = np.frombuffer(left_ids, "<u4"), np.frombuffer(right_ids, "<u4")
        if p is None:
            keep_l, first = self._seam(l_ids[::-1], len(tail.encode()))
            keep_l = len(l_ids) - keep_l
            before = b""
        else:
            at = self._split_at(left_ids, len(tail[p:].encode()), from_end=True)
            if at is None:
                return None
            keep_l, first, before = at // 4, len(tail[start:].encode()), self.encode(tail[p:start])
        if q is None:
            keep_r, last = self._seam(r_ids, len(head.encode()))
            behind = b""
        else:
            at = self._split_at(right_ids, len(head[:q].encode()), from_end=False)
            if at is None:
                return None
            keep_r, last, behind = at // 4, len(window[len(tail) : stop].encode()), self.encode(window[stop : len(tail) + q])
        raw_tail, raw_head = tail.encode(), head.encode()
        middle = raw_tail[len(raw_tail) - first :] + raw_head[:last]
        if not middle:
            return None
        self.encoded += len(middle)
        ids = self.core._core_bpe.encode_single_piece(middle)
        if p is None and (keep_l < 1 or not self._apart(int(l_ids[keep_l - 1]), ids[0])):
            return None
        if q is None and (keep_r >= len(r_ids) or not self._apart(ids[-1], int(r_ids[keep_r]))):
            return None
        return left_ids[: 4 * keep_l] + before + np.array(ids, "<u4").tobytes() + behind + right_ids[4 * keep_r :]

    def _seam(self, ids: np.ndarray, room: int) -> tuple[int, int]:
        """How many ids next to the cut to encode again, and their bytes: one less than lie in the window whole, so that
        the next one does too."""
        sizes: list[int] = []
        total = 0
        for i in ids.tolist():
            if total + len(self.of_id[i]) > room:
                break
            sizes.append(len(self.of_id[i]))
            total += sizes[-1]
        return max(0, len(sizes) - 1), sum(sizes[:-1])

    def _apart(self, a: int, b: int) -> bool:
        return self.core._core_bpe.encode_single_piece(self.of_id[a] + self.of_id[b]) == [a, b]

    def _split_at(self, ids: bytes, n_bytes: int, from_end: bool) -> int | None:
        """Where in ids the last (first) n_bytes of text begin (end); None if no token ends there."""
        seq = np.frombuffer(ids, "<u4")
        step, total, k = (-1, 0, len(seq)) if from_end else (1, 0, 0)
        while total < n_bytes:
            k += step if from_end else 0
            if not 0 <= k < len(seq):
                return None
            total += len(self.of_id[seq[k]])
            k += 0 if from_end else 1
        return 4 * k if total == n_bytes else None


#: Boundaries between pre-tokens that hold whatever surrounds them: white space after other text, and a change between
#: letters, digits and other characters away from apostrophes (which may begin a contraction).
_SPACE_AFTER = regex.compile(r"(?<=\S)(?=[\t-\r ])")
_BOUNDARY = regex.compile(r"(?<=\S)(?=[\t-\r ])|(?<=\p{L})(?=[^\s\p{L}'])|(?<=\p{N})(?=[^\s\p{N}'])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
#: What one pre-token may be, and part of one.
_RUN, _INSIDE = regex.compile(r" ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+)"), regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+")


def _first_boundary(text: str, plain: bool) -> int | None:
    """The first boundary that no earlier text can move; plain texts have no special token that one could split."""
    m = (_BOUNDARY if plain else _SPACE_AFTER).search(text)
    return m.start() if m else None


def _last_boundary(text: str, plain: bool) -> int | None:
    """The last such boundary; white space that it starts must go on to other text inside the window."""
    last = None
    for m in (_BOUNDARY if plain else _SPACE_AFTER).finditer(text):
        if not text[m.start()].isspace() or text[m.start() :].lstrip("\t\n\v\f\r "):
            last = m.start()
    return last


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, others follow U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def fold(codec: Codec, parts: list[tuple[str, bytes]]) -> tuple[str, bytes]:
    """The text and ids of all parts joined pairwise, level by level."""
    while len(parts) > 1:
        level = [(x[0] + y[0], codec.joined(x[0], x[1], y[0], y[1])) for x, y in zip(parts[::2], parts[1::2], strict=False)]
        parts = level + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", long: int = LONG) -> DataFrame:
    """(key, tokens binary): ids of each whole text as little-endian unsigned 32-bit integers.

    Texts of over `long` code points are dealt out in pieces and joined again by key; all others are encoded where
    they are read, without a shuffle. Rows with a null key are kept; rows that share a key keep a result each.
    """
    if long < 2:
        raise ValueError("pieces need two code points at least")
    base = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    arrow = pa.schema([("k", _arrow_type(base)), ("tokens", pa.binary())])
    kind = base.schema["k"].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.encode(t) for t in b.column(1).to_pylist()], pa.binary())], schema=arrow)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for b in sliced(batches):
            ids = pa.array([codec.encode(t) for t in b.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("k", "row", "n", "t")), ids], names=["k", "row", "n", "t", "tokens"])

    def join(group):
        codec = Codec.at(path)
        group = group.sort_values("n")
        text, tokens = fold(codec, list(zip(group["t"], group["tokens"], strict=True)))
        return group.iloc[:1][["k", "row"]].assign(n=group["n"].iloc[0] // FAN, t=text, tokens=tokens)

    size = F.length("t")
    done = base.where(size <= long).mapInArrow(short, f"k {kind}, tokens binary")
    cut = (
        base.where(size > long)
        .withColumn("row", F.monotonically_increasing_id())
        .select("k", "row", "t", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / long).cast("int"))).alias("n"))
        .select("k", "row", "n", F.substring("t", F.col("n") * long + 1, F.lit(long)).alias("t"))
    )
    parts = cut.repartition("row", "n").mapInArrow(pieces, f"k {kind}, row long, n int, t string, tokens binary")
    # a level joins FAN neighbours a task, so that a long text's joins run side by side; as many levels as its pieces need
    left = (base.agg(F.max(size)).first()[0] or 0) // long
    while left:
        parts = parts.groupBy("row", F.floor(F.col("n") / FAN)).applyInPandas(join, f"k {kind}, row long, n int, t string, tokens binary")
        left //= FAN
    return done.unionByName(parts.select("k", "tokens")).withColumnRenamed("k", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", column: str = "tokens") -> DataFrame:
    """(key, text binary): the bytes that the ids stand for; special tokens are kept as their strings."""
    base = tokens.select(F.col(key).alias("k"), F.coalesce(F.col(column), F.lit(b"")).alias("t"))
    arrow = pa.schema([("k", _arrow_type(base)), ("text", pa.binary())])
    kind = base.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lossy(codec.decode(t)) for t in b.column(1).to_pylist()], pa.binary())], schema=arrow)

    return base.mapInArrow(run, f"k {kind}, text binary").withColumnRenamed("k", key)


def lossy(raw: bytes) -> bytes:
    """raw as valid UTF-8: bytes that aren't become U+FFFD."""
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace").encode()


def _arrow_type(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["k"].dataType)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and then decoding every text."""
    ids = encode(docs, path)
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for b in sliced(batches):
            raw = b.column("tokens").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([hashlib.sha256(lossy(codec.decode(x))).hexdigest() for x in raw])],
                schema=arrow,
            )

    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
