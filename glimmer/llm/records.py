"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record is an unsigned 64-bit length, that length's masked CRC-32C, the payload and the payload's masked CRC-32C,
all little-endian. A payload is a flags byte (1: the key is null; 2: ids take four bytes instead of two), the
signed 64-bit key, and the ids. Files hold ascending keys; null keys come first, and rows that share a key
follow each other. Beside each file lies its index, `.idx`, with an entry per record of a fixed width: flags (1: the key is
null), key, offset, size and number of ids. Null and empty texts give a record with the end id alone; texts may be of any
length, a record is never split. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimmer.llm import files
from glimmer.llm.bpe import byte_alphabet, library
from glimmer.llm.kit import Memo, scratch_path, sliced, stored

#: Reversed Castagnoli polynomial and the constant that masks checksums.
CASTAGNOLI, MASK_DELTA = 0x82F63B78, 0xA282EAD8
FILE_BYTES = 16 << 20
_HEAD = struct.Struct("<QI")


@cache
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """[k, byte]: the checksum of byte with k zero bytes after it, for a word; and for 8, 16, ... zero bytes after."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(CASTAGNOLI), np.uint32(0))
    rows = [one]
    for _ in range(7):
        rows.append((rows[-1] >> 8) ^ one[rows[-1] & 0xFF])
    byte = np.arange(256, dtype=np.uint32)
    shifts = []
    shift = np.stack([_zeros(byte << np.uint32(8 * k), one, 8) for k in range(4)])
    for _ in range(40):
        shifts.append(shift)
        shift = np.stack([_shift(shift[k], shift) for k in range(4)])
    return np.stack(rows), shifts


def _zeros(crc: np.ndarray, one: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        crc = (crc >> 8) ^ one[crc & 0xFF]
    return crc


def _shift(crc: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][crc & 0xFF] ^ t[1][(crc >> 8) & 0xFF] ^ t[2][(crc >> 16) & 0xFF] ^ t[3][crc >> 24]


def crc32c(payloads: list[bytes]) -> np.ndarray:
    """CRC-32C of each payload (four bytes at least). Payloads of like size are folded together, pairs of words at a time."""
    word, shifts = _tables()
    out = np.empty(len(payloads), np.uint32)
    levels: dict[int, list[int]] = {}
    for i, p in enumerate(payloads):
        levels.setdefault(max(0, (max(len(p), 1) - 1) >> 3).bit_length(), []).append(i)
    for level, members in levels.items():
        width = 8 << level
        for at in range(0, len(members), step := max(1, (4 << 20) // width)):
            part = members[at : at + step]
            # zeros in front change nothing while the register is zero; the first four bytes take the starting ones
            grid = np.frombuffer(b"".join(bytes(width - len(payloads[i])) + bytes(b ^ 0xFF for b in payloads[i][:4]) + payloads[i][4:] for i in part), np.uint8).reshape(len(part), -1, 8)
            crc = word[7][grid[:, :, 0]]
            for k in range(1, 8):
                crc = crc ^ word[7 - k][grid[:, :, k]]
            for k in range(level):
                crc = _shift(crc[:, ::2], shifts[k]) ^ crc[:, 1::2]
            out[part] = ~crc[:, 0]
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    heads, bodies = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [a + heads[i].tobytes() + p + bodies[i].tobytes() for i, (a, p) in enumerate(zip(lengths, payloads, strict=True))]


def unframe(data: bytes) -> list[bytes]:
    """The payloads of a file; ValueError at the first checksum that doesn't hold or a record that is cut off."""
    payloads, lengths, heads, bodies, at = [], [], [], [], 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"a record is cut off at byte {at}")
        n, head = _HEAD.unpack_from(data, at)
        if at + 16 + n > len(data):
            raise ValueError(f"a record is cut off at byte {at}")
        lengths.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + n])
        heads.append(head)
        bodies.append(struct.unpack_from("<I", data, at + 12 + n)[0])
        at += 16 + n
    for what, given in ((lengths, heads), (payloads, bodies)):
        if what and (masked(crc32c(what)) != np.array(given, np.uint32)).any():
            raise ValueError("a checksum does not hold")
    return payloads


class WordCodec:
    """Encoder of a word-end vocabulary: NFC, lower case, white space dropped. One per path and Python worker."""

    _open: dict[str, WordCodec] = {}
    #: Words of these code points are normalised and split alike in Python and in the tokenizers library.
    _plain = re.compile(r"[!-~À-ÿ]+").fullmatch
    _split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+").findall

    @classmethod
    def at(cls, path: str) -> WordCodec:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, to_byte, end, special = spec["model"]["vocab"], byte_alphabet(), "</w>", {t["content"] for t in spec["added_tokens"]}
        # a word's last symbol carries the word end, which becomes a byte that UTF-8 never has
        ranks = {bytes(to_byte[c] for c in token.removesuffix(end)) + b"\xff" * token.endswith(end): i for token, i in vocabulary.items() if token not in special}
        self.piece = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.wide = max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) > 0xFFFF
        self.kind = "<u4" if self.wide else "<u2"
        self.memo = Memo(self._word)

    @cached_property
    def library(self):
        return library(self.path)

    def _word(self, word: str) -> bytes:
        if self._plain(word) and "<|" not in word and len(word) < 100_000:
            ids = [i for part in self._split(unicodedata.normalize("NFC", word).lower()) for i in self.piece(part.encode() + b"\xff")]
        else:
            ids = self.library.encode(word, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Words between ASCII white space never share a token, so each is encoded once and remembered."""
        return b"".join(map(self.memo.__getitem__, _words(text))) if text else b""


_words = re.compile(r"[^\t-\r ]+").findall


def payload(key: int | None, ids: bytes, wide: bool) -> bytes:
    return struct.pack("<Bq", (key is None) + 2 * wide, key or 0) + ids


def parsed(p: bytes) -> tuple[int | None, np.ndarray]:
    flags, key = struct.unpack_from("<Bq", p)
    return None if flags & 1 else key, np.frombuffer(p, "<u4" if flags & 2 else "<u2", offset=9)


def write(docs: DataFrame, path: str, folder: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append end_id, write record files and their indexes to folder in ascending key order; the index
    as `read_index` gives it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arrow = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, number = WordCodec.at(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], codec.kind).tobytes()
        held: list[tuple[int | None, bytes, int]] = []
        room = FILE_BYTES

        def flush() -> pa.RecordBatch:
            nonlocal held, room, number
            framed = frame([payload(k, ids, codec.wide) for k, ids, _ in held])
            sizes = [len(x) for x in framed]
            starts = np.cumsum([0, *sizes[:-1]])
            index = np.empty(len(held), INDEX)
            index["flags"], index["key"] = [k is None for k, _, _ in held], [k or 0 for k, _, _ in held]
            index["offset"], index["size"], index["n_ids"] = starts, sizes, [c for _, _, c in held]
            files.put(folder, f"part-{part:05d}-{number:05d}.rec", b"".join(framed))
            files.put(folder, f"part-{part:05d}-{number:05d}.idx", index.tobytes())
            out = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, number, len(held)), arrow, strict=True)], schema=arrow)
            held, room, number = [], FILE_BYTES, number + 1
            return out

        for b in sliced(batches):
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = codec.encode(t) + end
                held.append((k, ids, len(ids) // len(end)))
                room -= len(ids) + 25
                if room <= 0:
                    yield flush()
        if held:
            yield flush()

    ordered = rows.repartitionByRange(n, "k").sortWithinPartitions("k")
    written = stored(ordered.mapInArrow(run, "part int, file int, records long"), "written")
    return spark.createDataFrame([], _INDEX_SQL) if written.isEmpty() else read_index(spark, folder)


#: An index entry, and the columns of an index as a table.
INDEX = np.dtype([("flags", "<u1"), ("key", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("n_ids", "<u8")])
_INDEX_SQL = "key long, part int, file int, offset long, size long, n_ids long"


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """(key, part, file, offset, size, n_ids) of every record, from the index files of a folder."""
    arrow = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("file", pa.int32()), ("offset", pa.int64()), ("size", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                part, number = map(int, re.search(r"part-(\d+)-(\d+)\.idx$", name).groups())
                e = np.frombuffer(data.as_py(), INDEX)
                key = pa.array(np.ascontiguousarray(e["key"]), pa.int64(), mask=e["flags"] & 1 == 1)
                yield pa.RecordBatch.from_arrays([key, *(pa.array(np.full(len(e), x), pa.int32()) for x in (part, number)), *(pa.array(e[c].astype(np.int64)) for c in ("offset", "size", "n_ids"))], schema=arrow)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.idx").load(folder).select("path", "content")
    return content.mapInArrow(run, _INDEX_SQL)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, file, place, key, ids binary): every record of a folder, with all checksums verified."""
    arrow = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("place", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                part, number = map(int, re.search(r"part-(\d+)-(\d+)\.rec$", name).groups())
                found = [parsed(p) for p in unframe(data.as_py())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(found), pa.int32()), pa.array([number] * len(found), pa.int32()), pa.array(range(len(found)), pa.int64()), pa.array([k for k, _ in found], pa.int64()), pa.array([i.astype("<u4").tobytes() for _, i in found], pa.binary())],
                    schema=arrow,
                )

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.rec").load(folder).select("path", "content")
    return content.mapInArrow(run, "part int, file int, place long, key long, ids binary")


def read_shuffled(index: DataFrame, folder: str, seed: int) -> DataFrame:
    """(key, ids binary): the records that index names, dealt out in an order that seed fixes, each read by its offset."""
    arrow = pa.schema([("key", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parsed(unframe(files.get(folder, f"part-{r['part']:05d}-{r['file']:05d}.rec", r["offset"], r["size"]))[0]) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([i.astype("<u4").tobytes() for _, i in found], pa.binary())], schema=arrow)

    order = F.xxhash64(F.lit(seed), "part", "file", "offset")
    return index.repartition(order).sortWithinPartitions(order).mapInArrow(run, "key long, ids binary")


def digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the records written for docs, from the files as read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "records")
    index = write(docs, path, folder, end_id)
    arrow = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("place", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("part", "file", "place", "key")), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], schema=arrow)

    if index.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    found = read(spark, folder).mapInArrow(run, "part int, file int, place long, doc_id long, n_tokens long, ids_crc32 long")
    # the index is read back; one row a file goes through the only window that isn't partitioned
    sums = index.groupBy("part", "file").agg(F.sum("n_ids").alias("n"))
    before = sums.withColumn("base", F.sum("n").over(Window.orderBy("part", "file")) - F.col("n")).select("part", "file", "base")
    inside = Window.partitionBy("part", "file").orderBy("place")
    return found.withColumn("upto", F.sum("n_tokens").over(inside)).join(before, ["part", "file"]).select("doc_id", (F.col("base") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
