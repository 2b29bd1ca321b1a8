"""WARC archives: a writer that turns repeated payloads into revisit records, and a reader that salvages.

Every record that is written is a gzip member of its own. The reader also takes members of several records, records of any
type and digests of other algorithms and encodings. It checks each member, the record's header and length, and digests
whose algorithm it knows. After a failed check it looks for the next member (or, in a plain archive, the next version
line) that starts a valid record, goes on from there and logs the bytes between as a quarantined gap; of a member that
can be unpacked only the records that fail are quarantined. Places are the archive's bytes; records of one member share its.

An archive is read as one row, so archives of up to 2 GB can be read; those written here have 16 MB. Payloads may be of any
length below that. A null html is an empty payload. Payloads of under `least` bytes are never revisits. Rows that repeat both page_id
and payload are each written as what that page is. A null page_id is read back as null and can't be referred to.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import files
from glimmer.llm.kit import scratch_path, sliced, stored

FILE_BYTES, LEAST, PIECE = 16 << 20, 100, 1 << 14
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/"
_PAGE = re.compile(r"^<urn:page:(-?\d+)>$")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit has the HTTP header alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>" if page_id is not None else "WARC-Record-ID: <urn:page>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"] if url else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    """A record that fails a check."""


#: Algorithms by the names that headers give them, without punctuation.
_ALGORITHMS = {n: getattr(hashlib, n) for n in ("md5", "sha1", "sha256", "sha512")}
_VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r\n")
_CHUNKED = re.compile(rb"(?im)^transfer-encoding:[^\r\n]*chunked")


def _holds(label: str, data: bytes) -> bool | None:
    """Whether a digest header is right for data; None if its algorithm or encoding isn't known."""
    name, _, value = label.partition(":")
    algorithm = _ALGORITHMS.get(re.sub(r"[^a-z0-9]", "", name.lower()))
    if algorithm is None:
        return None
    digest, value = algorithm(data).digest(), value.strip()
    if len(value) == 2 * len(digest):
        return value.lower() == digest.hex()
    try:
        for decode in (base64.b32decode, base64.b64decode):
            raw = decode(value.upper() + "=" * (-len(value) % 8) if decode is base64.b32decode else value + "=" * (-len(value) % 4))
            if len(raw) == len(digest):
                return raw == digest
    except (binascii.Error, ValueError):
        pass
    return None


def _dechunked(body: bytes) -> bytes:
    """A body without its chunks' sizes; as far as they can be read."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(body, at):
        size = int(m[1], 16)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
        if not size:
            break
    return b"".join(out)


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at `at` and where it ends; Damaged if any check fails."""
    if not _VERSION_LINE.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damaged("header is cut off")
    lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not re.fullmatch("[0-9]+", head.get("content-length", "")):
        raise Damaged("no length")
    start, stop = end + 4, end + 4 + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damaged("length does not lead to the record's end")
    block, kind = data[start:stop], head.get("warc-type")
    sound = _holds(head.get("warc-block-digest", ""), block)
    if sound is False:
        raise Damaged("block digest differs")
    # a record without a content type is taken as it was before there were others here: as HTTP if it has its headers
    http_like = head.get("content-type", "application/http").lower().startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if http_like else (b"", b"", block)
    label = head.get("warc-payload-digest", "")
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        n = int(size[1]) if size else 0
    else:
        n = len(payload)
        # writers differ in whether a chunked body counts with its chunks; a block whose own digest holds is whole anyway
        if label and not sound and _holds(label, payload) is False and not (_CHUNKED.search(http) and _holds(label, _dechunked(payload))):
            raise Damaged("payload digest differs")
    page, refers = (_PAGE.match(head.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
    return {"page_id": page and int(page[1]), "url": head.get("warc-target-uri"), "record_type": kind, "payload": payload, "payload_bytes": n, "payload_digest": label.removeprefix("sha256:"), "refers_to": refers and int(refers[1])}, stop + 4


def _member_at(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the gzip member at `at`, with {"error"} for what fails in it, and where the member ends."""
    z, parts, view = zlib.decompressobj(31), [], memoryview(data)
    try:
        while not z.eof:  # piece by piece, as what follows the member is copied from the last piece
            if at >= len(data):
                raise Damaged("member is cut off")
            parts.append(z.decompress(view[at : at + PIECE]))
            at = min(at + PIECE, len(data))
    except zlib.error as e:
        raise Damaged(f"member: {e}") from None
    plain = b"".join(parts)
    end, found = at - len(z.unused_data), []
    if plain:
        found = [{k: v for k, v in r.items() if k not in ("at", "end")} for r in salvage(plain)]
    if not any("error" not in r for r in found):
        raise Damaged("member has no record")
    return found, end


def salvage(data: bytes) -> Iterator[dict]:
    """Records ({"at", "end", ...}) and quarantined gaps ({"at", "end", "error"}) of an archive, in its order."""
    at = 0
    view = data
    while at < len(view):
        packed = view.startswith(MEMBER, at)
        try:
            found, end = _member_at(view, at) if packed else _one(view, at)
            yield from ({"at": at, "end": end, **r} for r in found)
            at = end
            continue
        except Damaged as e:
            error = str(e)
        gap, probe = at, at + 1
        while True:
            ahead = [x for x in (view.find(MEMBER, probe), view.find(VERSION, probe)) if x >= 0]
            if not ahead:
                at = len(view)
                break
            probe = min(ahead)
            try:
                _member_at(view, probe) if view.startswith(MEMBER, probe) else parse(view, probe)
                at = probe
                break
            except Damaged:
                probe += 1
        yield {"at": gap, "end": at, "error": error}


def _one(data: bytes, at: int) -> tuple[list[dict], int]:
    found, end = parse(data, at)
    return [found], end


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to folder; a row for each file written."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    ids = base.where(F.octet_length("payload") >= least).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = ids.join(first, "digest").where("page_id IS NULL OR page_id <> refers_to").distinct()
    marked = base.alias("b").join(again.alias("a"), F.expr("b.page_id <=> a.page_id AND b.digest = a.digest"), "left").select("b.page_id", "b.url", "b.payload", "b.digest", "a.refers_to")
    arrow = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            name = f"part-{part:05d}-{number:05d}.warc.gz"
            files.put(folder, name, b"".join(held))
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64())], schema=arrow)
            number, held, size = number + 1, [], 0
            return out

        for b in sliced(batches):
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                held.append(member(record(*row)))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return stored(marked.mapInArrow(run, "file string, records long, bytes long"), "archives")


_ROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("end", pa.int64()), ("error", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record below folder, and a row with an error for each quarantined gap; plain and gzip archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                rows, size = [], 0
                for r in salvage(data.as_py()):
                    rows.append({"file": path} | r | ({} if payloads else {"payload": None}))
                    size += len(r.get("payload", b"")) if payloads else 100
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")
    return content.mapInArrow(run, "file string, at long, end long, error string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the archives written for pages."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "archives")
    if write(pages, folder).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    whole = F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat(F.lit("gap in "), "file", F.lit(": "), "error")).cast("long"))
    return read(spark, folder, payloads=False).select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
