"""A Merkle manifest of a dataset: a digest for each row, a root for each source and one for all, and proofs.

A leaf is the SHA-256 of a row's framed fields. The leaves of a group (source), in order of their ids, are the bottom of
a tree in which every 16 consecutive nodes, and a last run of fewer, become their hash; nothing is padded. The groups'
roots, in order of their names, are the leaves of one more such tree.

Rows are sorted over all partitions and packed into chunks of consecutive leaves of a group, each of which then knows at
which index it starts. A chunk keeps a stack with an open run a level: the sixteenth node of an aligned run closes it,
and its hash is carried to the level above, as in counting with base 16. What can't be closed in a chunk, since its run
began before or goes on after, or since the group ends, is a peak. Peaks are a small share of all nodes; level by level
they are grouped into runs and hashed. Going down again, each peak gets the path from itself to the root, and each chunk,
with its own nodes and its peaks' paths, makes the proofs of its leaves. Nothing but the root and the greatest size of a
group reaches the driver; a group of any size lies in as many tasks as it has chunks.

Defined cases: null fields are framed as '-'; a null group is the first group, and a null id comes first in its group;
rows that share an id are ordered by their digests, equal rows are leaves of their own; an empty table has no
row and no root. Texts may be of any length, one row is hashed at a time. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.kit import sliced, stored

FANOUT, CHUNK = 16, 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def framed(fields: list[bytes | None]) -> bytes:
    """Fields as one string that can be read back: '-' for null, else length, ':' and value."""
    return b"".join(b"-" if f is None else b"%d:%s" % (len(f), f) for f in fields)


def combined(children: bytes) -> bytes:
    """The digest of a run, whose raw digests are hashed as hex text."""
    return sha256(children.hex().encode()).digest()


def case_folded(fields: list[bytes | None]) -> list[bytes | None]:
    """A row that was tampered with, if the checksum of its id (the first field) is divisible by 5: its last field in lower case."""
    if fields[0] is None or fields[-1] is None or zlib.crc32(fields[0]) % 5:
        return fields
    return [*fields[:-1], fields[-1].lower()]


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", tamper: Callable[[list[bytes | None]], list[bytes | None]] | None = None) -> DataFrame:
    """(g, k, digest, other, row): each row's group and id, its digest, the digest of the row as tamper gives it, and a number."""
    # a name that sorts as the group does, null first
    g = F.when(F.col(group).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    rows = docs.select(g.alias("g"), F.col(key).cast("long").alias("k"), *(F.col(c).cast("string").cast("binary").alias(f"f{i}") for i, c in enumerate(fields)))
    schema = pa.schema([("g", pa.string()), ("k", pa.int64()), ("digest", pa.binary()), ("other", pa.binary()), ("row", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for b in sliced(batches):
            digests, others = [], []
            for at in range(b.num_rows):
                row = [b.column(2 + i)[at].as_py() for i in range(len(fields))]
                changed = tamper(row) if tamper else row
                digests.append(sha256(framed(row)).digest())
                others.append(digests[-1] if changed == row else sha256(framed(changed)).digest())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(digests, pa.binary()), pa.array(others, pa.binary()), pa.array(range(number, number + b.num_rows), pa.int64())], schema=schema)
            number += b.num_rows

    return stored(rows.mapInArrow(run, "g string, k long, digest binary, other binary, row long"), "leaves")


def mountain(start: int, digests: list[bytes]) -> tuple[list[list[bytes]], list[int], list[tuple[int, int, bytes]]]:
    """Of consecutive leaves from index start: the nodes of each level, each level's first index, and the peaks (level, index, digest)."""
    nodes: list[list[bytes]] = [[]]
    firsts, stack, peaks = [start], [[]], []
    for i, digest in enumerate(digests):
        level, index = 0, start + i
        while True:
            nodes[level].append(digest)
            stack[level].append((level, index, digest))
            if (index + 1) % FANOUT:
                break
            run, stack[level] = stack[level], []
            if len(run) < FANOUT:  # it began in another chunk
                peaks += run
                break
            digest = combined(b"".join(d for _, _, d in run))
            level, index = level + 1, index // FANOUT
            if level == len(nodes):
                nodes.append([])
                stack.append([])
                firsts.append(index)
    return nodes, firsts, peaks + [x for run in stack for x in run]


def _chunks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Sorted rows (g, k, digest, other), packed: (part, no, g, n, ks, digests, others), numbered in order within each group."""
    schema = pa.schema([("part", pa.int32()), ("no", pa.int64()), ("g", pa.string()), ("n", pa.int32()), ("ks", pa.list_(pa.int64())), ("digests", pa.binary()), ("others", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, name, held = TaskContext.get().partitionId(), 0, None, []

        def chunk() -> pa.RecordBatch:
            ks, digests, others = zip(*held, strict=True)
            values = part, no, name, len(held), ks, b"".join(digests), b"".join(others)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

        for b in batches:
            for g, *row in zip(*(b.column(c).to_pylist() for c in ("g", "k", "digest", "other")), strict=True):
                if held and (g != name or len(held) >= size):
                    yield chunk()
                    no, held = no + 1, []
                name = g
                held.append(row)
        if held:
            yield chunk()

    placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    return stored(placed.select("g", "k", "digest", "other").mapInArrow(pack, "part int, no long, g string, n int, ks array<long>, digests binary, others binary"), "chunks")


def _wide(level: int) -> Column:
    """How many nodes a list of `total` leaves has at a level."""
    return F.expr(f"(total + {FANOUT**level - 1}L) DIV {FANOUT**level}L")


@dataclass
class Forest:
    """Trees over groups of leaves: packed leaves, where each chunk starts, peaks, merged runs by level, and a top for each group."""

    chunks: DataFrame
    starts: DataFrame  # part, no, start
    peaks: DataFrame  # g, total, level, idx, digest, part, no
    runs: list[DataFrame]  # g, run, total, children
    tops: DataFrame  # g, level, digest


def forest(rows: DataFrame, order: list[str], size: int = CHUNK) -> Forest:
    """The trees of rows (g, k, digest, other), whose leaves are in the given order within each g."""
    chunks = _chunks(rows, order, size)
    by_group = Window.partitionBy("g")
    before = by_group.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)
    small = chunks.select("part", "no", "g", F.col("n").cast("long").alias("n"))  # a row for some thousand leaves
    starts = stored(small.select("part", "no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(by_group).alias("total")), "starts")
    schema = pa.schema([("g", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("part", pa.int32()), ("no", pa.int64())])

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 16):
            out = []
            for g, total, start, part, no, digests in zip(*(b.column(c).to_pylist() for c in ("g", "total", "start", "part", "no", "digests")), strict=True):
                out += [(g, total, level, idx, d.hex(), part, no) for level, idx, d in mountain(start, _split(digests))[2]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    peaks = stored(chunks.join(starts, ["part", "no"]).select("g", "total", "start", "part", "no", "digests").mapInArrow(climb, "g string, total long, level int, idx long, digest string, part int, no long"), "peaks")
    greatest = starts.agg(F.max("total")).first()[0] or 0
    runs, tops, carried, level = [], [], None, 0
    while True:
        nodes = peaks.where(F.col("level") == level).select("g", "total", "idx", "digest")
        if carried is not None:
            nodes = nodes.unionByName(carried)
        tops.append(nodes.where(_wide(level) == 1).select("g", F.lit(level).alias("level"), "digest"))
        if greatest <= FANOUT**level:
            break
        wide = _wide(level)
        inner = nodes.where(wide > 1).groupBy("g", "total", F.expr(f"idx DIV {FANOUT}L").alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("c"))
        whole = F.size("c") == F.least(F.lit(FANOUT), wide - F.col("run") * FANOUT)
        merged = inner.select("g", "total", "run", F.when(whole, F.col("c.digest")).otherwise(F.raise_error(F.lit("a run of nodes isn't whole"))).alias("children"))
        runs.append(stored(merged, f"runs{level}"))
        carried = runs[-1].select("g", "total", F.col("run").alias("idx"), F.sha2(F.array_join("children", "").cast("binary"), 256).alias("digest"))
        level += 1
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return Forest(chunks, starts, peaks, runs, stored(every, "tops"))


def _split(digests: bytes) -> list[bytes]:
    return [digests[i : i + 32] for i in range(0, len(digests), 32)]


def _routed(f: Forest, above: DataFrame) -> DataFrame:
    """(part, no, start, routes): each chunk's peaks with their paths to the root.

    A path is text: for each level the node's place in its run and the number of its siblings, a hex digit each, and
    the siblings' digests. above has (g, path): what follows at a group's top.
    """
    last = f.tops.join(above, "g").select("g", "level", F.lit(0).cast("long").alias("idx"), "path")
    down, parts = None, []
    for level in range(len(f.runs), -1, -1):
        here = last.where(F.col("level") == level).drop("level")
        if down is not None:
            opened = f.runs[level].join(down.withColumnRenamed("idx", "run"), ["g", "run"]).select("g", "run", "path", F.posexplode("children").alias("p", "own"), "children")
            others = F.concat(F.slice("children", F.lit(1), F.col("p")), F.slice("children", F.col("p") + 2, F.lit(FANOUT)))
            digit = F.lower(F.concat(F.hex(F.col("p").cast("long")), F.hex(F.size(others).cast("long"))))
            here = here.unionByName(opened.select("g", (F.col("run") * FANOUT + F.col("p")).alias("idx"), F.concat(digit, F.array_join(others, ""), F.col("path")).alias("path")))
        down = stored(here, f"paths{level}")
        parts.append(f.peaks.where(F.col("level") == level).join(down, ["g", "idx"]).select("part", "no", "level", "idx", "path"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # a chunk has at most 30 peaks a level
    grouped = every.groupBy("part", "no").agg(F.collect_list(F.struct("level", "idx", "path")).alias("routes"))
    return grouped.join(f.starts.select("part", "no", "start"), ["part", "no"])


def paths(start: int, digests: list[bytes], routes: list[dict]) -> Iterator[str]:
    """The path of each leaf of a chunk: within the chunk up to a peak, then the peak's."""
    nodes, firsts, _ = mountain(start, digests)
    known = {(r["level"], r["idx"]): r["path"] for r in routes}
    texts: dict[tuple[int, int], str] = {}

    def path(level: int, idx: int) -> str:
        if (level, idx) in known:
            return known[level, idx]
        run, p = divmod(idx, FANOUT)
        if (level, run) not in texts:
            at = run * FANOUT - firsts[level]
            texts[level, run] = b"".join(nodes[level][at : at + FANOUT]).hex()
        own = f"{p:x}{FANOUT - 1:x}{texts[level, run][: _HEX * p]}{texts[level, run][_HEX * (p + 1) :]}{path(level + 1, run)}"
        if level:
            known[level, idx] = own
        return own

    for i in range(len(digests)):
        yield path(0, start + i)


def siblings(path: str) -> list[tuple[str, str]]:
    """(left, right) siblings of each level of a path, as joined hex digests."""
    out, at = [], 0
    while at < len(path):
        p, n = int(path[at], 16), int(path[at + 1], 16)
        out.append((path[at + 2 : at + 2 + _HEX * p], path[at + 2 + _HEX * p : at + 2 + _HEX * n]))
        at += 2 + _HEX * n
    return out


def fold(digest: str, path: str) -> str:
    """The root that a leaf's digest and its path give."""
    for left, right in siblings(path):
        digest = sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def _mapped(f: Forest, above: DataFrame, fn: Callable[[dict, Iterator[str]], list[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """fn(chunk, its leaves' paths) for every chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            chunk = b.to_pylist()[0]
            rows = fn(chunk, paths(chunk["start"], _split(chunk["digests"]), chunk["routes"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return f.chunks.join(_routed(f, above), ["part", "no"]).mapInArrow(run, schema)


@dataclass
class Manifest:
    """root: the dataset's digest (None if it is empty); roots: (g, digest) of each group, names as leaves() gives them;
    trees: the groups' trees; above: (g, path), each group's path to the root, after its own digest and the root."""

    root: str | None
    roots: DataFrame
    trees: Forest
    above: DataFrame


def manifest(rows: DataFrame, size: int = CHUNK) -> Manifest:
    """The manifest of leaves(...)."""
    trees = forest(rows, ["k", "digest", "row"], size)
    roots = trees.tops.select("g", "digest")
    raw = F.unhex("digest")
    names = roots.select(F.lit("").alias("g"), F.lit(None).cast("long").alias("k"), raw.alias("digest"), F.col("g").cast("binary").alias("other"), F.col("g").alias("name"))
    # a group's name takes the place of the second digest, and is read back by its length
    upper = forest(names.withColumn("other", F.concat(F.lpad(F.hex(F.length("other")), 8, "0").cast("binary"), F.col("other"))), ["name"], size)
    top = upper.tops.first()
    arrow = pa.schema([("g", pa.string()), ("path", pa.string())])

    def named(chunk: dict, ways: Iterator[str]) -> list[tuple]:
        out, at = [], 0
        for digest, way in zip(_split(chunk["digests"]), ways, strict=True):
            n = int(chunk["others"][at : at + 8], 16)
            out.append((chunk["others"][at + 8 : at + 8 + n].decode(), f"|{digest.hex()}|{top.digest}|{way}"))
            at += 8 + n
        return out

    start = upper.tops.select("g", F.lit("").alias("path"))
    above = stored(_mapped(upper, start, named, "g string, path string", arrow), "above")
    return Manifest(top.digest if top else None, roots, trees, above)


def proofs(m: Manifest) -> DataFrame:
    """(k, leaf, subroot, root, path, folded_root) of every row: path has the siblings up to the root, folded_root is
    made of them and of the digest of the row as it was tampered with, or the leaf."""
    arrow = pa.schema([("k", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))])

    def proved(chunk: dict, ways: Iterator[str]) -> list[tuple]:
        out = []
        for k, digest, other, way in zip(chunk["ks"], _split(chunk["digests"]), _split(chunk["others"]), ways, strict=True):
            inner, subroot, root, outer = way.split("|")
            proof = sha256()
            for left, right in siblings(inner + outer):
                proof.update(f"{left}{right}".encode())
            out.append((k, digest.hex(), subroot, root, proof.hexdigest(), fold(other.hex(), inner + outer)))
        return out

    return _mapped(m.trees, m.above, proved, "k long, leaf string, subroot string, root string, proof_sha256 string, folded_root string", arrow)


def digests(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document, where texts of some were folded to lower case."""
    found = proofs(manifest(leaves(docs, tamper=case_folded), size))
    return found.withColumnRenamed("k", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))
