"""Vectors stored by cluster, and exact searches that read the clusters alone which can hold a result.

Centres are the means of a bounded sample; each vector lies in the part of its nearest centre, in order of its distance
from it. With the least and greatest distance of a part, the triangle inequality bounds how near to a query any of its
vectors can be. A search reads the parts with the best bounds until they have as many rows as it wants, and then all
whose bound isn't worse than the worst row kept; within a part the same inequality is a range of distances, which
prunes files and row groups. Scores, order and ties are those of vector.topk over all vectors.

Cosine works on vectors of length 1, whose distances order as their cosines do; zero vectors are a part of their own that
is always read. For dot products the bound is the centre's product and the query's length times the greatest distance.
Changes of keys write the parts of their old and new vectors. Vectors that are null aren't stored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glimmer.operators import vector
from glimmer.sources.parts import Parts
from glimmer.sources.snapshots import Snapshots

#: Vectors that centres are made of, centres, and the part of zero vectors.
SAMPLE, CENTRES, ZERO = 20_000, 1024, -1
#: What single precision and sums in another order may move a distance by, as a share of the lengths that are involved.
SLACK = 1e-5


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Means of k groups of a sample (Lloyd's rounds from evenly spaced rows)."""
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        nearest = _nearest(sample, found)[0]
        sums, n = np.zeros_like(found), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, sample)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


def _nearest(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.argmin((c * c).sum(1) - 2 * m @ c.T, axis=1)
    return at, np.linalg.norm(m - c[at], axis=1)


class VectorStore(Parts):
    """A store of (key, embedding) for one metric: Cosine, or Euclid, which serves Dot as well."""

    def __init__(self, store: Snapshots, name: str = "vector_parts", kind: str = "string", view=None):
        at = view or store.view()
        kind = (at.notes.get(name) or {}).get("kind", kind)
        super().__init__(store, name, StructType.fromDDL(f"key {kind}, embedding array<float>, away double"), at)
        self.kind = kind

    @classmethod
    def _like(cls, other):
        return cls(other.store, other.name, other.kind)

    def rebuild(self, vectors: DataFrame, key: str, column: str = "embedding", metric: str = "Cosine", clusters: int | None = None) -> VectorStore:
        """Write all vectors anew; vectors of different lengths are an error."""
        if metric not in ("Cosine", "Euclid"):
            raise ValueError(f"no store for {metric}")
        rows = vectors.where(F.col(column).isNotNull())
        size = rows.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("d")).first()
        sample = rows.select(column) if size.n <= SAMPLE else rows.where(F.pmod(F.xxhash64(key), F.lit(-(-size.n // SAMPLE))) == 0).select(column).limit(SAMPLE)
        drawn = np.array([r[0] for r in sample.collect()], np.float64).reshape(-1, size.d or 1)
        drawn = _unit(drawn) if metric == "Cosine" else drawn
        drawn = np.unique(drawn, axis=0)
        k = min(clusters or max(1, round(math.sqrt(size.n))), CENTRES, len(drawn)) if len(drawn) else 0
        made = centres(drawn, k) if k else np.zeros((1, size.d or 1))
        self.kind = vectors.schema[key].dataType.simpleString()
        self.schema["key"].dataType = vectors.schema[key].dataType
        placed = self._placed(rows.select(F.col(key).alias("key"), F.col(column).alias("embedding")), made, metric)
        note = {"kind": self.kind, "metric": metric, "dimension": size.d or 1, "centres": made.tolist()}

        def make(fresh: VectorStore) -> dict:
            every = range(-1, len(made))
            return fresh._described(fresh.written(placed, every, ["away"]) | note, every, {})

        return self.committed(make)

    def _placed(self, rows: DataFrame, made: np.ndarray, metric: str) -> DataFrame:
        """Rows with their part and distance from its centre."""
        sent = self.spark.sparkContext.broadcast(made)
        schema = pa.schema([("away", pa.float64()), ("part", pa.int32())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                lists = b.column(1)
                lengths = set(lists.value_lengths().to_pylist())
                if lengths != {sent.value.shape[1]}:
                    raise ValueError(f"a store of {sent.value.shape[1]} values got vectors of {sorted(lengths)}")
                m = np.array(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                empty = ~m.any(axis=1)
                at, away = _nearest(_unit(m) if metric == "Cosine" else m, sent.value)
                if metric == "Cosine":
                    at, away = np.where(empty, ZERO, at), np.where(empty, 0.0, away)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(away), pa.array(at.astype(np.int32))], schema=pa.schema([*b.schema, *schema]))

        kind = rows.schema["key"].dataType.simpleString()
        return rows.select("key", F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(run, f"key {kind}, embedding array<float>, away double, part int")

    def _described(self, note: dict, touched, old: dict) -> dict:
        """The note with rows and least and greatest distance of each touched part."""
        reader = type(self)(self.store, self.name, self.kind, type(self.view)(0, {}, {self.name: note}))
        found = reader.read(touched).groupBy("part").agg(F.count("*").alias("n"), F.min("away").alias("a"), F.max("away").alias("b")).collect()  # a row a part
        return note | {"bounds": {p: b for p, b in old.items() if int(p) not in set(touched)} | {str(r.part): [r.n, r.a, r.b] for r in found}}

    def changed(self, vectors: DataFrame | None, key: str, column: str = "embedding", removed: DataFrame | None = None) -> dict:
        """The note after vectors replace those of their keys, and keys are removed; other parts aren't read but for their keys."""
        note = self.note
        new = None
        if vectors is not None:
            new = self._placed(vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("embedding")), np.array(note["centres"]).reshape(-1, note["dimension"]), note["metric"])
        keys = [x.select(F.col(key).alias("key")) for x in (vectors, removed) if x is not None]
        gone = keys[0].unionByName(keys[1]).distinct() if len(keys) > 1 else keys[0].distinct()
        touched = {r[0] for r in self.read().select("key", "part").join(gone, "key", "left_semi").select("part").distinct().collect()}
        if new is not None:
            touched |= {r[0] for r in new.select("part").distinct().collect()}
        rows = self.read(touched).join(gone, "key", "left_anti")
        rows = rows if new is None else rows.unionByName(new)
        return self._described(self.written(rows, touched, ["away"]), touched, note["bounds"])

    def upsert(self, vectors: DataFrame, key: str, column: str = "embedding", removed: DataFrame | None = None) -> VectorStore:
        return self.committed(lambda s: s.changed(vectors, key, column, removed))

    def topk(self, query: Sequence[float], key: str, distance: str | None = None, limit: int | None = None, offset: int = 0, threshold: float | None = None, report: dict | None = None) -> DataFrame:
        """(key, score, rank): what vector.topk gives for the stored vectors. report gets parts and rows, and those read."""
        note, q = self.note, np.array(query, np.float64)
        metric = note["metric"]
        distance = distance or metric
        if (metric == "Cosine") != (distance == "Cosine"):
            raise ValueError(f"a store for {metric} has no bounds for {distance}")
        if len(q) != note["dimension"] and note["bounds"]:
            raise ValueError(f"vectors of lengths {note['dimension']} and {len(q)}")
        wanted = (limit or 200) + offset
        lower = distance == "Euclid"
        if distance == "Cosine":
            q = _unit(q[None])[0]
        length = float(np.linalg.norm(q))
        c = np.array(note["centres"]).reshape(-1, note["dimension"])
        away = np.linalg.norm(c - q, axis=1)
        spare = SLACK * (1 + length + float(np.abs(c).max(initial=0)) * math.sqrt(max(note["dimension"], 1)))
        best: dict[int, float] = {}  # the best score that a part can have, as a loss
        for p, (_, least, most) in note["bounds"].items():
            p = int(p)
            if p == ZERO or (distance == "Cosine" and not length):
                best[p] = -math.inf
            elif distance == "Dot":
                best[p] = -(float(c[p] @ q) + length * most) - spare * (1 + length)
            else:
                best[p] = max(0.0, away[p] - most, least - away[p]) - spare
        order, first, rows = sorted(best, key=lambda p: (best[p], p)), [], 0
        for p in order:
            if rows >= wanted and best[p] > -math.inf:
                break
            first.append(p)
            rows += note["bounds"][str(p)][0]
        plain = dict(column="embedding", distance=distance)
        found = vector.topk(self.read(first), list(map(float, query)), "key", limit=wanted, **plain).collect()
        edge = math.inf
        if len(found) == wanted:
            worst = found[-1].score
            edge = worst if lower else -worst if distance == "Dot" else math.sqrt(max(0.0, 2 - 2 * worst))
        read = [p for p in order if best[p] <= edge + spare]
        kept = self.read(read)
        if distance != "Dot" and edge < math.inf:
            near = [f"(part = {p} AND away BETWEEN {float(away[p]) - edge - 2 * spare!r}D AND {float(away[p]) + edge + 2 * spare!r}D)" if best[p] > -math.inf else f"part = {p}" for p in read]
            kept = kept.where(" OR ".join(near))
        if report is not None:
            n = {p: b[0] for p, b in note["bounds"].items()}
            report |= {"parts": len(n), "read": len(read), "rows": sum(n.values()), "rows_read": sum(n[str(p)] for p in read)}
        return vector.topk(kept, list(map(float, query)), "key", limit=limit, offset=offset, threshold=threshold, **plain).withColumnRenamed("key", key)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)
