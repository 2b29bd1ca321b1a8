"""Tables kept in parts, of which a change writes those alone that it touches."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glimmer.operators import merge
from glimmer.sources.snapshots import Conflict, Snapshots, View

RETRIES = 10


class Parts:
    """A table in parts, numbered by a column `part`. Each part lies in a folder of the version that wrote it last; which
    versions these are is a note of a commit, {"parts": {number: version}}, so readers see a change whole or not at all."""

    def __init__(self, store: Snapshots, name: str, schema: StructType, view: View | None = None):
        self.store, self.name, self.schema, self.spark = store, name, schema, store.spark
        self.base = f"{store.root}/{name}"
        self.view = view or store.view()

    @property
    def note(self) -> dict:
        return self.view.notes.get(self.name) or {"parts": {}}

    def read(self, parts: Iterable[int] | None = None) -> DataFrame:
        """The rows, with `part`, of the given parts or all."""
        kept = self.note["parts"] if parts is None else {str(p): v for p in parts if (v := self.note["parts"].get(str(p)))}
        schema = StructType([*self.schema.fields]).add("part", "integer").add("v", "string")
        if not kept:
            return self.spark.createDataFrame([], schema).drop("v")
        read = self.spark.read.schema(schema).option("basePath", self.base)
        return read.parquet(*(f"{self.base}/v={v}/part={p}" for p, v in kept.items())).drop("v")

    def written(self, rows: DataFrame, parts: Iterable[int], order: Sequence[str] = ()) -> dict:
        """Write rows (with `part`) as what the given parts now hold; the note to commit. A large part goes to as many
        files as its rows ask for."""
        version, place = uuid.uuid4().hex, [*order] or [c for c in self.schema.names if self.schema[c].dataType.typeName() != "array"]
        laid = rows.select(*self.schema.names, "part").repartitionByRange("part", *place).sortWithinPartitions("part", *order)
        laid.write.partitionBy("part").parquet(f"{self.base}/v={version}")
        fs, top = self.store._fs(), self.store._path(self.name, f"v={version}")
        filled = {s.getPath().getName().removeprefix("part=") for s in fs.listStatus(top) if s.isDirectory()}
        touched = {str(p) for p in parts}
        old = {p: v for p, v in self.note["parts"].items() if p not in touched}
        return self.note | {"parts": old | dict.fromkeys(sorted(filled & touched), version)}

    def committed(self, make) -> Parts:
        """make(table) gives a note; commit it, again if another writer was first."""
        for _ in range(RETRIES):
            fresh = type(self)._like(self)
            try:
                self.store.commit({}, {self.name: make(fresh)}, since=fresh.view)
            except Conflict:
                continue
            return type(self)._like(self)
        raise Conflict(f"{self.name} changed {RETRIES} times meanwhile")

    @classmethod
    def _like(cls, other):
        return cls(other.store, other.name, other.schema)


class Keyed(Parts):
    """A keyed table in `buckets` parts by hash of the key; the number is fixed by the first write."""

    def __init__(self, store: Snapshots, name: str, schema: StructType, key: str = "photo_id", buckets: int = 256, view: View | None = None):
        super().__init__(store, name, schema, view)
        self.key, self.buckets = key, self.note.get("buckets", buckets)

    @classmethod
    def _like(cls, other):
        return cls(other.store, other.name, other.schema, other.key, other.buckets)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        return self.read().drop("part")

    def lookup(self, value) -> DataFrame:
        """The rows of a key, of whose bucket alone files are read."""
        kind = self.schema[self.key].dataType
        part = self.spark.createDataFrame([(value,)], StructType().add(self.key, kind)).select(self._bucket()).first()[0]
        return self.read([part]).drop("part").where(F.col(self.key) == F.lit(value))

    def changed(self, changes: DataFrame | None, overwritten: Sequence[str] = (), merged: Sequence[str] = (), removed: DataFrame | None = None) -> dict:
        """The note after an upsert (operators.merge.upsert) and the removal of keys. Their buckets alone are read and written."""
        keys = [x.select(self.key) for x in (changes, removed) if x is not None]
        touched = {r[0] for k in keys for r in k.select(self._bucket()).distinct().collect()}  # at most `buckets` numbers
        rows = self.read(touched).drop("part")
        if removed is not None:
            rows = merge.deleted(rows, removed, self.key)
        if changes is not None:
            rows = merge.upsert(rows, changes, self.key, overwritten, merged)
        return self.written(rows.withColumn("part", self._bucket()), touched) | {"buckets": self.buckets}

    def upsert(self, changes: DataFrame, overwritten: Sequence[str], merged: Sequence[str] = (), removed: DataFrame | None = None) -> Keyed:
        return self.committed(lambda t: t.changed(changes, overwritten, merged, removed))

    def delete(self, keys: DataFrame) -> Keyed:
        return self.committed(lambda t: t.changed(None, removed=keys))
