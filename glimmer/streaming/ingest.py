"""Incremental ingest as a stream: new rows of a folder are merged into the index, each once."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from glimmer import schemas
from glimmer.operators import ingest, merge
from glimmer.plans.text_index import TextIndex
from glimmer.sources import files
from glimmer.sources.scratch import scratch_path
from glimmer.sources.snapshots import Conflict, Snapshots, View

#: So often a batch is applied anew because another writer was first.
RETRIES = 5


def _again(store: Snapshots, apply: Callable[[View], None]) -> None:
    for attempt in range(RETRIES):
        try:
            return apply(store.view())
        except Conflict:
            if attempt == RETRIES - 1:
                raise


def _indexed(store: Snapshots, view: View, texts: DataFrame, new: DataFrame, removed: DataFrame) -> dict:
    """The stemmed index's note after a batch: `new` full-text rows, and ids that have none any more."""
    index = TextIndex(store, view=view)
    if index.note is None:
        return {index.name: index.rebuilt(texts, "photo_id", stem=True)}
    if new.isEmpty():
        new = None
    return {index.name: index.changed(new, removed, "photo_id")}


def merged(store: Snapshots, processed: DataFrame, now: float) -> None:
    """Apply processed rows (schemas.PROCESSED) to photos, full-text rows, their index, vectors and dead letters in one
    commit. Of a path's versions in a batch the last by mtime and id counts. Applying a batch again changes nothing, so a
    batch that is retried after a failure does no harm."""
    _again(store, lambda view: _merged(store, view, processed, now))


def described(store: Snapshots, captions: DataFrame, now: float) -> None:
    """Merge (photo_id, caption, tags) into photos, full-text rows and their index in one commit; nulls keep what there
    is, ids without a photo are left out, and an id must not repeat."""
    def apply(view: View) -> None:
        photos = store.read("photos", schemas.PHOTOS, view)
        known = captions.join(photos.select("photo_id", "path", "mtime", "phash", "embedded_at"), "photo_id")
        changes = known.withColumn("captioned_at", F.when(F.col("caption").isNotNull(), F.lit(now))).select(*schemas.PHOTOS.names)
        photos = merge.upsert(photos, changes, "photo_id", schemas.OVERWRITTEN, schemas.MERGED)
        texts = merge.refreshed_text(store.read("fts", schemas.FTS, view), photos, changes)
        new = texts.join(changes.select("photo_id"), "photo_id", "left_semi")
        store.commit({"photos": photos, "fts": texts}, _indexed(store, view, texts, new, changes.select("photo_id")), since=view)

    _again(store, apply)


def _merged(store: Snapshots, view: View, processed: DataFrame, now: float) -> None:
    good, bad = ingest.dead_letters(processed)
    good = merge.last_of(good.withColumn("_s", F.struct("mtime", "photo_id")), "relative_path", "_s").select(*processed.columns)
    photos, vectors = store.read("photos", schemas.PHOTOS, view), store.read("vectors", schemas.VECTORS, view)
    letters = store.read("dead", schemas.PROCESSED, view)
    renamed = good.withColumnRenamed("relative_path", "path")
    old = ingest.superseded(renamed, photos, "path")
    changes = renamed.select("photo_id", "path", "mtime", F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("tags"), "phash", F.lit(now).alias("embedded_at"), F.lit(None).cast("double").alias("captioned_at"))
    changes = merge.last_of(changes.withColumn("_s", F.col("mtime")), "photo_id", "_s")
    photos = merge.upsert(merge.deleted(photos, old, "photo_id"), changes, "photo_id", schemas.OVERWRITTEN, schemas.MERGED)
    texts = merge.refreshed_text(merge.deleted(store.read("fts", schemas.FTS, view), old, "photo_id"), photos, changes)
    new = good.where("embedding IS NOT NULL").select("photo_id", "embedding", "mtime")
    vectors = merge.replaced(merge.deleted(vectors, old, "photo_id"), merge.last_of(new, "photo_id", "mtime"), "photo_id")
    letters = merge.replaced(merge.deleted(letters, good.select("photo_id"), "photo_id"), bad.dropDuplicates(["photo_id"]), "photo_id")
    fresh = texts.join(changes.select("photo_id"), "photo_id", "left_semi")
    gone = old.unionByName(changes.select("photo_id")).distinct()
    notes = _indexed(store, view, texts, fresh, gone)
    store.commit({"photos": photos, "fts": texts, "vectors": vectors, "dead": letters}, notes, since=view)


def stream(spark: SparkSession, source: str, schema: StructType, process: Callable[[DataFrame], DataFrame], store: Snapshots, checkpoint: str, clock: Callable[[], float]) -> StreamingQuery:
    """Read what is new in source, process it, merge it, and stop. A later call goes on where this one ended."""

    def batch(df: DataFrame, _: int) -> None:
        merged(store, process(df), clock())

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What the flag of that name may say: anything else, or nothing, means go on.
CONTROL, PAUSE, CANCEL = "ingest", "pause", "cancel"


def control(store: Snapshots, word: str) -> None:
    """Tell running ingests of a store, from any process, to pause, go on ("run") or stop after the batch they are at."""
    store.flag(CONTROL, word)


def rescan(spark: SparkSession, root: str, store: Snapshots, process: Callable[[DataFrame], DataFrame], clock: Callable[[], float], batch: int = 10_000, skip_shadowed: bool = True, portable_ids: bool = False, prune: bool = False, progress: Callable[[dict], None] = lambda _: None, poll: float = 1.0) -> dict:
    """List root, process the files that are new or have changed (operators.ingest), and merge them batch by batch.

    What is done is what the store's photos say, so a run that ended early, or one after changes, takes each file once;
    failures stay pending. process gives a row (schemas.PROCESSED) for each file. After each batch, and at the end,
    progress gets counts, rate and time left; counts are observed as rows are written, not in a pass of their own.
    Between batches the store's flag decides (control). prune: photos whose file is gone are deleted at the end, unless
    the run was cancelled.
    """
    place = scratch_path(spark, "rescan")
    found = ingest.without_shadowed(ingest.scanned(files.listed(spark, root), root, portable_ids), skip=skip_shadowed)
    found.write.parquet(f"{place}/files")
    listed = spark.read.schema(found.schema).parquet(f"{place}/files")
    photos = store.read("photos", schemas.PHOTOS).select(F.col("path").alias("relative_path"), "photo_id")
    ingest.changed(listed, photos).write.parquet(f"{place}/todo")
    todo = spark.read.schema(found.schema).parquet(f"{place}/todo")
    total, began = todo.count(), time.monotonic()
    state = {"state": "running", "total": total, "scanned": 0, "processed": 0, "skipped": 0, "errors": 0, "percent": 100 if not total else 0, "per_second": 0.0, "left": None}
    batches = -(-total // batch)
    for i in range(batches):
        while store.flag(CONTROL) == PAUSE:
            if state["state"] != "paused":
                state |= {"state": "paused"}
                progress(dict(state))
            time.sleep(poll)
        if store.flag(CONTROL) == CANCEL:
            state |= {"state": "cancelled"}
            break
        counts = Observation()
        failed, embedded = F.col("error").isNotNull(), F.col("embedding").isNotNull()
        mine = process(todo.where(F.pmod(F.xxhash64("relative_path"), F.lit(batches)) == i))
        seen = mine.observe(counts, F.count(F.lit(1)).alias("scanned"), F.count_if(~failed & embedded).alias("processed"), F.count_if(~failed & ~embedded).alias("skipped"), F.count_if(failed).alias("errors"))
        seen.write.parquet(f"{place}/{i}")
        merged(store, spark.read.schema(mine.schema).parquet(f"{place}/{i}"), clock())
        state |= {"state": "running", **{k: state[k] + v for k, v in counts.get.items()}}
        rate = state["scanned"] / max(time.monotonic() - began, 1e-9)
        state |= {"percent": 100 * state["scanned"] // total, "per_second": rate, "left": (total - state["scanned"]) / rate if rate else None}
        progress(dict(state))
    if state["state"] != "cancelled":
        if prune:
            removed(store, ingest.missing(store.read("photos", schemas.PHOTOS).withColumnRenamed("path", "relative_path"), listed).select("photo_id"))
        state |= {"state": "done", "left": 0.0}
    progress(dict(state))
    return state


def removed(store: Snapshots, gone: DataFrame) -> None:
    """Delete photos, their full-text rows, index entries and vectors in one commit."""

    def apply(view: View) -> None:
        kept = {name: merge.deleted(store.read(name, kind, view), gone, "photo_id") for name, kind in (("photos", schemas.PHOTOS), ("fts", schemas.FTS), ("vectors", schemas.VECTORS))}
        store.commit(kept, _indexed(store, view, kept["fts"], kept["fts"].where("false"), gone), since=view)

    _again(store, apply)
