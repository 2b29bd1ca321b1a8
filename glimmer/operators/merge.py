"""Upserts and deletes on tables that are replaced whole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.functions.text import caption_text


def folded(changes: DataFrame, key: str, sequence: str, overwritten: Sequence[str], merged: Sequence[str]) -> DataFrame:
    """One row a key, as if its changes had come one after the other: the last row's `overwritten`, nulls included,
    and the last value that isn't null of each of `merged`."""
    last = F.max_by(F.struct(*overwritten), sequence) if overwritten else None
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence))).alias(c) for c in merged]
    grouped = changes.groupBy(key).agg(*([last.alias("_last")] if last is not None else []), *kept)
    return grouped.select(key, *(F.col(f"_last.{c}").alias(c) for c in overwritten), *merged)


def upsert(table: DataFrame, changes: DataFrame, key: str, overwritten: Sequence[str], merged: Sequence[str], sequence: str | None = None) -> DataFrame:
    """table with changes applied: new keys are added, a null in a merged column keeps the old value."""
    if sequence is not None:
        changes = folded(changes, key, sequence, overwritten, merged)
    new = changes.select(F.col(key).alias("_key"), F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in (*overwritten, *merged)))
    both = table.join(new, F.col(key) == F.col("_key"), "full_outer")
    return both.select(
        F.coalesce(key, "_key").alias(key),
        *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in overwritten),
        *(F.coalesce(f"_{c}", c).alias(c) for c in merged),
    )


def replaced(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with all rows of new's keys replaced by new's."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def last_of(rows: DataFrame, key: str, sequence: str) -> DataFrame:
    """Each key's row with the greatest sequence."""
    columns = [c for c in rows.columns if c not in (key, sequence)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), sequence).alias("_r")).select(key, "_r.*")


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def refreshed_text(texts: DataFrame, photos: DataFrame, changed: DataFrame, key: str = "photo_id") -> DataFrame:
    """The full-text table after `changed` keys were merged into photos: text comes from the merged row; a row whose
    caption and tags are both gone has none."""
    new = photos.join(changed.select(key).distinct(), key, "left_semi").select(key, caption_text(F.col("caption"), F.col("tags")).alias("text"))
    return texts.join(changed.select(key).distinct(), key, "left_anti").unionByName(new.where("text IS NOT NULL"))
