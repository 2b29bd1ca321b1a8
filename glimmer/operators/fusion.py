"""Reciprocal-rank fusion of ranked lists, and the searches made of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer.operators.vector import ranked


def rrf(lists: list[DataFrame], key: str, k: int | None = None, scores: bool = False) -> DataFrame:
    """(key, score, rank_1, rank_2, ...): the sum of 1 / (k + rank) over lists of (key, rank); k of none or 0 means 60.

    The order is by score, then by rank in the first list, the second and so on; an id may repeat in a list. scores:
    each list's own score of an id, at its best rank there, comes along as score_1, score_2 and so on.
    """
    k = k or 60
    tagged = [x.select(key, F.col("rank"), *([F.col("score").alias("_score")] if scores else []), F.lit(i).alias("_list")) for i, x in enumerate(lists)]
    every = reduce(DataFrame.unionByName, tagged)
    best = [F.min(F.when(F.col("_list") == i, F.col("rank"))).alias(f"rank_{i + 1}") for i in range(len(lists))]
    # each list's share is added up in list order, so that sums don't depend on how rows arrive
    share = [F.sum(F.when(F.col("_list") == i, 1.0 / (k + F.col("rank")))).alias(f"_share_{i}") for i in range(len(lists))]
    own = [F.min_by("_score", F.when(F.col("_list") == i, F.col("rank"))).alias(f"score_{i + 1}") for i in range(len(lists) * scores)]
    summed = every.groupBy(key).agg(*best, *share, *own)
    score = reduce(lambda a, b: a + b, [F.coalesce(f"_share_{i}", F.lit(0.0)) for i in range(len(lists))])
    return summed.select(key, score.alias("score"), *(f"rank_{i + 1}" for i in range(len(lists))), *(f"score_{i + 1}" for i in range(len(lists) * scores)))


def order(lists: int) -> list:
    return [F.col("score").desc(), *(F.col(f"rank_{i + 1}").asc_nulls_last() for i in range(lists))]


def hybrid(vector: DataFrame | None, text: DataFrame | None, key: str, limit: int = 50, k: int | None = None) -> DataFrame:
    """(key, score, vector_score, vector_rank, text_score, text_rank) of the best `limit` ids.

    vector and text are candidate lists (key, score, rank), cut before. With one list alone its own score is the
    score and ranks are its ranks.
    """
    if vector is None and text is None:
        raise ValueError("a search needs a list")
    none = {"double": F.lit(None).cast("double"), "long": F.lit(None).cast("long")}
    if text is None or vector is None:
        only, name, other = (vector, "vector", "text") if text is None else (text, "text", "vector")
        page = only.orderBy("rank").limit(limit)
        cols = {f"{name}_score": F.col("score"), f"{name}_rank": F.col("rank"), f"{other}_score": none["double"], f"{other}_rank": none["long"]}
        return page.select(key, "score", *(cols[c].alias(c) for c in ("vector_score", "vector_rank", "text_score", "text_rank")))
    page = rrf([vector, text], key, k, scores=True).orderBy(*order(2), key).limit(limit)
    names = {"score_1": "vector_score", "rank_1": "vector_rank", "score_2": "text_score", "rank_2": "text_rank"}
    return page.select(key, "score", *(F.col(c).alias(n) for c, n in names.items()))


def with_metadata(hits: DataFrame, photos: DataFrame, key: str, photo_key: str, columns: list[str]) -> DataFrame:
    """Hits with their metadata; a hit without any stays, with nulls. Hits are a page, so the planner may send them to the photos."""
    side = photos.select(F.col(photo_key).alias(key), *columns)
    return hits.join(side, key, "left")


def widened(limit: int, k_vec: int | None = None, k_text: int | None = None) -> tuple[int, int]:
    """How many candidates to take of either list."""
    return max(k_vec or 200, limit), k_text or 200


def merged_page(vector: DataFrame, text: DataFrame, key: str, limit: int, offset: int, k: int | None = None) -> DataFrame:
    """The fused order itself paged (offset applies after fusion, unlike a search whose vector list alone is offset)."""
    fused = rrf([vector, text], key, k)
    return fused.orderBy(*order(2), key).offset(offset).limit(limit)


__all__ = ["hybrid", "merged_page", "order", "ranked", "rrf", "widened", "with_metadata"]
