"""What a server offers, as functions that return tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimmer import schemas
from glimmer.functions import paths
from glimmer.operators import fusion, metadata, vector
from glimmer.options import Options, limited
from glimmer.plans import fts
from glimmer.plans.text_index import TextIndex
from glimmer.sources.snapshots import Snapshots


class Library:
    """An index: photos (schemas.PHOTOS), vectors, full-text rows and thumbnails (photo_id, size), and an embedder.

    index: a stemmed plans.text_index.TextIndex of texts, or the path of one, which searches read instead of the texts
    themselves; one that was opened stays at its commit, as the tables do.
    """

    def __init__(self, photos: DataFrame, vectors: DataFrame, texts: DataFrame, thumbnails: DataFrame | None = None, embed=None, options: Options | None = None, embed_image=None, index: TextIndex | str | None = None):
        self.photos, self.vectors, self.texts, self.embed, self.embed_image = photos, vectors, texts, embed, embed_image
        self.index = TextIndex(Snapshots(photos.sparkSession, index)) if isinstance(index, str) else index
        self.thumbnails = photos.where("false").select("photo_id", F.lit(0).cast("long").alias("size")) if thumbnails is None else thumbnails
        self.options = options or Options()

    @classmethod
    def opened(cls, store: Snapshots, **kw) -> Library:
        """The library that an ingest keeps in a store, all of it as of the last commit."""
        view = store.view()
        photos, vectors, texts = (store.read(name, kind, view) for name, kind in (("photos", schemas.PHOTOS), ("vectors", schemas.VECTORS), ("fts", schemas.FTS)))
        index = TextIndex(store, view=view)
        return cls(photos, vectors, texts, index=index if index.note else None, **kw)

    def health(self) -> dict:
        return {"status": "ok"}

    def search(self, query: str = "", *, like: Sequence[float] | None = None, image: bytes | None = None, limit: int | None = None, offset: int = 0, threshold: float | None = None, mode: str = "hybrid") -> DataFrame:
        """Photos for a text, a vector or an image's bytes, or a text and either by fusion; texts are stemmed; offset and threshold apply to the vector list alone."""
        o = self.options
        limit = o.results if limit is None else limit
        threshold = o.threshold if threshold is None else threshold
        limited(limit, threshold)
        k_vec, k_text = fusion.widened(limit, o.vector_candidates, o.text_candidates)
        if image is not None:
            like = self._embedded(image)
        v = t = None
        if mode in ("hybrid", "vector"):
            point = like if like is not None else self.embed([query])[0] if self.embed and query else None
            if point is not None:
                v = vector.topk(self.vectors, point, "photo_id", distance=o.distance, limit=k_vec, offset=offset, threshold=threshold)
        if mode in ("hybrid", "text") and query:
            words = fts.normalized(query)
            hits = self.index.search(words, "photo_id", limit=k_text) if self.index else fts.search(self.texts, words, "photo_id", limit=k_text, stem=True)
            t = vector.ranked(hits, "photo_id")
        if v is None and t is None:
            raise ValueError("nothing to search by")
        return self._items(fusion.hybrid(v, t, "photo_id", limit, o.rrf_k))

    def similar(self, path: str, limit: int = 50, threshold: float = 0.0) -> DataFrame:
        """Neighbours of the photo at a path, itself included; LookupError if there is none. A photo without a vector is
        embedded again from its file, where an image embedder is plugged in."""
        limited(limit, threshold)
        row = metadata.by_path(self.photos, path).select("photo_id").first()
        if row is None:
            raise LookupError(path)
        if self.embed_image and self.vectors.where(F.col("photo_id") == row[0]).isEmpty():
            return self.search(image=self._content(self._placed(metadata.by_key(self.photos, row[0])).first().absolute_path), limit=limit, threshold=threshold, mode="vector")
        hits = vector.similar(self.vectors, "photo_id", row[0], limit=limit, threshold=threshold, distance=self.options.distance)
        return self._items(fusion.hybrid(hits, None, "photo_id", limit))

    def like_file(self, file: str, query: str = "", **settings) -> DataFrame:
        """Photos like an image file, fused with a text's if there is one."""
        return self.search(query, image=self._content(file), **settings)

    def _content(self, file: str) -> bytes:
        rows = self.photos.sparkSession.read.format("binaryFile").load(file).select("content").head(1)
        if not rows:
            raise LookupError(file)
        return bytes(rows[0][0])

    def _embedded(self, image: bytes) -> Sequence[float]:
        if self.embed_image is None:
            raise ValueError("no image embedder is plugged in")
        return self.embed_image([image])[0]

    def photo(self, photo_id: str) -> DataFrame:
        return self._placed(metadata.by_key(self.photos, photo_id))

    def stats(self) -> DataFrame:
        return metadata.index_stats(self.photos, self.vectors, self.thumbnails)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("absolute_path", paths.absolute(F.col("path"), self.options.photo_root))

    def _items(self, hits: DataFrame) -> DataFrame:
        found = fusion.with_metadata(hits, self.photos, "photo_id", "photo_id", ["path", "caption", "tags"])
        cached = self.thumbnails.select("photo_id", F.lit(True).alias("_cached")).distinct()
        url = F.when(F.col("_cached"), F.concat(F.lit("/thumbnail/"), F.col("photo_id")))
        placed = self._placed(found.join(cached, "photo_id", "left")).withColumn("thumbnail_url", url).drop("_cached")
        return placed.orderBy(F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), F.col("text_rank").asc_nulls_last(), "photo_id")


def response(query: str, items: DataFrame) -> DataFrame:
    """One row of JSON for a page of results."""
    rows = items.agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_order"), F.struct(*items.columns).alias("item")))).alias("r"))
    inner = F.transform("r", lambda x: x["item"])
    return rows.select(F.to_json(F.struct(F.lit(query).alias("query"), F.size("r").alias("total"), inner.alias("results"))).alias("json"))
