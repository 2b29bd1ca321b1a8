"""Search a stored index from a shell: python -m glimmer.cli INDEX QUERY [-n 10] [-m MODE] [-t THRESHOLD] [--image FILE]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from glimmer import schemas
from glimmer.api import Library
from glimmer.functions.text import truncated
from glimmer.models import hashing_embedder
from glimmer.sources.snapshots import Snapshots


def main(arguments: list[str] | None = None) -> list[str]:
    p = argparse.ArgumentParser(prog="glimmer")
    p.add_argument("index")
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--image", help="search by an image file, fused with the query if there is one")
    p.add_argument("-n", type=int, default=10)
    p.add_argument("-m", choices=("hybrid", "vector", "text"), default="text")
    p.add_argument("-t", type=float, default=0.0)
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    store = Snapshots(spark, a.index)
    vectors = store.read("vectors", schemas.VECTORS)
    row = vectors.where("embedding IS NOT NULL").select(F.size("embedding")).first()
    size = row[0] if row else 64  # the stand-in embedder takes the index's dimension
    library = Library.opened(store, embed=hashing_embedder(size), embed_image=hashing_embedder(size))
    settings = {"limit": a.n, "threshold": a.t}
    found = library.like_file(a.image, a.query, mode="hybrid", **settings) if a.image else library.search(a.query, mode=a.m, **settings)
    found = found.withColumn("shown", truncated(F.coalesce("caption", F.lit(""))))
    lines = [f"{r.score:.4f}  {r.path}  {r.shown}" for r in found.collect()]
    print("\n".join(lines) or "No results")
    return lines


if __name__ == "__main__":
    main()
