"""Near hashes over many partitions, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from glimmer.operators import duplicates


@pytest.mark.parametrize(("digits", "threshold"), [(16, 18), (16, 6), (64, 10)])
def test_all_pairs_of_many_partitions(spark, tmp_path, digits, threshold):
    """The sides of the comparison are read in partitions of their own: packs once had other numbers on each, and pairs were lost."""
    random = np.random.default_rng(digits + threshold)
    bits = random.integers(0, 2, (1200, 4 * digits)).astype(np.uint8)
    bits[600:] = bits[:600]
    for row in bits[600:]:
        row[random.choice(4 * digits, random.integers(0, threshold + 3), replace=False)] ^= 1
    names = [row.tobytes().hex()[:digits] for row in np.packbits(bits, axis=1)]
    spark.createDataFrame(list(enumerate(names)), "id long, h string").repartition(40).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1b")
    found = duplicates.similar_pairs(spark.read.parquet(str(tmp_path / "t")), "id", F.upper(F.col("h")), threshold, digits)
    wanted = {}
    for i in range(len(bits)):
        far = (bits[i + 1 :] != bits[i]).sum(axis=1)
        wanted |= {(i, i + 1 + int(j)): int(far[j]) for j in np.flatnonzero(far <= threshold)}
    try:
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len(rows) == len(wanted)
    assert {(r.a, r.b): r.distance for r in rows} == wanted
