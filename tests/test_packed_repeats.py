"""Repeats of resamples as bits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sieveline.operators import resampling


def test_packed_counts(spark):
    counts = np.random.default_rng(2).poisson(1, (40, 1000))
    counts[3, 7] = 100_000
    packs = [resampling.packed(c) for c in counts]
    assert (resampling.unpacked(packs, 1000) == counts).all()
    assert np.mean([len(p) for p in packs[:3]]) < 300  # two bytes a count took 2,000
    rows = spark.range(400).select(F.col("id"), F.lit("s").alias("strategy"), (F.col("id") / 400).alias("score"), F.lit(1).alias("y"))
    two, few = (sorted((r["score"], bytes(r["w"])) for r in resampling.repeats(rows, "id", 200, 3, pack=p).collect()) for p in (False, True))
    assert [np.frombuffer(w, np.uint16).tolist() for _, w in two] == resampling.unpacked([w for _, w in few], 200).tolist()
