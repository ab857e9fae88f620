"""Boosters that a task each grows from groups of equal rows: few jobs, the same trees as passes make, and metrics of groups as of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators import boosting, learn, metrics
from sieveline.operators.boosting import Setting
from sieveline.plans import catalog

FEATURES = list("abcd")


@pytest.fixture(scope="module")
def rows(spark):
    """Each row several times, under other ids, in other parts of the table."""
    rng = np.random.default_rng(9)
    x = pd.DataFrame({"a": rng.integers(0, 30, 300) / 7, "b": rng.integers(0, 4, 300).astype(float), "c": rng.integers(0, 12, 300) / 3, "d": rng.integers(0, 2, 300).astype(float)})
    x["t"] = (rng.random(300) < 1 / (1 + np.exp(2 - x["a"]))).astype(float)
    x["u"] = np.where(rng.random(300) < 0.2, np.nan, (x["b"] + x["d"] > 2) * 1.0)
    x = pd.concat([x] * 4, ignore_index=True)
    x["id"] = rng.permutation(len(x))
    df = spark.createDataFrame(x).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abcdtu"], "id").repartition(5)
    return boosting.binned(df, FEATURES, boosting.bin_edges(df, FEATURES, 16), ["t", "u"], "id")


def test_tasks_and_passes_grow_the_same_trees(rows, monkeypatch):
    monkeypatch.setattr(boosting, "_CHUNK", 16)
    monkeypatch.setattr(boosting, "_STEP", 32)
    settings = [
        Setting("t", 4, 0.1, leaves=7, columns=0.75, least=20, balanced=True), Setting("u", 3, 0.2, leaves=0, depth=4, rows=0.8, columns=0.75, ridge=1.0, least=1, weight=1.0),
        Setting("u", 4, 0.1, leaves=5, least=5), Setting("t", 0), Setting("t", 3, least=5000),
    ]
    whole = boosting.fit(rows, settings, 4, 16, ["t", "u"])
    monkeypatch.setattr(boosting, "_HELD_GROUPS", 10)
    passes = boosting.fit(rows, settings, 4, 16, ["t", "u"])
    assert [len(b.trees) for b in whole] == [len(b.trees) for b in passes] == [4, 3, 4, 0, 1]
    for a, b in zip(whole, passes, strict=True):
        for x, y in zip(a.trees, b.trees, strict=True):
            assert all(np.array_equal(getattr(x, c), getattr(y, c)) for c in ("feature", "bin", "left"))
            assert x.value == pytest.approx(y.value, rel=1e-9, abs=1e-15)


def test_jobs_do_not_follow_the_trees(spark, rows):
    """Forty trees by passes are some two hundred jobs."""
    spark.sparkContext.setJobGroup("forty trees", "")
    try:
        (booster,) = boosting.fit(rows, [Setting("t", 40, leaves=8, least=5)], 4, 16, ["t", "u"])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("forty trees")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(booster.trees) == 40 and 0 < len(jobs) < 20


def test_metrics_of_groups_equal_those_of_rows(spark):
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"k": rng.integers(0, 4, 900), "id": rng.permutation(900), "y": rng.integers(0, 2, 900).astype(float), "score": rng.integers(0, 5, 900) / 4})
    x.loc[x["k"] == 3, "score"] = 0.5
    df = spark.createDataFrame(x)
    steps = metrics.by_score(df.groupBy("k", "score", (F.col("id") % 3).alias("part")).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")), ["k"], F.sum("n"))
    got = metrics.area_of(steps, ["k"]).join(metrics.order_of(steps, ["k"]), "k").join(metrics.f1_at(steps, ["k"], 0.2, lambda cut: df.join(cut, ["k", "score"]).select("k", "id", "y")), "k")
    long = df.withColumnRenamed("id", "sample_row_id")
    want = metrics.average_precision(long, ["k"]).join(metrics.roc_auc(long, ["k"]), "k").join(metrics.threshold_table(long, ["k"], [0.2]).select("k", "f1"), "k")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


class Asked(Exception):
    pass


@pytest.mark.parametrize(("name", "boosters", "trees"), [("hyper_parameter_grid", 18, 480), ("model_candidates", 10, 240)])
def test_queries_grow_the_reference_numbers_of_trees(spark, monkeypatch, name, boosters, trees):
    def asked(train, others, settings, *_):
        assert len(settings) == boosters and {s.trees for s in settings} == {trees}
        raise Asked

    monkeypatch.setattr(learn, "boosted", asked)
    with pytest.raises(Asked):
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
