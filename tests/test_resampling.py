from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import metrics, resampling


def _long(spark, rng, n=600):
    """Two strategies: one without ties, one with half its rows tied."""
    a = rng.random(n).round(6)
    b = np.where(rng.random(n) < 0.5, 0.0, rng.random(n).round(2))
    y = (rng.random(n) < a).astype(int)
    rows = [(i, s, float(v[i]), int(y[i])) for i in range(n) for s, v in (("a", a), ("b", b))]
    return spark.createDataFrame([*rows, (n, "a", 0.5, None)], "sample_row_id long, strategy string, score double, y int"), {"a": a, "b": b}, y


def _plain(s, y, w, rate):
    order = sorted({*s.tolist()}, reverse=True)
    cn = ctp = area = top = 0
    k = math.ceil(w.sum() * rate)
    for v in order:
        n, tp = int(w[s == v].sum()), int((w * y)[s == v].sum())
        if n:
            top += tp * min(max(k - cn, 0), n) / n
            cn, ctp = cn + n, ctp + tp
            area += tp * ctp / cn
    return area / (w * y).sum(), 2 * top / (k + (w * y).sum())


@pytest.mark.parametrize("draw", [resampling.exact_repeats, resampling.poisson_repeats])
def test_bootstrap_equals_plain_sums_over_many_blocks_and_ranges(spark, draw):
    long, scores, y = _long(spark, np.random.default_rng(4))
    resamples, n = 12, len(y)
    rows = resampling.repeats(long.where("y IS NOT NULL").withColumn("score", F.col("sample_row_id").cast("double")), "sample_row_id", resamples, 7, draw, 100).collect()
    assert len({r["block"] for r in rows}) == 8
    w = {s: np.zeros((n, resamples), int) for s in "ab"}
    for r in rows:
        w[r["strategy"]][int(r["score"])] = np.frombuffer(r["w"], np.uint16)
    assert (w["a"] == w["b"]).all()
    if draw is resampling.exact_repeats:
        assert (w["a"].sum(axis=0) == n).all()
    got = {(r["iteration"], r["strategy"]): (r["average_precision"], r["f1_at_rate"]) for r in resampling.bootstrap(long, ["a", "b"], resamples, draw=draw, block=100, rows_each=70).collect()}
    assert len(got) == 2 * resamples
    for (i, s), values in got.items():
        assert values == pytest.approx(_plain(scores[s], y, w["a"][:, i], 0.2), abs=1e-8)
    whole = metrics.average_precision(long.where("y IS NOT NULL"), ["strategy"]).where("strategy = 'a'").first()["average_precision"]
    assert abs(np.mean([v[0] for (_, s), v in got.items() if s == "a"]) - whole) < 0.05


def test_exact_repeats_have_the_means_and_variances_of_draws_with_replacement(spark):
    n, resamples = 400, 1000
    rows = spark.range(n).select(F.col("id"), F.lit("a").alias("strategy"), F.col("id").cast("double").alias("score"), F.lit(1).alias("y"))
    w = np.stack([np.frombuffer(r["w"], np.uint16) for r in resampling.repeats(rows, "id", resamples, 3, each=30).collect()]).astype(float)
    assert w.shape == (n, resamples) and (w.sum(axis=0) == n).all()
    # each row: mean 1 and variance 1 - 1/n; two rows: covariance -1/n, also across blocks
    assert np.abs(w.mean(axis=1) - 1).max() < 5 / math.sqrt(resamples)
    assert w.var() == pytest.approx(1 - 1 / n, abs=0.01)
    halves = w[: n // 2].sum(axis=0)
    assert halves.var() == pytest.approx(n / 4, rel=0.2)
    assert np.corrcoef(halves, w[n // 2 :].sum(axis=0))[0, 1] == pytest.approx(-1)


def test_bootstrap_of_nothing_and_of_one_label(spark):
    schema = "sample_row_id long, strategy string, score double, y int"
    assert resampling.bootstrap(spark.createDataFrame([], schema), ["a"], 4).count() == 0
    rows = resampling.bootstrap(spark.createDataFrame([(1, "a", None, 0), (2, "a", math.nan, 0), (3, "a", 0.5, 0)], schema), ["a"], 4).collect()
    assert {(r["average_precision"], r["f1_at_rate"]) for r in rows} == {(0.0, 0.0)} and len(rows) == 4
