"""Resampling and multiple comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def holm(df: DataFrame, p: str, group: Sequence[str] = (), ties: str = "comparison") -> DataFrame:
    """df with holm: the running maximum of (m - rank) * p, at most 1."""
    over = Window.partitionBy(*(group or [F.lit(1)]))  # a row per comparison
    order = over.orderBy(p, ties)
    step = (F.count(F.lit(1)).over(over) - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("_step", step).withColumn("holm", F.least(F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(1.0))).drop("_step")


def percentile_interval(boot: DataFrame, keys: Sequence[str], metric: str, level: float = 0.95) -> DataFrame:
    """keys, low and high: the metric's percentiles over resamples, of which there are some thousand for each keys."""
    tail = (1 - level) / 2
    at = F.percentile(metric, F.array(F.lit(tail), F.lit(1 - tail)))
    return boot.groupBy(*keys).agg(at.alias("_at")).select(*keys, F.col("_at")[0].alias("low"), F.col("_at")[1].alias("high"))


def bootstrap_comparison(boot: DataFrame, observed: DataFrame, reference: str, metrics: Sequence[str] = ("average_precision", "f1_at_rate")) -> DataFrame:
    """For each strategy and metric against the reference: observed and mean difference, bias-corrected interval, share of
    resamples in which it is better (a difference of 0 isn't), the strategy that the mean favours, raw and Holm-adjusted
    p = 2 min(P, 1 - P), and all seen from the reference's side. observed has a row per strategy with the metrics. The
    differences, one for each resample, strategy and metric, come to the driver."""
    seen = {r["strategy"]: r for r in observed.collect()}
    base = boot.where(F.col("strategy") == reference).select("iteration", *[F.col(m).alias(f"_{m}") for m in metrics])
    gaps = boot.where(F.col("strategy") != reference).join(base, "iteration").select("iteration", "strategy", *[(F.col(m) - F.col(f"_{m}")).alias(m) for m in metrics])
    drawn: dict[tuple[str, str], list[float]] = {}
    for r in gaps.orderBy("strategy", "iteration").collect():
        for m in metrics:
            drawn.setdefault((r["strategy"], m), []).append(r[m])
    rows = []
    for (strategy, m), d in drawn.items():
        gap, mean, better = seen[strategy][m] - seen[reference][m], float(np.mean(d)), float(np.mean(np.array(d) > 0))
        low, high = bca_interval(d, gap)
        rows.append((f"{strategy}|{m}", strategy, m, gap, mean, low, high, better, strategy if mean > 0 else reference, 2 * min(better, 1 - better)))
    schema = "comparison string, strategy string, metric string, observed_difference double, mean_difference double, ci_low double, ci_high double, probability_better double, favoured string, raw_p double"
    return sign_flipped(holm(boot.sparkSession.createDataFrame(rows, schema), "raw_p"))


def bca_interval(replicates: Sequence[float], observed: float, level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected and accelerated interval of at most some thousand replicates. The acceleration is a jackknife over
    the replicates themselves, as the reference has it, and not over records."""
    x = np.sort(np.asarray(replicates, float))
    n = len(x)
    normal = NormalDist()
    below = min(max(float((x < observed).mean()), 1 / (2 * n)), 1 - 1 / (2 * n))
    z0 = normal.inv_cdf(below)
    left_out = (x.sum() - x) / (n - 1)
    d = left_out.mean() - left_out
    spread = (d**2).sum()
    accel = float((d**3).sum() / (6 * spread**1.5)) if spread > 0 else 0.0
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(float(np.quantile(x, normal.cdf(z0 + z / (1 - accel * z)))))
    return ends[0], ends[1]


def sign_flipped(df: DataFrame) -> DataFrame:
    """A difference and its interval seen from the other side."""
    return df.withColumns({"advantage": -F.col("mean_difference"), "advantage_low": -F.col("ci_high"), "advantage_high": -F.col("ci_low")})


def dirichlet_vectors(base: Sequence[float], draws: int = 500, concentration: float = 12.0, seed: int = 5) -> list[list[float]]:
    return np.random.default_rng(seed).dirichlet(concentration * len(base) * np.asarray(base), draws).tolist()


def dirichlet_choices(front: DataFrame, base: Sequence[float], draws: int = 500, concentration: float = 12.0, seed: int = 5) -> DataFrame:
    """How often each solution is the pseudo-weight choice if the target weights are drawn round the base ones."""
    from sieveline.operators.pareto import choices_under

    picked = choices_under(front, [(f"d{i:04d}", 0, 1.0, *v) for i, v in enumerate(dirichlet_vectors(base, draws, concentration, seed))])
    return picked.groupBy("seq").agg(F.count(F.lit(1)).alias("times"))
