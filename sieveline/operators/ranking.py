"""Normalisation, objective weights and multi-criterion scores.

All of them need statistics of a set of rows. Those are aggregated per configuration (the columns in keys) into a row
each, computed at once and broadcast back: one row per configuration, whatever the number of records, so plans don't
repeat what the statistics were made from. Criteria stay nine scalar columns, so that a score is one expression inside
generated code. Rows that are passed in are read several times: give stored tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.criteria import CRITERIA
from sieveline.operators.metrics import average_precision
from sieveline.operators.ordering import percentiles, with_place
from sieveline.sources.shared import small, stored

NORMALIZATIONS = ("minmax", "vector", "sum", "robust")
WEIGHTINGS = ("equal", "entropy", "critic", "validation_ap")


def _add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _safe(span: Column) -> Column:
    return F.when(span == 0, F.lit(1.0)).otherwise(span)


def per_group(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """df with aggregates over the rows of equal keys, by way of a row per configuration."""
    stats = small(df.groupBy(*keys).agg(*aggregates))
    return df.join(stats, [*keys]) if keys else df.crossJoin(stats)  # without keys, one row


def normalized(df: DataFrame, reference: DataFrame, methods: Sequence[str] = NORMALIZATIONS, columns: Sequence[str] = CRITERIA) -> DataFrame:
    """df with the column normalization and, for each method, the criteria scaled to [0, 1] by statistics of reference.
    Nulls become the reference's median (0 if it has none). Statistics are numbers in the plan."""
    median = {c: v[0] or 0.0 for c, v in percentiles(reference, columns, (0.5,)).items()}
    filled = {c: F.coalesce(c, F.lit(median[c])) for c in columns}
    known = reference.withColumns(filled)
    wanted = [f(e).alias(f"{c}_{n}") for c in columns for e in (F.col(c),) for n, f in (("lo", F.min), ("hi", F.max), ("l2", lambda x: F.sqrt(F.sum(x * x))), ("sum", F.sum))]
    stats = known.agg(*wanted).first()
    ends = percentiles(known, columns, (0.01, 0.99)) if "robust" in methods else {}

    def scaled(c: str, method: str) -> Column:
        x, lo, hi = filled[c], F.lit(stats[f"{c}_lo"]), F.lit(stats[f"{c}_hi"])
        if method == "robust":
            lo, hi = (F.lit(e) for e in ends[c])
            x = F.least(F.greatest(x, lo), hi)
        elif method in ("vector", "sum"):
            by = _safe(F.lit(stats[f"{c}_l2" if method == "vector" else f"{c}_sum"]))
            x, lo, hi = x / by, lo / by, hi / by
        return F.least(F.greatest((x - lo) / _safe(hi - lo), F.lit(0.0)), F.lit(1.0))

    kept = [c for c in df.columns if c not in columns]
    every = F.array(*[F.struct(F.lit(m).alias("normalization"), *[scaled(c, m).alias(c) for c in columns]) for m in methods])
    return df.select(*kept, F.explode(every).alias("_n")).select(*kept, "_n.*")


def _shares(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of raw weights scaled to sum 1, or equal ones if they sum to 0."""
    total = _add([F.col(c) for c in columns])
    return raw.withColumns({c: F.when(F.abs(total) <= 1e-8, F.lit(1.0 / len(columns))).otherwise(F.try_divide(F.col(c), total)) for c in columns})


def equal_weights(df: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str) -> DataFrame:
    return df.select(*keys).distinct().select(*keys, *[F.lit(1.0 / len(columns)).alias(c) for c in columns])


def entropy_weights(df: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str) -> DataFrame:
    """One minus the entropy of a criterion's shares, over the logarithm of the number of rows."""
    floor = df.select(*keys, *[F.greatest(F.col(c), F.lit(1e-12)).alias(c) for c in columns])
    sums = per_group(floor, keys, [F.count(F.lit(1)).alias("_n"), *[F.greatest(F.sum(c), F.lit(1e-12)).alias(f"{c}_sum") for c in columns]])
    share = {c: F.col(c) / F.col(f"{c}_sum") for c in columns}
    entropy = sums.groupBy(*keys).agg(F.max("_n").alias("_n"), *[(-F.sum(s * F.log(s))).alias(c) for c, s in share.items()])
    return _shares(entropy.select(*keys, *[(1 - F.try_divide(F.col(c), F.log("_n"))).alias(c) for c in columns]), columns)


def critic_weights(df: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str) -> DataFrame:
    """A criterion's spread times its disagreement with the others. Correlations come from sums of centred products, and
    count as 0 where a criterion is constant."""
    means = per_group(df.select(*keys, *columns), keys, [F.avg(c).alias(f"{c}_m") for c in columns])
    centred = {c: F.col(c) - F.col(f"{c}_m") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    moments = means.groupBy(*keys).agg(*[F.avg(centred[a] * centred[b]).alias(f"{a}__{b}") for a, b in pairs])
    cov = lambda a, b: F.col(f"{a}__{b}") if (a, b) in pairs else F.col(f"{b}__{a}")
    corr = lambda a, b: F.when((cov(a, a) > 1e-18) & (cov(b, b) > 1e-18), cov(a, b) / F.sqrt(cov(a, a) * cov(b, b))).otherwise(F.lit(0.0))
    told = {a: F.sqrt(cov(a, a)) * _add([1 - corr(a, b) for b in columns]) for a in columns}
    return _shares(moments.select(*keys, *[e.alias(a) for a, e in told.items()]), columns)


def validation_ap_weights(df: DataFrame, keys: Sequence[str], columns: Sequence[str], label: str) -> DataFrame:
    """Each criterion's average precision as a score for the label."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("score")) for c in columns])).alias("e")
    long = df.select(*keys, F.col(label).alias("y"), each).select(*keys, "y", "e.criterion", F.round("e.score", 9).alias("score"))
    ap = average_precision(long, [*keys, "criterion"])
    wide = ap.groupBy(*keys).pivot("criterion", list(columns)).agg(F.first("average_precision"))
    return _shares(wide.fillna(0.0, list(columns)), columns)


#: How to add a weighting: a function of (rows, keys, columns, label) to one row of weights per configuration.
WEIGHT_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "equal": equal_weights, "entropy": entropy_weights, "critic": critic_weights, "validation_ap": validation_ap_weights,
}


def weights(df: DataFrame, keys: Sequence[str], methods: Sequence[str] = WEIGHTINGS, columns: Sequence[str] = CRITERIA, label: str = "y_cri_high") -> DataFrame:
    """keys, weighting and a weight for each criterion: a row per configuration, computed at once."""
    parts = [small(WEIGHT_FUNCTIONS[m](df, keys, columns, label).withColumn("weighting", F.lit(m))) for m in methods]
    return reduce(lambda a, b: a.unionByName(b), parts).select(*keys, "weighting", *columns)


def _w(c: str) -> Column:
    return F.col(f"w_{c}")


@dataclass(frozen=True)
class Scorer:
    """A score in two steps: parts are expressions over criteria c, their weights w_c and, over the rows of a configuration
    without its weights, c_lo, c_hi and c_avg; raw also sees part_lo, part_hi and part_sum, over the rows of a configuration.
    Both are functions of the criteria's names."""

    raw: Callable[[Sequence[str]], Column]
    parts: Callable[[Sequence[str]], Mapping[str, Column]] = field(default=lambda columns: {})


def _floor(e: Column) -> Column:
    return F.greatest(e, F.lit(1e-12))


def _unit(part: str) -> Column:
    return (F.col(part) - F.col(f"{part}_lo")) / _floor(F.col(f"{part}_hi") - F.col(f"{part}_lo"))


def _topsis(columns: Sequence[str]) -> Column:
    # weights aren't negative, so the best weighted value is the best value's
    best, worst = (F.sqrt(_add([F.pow(F.col(c) * _w(c) - F.col(f"{c}_{n}") * _w(c), 2) for c in columns])) for n in ("hi", "lo"))
    return worst / _floor(best + worst)


def _vikor(columns: Sequence[str]) -> Mapping[str, Column]:
    regret = [_w(c) * (F.col(f"{c}_hi") - F.col(c)) / _safe(F.col(f"{c}_hi") - F.col(f"{c}_lo")) for c in columns]
    return {"vikor_s": _add(regret), "vikor_r": F.greatest(*regret)}


def _edas(columns: Sequence[str]) -> Mapping[str, Column]:
    mean = {c: _floor(F.col(f"{c}_avg")) for c in columns}
    off = lambda sign: _add([_w(c) * F.greatest(sign * (F.col(c) - mean[c]), F.lit(0.0)) / mean[c] for c in columns])
    return {"edas_p": off(1), "edas_n": off(-1)}


def _clipped(c: str) -> Column:
    return F.least(F.greatest(F.col(c), F.lit(1e-9)), F.lit(1.0))


def _cocoso(columns: Sequence[str]) -> Column:
    s, p = F.col("cocoso_s"), F.col("cocoso_p")
    a = (s + p) / _floor(F.col("cocoso_s_sum") + F.col("cocoso_p_sum"))
    b = s / _floor(F.col("cocoso_s_lo")) + p / _floor(F.col("cocoso_p_lo"))
    k = (0.5 * s + 0.5 * p) / _floor(0.5 * F.col("cocoso_s_hi") + 0.5 * F.col("cocoso_p_hi"))
    return F.cbrt(F.greatest(a * b * k, F.lit(0.0))) + (a + b + k) / 3


#: How to add a scorer: under its name, a Scorer.
SCORERS: dict[str, Scorer] = {
    "topsis": Scorer(_topsis),
    "vikor": Scorer(lambda columns: 1 - (0.5 * _unit("vikor_s") + 0.5 * _unit("vikor_r")), _vikor),
    "edas": Scorer(lambda columns: 0.5 * (F.col("edas_p") / _floor(F.col("edas_p_hi")) + 1 - F.col("edas_n") / _floor(F.col("edas_n_hi"))), _edas),
    "cocoso": Scorer(_cocoso, lambda columns: {"cocoso_s": _add([_clipped(c) * _w(c) for c in columns]), "cocoso_p": _add([F.when(_w(c) > 0, F.pow(_clipped(c), _w(c))).otherwise(F.lit(0.0)) for c in columns])}),
    "waspas": Scorer(lambda columns: 0.5 * _add([_clipped(c) * _w(c) for c in columns]) + 0.5 * reduce(lambda a, b: a * b, [F.pow(_clipped(c), _w(c)) for c in columns])),
}


def scored(df: DataFrame, weight_rows: DataFrame, keys: Sequence[str], methods: Sequence[str] = tuple(SCORERS), columns: Sequence[str] = CRITERIA, store: bool = False) -> DataFrame:
    """df's other columns, weighting, method and score in [0, 1] (9 digits), for every weighting of df's configuration.
    Scores depend on the rows that are scored together: those of equal keys and weighting.

    Statistics come in three passes over df: of criteria, of the scorers' parts, and of raw scores. Each is a row per configuration, so
    the last plan is df, three broadcast joins and one projection. Each method has a projection of its own: one of all methods was
    several times slower, most likely as more code than the JVM compiles. store: raw scores are written once, for callers that read them
    several times. A criterion whose weight is 0 takes no part in any score."""
    kept = [c for c in df.columns if c not in columns and c not in keys]
    named = small(weight_rows.select(*keys, "weighting", *[F.col(c).alias(f"w_{c}") for c in columns]))
    basic = small(df.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max), ("avg", F.avg))]))
    meet = lambda a, b, on: a.join(b, [*on]) if on else a.crossJoin(b)  # noqa: E731  (one row a configuration)
    config, out = [*keys, "weighting"], []
    for m in methods:
        parts = SCORERS[m].parts(columns)
        wide = meet(meet(df, named, keys), basic, keys).select(*config, *kept, *columns, *[f"w_{c}" for c in columns], *[f"{c}_{n}" for c in columns for n in ("lo", "hi", "avg")], *[e.alias(n) for n, e in parts.items()])
        if parts:
            wide = per_group(wide, config, [f(n).alias(f"{n}_{k}") for n in parts for k, f in (("lo", F.min), ("hi", F.max), ("sum", F.sum))])
        raw = wide.select(*config, *kept, SCORERS[m].raw(columns).alias("_raw"))
        ends = per_group(stored(raw, "raw-scores") if store else raw, config, [f("_raw").alias(f"_{n}") for n, f in (("lo", F.min), ("hi", F.max))])
        score = F.round((F.col("_raw") - F.col("_lo")) / _safe(F.col("_hi") - F.col("_lo")), 9)
        out.append(ends.select(*config, F.lit(m).alias("method"), *kept, score.alias("score")))
    return reduce(lambda a, b: a.unionByName(b), out)


def ranked(df: DataFrame, rate: float, keys: Sequence[str] = (), id_col: str = "sample_row_id") -> DataFrame:
    """df with rank (ties by id) and selected_for_review: rank within ceil(rate * rows), labels or not."""
    limit = F.greatest(F.ceil(F.col("_rows") * F.lit(float(rate))), F.lit(1))
    placed = with_place(df, keys, "score", id_col, "rank").withColumn("selected_for_review", F.col("rank") <= limit)
    return placed.select(*df.columns, F.col("rank").cast("long").alias("rank"), "selected_for_review")
