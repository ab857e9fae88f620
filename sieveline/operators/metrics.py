"""Ranking and classification metrics over a long table: keys, y (0 or 1, null: not labelled) and score, plus an id where
ties must be broken. Unlabelled rows are left out of every metric."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.curves import limit, measured
from sieveline.operators.ordering import mid_ranked, running, with_place
from sieveline.sources.shared import small

RATES = (0.01, 0.03, 0.05, 0.10, 0.15, 0.20)


def _labelled(df: DataFrame) -> DataFrame:
    return df.where(F.col("y").isNotNull())


def by_score(df: DataFrame, keys: Sequence[str], n: Column | None = None) -> DataFrame:
    """One row for each distinct score, with what is at it (tp, n) and at or above it (ctp, cn). n: where a row stands for several, their sum; y is then that of their labels."""
    sums = {"tp": F.sum("y").cast("double"), "n": (F.count(F.lit(1)) if n is None else n).cast("double")}
    return running(_labelled(df), keys, "score", sums).withColumnsRenamed({"c_tp": "ctp", "c_n": "cn"})


def average_precision(df: DataFrame, keys: Sequence[str], id_col: str = "sample_row_id") -> DataFrame:
    """Sum over distinct scores of recall gained times precision; 0 without a positive. Rows without an id are added up by score."""
    if id_col in df.columns:
        return measured(df, keys, ["y"], id_col=id_col).select(*keys, precision_area())
    return area_of(by_score(df, keys), keys)


def area_of(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """average_precision of what by_score made."""
    area = F.sum(F.col("tp") * F.col("ctp") / F.col("cn"))
    return steps.groupBy(*keys).agg(F.round(F.coalesce(F.try_divide(area, F.sum("tp")), F.lit(0.0)), 9).alias("average_precision"))


def roc_auc(df: DataFrame, keys: Sequence[str], id_col: str = "sample_row_id") -> DataFrame:
    """Share of pairs of a positive and a negative that are in the right order, ties half; null if one class is missing."""
    if id_col in df.columns:
        return measured(df, keys, ["y"], id_col=id_col).select(*keys, pairs_in_order())
    return order_of(by_score(df, keys), keys)


def order_of(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """roc_auc of what by_score made."""
    above = F.col("cn") - F.col("ctp")
    # with all negatives known only at the end: positives times those at half or above, summed, leave the pairs below
    beaten = F.sum(F.col("tp") * (above - (F.col("n") - F.col("tp")) / 2))
    pairs = F.sum("tp") * F.sum(F.col("n") - F.col("tp"))
    return steps.groupBy(*keys).agg(F.round(F.try_divide(pairs - beaten, pairs), 9).alias("roc_auc"))


def f1_at(steps: DataFrame, keys: Sequence[str], rate: float, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """F1 of the top ceil(rate * rows) of what by_score made, ties by id. rows_of: for a table of a row per keys (keys and score), the rows (keys, id, y) at that score."""
    sizes = steps.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum("tp").alias("pos"))
    cut = steps.join(F.broadcast(sizes), list(keys)).withColumn("_limit", limit(F.lit(float(rate))).cast("double"))  # a row per keys
    cut = small(cut.where((F.col("cn") - F.col("n") < F.col("_limit")) & (F.col("_limit") <= F.col("cn"))))
    tied = with_place(rows_of(cut.where("_limit < cn").select(*keys, "score")).withColumn("_same", F.lit(0)), keys, "_same", "id")
    need = cut.select(*keys, (F.col("_limit") - F.col("cn") + F.col("n")).alias("_need"))
    own = tied.join(need, list(keys)).where(F.col("_place") <= F.col("_need")).groupBy(*keys).agg(F.sum("y").cast("double").alias("_own"))
    hits = F.col("ctp") - F.col("tp") + F.when(F.col("_limit") < F.col("cn"), F.coalesce("_own", F.lit(0.0))).otherwise(F.col("tp"))
    return cut.join(own, list(keys), "left").select(*keys, F.round(F.coalesce(F.try_divide(2 * hits, F.col("_limit") + F.col("pos")), F.lit(0.0)), 9).alias("f1"))


# ---- what is read off curves.measured


def precision_area() -> Column:
    return F.round(F.coalesce(F.try_divide(F.col("area"), F.col("pos").cast("double")), F.lit(0.0)), 9).alias("average_precision")


def pairs_in_order() -> Column:
    pairs = F.col("pos").cast("double") * (F.col("rows") - F.col("pos"))
    return F.round(F.try_divide(pairs - F.col("beaten"), pairs), 9).alias("roc_auc")


def _at(i: int) -> dict[str, Column]:
    """selected, precision, recall, f1, lift and ndcg at a measured row's limit i."""
    k, tp, pos = F.col("limits")[i], F.col("hits")[i], F.col("pos")
    zero = lambda e: F.round(F.coalesce(e, F.lit(0.0)), 9)
    return {
        "selected": k, "precision": zero(tp / k), "recall": zero(tp / F.greatest(pos, F.lit(1))), "f1": zero(F.try_divide(2 * tp, (k + pos).cast("double"))),
        "lift": zero(F.try_divide(tp / k, pos / F.col("rows"))), "ndcg": zero(F.try_divide(F.col("dcg")[i], F.col("ideal")[i])),
    }


def rate_rows(found: DataFrame, keys: Sequence[str], rates: Sequence[float]) -> DataFrame:
    """A row for each measured row and rate."""
    each = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("rate"), *[e.alias(n) for n, e in _at(i).items()]) for i, r in enumerate(rates)])).alias("r")
    return found.select(*keys, each).select(*keys, "r.*")


def columns_at(i: int, names: Sequence[str], ending: str = "") -> list[Column]:
    return [_at(i)[n].alias(n + ending) for n in names]


def best_rate(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rate with the highest f1, then ndcg, then precision, then the smallest."""
    order = Window.partitionBy(*keys).orderBy(F.desc("f1"), F.desc("ndcg"), F.desc("precision"), "rate")
    return table.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def at_half(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall and F1 of score >= 0.5, 0 where undefined."""
    hit = (F.col("score") >= 0.5).cast("int")
    sums = _labelled(df).groupBy(*keys).agg(F.sum(hit * F.col("y")).alias("tp"), F.sum(hit).alias("said"), F.sum("y").alias("pos"))
    or_zero = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)
    return sums.select(
        *keys, or_zero(F.col("tp"), F.col("said")).alias("precision"), or_zero(F.col("tp"), F.col("pos")).alias("recall"),
        or_zero(2 * F.col("tp"), F.col("said") + F.col("pos")).alias("f1"),
    )


def brier(df: DataFrame, keys: Sequence[str], n: str | None = None) -> DataFrame:
    """n: how many rows a row stands for."""
    gap = F.pow(F.col("score") - F.col("y"), 2)
    mean = F.sum(gap * F.col(n)) / F.sum(n) if n else F.avg(gap)
    return _labelled(df).groupBy(*keys).agg(F.round(mean, 9).alias("brier"))


def reliability(df: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Mean score and observed rate in equal bins of [0, 1], the last one closed."""
    edge = F.least(F.floor(F.round(F.col("score") * bins, 9)), F.lit(bins - 1)).cast("int")
    return _labelled(df).groupBy(*keys, edge.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_predicted"), F.round(F.avg("y"), 6).alias("observed_rate")
    )


def expected_calibration_error(df: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    part = reliability(df, keys, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed_rate"))) / F.sum("n")
    return part.groupBy(*keys).agg(F.round(gap, 6).alias("ece"))


def threshold_table(df: DataFrame, keys: Sequence[str], rates: Sequence[float] = RATES, id_col: str = "sample_row_id") -> DataFrame:
    """For each review rate: selected, precision, recall, f1, lift and ndcg of the top ceil(rate * rows). A row counts
    for every rate that reaches it, all in one pass over one sort."""
    return rate_rows(measured(df, keys, ["y"], rates, id_col=id_col), keys, rates)


def at_own_rate(df: DataFrame, keys: Sequence[str], rate: str, id_col: str = "sample_row_id") -> DataFrame:
    """precision, recall, f1 and ndcg of each configuration's top ceil(rate * rows), rate being a column that is the same in
    all rows of its keys."""
    return measured(df, keys, ["y"], own=rate, id_col=id_col).select(*keys, *columns_at(0, ("precision", "recall", "f1", "ndcg")))


def best_threshold(df: DataFrame, keys: Sequence[str], rates: Sequence[float] = RATES, id_col: str = "sample_row_id") -> DataFrame:
    return best_rate(threshold_table(df, keys, rates, id_col), keys)


def mid_ranks(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Average rank of each distinct value of column."""
    at = running(df, keys, column, {"_n": F.count(F.lit(1))}, down=False)
    return at.select(*keys, column, (F.col("c__n") - (F.col("_n") - 1) / 2).alias("mid_rank"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, id_col: str = "sample_row_id") -> DataFrame:
    """Correlation of mid-ranks; null if either is constant. Rows with a null in either take no part."""
    ranks = mid_ranked(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), [a, b], id_col, keys)
    sums = ranks.groupBy(*keys).agg(F.covar_pop(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return sums.select(*keys, F.round(F.try_divide(F.col("c"), F.col("sa") * F.col("sb")), 9).alias("spearman"))


def top_jaccard(df: DataFrame, keys: Sequence[str], a: str, b: str, rate: float = 0.2, id_col: str = "sample_row_id") -> DataFrame:
    """Jaccard overlap of the top sets by two scores."""
    k = F.greatest(F.ceil(F.col("_rows") * F.lit(float(rate))), F.lit(1))
    flags = with_place(df, keys, a, id_col, "_pa").withColumn("_ia", F.col("_pa") <= k).drop("_rows")
    flags = with_place(flags, keys, b, id_col, "_pb").withColumn("_ib", F.col("_pb") <= k)
    both = F.sum((F.col("_ia") & F.col("_ib")).cast("int"))
    return flags.groupBy(*keys).agg(both.alias("both"), F.round(both / F.sum((F.col("_ia") | F.col("_ib")).cast("int")), 9).alias("jaccard"))


def f1_bound(rate: Column, positive_rate: Column) -> Column:
    """The best F1 that a queue of this rate can have: all of it hits, or it holds all hits."""
    recall = F.least(rate / positive_rate, F.lit(1.0))
    return 2 * recall / (1 + recall)
