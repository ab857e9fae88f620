"""Targets, their checks, splits, samples, and target encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.sources.shared import stored


def target_balance(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """target, labelled, positives, negatives, positive_rate."""
    one = df.agg(*[e for t in targets for e in (F.count(t).alias(f"{t}_n"), F.sum(t).alias(f"{t}_p"))])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_n").alias("labelled"), F.coalesce(F.col(f"{t}_p"), F.lit(0)).alias("positives")) for t in targets])).alias("r")
    rate = F.round(F.try_divide(F.col("positives"), F.col("labelled")), 9)
    return one.select(each).select("r.*").withColumn("negatives", F.col("labelled") - F.col("positives")).withColumn("positive_rate", rate)


def target_verification(df: DataFrame, rules: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """For (target, score, op, cut): how many rows' targets don't follow from their scores, how many of these lie on the
    cut itself, and how many are unexplained."""

    def counts(target: str, score: str, op: str, cut: float) -> list[Column]:
        over = F.col(score) >= cut if op == ">=" else F.col(score) > cut
        again = F.when(F.col(score).isNotNull(), over.cast("int"))
        wrong = ~F.col(target).eqNullSafe(again)
        edge = F.coalesce(F.col(score) == cut, F.lit(False))
        return [F.sum(wrong.cast("int")).alias(f"{target}_w"), F.sum((wrong & edge).cast("int")).alias(f"{target}_e"), F.count(target).alias(f"{target}_n")]

    one = df.agg(*[c for rule in rules for c in counts(*rule)])
    each = [F.struct(F.lit(t).alias("target"), F.col(f"{t}_n").alias("labelled"), F.col(f"{t}_w").alias("disagreements"), F.col(f"{t}_e").alias("at_the_cut"), (F.col(f"{t}_w") - F.col(f"{t}_e")).alias("unexplained")) for t, *_ in rules]
    return one.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def split_summary(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """split, target, rows, share of all rows, labelled, positives, positive_rate."""
    sums = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), *[e for t in targets for e in (F.count(t).alias(f"{t}_n"), F.sum(t).alias(f"{t}_p"))])
    share = F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy(F.lit(1))), 9)  # three rows
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_n").alias("labelled"), F.col(f"{t}_p").alias("positives")) for t in targets])).alias("r")
    return sums.withColumn("share", share).select("split", "rows", "share", each).select("split", "rows", "share", "r.*", F.round(F.try_divide(F.col("r.positives"), F.col("r.labelled")), 9).alias("positive_rate"))


def stratified_sample(df: DataFrame, target: str, cap: int, order: Column, id_col: str) -> DataFrame:
    """At most about cap rows of each split, each stratum of target (-1: not labelled) with its share, one at least; rows
    are taken in a given (hashed) order. A cap of 0 keeps all. Numbers sample_row_id by split and id."""
    strata = df.withColumn("stratum", F.coalesce(target, F.lit(-1)))
    sizes = strata.groupBy("split", "stratum").agg(F.count(F.lit(1)).alias("_n"))
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy("split"))
    limit = F.least(F.col("_n"), F.greatest(F.round(F.lit(float(cap)) * share), F.lit(1)).cast("long")) if cap > 0 else F.col("_n")
    limits = sizes.select("split", "stratum", limit.alias("_limit"))
    nth = F.row_number().over(Window.partitionBy("split", "stratum").orderBy(order, id_col))
    placed = strata.withColumn("_nth", nth)
    if cap > 0:  # no stratum gives more than cap, so tasks keep so many of each before any shuffle
        placed = placed.where(F.col("_nth") <= cap)
    return placed.join(F.broadcast(limits), ["split", "stratum"]).where("_nth <= _limit").drop("_nth", "_limit")  # nine rows


def numbered(df: DataFrame, id_col: str, out: str = "sample_row_id") -> DataFrame:
    """df with 0, 1, ... by split, then id. Rows are sorted over the cluster; each range is numbered by itself and shifted by
    the sizes of those before it, a row for each range."""
    dealt = stored(df.repartitionByRange("split", id_col).withColumn("_part", F.spark_partition_id()), "numbered")
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("split", id_col))
    return dealt.withColumn("_nth", nth).join(F.broadcast(sizes), "_part").withColumn(out, F.col("_before") + F.col("_nth") - 1).drop("_part", "_nth", "_before")


def _encoding(n: Column, mean: Column, variance: Column, all_mean: Column, all_variance: Column) -> Column:
    """Empirical Bayes: a category's mean drawn to the global one, the more the larger its variance and the fewer its rows."""
    weight = n * all_variance
    return F.coalesce(F.try_divide(weight * mean + variance * all_mean, weight + variance), all_mean)


def _moments(n: Column, s: Column) -> tuple[Column, Column]:
    """Mean and population variance of a binary target from its count and sum."""
    mean = s / n
    return mean, mean * (1 - mean)


def encoding_table(train: DataFrame, key: str, target: str) -> DataFrame:
    """key, n, encoding, global_mean over labelled rows."""
    known = train.where(F.col(target).isNotNull())
    whole = known.agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(target).cast("double").alias("_s"))
    sums = known.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(target).cast("double").alias("s"))
    mean, variance = _moments(F.col("n"), F.col("s"))
    all_mean, all_variance = _moments(F.col("_n"), F.col("_s"))
    wide = sums.crossJoin(F.broadcast(whole))  # one row
    return wide.select("key", F.col("n").cast("long").alias("n"), F.round(_encoding(F.col("n"), mean, variance, all_mean, all_variance), 9).alias("encoding"), F.round(all_mean, 9).alias("global_mean"))


def apply_encoding(df: DataFrame, table: DataFrame, key: str, out: str) -> DataFrame:
    """df with its key's encoding, the global mean for keys that the table hasn't."""
    mean = table.agg(F.max("global_mean").alias("_g"))
    lookup = table.select(F.col("key").alias("_k"), F.col("encoding").alias("_e"))
    return df.join(lookup, F.col(key).eqNullSafe(F.col("_k")), "left").crossJoin(F.broadcast(mean)).withColumn(out, F.coalesce("_e", "_g")).drop("_k", "_e", "_g")


def out_of_fold_table(train: DataFrame, key: str, target: str, fold: str) -> DataFrame:
    """fold, key, encoding: from the labelled rows of all other folds, as total minus fold, so one pass over the rows."""
    known = train.where(F.col(target).isNotNull())
    sums = known.groupBy(F.col(key).alias("key"), F.col(fold).alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("s"))
    per_key = sums.groupBy("key").agg(F.sum("n").alias("kn"), F.sum("s").alias("ks"))
    per_fold = sums.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    whole = per_fold.agg(F.sum("fn").alias("an"), F.sum("fs").alias("as"))
    grid = per_key.crossJoin(F.broadcast(per_fold)).crossJoin(F.broadcast(whole)).join(sums, ["key", "fold"], "left")  # folds, one row
    less = lambda total, own: (F.col(total) - F.coalesce(F.col(own), F.lit(0))).cast("double")
    out = grid.select("fold", "key", less("kn", "n").alias("n"), less("ks", "s").alias("s"), less("an", "fn").alias("an"), less("as", "fs").alias("as"))
    mean, variance = F.try_divide(F.col("s"), F.col("n")), F.try_divide(F.col("s"), F.col("n")) * (1 - F.try_divide(F.col("s"), F.col("n")))
    all_mean, all_variance = _moments(F.col("an"), F.col("as"))
    encoding = F.when(F.col("n") > 0, _encoding(F.col("n"), mean, variance, all_mean, all_variance)).otherwise(all_mean)
    return out.select(F.col("fold").cast("int").alias("fold"), "key", F.round(encoding, 9).alias("encoding"))


def out_of_fold(df: DataFrame, key: str, target: str, fold: str, out: str) -> DataFrame:
    """df's training rows with the encoding of their fold; rows that aren't labelled get null."""
    table = out_of_fold_table(df, key, target, fold).select(F.col("fold").alias("_f"), F.col("key").alias("_k"), F.col("encoding").alias("_e"))
    joined = df.join(table, (F.col(fold) == F.col("_f")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    return joined.withColumn(out, F.when(F.col(target).isNotNull(), F.col("_e"))).drop("_f", "_k", "_e")
