"""Column profiles. Each takes a table of any width in one or two aggregates over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.ordering import percentiles


def _long(one_row: DataFrame, value: str, names: Sequence[str]) -> DataFrame:
    return one_row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias(value)) for n in names])).alias("r")).select("r.*")


def missingness(df: DataFrame) -> DataFrame:
    """column, missing (null or blank), missing_rate, of every column."""
    blank = lambda c: F.coalesce((F.trim(F.col(c).cast("string")) == "").cast("int"), F.lit(1))
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(blank(c)).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])).alias("r")
    return one.select("_rows", rows).select("r.column", "r.missing", F.round(F.try_divide(F.col("r.missing"), F.col("_rows")), 9).alias("missing_rate"))


def cardinality(df: DataFrame, columns: Sequence[str], relative_error: float | None = None) -> DataFrame:
    """Exact distinct values, nulls left out; HyperLogLog where an error is allowed."""
    count = (lambda c: F.count_distinct(c)) if relative_error is None else (lambda c: F.approx_count_distinct(c, relative_error))
    return _long(df.agg(*[count(c).alias(c) for c in columns]), "distinct_values", columns)


def quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, quartiles and how many values reach the third, of each column. df is read several times (see percentiles)."""
    at = percentiles(df, columns, (0.25, 0.5, 0.75))
    wanted = [e for c in columns for e in (F.avg(c).alias(f"{c}__m"), F.sum((F.col(c) >= F.lit(at[c][2])).cast("int")).alias(f"{c}__n"))]
    each = [
        F.struct(F.lit(c).alias("column"), F.round(f"{c}__m", 6).alias("mean"), *[F.round(F.lit(at[c][i]).cast("double"), 6).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], F.col(f"{c}__n").alias("at_least_p75"))
        for c in columns
    ]
    return df.agg(*wanted).select(F.explode(F.array(*each)).alias("r")).select("r.*")


def top_categories(df: DataFrame, columns: Sequence[str], n: int = 8) -> DataFrame:
    """The n most frequent values of each column, ties by value, with their share of all rows. Null is a value."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")
    counts = df.select(each).groupBy("r.column", "r.value").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("column").orderBy(F.desc("rows"), F.asc_nulls_last("value"))
    total = F.sum("rows").over(Window.partitionBy("column"))
    ranked = counts.withColumn("share", F.round(F.col("rows") / total, 9)).withColumn("place", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("place") <= n).select("column", "value", "rows", "share", "place")


def label_feasibility(df: DataFrame, binary: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """How many positives each possible label would have: true values of a binary one, values in the upper quartile of a
    numeric one."""
    flags = _long(df.agg(*[F.sum((F.col(c) > 0).cast("int")).alias(c) for c in binary]), "positives", binary)
    known = _long(df.agg(*[F.count(c).alias(c) for c in binary]), "labelled", binary)
    first = flags.join(known, "column").select("column", F.lit("binary").alias("kind"), "labelled", "positives")
    upper = quantiles(df, numeric).select("column", "at_least_p75").join(_long(df.agg(*[F.count(c).alias(c) for c in numeric]), "labelled", numeric), "column")
    return first.unionByName(upper.select("column", F.lit("numeric").alias("kind"), "labelled", F.col("at_least_p75").alias("positives")))


def histogram(df: DataFrame, column: str, by: str, bins: int = 30) -> DataFrame:
    """Rows in equal bins of [0, 1] by a class."""
    edge = F.least(F.floor(F.round(F.col(column) * bins, 9)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(F.col(by), edge.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Half the summed difference of two tables' shares of each value of column."""
    share = lambda df, name: df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).withColumn(name, F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(1)))).select(F.col(column).alias(f"_{name}"), name)
    both = share(a, "p").join(share(b, "q"), F.col("_p").eqNullSafe(F.col("_q")), "full")
    gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))
    return both.agg(F.round(F.sum(gap) / 2, 9).alias("total_variation")).select(F.lit(column).alias("column"), "total_variation")


def composition(df: DataFrame) -> DataFrame:
    """Statements on the table of lots: shares of lots with several bids (a null bid count stays in the denominator),
    their median and 99th percentile, the span of years and the share of the late ones."""
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    count = F.col("lot_bidscount")
    median, last = percentiles(df, ["lot_bidscount"], (0.5, 0.99))["lot_bidscount"]
    return df.agg(
        F.count(F.lit(1)).alias("lots"), share(count > 1).alias("share_over_one"), share(count >= 5).alias("share_five_or_more"),
        F.lit(median).cast("double").alias("median_bids"), F.lit(last).cast("double").alias("p99_bids"),
        F.min("award_year").alias("first_year"), F.max("award_year").alias("last_year"), share(F.col("award_year").between(1996, 1998)).alias("share_1996_1998"),
    )
