"""The star schema read as procurement: orders are lots, line items their bids, customers buyers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.cleaning import binarize
from sieveline.operators.ordering import percentiles
from sieveline.sources.readers import table
from sieveline.sources.shared import stored

SCORES = ("label_cri", "label_corr_proc", "label_corr_buyer_concentration", "label_corr_singleb", "label_corr_nocft")
TARGETS = ("y_cri_high", "y_proc_high", "y_buyer_concentration_high", "y_single_bid", "y_no_call_for_tender")
PROBABILITIES = ("p_cri_high", "p_proc_high", "p_buyer_concentration_high", "p_single_bid", "p_no_call_for_tender")
#: Factor, shift and modulus of each stand-in probability's noise.
NOISE = ((31, 7, 97), (37, 11, 89), (41, 13, 83), (43, 17, 79), (47, 19, 73))
CRI_CUT, PROC_CUT = 0.35, 0.5


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money in whole cents and discounts in whole per cent, so that sums don't depend on their order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lot_id"),
        F.col("l_suppkey").alias("bidder"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("quantity"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("long").alias("percent"),
    )


def bid_to_lot(bid: DataFrame) -> DataFrame:
    """One row per lot: counts, price statistics, their logs and ratios, and flags for what can't be known."""
    price = F.col("cents") / 100.0
    agg = bid.groupBy("lot_id").agg(
        F.count(F.lit(1)).alias("reported_bid_count"),
        F.count_distinct("bidder").alias("bidder_count"),
        F.min("part").alias("first_part"),
        F.sum("percent").alias("percent_sum"),
        F.sum("cents").alias("cents_sum"),
        F.min(price).alias("bid_price_min"),
        F.max(price).alias("bid_price_max"),
        F.stddev_samp(price).alias("bid_price_std"),
    )
    mean = F.col("cents_sum") / 100.0 / F.col("reported_bid_count")
    return agg.select(
        "*",
        mean.alias("bid_price_mean"),
        F.try_divide(F.col("bid_price_std"), mean).alias("bid_price_cv"),
        F.try_divide(F.col("bid_price_max") - F.col("bid_price_min"), mean).alias("bid_price_spread_ratio"),
        F.log1p(F.col("bid_price_max")).alias("log_bid_price_max"),
        (F.col("bidder_count") / F.col("reported_bid_count")).alias("bidder_ratio"),
        F.col("bid_price_std").isNull().cast("int").alias("missing_bid_price_std"),
    )


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its features and the five component scores (null where they can't be known)."""
    bid = bids(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    per_lot = bid.groupBy("lot_id").agg(
        F.count(F.lit(1)).alias("lot_bidscount"), F.count_distinct("bidder").alias("award_criteria_count"),
        F.min("part").alias("first_part"), F.sum("percent").alias("percent_sum"), F.sum("cents").alias("cents_sum"),
    )
    spend = (
        bid.join(orders.select(F.col("o_orderkey").alias("lot_id"), F.col("o_custkey").alias("buyer")), "lot_id")
        .groupBy("buyer", "bidder").agg(F.sum("cents").alias("c"))
        .groupBy("buyer").agg((F.max("c").cast("double") / F.sum("c").cast("double")).alias("label_corr_buyer_concentration"))
    )
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("buyer"), F.col("c_mktsegment").alias("buyer_type"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer_country"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("first_part"), F.col("p_type").alias("cpv_code"), F.col("p_brand").alias("cpv_group"))
    lot = orders.select(
        F.col("o_orderkey").alias("lot_id"), F.col("o_custkey").alias("buyer"), F.col("o_orderpriority").alias("procedure_type"),
        F.col("o_orderstatus").alias("supply_type"), F.year("o_orderdate").alias("award_year"), "o_totalprice",
    )
    wide = lot.join(per_lot, "lot_id", "left").join(spend, "buyer", "left").join(customer, "buyer", "left").join(nation, "c_nationkey", "left").join(part, "first_part", "left")
    bid_count = F.col("lot_bidscount")
    single = F.when(bid_count.isNotNull(), (bid_count == 1).cast("double"))
    no_call = F.when(F.col("procedure_type") != "4-NOT SPECIFIED", (F.col("supply_type") == "P").cast("double"))
    scored = wide.select(
        "lot_id", "buyer", "buyer_type", "buyer_country", "procedure_type", "supply_type", "award_year", "o_totalprice",
        "lot_bidscount", "award_criteria_count", "cpv_code", "cpv_group", "cents_sum",
        single.alias("label_corr_singleb"), no_call.alias("label_corr_nocft"),
        (F.col("percent_sum").cast("double") / (bid_count * 10)).alias("label_corr_proc"), "label_corr_buyer_concentration",
    )
    parts = [F.col(c) for c in ("label_corr_singleb", "label_corr_nocft", "label_corr_proc", "label_corr_buyer_concentration")]
    known = sum((c.isNotNull().cast("int") for c in parts[1:]), parts[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    return scored.withColumn("label_cri", F.when(known > 0, total / known))


def split_of(key: Column) -> Column:
    """60 / 20 / 20 by a modular hash of the key."""
    h = (key * 7919 + 104729) % 100
    return F.when(h < 60, "train").when(h < 80, "val").otherwise("test")


def fold_of(key: Column, folds: int = 5) -> Column:
    return ((key * 31 + 17) % folds).cast("int")


def with_targets(lot: DataFrame) -> DataFrame:
    """lots with the five binary targets and the split. The concentration cutoff is the scores' own third quartile."""
    known = stored(lot, "lots")
    cut = percentiles(known, ["label_corr_buyer_concentration"], (0.75,))["label_corr_buyer_concentration"][0]
    return known.select(
        *lot.columns,
        binarize("label_cri", F.lit(CRI_CUT), ">=").alias("y_cri_high"),
        binarize("label_corr_proc", F.lit(PROC_CUT), ">=").alias("y_proc_high"),
        binarize("label_corr_buyer_concentration", F.lit(cut), ">=").alias("y_buyer_concentration_high"),
        binarize("label_corr_singleb", F.lit(0.0), ">").alias("y_single_bid"),
        binarize("label_corr_nocft", F.lit(0.0), ">").alias("y_no_call_for_tender"),
        split_of(F.col("lot_id")).alias("split"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_row_id, split, y_* and stand-in probabilities p_*, which follow the scores with noise from the key."""
    # other columns would be carried through five joins and written
    lot = with_targets(lots(spark, sf_dir).select("lot_id", *SCORES))
    noise = [F.expr(f"CAST((lot_id * {a} + {b}) % {m} AS DOUBLE) / {m}") for a, b, m in NOISE]
    chance = [(F.least(F.coalesce(F.col(s), F.lit(0.0)), F.lit(1.0)) + n) / 2 for s, n in zip(SCORES, noise, strict=True)]
    return lot.select(F.col("lot_id").alias("sample_row_id"), "split", *TARGETS, *[c.alias(p) for c, p in zip(chance, PROBABILITIES, strict=True)])


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic archive of solutions: one a supplier, some with a double, six objectives to minimise."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("double").alias("nk"))
    rows = supplier.select("k", "nk", F.explode(F.when(F.col("k") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("d"))
    of = lambda a, b, m: f"((k * {a} + {b}) % {m})"
    return rows.select(
        (F.col("k") * 2 + F.col("d")).alias("seq"),
        ((F.col("k") + F.col("d")) % 5).alias("algorithm"),
        F.expr(f"CAST({of(37, 11, 101)} AS DOUBLE) / 101").alias("o1"),
        F.expr(f"CAST({of(53, 7, 97)} AS DOUBLE) / 97").alias("o2"),
        F.expr(f"CAST({of(37, 11, 101)} + {of(29, 3, 13)} AS DOUBLE) / 114").alias("o3"),
        F.expr(f"CAST({of(53, 7, 97)} + {of(17, 5, 11)} AS DOUBLE) / 108").alias("o4"),
        F.expr("CAST(0.01 AS DOUBLE) + CAST(0.19 AS DOUBLE) * nk / 24").alias("o5"),
        F.expr("CAST(3 + k % 7 AS DOUBLE) / 9").alias("o6"),
    )


def configurations(spark: SparkSession, sf_dir: str, criteria: Sequence[str]) -> DataFrame:
    """A deterministic archive of configurations, one a nation: a method, a normalisation, a review rate, and which criteria
    take part with what weight."""
    k = F.col("n_nationkey")
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    columns = [k.cast("long").alias("seq"), (k % 5).cast("int").alias("algorithm"), pick(("topsis", "vikor", "edas", "cocoso", "waspas"), k % 5).alias("method")]
    columns += [pick(("minmax", "vector", "sum", "robust"), F.floor(k / 5) % 4).alias("normalization"), ((k % 8 + 2) / 100).alias("rate")]
    for i, c in enumerate(criteria):
        columns += [((k * 7 + i * 5) % 9 < k % 7 + 3).alias(f"sel_{c}"), ((k * (i + 3) + i) % 11 + 1).cast("double").alias(f"weight_{c}")]
    return table(spark, sf_dir, "nation").select(*columns)
