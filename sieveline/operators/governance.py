"""Which columns may be features: rules over column names, as a plan over a table of names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names and parts of names that the rules look for.
TARGETS = ("corr_singleb", "corr_proc", "corr_nocft", "corr_buyer_concentration", "cri")
TARGET_PREFIXES = ("label_", "y_")
TEMPORAL = ("year", "date", "deadline", "period", "duration")
GEOGRAPHIC = ("country", "city", "nuts", "postcode", "street", "address")
IDENTIFIERS = ("id", "name", "email", "phone", "url", "source", "contact")
GROUPING = ("trace", "federated", "client", "email", "phone", "url", "source", "contact")
EXCLUDED, NO_REASON = "exclude from model features", "no automatic exclusion"


def _has(name: Column, parts: Sequence[str]) -> Column:
    return F.greatest(*[F.contains(F.lower(name), F.lit(p)) for p in parts], F.lit(False))


def _begins(name: Column, prefixes: Sequence[str]) -> Column:
    return F.greatest(*[F.startswith(name, F.lit(p)) for p in prefixes], F.lit(False))


def _reasons(*rules: tuple[Column, str]) -> Column:
    """The reasons whose rule holds, in the rules' order."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(reason)) for holds, reason in rules]))


def _decided(names: DataFrame, reasons: Column, free: str) -> DataFrame:
    found = F.array_sort(F.array_distinct(reasons))
    out = F.when(F.size(found) > 0, F.lit(EXCLUDED)).otherwise(F.lit(free))
    return names.select("column", out.alias("decision"), F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(F.lit(NO_REASON)).alias("reasons"))


def raw_columns(names: DataFrame) -> DataFrame:
    """column, decision and sorted reasons for names of raw columns."""
    name = F.col("column")
    reasons = _reasons(
        (name.isin(*TARGETS), "target or validation label"), (F.startswith(F.lower(name), F.lit("filter_")), "filter or derived screening field"),
        (_has(name, ("currency",)), "currency proxy"), (_has(name, TEMPORAL), "temporal variable"), (_has(name, GEOGRAPHIC), "geographic variable"),
        (_has(name, IDENTIFIERS), "identifier or contact field"),
    )
    return _decided(names, reasons, "candidate feature after preprocessing")


def processed_columns(names: DataFrame) -> DataFrame:
    """column, decision and sorted reasons for names of a processed table."""
    name = F.col("column")
    own = _has(name, ("trace",)) | F.endswith(F.lower(name), F.lit("_id")) | (F.lower(name) == "id")
    reasons = _reasons(
        (_begins(name, TARGET_PREFIXES), "label or evaluation target"), (_has(name, ("federated", "client")), "federated grouping field"),
        (own, "trace or identifier field"), (_has(name, TEMPORAL), "temporal variable"), (_has(name, GEOGRAPHIC), "geographic variable"),
    )
    return _decided(names, reasons, "candidate model feature")


def forbidden_features(names: DataFrame) -> DataFrame:
    """column, forbidden, and reasons in the rules' order."""
    name = F.col("column")
    reasons = _reasons(
        (_begins(name, TARGET_PREFIXES), "target"), (name.isin(*TARGETS), "raw label source"), (_has(name, TEMPORAL), "temporal"),
        (_has(name, GEOGRAPHIC), "geographic"), (_has(name, GROUPING), "identifier or grouping"),
    )
    return names.select("column", (F.size(reasons) > 0).alias("forbidden"), F.array_join(reasons, "; ").alias("reasons"))


def feature_sets(manifest: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """manifest's columns with audit_priority and strict_ex_ante: used and not forbidden, and for strict also allowed; and
    the reason of those that are forbidden. Rows that repeat a name are judged each for itself."""
    judged = manifest.join(forbidden_features(manifest.select("column").distinct()), "column")
    usable = F.col("used_as_feature") & ~F.col("forbidden")
    return judged.select(
        "column", "type", usable.alias("audit_priority"), (usable & F.col("column").isin(*allowed)).alias("strict_ex_ante"), F.col("reasons").alias("exclusion_reason"),
    )


def inferred_types(manifest: DataFrame) -> DataFrame:
    """column and numeric or categorical: by the manifest's type, or a name that begins like a label."""
    kind, name = F.lower("type"), F.col("column")
    numeric = F.contains(kind, F.lit("numeric")) | F.contains(kind, F.lit("risk outcome")) | _begins(name, TARGET_PREFIXES)
    return manifest.select("column", F.when(F.coalesce(numeric, F.lit(False)), "numeric").otherwise("categorical").alias("kind"))
