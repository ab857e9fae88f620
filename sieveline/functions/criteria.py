"""The nine benefit criteria of a record, from its five probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.cleaning import any_risk
from sieveline.sources.fixtures import PROBABILITIES, TARGETS

DERIVED = ("risk_consensus_mean", "risk_consensus_max", "uncertainty_mean", "uncertainty_max")
CRITERIA = (*PROBABILITIES, *DERIVED)


def _mean(columns):
    known = sum((c.isNotNull().cast("int") for c in columns[1:]), columns[0].isNotNull().cast("int"))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return F.when(known > 0, total / known)


def with_criteria(df: DataFrame) -> DataFrame:
    """df with the consensus and uncertainty criteria; nulls are skipped, as they are in any row mean."""
    p = [F.col(c) for c in PROBABILITIES]
    doubt = [1 - 2 * F.abs(c - 0.5) for c in p]
    return df.select("*", _mean(p).alias(DERIVED[0]), F.greatest(*p).alias(DERIVED[1]), _mean(doubt).alias(DERIVED[2]), F.greatest(*doubt).alias(DERIVED[3]))


def with_any_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("y_any_risk", any_risk(TARGETS))
