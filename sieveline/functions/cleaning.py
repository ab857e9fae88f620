"""Column expressions: coercion, targets, engineered numerics, keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as true in a text column.
TRUE_WORDS = ("1", "1.0", "true", "t", "yes", "y")
MISSING = "missing"


def to_float(name: str) -> Column:
    """A 32-bit float; null for what doesn't parse."""
    return F.expr(f"try_cast(`{name}` AS FLOAT)")


def trimmed(name: str) -> Column:
    """Text without blanks at its ends; null if nothing is left."""
    return F.nullif(F.trim(F.col(name)), F.lit(""))


def truthy(name: str) -> Column:
    return F.coalesce(F.lower(F.trim(F.col(name).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def binarize(name: str, cut: Column, op: str) -> Column:
    """1 or 0, null where the score is null."""
    over = F.col(name) >= cut if op == ">=" else F.col(name) > cut
    return F.when(F.col(name).isNotNull(), over.cast("int"))


def clipped_log1p(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.log1p(F.greatest(F.col(name).cast("double"), F.lit(0.0))))


def zero_if_null(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def total_of(names: Sequence[str]) -> Column:
    return sum((zero_if_null(n) for n in names[1:]), zero_if_null(names[0]))


def ratio_plus_one(top: str, bottom: str) -> Column:
    return zero_if_null(top) / (zero_if_null(bottom) + 1)


def per_at_least_one(top: str, bottom: str) -> Column:
    return zero_if_null(top) / F.greatest(F.coalesce(F.col(bottom).cast("double"), F.lit(1.0)), F.lit(1.0))


def interaction(left: str, right: str) -> Column:
    known = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in (left, right)]
    return F.concat_ws("||", *known)


def column_or_null(df: DataFrame, name: str, kind: str = "float") -> Column:
    """A column that may be absent, as nulls if it is."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def sigmoid(name: str) -> Column:
    return 1 / (1 + F.exp(-F.col(name)))


def caption(name: str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.col(name), "_", " "), r"\s+", " "))


def any_risk(targets: Sequence[str]) -> Column:
    """1 if any known target is 1, 0 if all known ones are 0, null if none is known: greatest skips nulls."""
    return F.greatest(*[F.col(t) for t in targets])
