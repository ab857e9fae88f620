"""Bounded, seeded samples of labelled documents for fitting; held-out rows never get in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, unsigned, modulo divisor; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor, F.lit(0))


def held_out(id_col: str, divisor: int, left: int) -> Column:
    return remainder(id_col, divisor) == left


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, away: Column, most: int, seed: int = 42) -> DataFrame:
    """(id, label, text) of at most `most` labelled documents for which away is false, those first in a hashed order of id and text.
    Rows without label or id are out; where an id has several labels the larger counts; where it has several documents
    each is a row, and counts for the bound."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~away)
    one = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    # no more ids than rows are needed, so two numbers for each of at most `most` ids are broadcast
    picked = one.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), F.col("doc") == F.col("id")).select("id", "label", "text")
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id", F.xxhash64("text"), "text").limit(most)
