"""Sinks: Parquet tables, report tables in CSV and Markdown, JSON summaries, and the update of a manifest."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A report table; reports are small, so one file. Other tables are as many files as they have partitions. Fields are quoted,
    quotes within are doubled, white space and line ends stay; null and the empty text are both empty."""
    options = {"header": True, "quoteAll": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (df.coalesce(1) if one_file else df).write.mode("overwrite").options(**options).csv(path)


def markdown_rows(df: DataFrame, limit: int = 1000) -> str:
    """A report table as Markdown. Reports have few rows; more than limit are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a Markdown table takes {limit} rows at most")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *([cell(x) for x in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(df: DataFrame, stem: str) -> None:
    write_csv(df, f"{stem}.csv")
    write_text(df.sparkSession, markdown_rows(df), f"{stem}.md")


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    write_text(spark, json.dumps(summary, indent=2, sort_keys=True, ensure_ascii=False), path)


def text_report(title: str, facts: dict) -> str:
    return f"# {title} Summary\n\n" + "".join(f"- {k}: {v}\n" for k, v in facts.items())


def upsert_manifest(manifest: DataFrame, added: DataFrame) -> DataFrame:
    """manifest with the rows of added (same columns, keyed by column): flags of existing rows are set, others follow."""
    flags = added.select(F.col("column").alias("_key"), F.col("used_as_feature").alias("_flag"))
    updated = manifest.join(flags, F.col("column") == F.col("_key"), "left").withColumn("used_as_feature", F.coalesce("_flag", "used_as_feature"))
    new = added.join(manifest.select(F.col("column").alias("_key")), F.col("column") == F.col("_key"), "left_anti")
    return updated.select(*manifest.columns).unionByName(new.select(*manifest.columns))
