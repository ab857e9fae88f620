"""Intermediate tables in the cluster's shared folder, and gapless positions without one-task windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space as all operators here mean it: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local master gets one under /tmp/checkpoints;
    on a cluster that is an error, as no machine's own folder is seen by the others."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file:///tmp/checkpoints"
    return f"{folder.rstrip('/')}/sieveline-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, so lost executors cost a
    reread and not a recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard_stored(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that still read them must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows at most, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_of(text: Column) -> Column:
    """A hash that tells texts apart; null is not the empty text."""
    return F.xxhash64(text, text.isNull())


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """rows joined with counted, which has one row for each key and n, the number of rows with it; total is the sum of n
    where that is known. counted is read several times: give a stored table. A key of more than a thousand rows and more than one in 10,000 of all is hot: there are fewer
    than 10,000 such keys, whatever the table's size, so they are broadcast, and their rows stay in the tasks that they
    are in. The others meet by a shuffle."""
    total = counted.agg(F.sum(n).alias("all")).first()["all"] or 0 if total is None else total
    hot = F.col(n) > max(1000, total // 10_000)
    left = rows.join(F.broadcast(counted.where(hot).select(key)), key, "left_anti")
    return rows.join(F.broadcast(counted.where(hot)), key).unionByName(left.join(counted.where(~hot), key))


def buckets_for(rows: int, each: int = 200_000) -> int:
    """How many buckets with_position needs so that one has about `each` rows."""
    return max(16, -(-rows // each))


def with_position(
    df: DataFrame, out: str, group: Sequence[str], spread: Column, order: Sequence[str], buckets: int
) -> DataFrame:
    """Adds out: 0, 1, 2, ... within each group. spread deals a group's rows to so many buckets; each bucket is numbered
    by itself and shifted by the sizes of those before it, so a group with most rows is still many tasks' work. df is
    read twice and must give the same rows both times."""
    dealt = df.withColumn("_sl_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    keys = [*group, "_sl_bucket"]
    before = Window.partitionBy(*group).orderBy("_sl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        dealt.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_sl_n"))
        .select(*keys, F.coalesce(F.sum("_sl_n").over(before), F.lit(0)).alias("_sl_shift"))
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return (
        dealt.withColumn("_sl_rank", rank)
        .join(shift, keys)
        .withColumn(out, F.col("_sl_shift") + F.col("_sl_rank") - 1)
        .drop("_sl_bucket", "_sl_shift", "_sl_rank")
    )
