"""Scans. Schemas are stated, never inferred; columns are pruned by the plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.sources.shared import stored

_BOM = "\ufeff"


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


_PLACE = ["_file", "_block", "_at"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files, with their file, the byte at which their split begins, and their order within it."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
        "value", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("_quotes"),
    )


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files as text, with their place (_file, _block, _at): one of several lines is whole, and blank ones are out.

    Files are read in splits. A line begins a record if the quotes before it are even in number, so each split's own quotes are
    counted, and their sums over a file's splits say how a split begins. A split that begins even and whose lines
    are all even needs nothing else. The others' lines are put in order split by split, and only lines of records of several
    lines are shuffled once more, by the record's place; where one goes on over splits, its beginning is known from the table of
    splits, which has a row for each. A quote within a field that isn't quoted isn't standard CSV."""
    # the order of lines is part of a task's own numbering, so it is fixed by writing it
    lines = stored(_lines(spark, path), "csv-lines")
    blocks = lines.groupBy("_file", "_block").agg(F.sum("_quotes").alias("_q"), F.count_if(F.col("_quotes") % 2 == 1).alias("_odd"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = stored(blocks.withColumn("_open", F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2), "csv-blocks").drop("_q")
    split = ["_file", "_block"]
    known = lines.join(F.broadcast(opened), split)  # a row a split
    plain = known.where((F.col("_odd") == 0) & (F.col("_open") == 0)).select(*_PLACE, F.col("value").alias("record"))
    earlier = Window.partitionBy(*split).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*split).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    other = known.where((F.col("_odd") > 0) | (F.col("_open") == 1))
    begins = (F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) + F.col("_open")) % 2 == 0
    other = other.withColumn("_first", F.when(begins, F.col("_at"))).withColumn("_first", F.last("_first", ignorenulls=True).over(so_far))
    # what a split begins with may go on from the last record of one before it
    last = other.groupBy(*split).agg(F.max("_first").alias("_last")).unionByName(plain.groupBy(*split).agg(F.max("_at").alias("_last")))
    held = F.when(F.col("_last").isNotNull(), F.struct(F.col("_block").alias("b"), F.col("_last").alias("f")))
    from_before = last.select(*split, F.last(held, ignorenulls=True).over(before).alias("_from"))
    at = F.when(F.col("_first").isNotNull(), F.struct(F.col("_block").alias("b"), F.col("_first").alias("f"))).otherwise(F.col("_from"))
    # a record that no line begins is one that its file never closes
    placed = other.join(F.broadcast(from_before), split).select("_file", at.alias("_record"), "_block", "_at", "value", "_quotes")
    single = (F.col("_block") == F.col("_record.b")) & (F.col("_at") == F.col("_record.f")) & (F.col("_quotes") % 2 == 0)
    alone = placed.where(single).select(*_PLACE, F.col("value").alias("record"))
    parts = placed.where(~single).groupBy("_file", F.col("_record.b").alias("_record_block"), F.col("_record.f").alias("_record_at"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))), lambda x: x["value"]), "\n")
    long = parts.agg(joined.alias("record")).select("_file", F.col("_record_block").alias("_block"), F.col("_record_at").alias("_at"), "record")
    records = plain.unionByName(alone).unionByName(long).withColumn("record", F.regexp_replace("record", "\r$", ""))
    start = (F.col("_block") == 0) & F.col("record").startswith(_BOM)
    return records.withColumn("record", F.when(start, F.substring("record", 2, 1 << 30)).otherwise(F.col("record"))).where("record <> ''")


def _fields(record: Column, names: Sequence[str], schema: T.StructType | None = None) -> Column:
    kinds = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    return F.from_csv(record, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), {"quote": '"', "escape": '"', "lineSep": "\u0000", "maxCharsPerColumn": "-1"})


def _parsed(records: DataFrame, schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """Fields of all records but each file's first, and the names that the first file's first record has."""
    first = records.where("_block = 0").groupBy("_file").agg(F.min_by("record", "_at").alias("record"), F.min("_at").alias("_at"))
    heads = first.orderBy("_file").limit(1).collect()
    if not heads:
        return records.select(F.lit(None).alias("f")).where("false"), []
    width = heads[0]["record"].count(",") + 1
    row = records.sparkSession.createDataFrame([(heads[0]["record"],)], "record string").select(_fields(F.col("record"), [f"c{i}" for i in range(width)]).alias("f")).first()["f"]
    names = [n for n in row if n is not None]
    body = records.join(F.broadcast(first.select("_file", F.lit(0).cast("long").alias("_block"), "_at")), _PLACE, "left_anti")  # a row a file
    return body.select(_fields(F.col("record"), names, schema).alias("f")), names


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, without a leading byte order mark."""
    return _parsed(csv_records(spark, path))[1]


def csv_strings(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with every column a string; empty cells are null, quoted or not, cells that a row lacks are null, and those beyond the
    header are left out. Quotes are doubled within quotes, where commas and line ends are text. Each file has a header."""
    rows, names = _parsed(csv_records(spark, path))
    return rows.select(*[F.when(F.col("f")[n] != "", F.col("f")[n]).alias(n) for n in (columns or names)])


def csv_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV's columns in order as schema has them; what doesn't fit is null."""
    return _parsed(csv_records(spark, path), T._parse_datatype_string(schema))[0].select("f.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """column, role, type and used_as_feature as a boolean, whatever its spelling in the file."""
    raw = csv_strings(spark, path, ["column", "role", "type", "used_as_feature"])
    return raw.withColumn("used_as_feature", F.lower(F.trim("used_as_feature")) == "true")


def line_count(spark: SparkSession, path: str) -> int:
    """Physical lines after the header; a line end inside quotes counts, too."""
    return spark.read.text(path).count() - 1


def sizes_mb(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.round(F.col("length") / 1048576, 2).alias("size_mb"))
