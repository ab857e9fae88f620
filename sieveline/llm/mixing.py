"""A mix of sources with target weights, dealt out in blocks of equal tokens by Sainte-Laguë's method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.tables import stored, words_in


#: Blocks that the smallest source is cut into at least, if it has as many words.
_LEAST = 4_000


def _source_key(source: Column) -> Column:
    """Never null; sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("z"))


def _seats(df: DataFrame, votes: str, seats: str, limit: Column, group: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """df with quota: of each group's seats, those that go to a row, which are its quotients votes / (2k + 1) among the
    group's highest, ties by the columns named ties. No row gets more than limit.

    Were seats divided in proportion, a row's last quotient would be near where they end. Rounding n rows moves that end by n / 2
    seats, and limits by 25 a row at most (each of 16 cells rounds its blocks), so only quotients within 26 n seats of it are compared;
    those before are won. So rows grow with the number of rows and not with that of seats."""
    within, order = Window.partitionBy(*group), Window.partitionBy(*group).orderBy(F.desc("_sl_quotient"), *ties, "_sl_k")
    fair = F.col(votes) * F.col(seats) / F.greatest(F.sum(votes).over(within), F.lit(1e-300))
    near = 3 + F.ceil(F.col("_sl_fair") * 26 * F.count(F.lit(1)).over(within) / F.greatest(F.col(seats), F.lit(1)))
    cut = (
        df.where(limit > 0).withColumn("_sl_limit", limit).withColumn("_sl_fair", fair).withColumn("_sl_near", near)
        .withColumn("_sl_from", F.least(F.col("_sl_limit"), F.greatest(F.lit(0), F.floor(F.col("_sl_fair") - F.col("_sl_near")))).cast("long"))
        .withColumn("_sl_to", F.least(F.col("_sl_limit"), F.ceil(F.col("_sl_fair") + F.col("_sl_near"))).cast("long"))
        .withColumn("_sl_left", F.col(seats) - F.sum("_sl_from").over(within))
    )
    won = (
        cut.withColumn("_sl_k", F.explode(F.expr("CASE WHEN _sl_from < _sl_to THEN sequence(_sl_from, _sl_to - 1) ELSE array(CAST(NULL AS BIGINT)) END")))
        .withColumn("_sl_quotient", F.col(votes) / (2 * F.col("_sl_k") + 1).cast("double"))
        .withColumn("_sl_place", F.row_number().over(order))
        .groupBy(*ties)
        .agg((F.max("_sl_from") + F.count_if(F.col("_sl_k").isNotNull() & (F.col("_sl_place") <= F.col("_sl_left")))).alias("quota"))
    )
    return df.join(won, [*ties], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def source_plan(cells: DataFrame, weights: Sequence[float], max_repeat: int, blocks: int) -> DataFrame:
    """One row per source and shard of cells (skey, shard, size), with what the source may give.

    All blocks are of one size: a share of 1 / blocks of all words, or less, so that the smallest source is a few thousand
    blocks or single words. The windows over all sources see some rows for each source; documents don't reach them.
    """
    per_source = cells.groupBy("skey").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = (
        per_source.withColumn("rank", F.row_number().over(everything.orderBy("skey")))
        .withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("most", F.col("source_size") * max_repeat)
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    # sources in the order in which a rising level fills them; level: what a unit of weight gets if all before are full
    filling = everything.orderBy("ratio", "skey")
    full = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    aimed = (
        weighed.withColumn("level", (F.col("total") - full) / left)
        .withColumn("capped", F.col("ratio") <= F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
        .withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight")))
        .withColumn("least", F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.ceil(F.col("total") / F.lit(blocks)), F.expr(f"least div {_LEAST}"))).cast("long"))
        .withColumn("seats", F.round(F.col("total") / F.col("block")).cast("long"))
    )
    in_blocks = F.when(F.col("size") > 0, F.greatest(F.lit(1), F.round(F.col("size") / F.col("block")))).otherwise(0).cast("long")
    cut = cells.join(aimed.select("skey", "block"), "skey").withColumn("n", in_blocks)
    held = cut.groupBy("skey").agg(F.sum("n").alias("held"))
    by_source = _seats(aimed.join(held, "skey"), "target", "seats", F.col("held") * max_repeat, ["total"], ["skey"])
    by_source = by_source.select("skey", "source_size", "target", F.col("quota").alias("source_quota"))
    inner = cut.drop("block").join(by_source, "skey")
    return _seats(inner, "size", "source_quota", F.col("n") * max_repeat, ["skey"], ["skey", "shard"]).select(
        "skey", "shard", F.col("size").alias("cell_size"), "n", "source_size", "target", "quota"
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    blocks: int = 20_000,
    seed: int = 42,
) -> DataFrame:
    """Per row of docs: id, the columns in keep, size (words), source_size, target (its source's), taken (words that the
    mix takes, repeats counted), copies (times that the whole document is taken) and pieces (word ranges [from, to) that
    are taken once more).

    Sources sorted by code point, null last, get the weights in turn and share the total of all sizes; a source's target
    stops at max_repeat times its size and the rest shares the excess. A source's documents lie end to end in each of 16
    shards, in a seeded order, cut into blocks of equal tokens. Sources win blocks by highest quotients target / (2k + 1),
    a source's shards by size / (2k + 1); within a shard every block is taken quota // n times and quota % n blocks in a row
    from a seeded one on (round the end) once more, so none above max_repeat, and few documents are cut. Blocks are a share of
    1 / blocks of all words at most, and small enough for the smallest source (see source_plan).

    A null or blank text has size 0 and nothing taken. A null id sorts first. Rows that repeat an id are documents of
    their own. Columns that are neither named nor in keep are ignored. An empty table gives no rows.
    """
    # rows that repeat an id, or have none, are dealt by their texts too
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    kept = [F.col(c).alias(f"_sl_keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.col(id_col).alias("id"), _source_key(F.col(source_col)).alias("skey"), key.alias("key"),
        words_in(F.col(text_col)).alias("size"), *kept,
    )
    narrow = stored(rows.select("id", "skey", "key", "size"), "mix")
    rows = (rows if keep else narrow).withColumn("shard", F.substring("key", 1, 1)).withColumn("bucket", F.substring("key", 2, 2))
    buckets = (
        narrow.groupBy("skey", F.substring("key", 1, 1).alias("shard"), F.substring("key", 2, 2).alias("bucket"))
        .agg(F.sum("size").alias("size"))
    )
    buckets = stored(buckets, "mix-buckets")
    plan = source_plan(buckets.groupBy("skey", "shard").agg(F.sum("size").alias("size")), weights, max_repeat, blocks)
    before = Window.partitionBy("skey", "shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("skey", "shard", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    cell = ["skey", "shard", "bucket"]
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "skey", "shard")), 1, 7), 16, 10).cast("long")
    wide = offsets.join(plan, ["skey", "shard"]).withColumn("turn", F.when(F.col("n") > 0, offset % F.greatest("n", F.lit(1))))
    earlier = Window.partitionBy(*cell).orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        rows.withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .join(wide, cell)
        .withColumn("start", F.col("start") + F.col("shift"))
        .withColumn("end", F.col("start") + F.col("size"))
        .withColumn("copies", F.when(F.col("n") > 0, F.expr("quota div n")).otherwise(F.lit(0)).cast("long"))
        .withColumn("extra", F.when(F.col("n") > 0, F.expr("quota % n")).otherwise(F.lit(0)).cast("long"))
    )
    # the blocks taken once more are `extra` in a row from `turn` on, and if they run over the end, the rest from 0 on
    run = F.expr(
        """CASE WHEN size > 0 AND extra > 0 THEN transform(
             array(struct(turn AS f, least(turn + extra, n) AS t), struct(0L AS f, greatest(turn + extra - n, 0L) AS t)),
             r -> struct(greatest(start, (CAST(r.f AS DECIMAL(19, 0)) * CAST(cell_size AS DECIMAL(18, 0))) div n) - start AS from, least(end, (CAST(r.t AS DECIMAL(19, 0)) * CAST(cell_size AS DECIMAL(18, 0))) div n) - start AS to))
           ELSE array() END"""
    )
    span = F.array_sort(F.filter(run, lambda x: x["from"] < x["to"]))
    more = F.aggregate("pieces", F.lit(0).cast("long"), lambda total, x: total + x["to"] - x["from"])
    return laid.withColumn("pieces", span).select(
        F.col("id").alias(id_col), *[F.col(f"_sl_keep{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size",
        "target", (F.col("copies") * F.col("size") + more).alias("taken"), "copies", "pieces",
    )


def written_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **params
) -> DataFrame:
    """The mix itself, with the columns of docs: whole documents as often as they are taken, and the pieces taken once
    more as rows of their own, cut between words. chars_col follows the text where there is such a column. Columns may have
    any names; those that aren't named are carried along, and rows of which nothing is taken go."""
    columns = docs.columns
    own = {c: f"_sl_d{i}" for i, c in enumerate(columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    text = own[text_col]
    mixed = mix_sources(renamed, own[id_col], text, own[source_col], keep=[n for c, n in own.items() if c != id_col], **params)
    # (?s) and an anchored count of words with the space after each, so that a piece is one substring of the text
    ends = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    parts = F.split(ends, r"(?<=[\x20\x09-\x0D])(?![\x20\x09-\x0D])")
    piece = F.transform("pieces", lambda x: F.rtrim(F.array_join(F.slice(parts, (x["from"] + 1).cast("int"), (x["to"] - x["from"]).cast("int")), "")))
    texts = F.concat(F.array_repeat(F.col(text), F.col("copies").cast("int")), piece)
    rows = mixed.where(F.col("taken") > 0).withColumn(text, F.explode(texts))
    if chars_col in columns:
        rows = rows.withColumn(own[chars_col], F.length(text).cast(docs.schema[chars_col].dataType))
    return rows.select(*[F.col(n).alias(c) for c, n in own.items()])
