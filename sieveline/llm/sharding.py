"""Balanced label propagation: linked rows gather in one shard while all shards keep their number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.tables import buckets_for, join_counted, stored, with_position


def _spread(name: str):
    return F.xxhash64(name)


def _allowed(demand: DataFrame, pool: DataFrame, used: DataFrame, shards: int) -> DataFrame:
    """How many rows may move for each pair of shards (at most shards² rows): src, dst, swap (moves that a move the other
    way pays for) and fill (moves that an unlinked row of dst pays for by going to src), with the place in dst's pool of
    unlinked rows, first, from which those are taken."""
    back = demand.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("back"))
    over = Window.partitionBy("dst")
    order = over.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    left = pool.join(F.broadcast(used), "dst", "left").select("dst", F.coalesce("used", F.lit(0)).alias("used"), (F.col("size") - F.coalesce("used", F.lit(0))).alias("left"))
    return (
        demand.join(F.broadcast(back), ["src", "dst"], "left")
        .withColumn("swap", F.least("n", F.coalesce("back", F.lit(0))))
        .withColumn("excess", F.col("n") - F.col("swap"))
        .join(F.broadcast(left), "dst", "left")
        .fillna(0, ["used", "left"])
        .withColumn("wanted", F.sum("excess").over(over))
        .withColumn("fill", F.least("excess", F.expr("CASE WHEN wanted > 0 THEN excess * left div wanted ELSE 0 END")))
        .withColumn("first", F.col("used") + F.coalesce(F.sum("fill").over(order), F.lit(0)))
        .select("src", "dst", "swap", "fill", "first")
    )


def balanced_shards(rows: DataFrame, link_col: str, shards: int = 16, rounds: int = 4) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (0, 1, ... within the shard). Rows with equal, non-null link_col are
    linked; a link is a hub that its rows share, so a group costs as many edges as it has rows, not their pairs.

    Law `rows`: shards' counts are at most one apart, from the start and after every round. Rows are first dealt round
    robin in a hashed order. Then, a few times: join each group's rows to the shard that holds most of it and still has
    room (ties by hash), and move those elsewhere there. Each move is paid for by a move the other way: of a linked row
    that wants it, or of an unlinked row, whose place costs no link. A group larger than a shard fills several.

    rows must have no columns shard, slot or with the prefix _sl_. Null links are unlinked. Repeated rows are rows of
    their own. An empty table gives no rows. All work is in joins, windows and aggregates over narrow tables.
    """
    spark, columns = rows.sparkSession, rows.columns
    renamed = rows.select(*[F.col(c).alias(f"_sl_c{i}") for i, c in enumerate(columns)], F.col(link_col).alias("hub"))
    renamed = stored(renamed, "shard-rows")
    total, content = renamed.count(), [c for c in renamed.columns if c != "hub"]
    state = stored(with_position(renamed, "rid", [], F.xxhash64(*content), content, buckets_for(total)), "shard-state")
    state = state.withColumn("shard", (F.col("rid") % shards).cast("int"))
    groups = stored(state.where(F.col("hub").isNotNull()).groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shard-groups")
    linked = stored(join_counted(state, groups, "hub").select("rid", "hub", "shard"), "shard-linked")
    free = state.join(linked.select("rid"), "rid", "left_anti").select("rid", "shard")
    each = buckets_for(-(-total // shards))
    free = stored(with_position(free, "place", ["shard"], _spread("rid"), ["rid"], each), "shard-free")
    pool = stored(free.groupBy(F.col("shard").alias("dst")).agg(F.count(F.lit(1)).alias("size")), "shard-pool")
    deals = spark.createDataFrame([], "src int, dst int, swap long, fill long, first long")

    # tables by shard or by pair of shards, of at most shards² rows for each round, are broadcast
    for turn in range(rounds):
        used = deals.groupBy("dst").agg(F.sum("fill").alias("used"))
        room = pool.join(F.broadcast(used), "dst", "left").where(F.col("size") > F.coalesce("used", F.lit(0))).select(F.col("dst").alias("shard"))
        held = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
        if turn == 0:  # a group may be a third of all rows; later, shards that are full no longer draw
            drawn = held.withColumn("drawn", F.lit(True))
        else:
            drawn = held.join(F.broadcast(room.withColumn("drawn", F.lit(True))), "shard", "left")
        choice = F.max(F.when(F.col("drawn"), F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard"))).alias("best")
        best = drawn.groupBy("hub").agg(choice, F.sum("n").alias("n")).where(F.col("best").isNotNull()).select("hub", F.col("best.shard").alias("dst"), "n")
        movers = join_counted(linked, stored(best, "shard-best"), "hub", total=total).where(F.col("shard") != F.col("dst"))
        if turn:
            movers = movers.join(F.broadcast(room), "shard", "left_semi")  # those in a full shard stay
        movers = stored(movers.select("rid", "hub", F.col("shard").alias("src"), "dst"), "shard-movers")
        demand = movers.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        deal = stored(_allowed(demand, pool, used, shards), "shard-deal")
        if deal.agg(F.sum(F.col("swap") + F.col("fill"))).first()[0] in (None, 0):
            break
        deals = deals.unionByName(deal)
        ranked = with_position(movers, "turn", ["src", "dst"], _spread("rid"), ["hub", "rid"], each)
        moved = ranked.join(F.broadcast(deal), ["src", "dst"]).where(F.col("turn") < F.col("swap") + F.col("fill")).select("rid", F.col("dst").alias("goes"))
        linked = linked.join(moved, "rid", "left").select("rid", "hub", F.coalesce("goes", "shard").alias("shard"))
        linked = stored(linked, "shard-linked")

    swaps = deals.where("fill > 0").select(F.col("dst").alias("shard"), "src", "first", (F.col("first") + F.col("fill")).alias("end"))
    inside = (F.col("place") >= F.col("first")) & (F.col("place") < F.col("end"))
    # at most shards² rows for each round
    freed = free.alias("f").join(F.broadcast(swaps.alias("s")), (F.col("f.shard") == F.col("s.shard")) & inside, "left")
    freed = freed.select("rid", F.coalesce("src", F.col("f.shard")).alias("shard"))
    final = state.drop("shard", "hub").join(freed.unionByName(linked.select("rid", "shard")), "rid")
    final = stored(final, "shard-final")
    placed = with_position(final, "slot", ["shard"], _spread("rid"), ["rid"], each)
    return placed.select(*[F.col(f"_sl_c{i}").alias(c) for i, c in enumerate(columns)], "shard", "slot")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = 4) -> DataFrame:
    """Per row of docs: id, size (UTF-8 bytes of the text plus 1; a null text counts as empty), text_crc32, law, shard,
    slot and grown_shard (null: the law isn't `key`). Documents with equal texts are linked; see balanced_shards. Other
    columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("text_md5"),
    )
    return balanced_shards(narrow, "text_md5", shards, rounds).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded(docs: DataFrame, text_col: str = "text", shards: int = 16, rounds: int = 4) -> DataFrame:
    """docs with shard and slot, which replace columns of these names; see balanced_shards. Only hashes go through its
    joins; texts meet their shard once, by a number that their row gets as docs are written to the shared folder."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_sl_d{i}") for i, c in enumerate(kept)], F.monotonically_increasing_id().alias("_sl_row"))
    rows = stored(rows, "shard-docs")
    own = [c for c in rows.columns if c != "_sl_row"]
    text = F.coalesce(F.col(f"_sl_d{kept.index(text_col)}"), F.lit(""))
    narrow = rows.select(F.xxhash64(*own).alias("content"), F.unhex(F.md5(text.cast("binary"))).alias("text_md5"), F.col("_sl_row").alias("row"))
    dealt = balanced_shards(narrow, "text_md5", shards, rounds).select(F.col("row").alias("_sl_row"), "shard", "slot")
    return rows.join(dealt, "_sl_row").select(*[F.col(c).alias(kept[i]) for i, c in enumerate(own)], "shard", "slot")
