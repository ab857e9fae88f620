"""Bootstrap of ranking metrics: a row's repeats in all resamples travel as one array, and resamples are added up by ranges
of falling score."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.ordering import dealt
from sieveline.sources.shared import stored

#: Ids of a block, whose repeats are drawn together, and rows of a range, which a task holds with their repeats.
_BLOCK, _RANGE = 2048, 20_000


def poisson_cuts() -> list[int]:
    """Cumulative Poisson(1) probabilities in 2^-32; 12 and more have less than 1e-9."""
    cumulative, term = [], math.exp(-1)
    for k in range(12):
        cumulative.append((cumulative[-1] if cumulative else 0.0) + term)
        term /= k + 1
    return [math.ceil(c * 2**32) for c in cumulative]


def poisson_repeats(names: Sequence[str], path: pd.DataFrame, block: int, resamples: int, seed: int) -> np.ndarray:
    """Repeats (ids by resamples) by Poisson(1): an MD5 hash of seed, id and a quarter of the resample's number gives four."""
    cuts = np.array(poisson_cuts(), np.uint32)
    fours = range(-(-resamples // 4))
    draws = [np.frombuffer(b"".join(hashlib.md5(f"{seed}|{name}|{four}".encode()).digest() for four in fours), ">u4") for name in names]
    return np.stack([np.searchsorted(cuts, u[:resamples], side="right") for u in draws]).astype(np.uint16)


def exact_repeats(names: Sequence[str], path: pd.DataFrame, block: int, resamples: int, seed: int) -> np.ndarray:
    """Repeats (ids by resamples) such that each resample has as many rows as there are ids.

    path holds the block's nodes down a binary tree over all blocks, with the ids below the left child and below both. The
    rows that a node gets are split by a binomial draw whose seed is the node, so all blocks below it see the same split
    and none has to know of another's rows; those that a block gets fall on its ids alike."""
    rows = np.full(resamples, path["both"].iloc[0] if len(path) else len(names), np.int64)
    for level, node, left, both, is_left in path[["level", "node", "left", "both", "is_left"]].itertuples(index=False):
        down = np.random.default_rng([seed, level, node]).binomial(rows, left / both)
        rows = down if is_left else rows - down
    chosen = np.random.default_rng([seed, 1 << 20, block]).integers(0, len(names), rows.sum())
    at = np.repeat(np.arange(resamples), rows)
    return np.bincount(chosen * resamples + at, minlength=len(names) * resamples).reshape(len(names), resamples).astype(np.uint16)


def _paths(ids: DataFrame, depth: int) -> DataFrame:
    """For each block and level the node above, the ids below its left child and below it. ids has one row for each id."""
    if not depth:
        return ids.select("block").distinct().select("block", F.lit(None).cast("int").alias("level"), F.lit(0).alias("node"), F.lit(1).cast("long").alias("left"), F.lit(1).cast("long").alias("both"), F.lit(True).alias("is_left"))
    sizes = ids.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth)))).withColumn("child", F.expr(f"shiftright(block, {depth} - level)"))
    each = stored(each, "tree-paths")
    below = each.groupBy("level", F.expr("shiftright(child, 1)").alias("node")).agg(F.sum(F.when(F.col("child") % 2 == 0, F.col("n")).otherwise(0)).alias("left"), F.sum("n").alias("both"))
    return each.select("block", "level", F.expr("shiftright(child, 1)").alias("node"), (F.col("child") % 2 == 0).alias("is_left")).join(below, ["level", "node"]).select("block", "level", "node", "left", "both", "is_left")


def packed(counts: np.ndarray) -> bytes:
    """Counts as bits, each so many ones and a zero: two bits for a count of mean 1, which is near what its distribution needs."""
    bits = np.ones(len(counts) + int(counts.sum()), bool)
    bits[np.cumsum(counts + 1) - 1] = False
    return np.packbits(bits).tobytes()


def unpacked(packs: Sequence[bytes], resamples: int) -> np.ndarray:
    """Rows of packed as a matrix."""
    out = np.empty((len(packs), resamples), np.int64)
    for i, own in enumerate(packs):
        zeros = np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8)) == 0)[:resamples]
        out[i] = np.diff(zeros, prepend=-1) - 1
    return out


def repeats(rows: DataFrame, id_col: str, resamples: int, seed: int, draw: Callable = exact_repeats, each: int = _BLOCK, pack: bool = False) -> DataFrame:
    """rows (id_col, strategy, score, y) as (block, strategy, score, y, rows, w): w holds the repeats of rows of a block that
    are equal but for their id, two bytes a resample or, with pack, as packed has them. All rows of an id have the same repeats. Ids are dealt to blocks of
    about `each` by hash."""
    named = stored(rows.select(F.col(id_col).cast("string").alias("name"), "strategy", F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(-math.inf)), F.lit(-math.inf)).alias("score"), F.col("y").cast("int").alias("y")), "resampled-rows")
    known = named.select("name").distinct()
    depth = max(0, math.ceil(math.log2(max(1, known.count() / each))))
    block = F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(1 << depth)).cast("int").alias("block")

    def run(own: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(own["name"].to_numpy(object), return_inverse=True)
        number = int(own["block"].iloc[0]) if len(own) else 0
        w = draw(names.tolist(), path[path["level"].notna()].sort_values("level").astype({"level": int}), number, resamples, seed)
        out = []
        for keys, index in own.groupby(["strategy", "score", "y"], sort=True).indices.items():
            sums = w[at[index]].sum(axis=0, dtype=np.int64)
            if not pack and sums.max(initial=0) > np.iinfo(np.uint16).max:
                raise ValueError("a block's equal rows are drawn more than 65,535 times: ids aren't unique in a strategy")
            out.append((number, *keys, len(index), packed(sums) if pack else sums.astype(np.uint16).tobytes()))
        return pd.DataFrame(out, columns=["block", "strategy", "score", "y", "rows", "w"])

    dealt_rows = named.select(block, "*").groupBy("block")
    paths = _paths(known.select(block), depth).groupBy("block")
    return dealt_rows.cogroup(paths).applyInPandas(run, "block int, strategy string, score double, y int, rows long, w binary")


def bootstrap(long: DataFrame, strategies: Sequence[str], resamples: int = 1000, seed: int = 7, rate: float = 0.2, id_col: str = "sample_row_id", draw: Callable = exact_repeats, block: int = _BLOCK, rows_each: int = _RANGE) -> DataFrame:
    """iteration, strategy, average_precision and f1_at_rate of resampled rows; all strategies see the same resamples.

    draw says how often an id enters each resample: exact_repeats gives resamples of exactly as many rows as there are ids,
    poisson_repeats lets each id draw for itself. Rows without a label are left out before; ids are unique within a strategy. Null and NaN scores
    come last. Of rows with equal scores at the edge of the top, the share that fits is taken. A resample without a
    positive row has 0 in both metrics. No rows give no rows.

    Rows with their repeats are dealt once to ranges of falling score. Sums of each range shift the next ones', and a second
    pass adds up the metrics within ranges. Scores at a range's ends may go on in others and are added up over ranges first.
    """
    labelled = long.where(F.col("y").isNotNull() & F.col("strategy").isin(*strategies))
    drawn = stored(repeats(labelled, id_col, resamples, seed, draw, block, pack=True), "repeats")
    ranges = max(1, -(-drawn.count() // rows_each))
    known = dealt(drawn, ["strategy", F.desc("score"), "block", "y"], ranges, "repeats-dealt").drop("block", "rows")
    ends = stored(known.groupBy("_range", "strategy").agg(F.max("score").alias("first"), F.min("score").alias("last")), "repeats-ends")
    slot = F.when(F.col("score") == F.col("first"), 0).when(F.col("score") == F.col("last"), 2).otherwise(1)
    # two rows a range and strategy at the most
    placed = known.join(F.broadcast(ends), ["_range", "strategy"]).withColumn("slot", slot).withColumn("at", F.when(F.col("slot") == 2, F.col("last")).otherwise(F.col("first")))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w, y, out = unpacked(batch["w"], resamples), batch["y"].to_numpy(), []
            for keys, index in batch.groupby(["_range", "strategy", "slot", "at"]).indices.items():
                out.append((*keys, w[index].sum(axis=0, dtype=np.int64).tolist(), w[index[y[index] > 0]].sum(axis=0, dtype=np.int64).tolist()))
            yield pd.DataFrame(out, columns=["_range", "strategy", "slot", "at", "n", "tp"])

    parts = placed.select("_range", "strategy", "slot", "at", "y", "w").mapInPandas(sums, "_range long, strategy string, slot int, at double, n array<long>, tp array<long>")
    parts = parts.select("strategy", "at", F.when(F.col("slot") == 1, F.col("_range")).alias("inner"), F.posexplode(F.arrays_zip("n", "tp")).alias("iteration", "s"))
    units = parts.groupBy("strategy", "iteration", "at", "inner").agg(F.sum("s.n").alias("n"), F.sum("s.tp").alias("tp"))
    over = Window.partitionBy("strategy", "iteration")
    down = over.orderBy(F.desc("at"), F.asc_nulls_first("inner")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = units.withColumns({"cn": F.sum("n").over(down), "ctp": F.sum("tp").over(down), "k": F.ceil(F.sum("n").over(over) * F.lit(float(rate))), "all": F.sum("tp").over(over)})
    units = stored(units, "repeats-units")
    inside = F.col("tp") * F.least(F.greatest(F.col("k") - F.col("cn") + F.col("n"), F.lit(0)), F.col("n"))
    outer = units.where(F.col("inner").isNull()).select("strategy", "iteration", F.coalesce(F.try_divide(F.col("tp") * F.col("ctp"), F.col("cn").cast("double")), F.lit(0.0)).alias("area"), F.coalesce(F.try_divide(inside, F.col("n").cast("double")), F.lit(0.0)).alias("top"))
    before = units.where(F.col("inner").isNotNull()).select(F.col("inner").alias("_range"), "strategy", "iteration", (F.col("cn") - F.col("n")).alias("cn"), (F.col("ctp") - F.col("tp")).alias("ctp"), "k")

    def within(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        out, starts = [], dict([*starts.groupby("strategy")])
        for strategy, own in rows.groupby("strategy"):
            own, at = own.sort_values("score", ascending=False, kind="stable"), starts[strategy].sort_values("iteration")
            w, y, s = unpacked(own["w"], resamples), own["y"].to_numpy()[:, None], own["score"].to_numpy()
            firsts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            cn0, ctp0, k = (at[c].to_numpy() for c in ("cn", "ctp", "k"))
            for lo in range(0, resamples, 50):
                part = slice(lo, lo + 50)
                n = np.add.reduceat(w[:, part], firsts)
                tp = np.add.reduceat(w[:, part] * (y > 0), firsts)
                cn, ctp = cn0[part] + n.cumsum(axis=0), ctp0[part] + tp.cumsum(axis=0)
                area = (tp * ctp / np.maximum(cn, 1)).sum(axis=0)
                top = (tp * np.clip(k[part] - (cn - n), 0, n) / np.maximum(n, 1)).sum(axis=0)
                out += [(strategy, lo + i, a, t) for i, (a, t) in enumerate(zip(area.tolist(), top.tolist(), strict=True))]
        return pd.DataFrame(out, columns=["strategy", "iteration", "area", "top"])

    inner = placed.where("slot = 1").select("_range", "strategy", "score", "y", "w").groupBy("_range").cogroup(before.groupBy("_range")).applyInPandas(within, "strategy string, iteration int, area double, top double")
    total = outer.unionByName(inner).groupBy("iteration", "strategy").agg(F.sum("area").alias("area"), F.sum("top").alias("top"))
    sizes = units.groupBy("iteration", "strategy").agg(F.max("k").alias("k"), F.max("all").alias("all")).where("k > 0")
    zero = lambda e: F.round(F.coalesce(e, F.lit(0.0)), 9)
    return total.join(sizes, ["iteration", "strategy"]).select(
        "iteration", "strategy", zero(F.try_divide(F.col("area"), F.col("all"))).alias("average_precision"), zero(F.try_divide(2 * F.col("top"), F.col("k") + F.col("all"))).alias("f1_at_rate")
    )
