"""Places in a total order, sums along it and order statistics without a window or a buffer over all rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.sources.shared import stored

#: Rank error of a sketch is a row in so many; a bracket reaches twice as far to both sides of a rank.
_ACCURACY = 10_000
#: Values that a bracket may hold when they are fetched.
_FEW = 200_000


def dealt(df: DataFrame, order: Sequence[Column | str], buckets: int | None, label: str) -> DataFrame:
    """df in ranges of equal depth, stored, with _at: the range in the upper bits, the place within it in the lower 33. Spark
    measures where ranges end on a sample of rows, so a distribution can't fill one of them, and as order ends with an id,
    rows of one hot value are dealt to as many ranges as they need."""
    ranged = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    return stored(ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_range", F.shiftright("_at", 33))


def with_place(df: DataFrame, keys: Sequence[str], score: str, id_col: str, place: str = "_place", buckets: int | None = None, totals: Sequence[Column] = ()) -> DataFrame:
    """df with place (1, 2, ... by falling score, ties by id), _rows and totals, all per keys, none of which is null. Null scores come last.

    Rows are dealt to ranges (the session's shuffle partitions unless buckets says so) and sorted there. A row's place is its
    place in its range and the number of its keys' rows in ranges before; that table has a row for each range and keys that meet."""
    known = dealt(df, [*keys, F.desc(score), F.asc(id_col)], buckets, "places")
    sizes = known.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"), *[F.sum(t).alias(f"_t{i}") for i, t in enumerate(totals)])
    over = Window.partitionBy(*keys)
    above = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(
        *keys, "_range", (F.coalesce(F.sum("_size").over(above), F.lit(0)) - F.col("_first") + 1).alias("_shift"), F.sum("_size").over(over).alias("_rows"),
        *[F.sum(f"_t{i}").over(over).alias(f"_total{i}") for i in range(len(totals))],
    )
    # a row for each range and keys that meet
    return known.join(F.broadcast(shift), [*keys, "_range"]).withColumn(place, F.col("_at") + F.col("_shift")).drop("_range", "_shift", "_at")


def running(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], down: bool = True, buckets: int | None = None) -> DataFrame:
    """One row for each distinct value per keys, with sums over its rows and, as c_<name>, over those at it and before it:
    above it if down, else below. Rows are added up by value first, so equal values are no hot key; the distinct values are
    dealt to ranges as in with_place, a window sees those of one range, and ranges' own sums shift it."""
    order = F.desc(value) if down else F.asc(value)
    own = df.groupBy(*keys, value).agg(*[e.alias(n) for n, e in sums.items()])
    known = dealt(own, [*keys, order], buckets, "running")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = known.groupBy(*keys, "_range").agg(*[F.sum(n).alias(n) for n in sums]).select(*keys, "_range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = known.withColumns({f"c_{n}": F.sum(n).over(inside) for n in sums})
    return at.join(F.broadcast(shift), [*keys, "_range"]).select(*keys, value, *sums, *[(F.col(f"c_{n}") + F.col(f"_b_{n}")).alias(f"c_{n}") for n in sums])


def mid_ranked(df: DataFrame, columns: Sequence[str], id_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, id_col and, under each column's name, the mid-rank of its value (the mean place of the rows that have it), all
    columns in one pass. id_col tells the rows of equal keys apart. Nulls have no rank and count for none.

    Values in long form are dealt to ranges by (column, value, id). A value's first and last place are known in each range
    that has it; a value that goes on over ranges is mended from a table of the ranges' ends. Ranks go back to their row by its
    id, never by a value, so ties are no hot key."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(columns)])).alias("e")
    long = df.select(*keys, F.col(id_col).alias("_id"), each).select(*keys, "_id", "e._column", "e._value").where(F.col("_value").isNotNull())
    by = [*keys, "_column"]
    known = dealt(long, [*by, "_value", "_id"], None, "ranks")
    over = Window.partitionBy(*by)
    sizes = known.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    earlier = over.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*by, "_range", "_lo", "_hi", (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    tied = Window.partitionBy(*by, "_range", "_value")
    placed = known.withColumn("_a", F.min("_at").over(tied)).withColumn("_b", F.max("_at").over(tied)).join(F.broadcast(shift), [*by, "_range"])
    placed = placed.withColumn("_a", F.col("_a") + F.col("_shift")).withColumn("_b", F.col("_b") + F.col("_shift"))
    # only the first and the last value of a range can be in another: two rows a range
    ends = known.join(F.broadcast(shift), [*by, "_range"]).where((F.col("_value") == F.col("_lo")) | (F.col("_value") == F.col("_hi")))
    ends = ends.groupBy(*by, "_range", "_value").agg((F.min("_at") + F.first("_shift")).alias("_a"), (F.max("_at") + F.first("_shift")).alias("_b"))
    ends = ends.groupBy(*by, "_value").agg(F.min("_a").alias("_from"), F.max("_b").alias("_to"), F.count(F.lit(1)).alias("_in")).where("_in > 1").drop("_in")
    ranked = placed.join(F.broadcast(ends), [*by, "_value"], "left").withColumn("_rank", (F.coalesce("_from", "_a") + F.coalesce("_to", "_b")) / 2)
    wide = ranked.groupBy(*keys, "_id").agg(*[F.max(F.when(F.col("_column") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(columns))])
    return wide.select(*keys, F.col("_id").alias(id_col), *[F.col(f"_r{i}").alias(c) for i, c in enumerate(columns)])


def percentiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], accuracy: int = _ACCURACY, few: int = _FEW) -> dict[str, list[float | None]]:
    """The exact percentiles of each column, interpolated between order statistics. Nulls and NaN are left out; None for a
    column without a value. Infinities are values, the smallest and the largest; between two opposite ones is NaN.

    One pass makes a sketch of each column (Greenwald and Khanna's, of known rank error and mergeable) and brackets every
    order statistic between two of its values. Where a bracket may hold more than few values, which takes some hundred million
    rows, a second pass makes a sketch within it. The last pass counts what lies below and between the brackets and each
    value within, which proves the order statistics; one that its bracket doesn't hold is looked for between brackets.
    Brackets are bounded by ranks, so neither a distribution nor ties nor heavy tails add a pass. What comes to the driver is
    the brackets' values. df is read in each pass: give a stored table."""
    typed = {c: F.col(c).cast("double") for c in columns}
    df = df.select(*[F.when(~F.isnan(x), x).alias(c) for c, x in typed.items()])
    # of a small table each value is a thousandth of all or more
    margins = (2.0 / accuracy, max(0.001, 2.0 / accuracy))
    points = sorted({min(max(p + sign * m, 0.0), 1.0) for p in shares for m in margins for sign in (-1, 1)})
    row = df.agg(*[f for c in columns for f in (F.count(c).alias(f"{c}|n"), F.percentile_approx(c, points, accuracy).alias(f"{c}|q"))]).first()
    sizes = {c: row[f"{c}|n"] for c in columns if row[f"{c}|n"]}
    # column: the ranks that are open, and disjoint brackets with the most values that one may hold
    open_ = {c: {f(p * (n - 1)) for p in shares for f in (math.floor, math.ceil)} for c, n in sizes.items()}
    brackets: dict[str, list[tuple[float, float, float]]] = {}
    for c, n in sizes.items():
        at, m = dict(zip(points, row[f"{c}|q"], strict=True)), margins[n < 5 * accuracy]
        ends = [(at[p - m] if p > m else -math.inf, at[p + m] if p + m < 1 else math.inf, n * (2 * m + 2 / accuracy)) for p in shares]
        brackets[c] = _apart(ends) if n > min(few, 4096) else [(-math.inf, math.inf, n)]
    found: dict[tuple[str, int], float] = {}
    while open_:
        if any(n > few for own in brackets.values() for _, _, n in own):
            brackets = _narrowed(df, brackets, open_, few, accuracy)
        cells = _counted(df, brackets)
        for c, ranks in [*open_.items()]:
            below, missed = 0, []
            for k in range(2 * len(brackets[c]) + 1):
                # within a bracket if k is odd, else between two
                rows = sorted(cells.get((c, k), [])) if k % 2 else [(None, sum(n for _, n in cells.get((c, k), [])))]
                for x, n in rows:
                    here = {r for r in ranks if below <= r < below + n}
                    if here and k % 2:
                        found |= dict.fromkeys(((c, r) for r in here), x)
                        ranks -= here
                    elif here:
                        lo = math.nextafter(brackets[c][k // 2 - 1][1], math.inf) if k else -math.inf
                        missed.append((lo, math.nextafter(brackets[c][k // 2][0], -math.inf) if k // 2 < len(brackets[c]) else math.inf, n))
                    below += n
            brackets[c] = missed
            if not ranks:
                del open_[c], brackets[c]
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for c in columns:
        for p in shares:
            at = p * (sizes.get(c, 0) - 1)
            low, high = found.get((c, math.floor(at))), found.get((c, math.ceil(at)))
            out[c].append(low if low is None or low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
    return out


def _apart(brackets: Sequence[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Brackets that overlap made one, in order."""
    out: list[tuple[float, float, float]] = []
    for lo, hi, n in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi), out[-1][2] + n)
        else:
            out.append((lo, hi, n))
    return out


def _narrowed(df: DataFrame, brackets: Mapping[str, list], ranks: Mapping[str, set[int]], few: int, accuracy: int, steps: int = 1000) -> dict[str, list]:
    """brackets, those of more than few values cut down round their ranks by a sketch within each."""
    parts = [(c, lo, hi) for c, own in brackets.items() for lo, hi, _ in own]
    grid, aggregates = [i / steps for i in range(steps + 1)], []
    for i, (c, lo, hi) in enumerate(parts):
        x = F.when((F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi)), F.col(c))
        aggregates += [F.count_if(F.col(c) < F.lit(lo)).alias(f"b{i}"), F.count(x).alias(f"n{i}"), F.percentile_approx(x, grid, accuracy).alias(f"q{i}")]
    row = df.agg(*aggregates).first()
    out: dict[str, list] = {c: [] for c in brackets}
    for i, (c, lo, hi) in enumerate(parts):
        below, n, q = row[f"b{i}"], row[f"n{i}"], row[f"q{i}"]
        if n <= few:
            out[c].append((lo, hi, n))
            continue
        for r in ranks[c]:
            at = (r - below) / n * steps
            if 0 <= at < steps:
                out[c].append((q[max(math.floor(at) - 2, 0)], q[min(math.ceil(at) + 2, steps)], 0))
    # a rank that the sketch put outside all brackets is between them, which the next pass shows
    return {c: _apart(out[c]) or list(brackets[c]) for c in brackets}


def _counted(df: DataFrame, brackets: Mapping[str, list]) -> dict[tuple[str, int], list[tuple[float | None, int]]]:
    """(column, k) -> values and their rows in bracket (k - 1) / 2 if k is odd; else rows before bracket k / 2, as one."""
    each = []
    for c, own in brackets.items():
        x, k = F.col(c), F.lit(2 * len(own))
        for i, (lo, hi, _) in reversed([*enumerate(own)]):
            k = F.when(x < F.lit(lo), F.lit(2 * i)).when(x <= F.lit(hi), F.lit(2 * i + 1)).otherwise(k)
        each.append(F.struct(F.lit(c).alias("c"), k.alias("k"), F.when(k % 2 == 1, x).alias("x"), x.isNotNull().alias("is")))
    rows = df.select(F.explode(F.array(*each)).alias("e")).select("e.*").where("is").groupBy("c", "k", "x").agg(F.count(F.lit(1)).alias("n"))
    out: dict[tuple[str, int], list[tuple[float | None, int]]] = {}
    for r in rows.collect():
        out.setdefault((r["c"], r["k"]), []).append((r["x"], r["n"]))
    return out
