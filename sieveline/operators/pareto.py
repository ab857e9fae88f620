"""Archives of solutions: duplicates, dominance, scaling, and the choice of a compromise."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators import curves, metrics, ranking
from sieveline.sources.shared import small, stored

OBJECTIVES = ("o1", "o2", "o3", "o4", "o5", "o6")
#: What the objectives should weigh in the chosen compromise.
TARGET_WEIGHTS = (0.30, 0.20, 0.20, 0.15, 0.10, 0.05)


def signature(method: Column, normalization: Column, rate: Column, mask: Column, weights: Column) -> Column:
    """A configuration as JSON with sorted keys and numbers of four digits."""
    return F.to_json(F.struct(
        mask.alias("mask"), method.alias("method"), normalization.alias("normalization"), F.round(rate, 4).alias("rate"),
        F.transform(weights, lambda w: F.round(w, 4)).alias("weights"),
    ))


def without_duplicates(archive: DataFrame, objectives: Sequence[str] = OBJECTIVES, seq: str = "seq") -> DataFrame:
    """The first solution, by seq, of those whose objectives agree to five digits."""
    key = F.concat_ws("|", *[F.format_string("%.5f", F.col(o)) for o in objectives])
    nth = F.row_number().over(Window.partitionBy("_key").orderBy(seq))
    return archive.withColumn("_key", key).withColumn("_n", nth).where("_n = 1").drop("_key", "_n")


def _undominated(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which points none of by dominates. Both are in order of their sums, so a point's dominators have smaller sums or, with
    rounding, equal ones."""
    left, sums = np.arange(len(points)), points.sum(axis=1)
    for s in range(0, len(by), 256):
        part = by[s : s + 256]
        if not len(left) or part[0].sum() > sums.max() * (1 + 1e-9) + 1e-9 and (part[0] >= 0).all():
            break
        x = points[left]
        no_worse = np.ones((len(x), len(part)), bool)
        better = np.zeros((len(x), len(part)), bool)
        for k in range(points.shape[1]):
            no_worse &= part[:, k] <= x[:, k, None]
            better |= part[:, k] < x[:, k, None]
        left = left[~(no_worse & better).any(axis=1)]
    out = np.zeros(len(points), bool)
    out[left] = True
    return out


def _own_front(points: np.ndarray) -> np.ndarray:
    """Which points no other of them dominates, block by block in order of their sums: what a block keeps goes on to the next."""
    order = np.argsort(points.sum(axis=1), kind="stable")
    kept = np.zeros((0, points.shape[1]))
    out = np.zeros(len(points), bool)
    for s in range(0, len(order), 1024):
        at = order[s : s + 1024]
        at = at[_undominated(points[at], kept)]
        at = at[_undominated(points[at], points[at])]
        out[at] = True
        kept = np.concatenate([kept, points[at]])
    return out


def front(archive: DataFrame, objectives: Sequence[str] = OBJECTIVES, seq: str = "seq", window: int = 4096) -> DataFrame:
    """Solutions that no other dominates (no worse in all objectives, better in one). Null or NaN objectives take no part.

    A dominator's scaled objectives have a smaller sum. So of the solutions that are left, the window with the smallest sums is
    compared within itself, and what none of it dominates is final. These go to all tasks, at most a window of them, which drop
    what they dominate; the rest is the next round's. Before the first, each batch of rows in a task is thinned by itself. A front of so many
    solutions takes as many rounds as it has windows, each over fewer rows; no round compares more than a window with each row."""
    spark = archive.sparkSession
    names = [F.col(o).cast("double") for o in objectives]
    usable = archive.where(reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in names]))
    ends = usable.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if ends["lo0"] is None:
        return usable
    unit = [(x - F.lit(ends[f"lo{i}"])) / F.lit((ends[f"hi{i}"] - ends[f"lo{i}"]) or 1.0) for i, x in enumerate(names)]
    kind = usable.schema[seq].dataType.simpleString()

    def against(by: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield batch.filter(pa.array(_own_front(x) if by is None else _undominated(x, by)))

        return run

    schema = f"id {kind}, x array<double>, s double"
    # the sum is that of the scaled objectives in their order, so equal rows have equal sums
    rows = usable.select(F.col(seq).alias("id"), F.array(*unit).alias("x")).withColumn("s", reduce(lambda a, b: a + b, [F.get("x", F.lit(i)) for i in range(len(names))]))
    left, final = stored(rows.mapInArrow(against(None), schema), "front"), []
    while True:
        first = left.orderBy("s", "id").limit(window + 1).collect()
        if not first:
            break
        points = np.array([r["x"] for r in first]).reshape(len(first), -1)
        # rows whose sums equal the window's last may lie outside it, or be told apart by rounding only: they wait
        whole = len(first) <= window
        own = _own_front(points)
        sure = np.ones(len(first), bool) if whole else points.sum(axis=1) < first[-1]["s"] * (1 - 1e-9) - 1e-12
        if not sure.any():
            window *= 2
            continue
        final += [(first[i]["id"],) for i in np.flatnonzero(own & sure)]
        if whole:
            break
        by = points[own & sure]
        last = first[-1]["s"] * (1 - 1e-9) - 1e-12
        left = stored(left.where(F.col("s") >= last).mapInArrow(against(by), schema), "front")
    ids = spark.createDataFrame(final, f"_id {kind}")
    return usable.join(ids, F.col(seq) == F.col("_id"), "left_semi")


def scaled(df: DataFrame, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """Objectives min-max scaled over df; a constant one is 0."""
    stats = df.agg(*[f(o).alias(f"{o}_{n}") for o in objectives for n, f in (("lo", F.min), ("hi", F.max))])
    wide = df.crossJoin(F.broadcast(stats))  # one row
    span = lambda o: F.when(F.col(f"{o}_hi") == F.col(f"{o}_lo"), F.lit(1.0)).otherwise(F.col(f"{o}_hi") - F.col(f"{o}_lo"))
    return wide.withColumns({o: (F.col(o) - F.col(f"{o}_lo")) / span(o) for o in objectives}).drop(*stats.columns)


def _norm(terms: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [t * t for t in terms]))


def knee(df: DataFrame, objectives: Sequence[str] = OBJECTIVES, seq: str = "seq") -> DataFrame:
    """The solution nearest to the best of all scaled objectives."""
    return scaled(df, objectives).withColumn("distance", F.round(_norm([F.col(o) for o in objectives]), 9)).orderBy("distance", seq).limit(1)


def pseudo_weights(df: DataFrame, target: Sequence[float] = TARGET_WEIGHTS, objectives: Sequence[str] = OBJECTIVES) -> DataFrame:
    """w_<objective>: how near each solution is to the best of an objective, as shares; distance: to the target weights."""
    near = {o: 1 - F.col(o) for o in objectives}
    total = reduce(lambda a, b: a + b, near.values())
    shares = {o: F.when(total == 0, F.lit(1.0 / len(objectives))).otherwise(F.try_divide(e, total)) for o, e in near.items()}
    wide = scaled(df, objectives).withColumns({f"w_{o}": e for o, e in shares.items()})
    return wide.withColumn("distance", F.round(_norm([F.col(f"w_{o}") - t for o, t in zip(objectives, target, strict=True)]), 9))


def pseudo_weight_choice(df: DataFrame, target: Sequence[float] = TARGET_WEIGHTS, seq: str = "seq") -> DataFrame:
    return pseudo_weights(df, target).orderBy("distance", seq).limit(1)


def best_per_algorithm(df: DataFrame) -> DataFrame:
    """Size of each algorithm's part, its best values, and the solution with the smallest first objective."""
    nth = F.row_number().over(Window.partitionBy("algorithm").orderBy("o1", "seq"))
    sums = df.groupBy("algorithm").agg(F.count(F.lit(1)).alias("solutions"), *[F.round(F.min(o), 9).alias(f"best_{o}") for o in OBJECTIVES])
    first = df.withColumn("_n", nth).where("_n = 1").select("algorithm", F.col("seq").alias("best_seq"))
    return sums.join(first, "algorithm")


def perturbed_weights(factors: Sequence[float] = (0.5, 1.5), base: Sequence[float] = TARGET_WEIGHTS) -> list[tuple]:
    """The base weights, and each weight alone times each factor with all rescaled: 1 + n * factors vectors."""
    vectors = [("base", 0, 1.0, *base)]
    for i in range(len(base)):
        for f in factors:
            v = [w * (f if j == i else 1) for j, w in enumerate(base)]
            vectors.append((f"o{i + 1}x{f}", i + 1, f, *[w / sum(v) for w in v]))
    return vectors


def choices_under(df: DataFrame, vectors: Sequence[tuple], objectives: Sequence[str] = OBJECTIVES, seq: str = "seq") -> DataFrame:
    """The pseudo-weight choice for each of the given target vectors (they are few and broadcast)."""
    spark = df.sparkSession
    names = [f"t_{o}" for o in objectives]
    table = spark.createDataFrame([(v[0], *[float(x) for x in v[3:]]) for v in vectors], "vector string, " + ", ".join(f"{n} double" for n in names))
    wide = pseudo_weights(df, objectives=objectives).crossJoin(F.broadcast(table))
    gap = F.round(_norm([F.col(f"w_{o}") - F.col(n) for o, n in zip(objectives, names, strict=True)]), 9)
    best = wide.groupBy("vector").agg(F.min(F.struct(gap.alias("gap"), F.col(seq).alias("seq"))).alias("b"))
    return best.select("vector", F.col("b.seq").alias("seq"), F.col("b.gap").alias("distance"))


def capacity_band(df: DataFrame, low: float = 0.04, high: float = 0.06, slack: float = 0.05) -> DataFrame:
    """Of solutions whose review rate lies in the band, and whose average precision (1 - o1) is within slack of the best
    there, the one with the smallest any-risk F1 loss (o4)."""
    band = df.where((F.col("o5") >= low) & (F.col("o5") <= high))
    best = band.agg(F.min("o1").alias("_best"))
    return band.crossJoin(F.broadcast(best)).where(F.round(F.col("o1") - F.col("_best"), 9) <= slack).drop("_best").orderBy("o4", "seq").limit(1)


def decoded(archive: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """archive with its weight_<criterion> columns replaced by a column for each criterion: its weight as a share of those that
    sel_<criterion> takes in, 0 for the others; and criteria_share, the share that takes part."""
    taken = {c: F.when(F.col(f"sel_{c}"), F.col(f"weight_{c}")).otherwise(F.lit(0.0)) for c in criteria}
    total = F.greatest(reduce(lambda a, b: a + b, taken.values()), F.lit(1e-12))
    share = reduce(lambda a, b: a + b, [F.col(f"sel_{c}").cast("int") for c in criteria]) / len(criteria)
    gone = [f"{k}_{c}" for k in ("sel", "weight") for c in criteria]
    return archive.withColumns({c: e / total for c, e in taken.items()} | {"criteria_share": share}).drop(*gone)


def archive_scores(configs: DataFrame, rows: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """Scores of rows (normalised, with the column normalization) by every decoded configuration: seq, rate, and rows' other
    columns. Configurations of one method are scored together; each meets its own normalisation's rows only."""
    weights = configs.select("normalization", F.col("seq").cast("string").alias("weighting"), *criteria, "method")
    known = [r["method"] for r in configs.select("method").distinct().orderBy("method").collect()]
    parts = [ranking.scored(rows, weights.where(F.col("method") == m).drop("method"), ["normalization"], [m], criteria) for m in known]
    scores = reduce(lambda a, b: a.unionByName(b), parts).withColumn("seq", F.col("weighting").cast("long")).drop("weighting", "method", "normalization")
    return scores.join(F.broadcast(small(configs.select("seq", "rate"))), "seq")  # a row per configuration


def evaluated(configs: DataFrame, scores: DataFrame, y: str, any_risk: str) -> DataFrame:
    """Each configuration's metrics on scored rows: average precision, AUC, metrics at its own rate and at 20%, and the F1
    of any risk at its own rate, from one sort of the scores."""
    found = curves.measured(scores, ["seq"], [y, any_risk], [0.2], own="rate")
    names = ("f1", "precision", "recall", "ndcg")
    risk = found.where("label = 0").select("seq", metrics.precision_area(), metrics.pairs_in_order(), *metrics.columns_at(1, names), *metrics.columns_at(0, names, "_at_20pct"))
    found = risk.join(found.where("label = 1").select("seq", *metrics.columns_at(1, ["f1"], "_any")), "seq").withColumnRenamed("f1_any", "any_f1")
    return configs.select("seq", "algorithm", "method", "normalization", "rate", "criteria_share").join(found, "seq")


def objectives_of(results: DataFrame) -> DataFrame:
    """results with o1 to o6, all to minimise: losses of average precision, NDCG, F1 and any-risk F1, the review rate and the
    share of criteria, to six digits."""
    of = (1 - F.col("average_precision"), 1 - F.col("ndcg"), 1 - F.col("f1"), 1 - F.col("any_f1"), F.col("rate"), F.col("criteria_share"))
    return results.withColumns({o: F.round(e, 6) for o, e in zip(OBJECTIVES, of, strict=True)})


def best_on_test(results: DataFrame) -> DataFrame:
    """Each algorithm's configuration with the highest average precision."""
    nth = F.row_number().over(Window.partitionBy("algorithm").orderBy(F.desc(F.round("average_precision", 6)), "seq"))
    return results.withColumn("_n", nth).where("_n = 1").drop("_n")
