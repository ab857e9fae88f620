"""A search for configurations by NSGA-II (Deb et al. 2002) whose generations are evaluated as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.criteria import CRITERIA
from sieveline.operators.ranking import NORMALIZATIONS, SCORERS

METHODS = tuple(SCORERS)
GENES = 2 * len(CRITERIA) + 3
#: Fixed value: a criterion takes part if its gene reaches this.
MASK_CUT = 0.35


def decode(genes: np.ndarray) -> tuple[np.ndarray, str, str, float]:
    """Weights (0 for criteria that don't take part), method, normalisation and review rate of a vector in [0, 1]^21."""
    m = len(CRITERIA)
    mask = genes[:m] >= MASK_CUT
    if mask.sum() < 3:
        mask = np.zeros(m, bool)
        mask[np.argsort(-genes[:m], kind="stable")[:3]] = True
    raw = np.where(mask, genes[m : 2 * m], 0.0)
    weights = raw / raw.sum() if raw.sum() > 0 else mask / mask.sum()
    pick = lambda g, names: names[min(int(g * len(names)), len(names) - 1)]
    return weights, pick(genes[-3], METHODS), pick(genes[-2], NORMALIZATIONS), float(0.01 + 0.19 * genes[-1])


def score(x: np.ndarray, w: np.ndarray, method: str) -> np.ndarray:
    """The scorers over a matrix, for candidates inside a task; ranking.SCORERS are the same over a DataFrame."""
    if method == "topsis":
        v = x * w
        best, worst = (np.sqrt(((v - e) ** 2).sum(axis=1)) for e in (v.max(axis=0), v.min(axis=0)))
        return worst / np.maximum(best + worst, 1e-12)
    if method == "vikor":
        hi, lo = x.max(axis=0), x.min(axis=0)
        regret = w * (hi - x) / np.where(hi == lo, 1, hi - lo)
        s, r = regret.sum(axis=1), regret.max(axis=1)
        unit = lambda q: (q - q.min()) / max(q.max() - q.min(), 1e-12)
        return 1 - (unit(s) + unit(r)) / 2
    if method == "edas":
        mean = np.maximum(x.mean(axis=0), 1e-12)
        up, down = np.maximum(x - mean, 0) / mean @ w, np.maximum(mean - x, 0) / mean @ w
        return (up / max(up.max(), 1e-12) + 1 - down / max(down.max(), 1e-12)) / 2
    x = np.clip(x, 1e-9, 1)
    if method == "waspas":
        return 0.5 * (x @ w) + 0.5 * np.prod(x**w, axis=1)
    s, p = x @ w, (x**w).sum(axis=1)
    a = (s + p) / max((s + p).sum(), 1e-12)
    b = s / max(s.min(), 1e-12) + p / max(p.min(), 1e-12)
    c = (s + p) / max(s.max() + p.max(), 1e-12)
    return np.cbrt(np.maximum(a * b * c, 0)) + (a + b + c) / 3


def objectives(s: np.ndarray, y: np.ndarray, any_risk: np.ndarray, rate: float, used: int) -> list[float]:
    """To minimise: 1 - AP, 1 - NDCG, 1 - F1, 1 - any-risk F1, rate, share of criteria. y may be NaN."""
    order = np.argsort(-s, kind="stable")

    def part(label: np.ndarray) -> tuple[float, float, float]:
        ranked = order[~np.isnan(label[order])]
        hit, value = label[ranked], s[ranked]
        k, pos = max(int(np.ceil(len(hit) * rate)), 1), hit.sum()
        last = np.append(value[1:] != value[:-1], True)
        ctp, cn = np.cumsum(hit)[last], np.flatnonzero(last) + 1
        ap = float((np.diff(np.append(0, ctp)) * ctp / cn).sum() / max(pos, 1))
        discount = 1 / np.log2(np.arange(2, k + 2))
        ideal = discount[: int(min(pos, k))].sum()
        return ap, float((hit[:k] * discount[: len(hit[:k])]).sum() / ideal) if ideal else 0.0, float(2 * hit[:k].sum() / max(k + pos, 1))

    ap, ndcg, f1 = part(y)
    return [1 - ap, 1 - ndcg, 1 - f1, 1 - part(any_risk)[2], rate, used / len(CRITERIA)]


def fronts(f: np.ndarray) -> np.ndarray:
    """The rank of each row's front (0: not dominated)."""
    no_worse = (f[:, None, :] <= f[None, :, :]).all(axis=2)
    better = (f[:, None, :] < f[None, :, :]).any(axis=2)
    over, rank, left, level = no_worse & better, np.full(len(f), -1), np.ones(len(f), bool), 0
    while left.any():
        now = left & ~(over & left[:, None]).any(axis=0)
        rank[now], left[now], level = level, False, level + 1
    return rank


def crowding(f: np.ndarray) -> np.ndarray:
    out = np.zeros(len(f))
    for j in range(f.shape[1]):
        order = np.argsort(f[:, j], kind="stable")
        span = f[order[-1], j] - f[order[0], j] or 1.0
        out[order[[0, -1]]] = np.inf
        out[order[1:-1]] += (f[order[2:], j] - f[order[:-2], j]) / span
    return out


def _best(f: np.ndarray, n: int) -> np.ndarray:
    rank, kept = fronts(f), []
    for level in range(rank.max() + 1):
        own = np.flatnonzero(rank == level)
        if len(kept) + len(own) > n:
            own = own[np.argsort(-crowding(f[own]), kind="stable")[: n - len(kept)]]
        kept += own.tolist()
        if len(kept) == n:
            break
    return np.array(kept)


def _evaluated(spark: SparkSession, held, genes: np.ndarray) -> np.ndarray:
    """Objectives of candidates, one row each, dealt over the cluster; the matrix is broadcast once a search."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrices, y, any_risk = held.value
        for batch in batches:
            out = []
            for g in batch["genes"]:
                w, method, normalization, rate = decode(np.asarray(g))
                used = w > 0
                s = score(matrices[normalization][:, used], w[used], method)
                out.append(objectives(s, y, any_risk, rate, int(used.sum())))
            yield pd.DataFrame({"seq": batch["seq"], "f": out})

    parts = min(len(genes), spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(genes)], "seq int, genes array<double>").repartition(parts)
    rows = table.mapInPandas(run, "seq int, f array<double>").collect()
    return np.array([r["f"] for r in sorted(rows, key=lambda r: r["seq"])])


def nsga2(normalized_rows: DataFrame, y: str = "y_cri_high", any_risk: str = "y_any_risk", population: int = 40, generations: int = 20, seed: int = 1, most_rows: int = 15_000, id_col: str = "sample_row_id") -> DataFrame:
    """The last population: seq, front, objectives o1 to o6, method, normalization, rate and weights.

    normalized_rows holds every normalisation (ranking.normalized). The search sees the first most_rows ids in a hashed
    order, as a bounded matrix that is sent to every task; populations are small and stay on the driver.
    """
    spark = normalized_rows.sparkSession
    ids = normalized_rows.select(id_col).distinct().orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(most_rows)
    rows = normalized_rows.join(F.broadcast(ids), id_col).select(id_col, "normalization", F.col(y).cast("double").alias("y"), F.col(any_risk).cast("double").alias("a"), *CRITERIA).toPandas()
    parts = {n: g.sort_values(id_col) for n, g in rows.groupby("normalization")}
    one = next(iter(parts.values()))
    held = spark.sparkContext.broadcast(({n: g[[*CRITERIA]].to_numpy() for n, g in parts.items()}, one["y"].to_numpy(float), one["a"].to_numpy(float)))
    rng = np.random.default_rng(seed)
    x = rng.random((population, GENES))
    f = _evaluated(spark, held, x)
    for _ in range(generations):
        rank, crowd = fronts(f), crowding(f)
        pairs = rng.integers(0, population, (population, 2, 2))
        wins = (rank[pairs[..., 0]] < rank[pairs[..., 1]]) | ((rank[pairs[..., 0]] == rank[pairs[..., 1]]) & (crowd[pairs[..., 0]] >= crowd[pairs[..., 1]]))
        parents = np.where(wins, pairs[..., 0], pairs[..., 1])
        a, b = x[parents[:, 0]], x[parents[:, 1]]
        u = rng.random(x.shape)
        spread = np.where(u <= 0.5, (2 * u) ** (1 / 16), (1 / np.maximum(2 * (1 - u), 1e-12)) ** (1 / 16))
        child = np.where(rng.random(x.shape) < 0.9, 0.5 * ((1 + spread) * a + (1 - spread) * b), a)
        v = rng.random(x.shape)
        step = np.where(v < 0.5, (2 * v) ** (1 / 21) - 1, 1 - (2 * (1 - v)) ** (1 / 21))
        child = np.clip(child + step * (rng.random(x.shape) < 1 / GENES), 0, 1)
        x, f = np.vstack([x, child]), np.vstack([f, _evaluated(spark, held, child)])
        kept = _best(f, population)
        x, f = x[kept], f[kept]
    rank = fronts(f)
    out = [(i, int(rank[i]), *map(float, f[i]), m, n, r, w.tolist()) for i in range(len(x)) for w, m, n, r in [decode(x[i])]]
    held.unpersist()
    return spark.createDataFrame(out, "seq int, front int, o1 double, o2 double, o3 double, o4 double, o5 double, o6 double, method string, normalization string, rate double, weights array<double>")


def hypervolume(f: np.ndarray, reference: Sequence[float] | float = 1.1, samples: int = 20_000, seed: int = 3) -> float:
    """The share of the box from 0 to the reference point that a front dominates, by Monte Carlo."""
    box = np.random.default_rng(seed).random((samples, f.shape[1])) * np.asarray(reference)
    hit = np.zeros(samples, bool)
    for row in f:
        hit |= (box >= row).all(axis=1)
    return float(hit.mean())
