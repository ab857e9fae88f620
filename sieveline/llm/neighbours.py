"""Nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.tables import stored


def _rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; the width is a power of two."""
    n, width = x.shape
    for s in signs:
        x, h = x * s, 1
        while h < width:
            halves = x.reshape(n, width // (2 * h), 2, h)
            x = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(n, width)
            h *= 2
    return x


def _width(dim: int) -> int:
    return 1 << max(0, (dim - 1).bit_length())


class Hashes:
    """For vectors of one length: tables of so many hashes each. A hash is a pseudo-rotation and the nearest of the 2 * width
    signed axes; axis i is code 2i, its opposite 2i + 1. A table's first code names a cell, the others a bucket in it."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int):
        self.dim, self.tables, self.hashes, self.width = dim, tables, hashes, _width(dim)
        self.signs = np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def unit(self, x: np.ndarray) -> np.ndarray:
        """x padded, and scaled to length 1 (by its largest component first, which keeps squares from overflowing)."""
        padded = np.zeros((len(x), self.width))
        padded[:, : self.dim] = x / np.abs(x).max(axis=1, keepdims=True)
        return padded / np.sqrt((padded**2).sum(axis=1, keepdims=True))

    def turned(self, unit: np.ndarray, table: int, k: int) -> np.ndarray:
        return _rotated(unit, self.signs[table, k]) / self.width**1.5

    def code(self, unit: np.ndarray, table: int, k: int) -> np.ndarray:
        z = self.turned(unit, table, k)
        axis = np.abs(z).argmax(axis=1)
        return 2 * axis + (z[np.arange(len(z)), axis] < 0)

    def gaps(self, unit: np.ndarray, table: int, k: int) -> np.ndarray:
        """How much farther each signed axis is than the nearest: the squared difference of the coordinates."""
        z = self.turned(unit, table, k)
        return (np.abs(z).max(axis=1)[:, None] - np.stack([z, -z], axis=2).reshape(len(z), -1)) ** 2

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows x tables: the first code, and the others as digits of one number."""
        unit = self.unit(x)
        first, rest = (np.zeros((len(x), self.tables), np.int64) for _ in range(2))
        for t in range(self.tables):
            first[:, t] = self.code(unit, t, 0)
            for k in range(1, self.hashes):
                rest[:, t] = rest[:, t] * 2 * self.width + self.code(unit, t, k)
        return first, rest

    def rest_gaps(self, unit: np.ndarray, table: int, rest: np.ndarray) -> np.ndarray:
        """Summed gaps of the hashes after the first: rows of unit x buckets in rest."""
        total = np.zeros((len(unit), len(rest)))
        for k in range(self.hashes - 1, 0, -1):
            rest, digit = np.divmod(rest, 2 * self.width)
            total += self.gaps(unit, table, k)[:, digit]
        return total

    def reach(self, query: np.ndarray, other: np.ndarray) -> np.ndarray:
        """For rows of both: the least summed gap, over the tables, of the bucket that holds other."""
        a, (first, rest) = self.unit(query), self.codes(other)
        least, row = np.full(len(query), np.inf), np.arange(len(query))
        for t in range(self.tables):
            total, left = self.gaps(a, t, 0)[row, first[:, t]], rest[:, t]
            for k in range(self.hashes - 1, 0, -1):
                left, digit = np.divmod(left, 2 * self.width)
                total = total + self.gaps(a, t, k)[row, digit]
            least = np.minimum(least, total)
        return least


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) for the vectors of each length."""
    vectors = batch.column(column)
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        yield int(dim), rows, flat[starts[rows, None] + np.arange(dim)]


def _coded(vectors: DataFrame, known: Mapping[int, Hashes]) -> DataFrame:
    """A row for each vector and table: vec_id, embedding, dim, tab, code, rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in _by_length(batch, 1):
                own = known[dim]
                first, rest = own.codes(x)
                tab = np.tile(np.arange(own.tables, dtype=np.int32), len(rows))
                cells = pa.StructArray.from_arrays([pa.array(tab), pa.array(first.ravel().astype(np.int32)), pa.array(rest.ravel())], ["tab", "code", "rest"])
                offsets = pa.array(np.arange(0, len(tab) + 1, own.tables, dtype=np.int32))
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, cells)], ["vec_id", "embedding", "cells"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    out = vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, cells array<struct<tab:int,code:int,rest:bigint>>")
    return out.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.inline("cells"))


def _probing(queries: DataFrame, known: Mapping[int, Hashes], reach: Mapping[int, float]) -> DataFrame:
    """A row for each query and cell whose first gap is within reach: vec_id, embedding, dim, tab, code, left (what the
    gaps of the other hashes may sum to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in _by_length(batch, 1):
                own = known[dim]
                unit = own.unit(x)
                gaps = np.stack([own.gaps(unit, t, 0) for t in range(own.tables)], axis=1)
                row, tab, code = np.nonzero(gaps <= reach[dim])
                left = reach[dim] - gaps[row, tab, code]
                cells = pa.StructArray.from_arrays([pa.array(tab.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(left)], ["tab", "code", "left"])
                offsets = pa.array(np.append(0, np.bincount(row, minlength=len(rows)).cumsum()).astype(np.int32))
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(offsets, cells)], ["vec_id", "embedding", "cells"])

    kind = queries.schema["embedding"].dataType.simpleString()
    out = queries.select("vec_id", "embedding").mapInArrow(run, f"vec_id long, embedding {kind}, cells array<struct<tab:int,code:int,left:double>>")
    return out.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.inline("cells"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = table["vec_id"].to_numpy(), table["embedding"].combine_chunks()
    return ids, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest scores, ties to the smaller id."""
    if len(score) > k:
        near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
        return near[np.lexsort((ids[near], score[near]))[:k]]
    return np.lexsort((ids, score))


def _nearest(k: int, known: Mapping[int, Hashes]):
    """Queries and vectors of one block of a cell against each other: for each query the k nearest in the buckets that
    its gaps reach."""

    def run(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        found_q, found_v, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if queries.num_rows and vectors.num_rows:
            own, tab = known[key[0].as_py()], key[1].as_py()
            (qi, q), (vi, v) = _matrix(queries), _matrix(vectors)
            buckets, bucket = np.unique(vectors["rest"].to_numpy(), return_inverse=True)
            near = own.rest_gaps(own.unit(q), tab, buckets) <= queries["left"].to_numpy()[:, None]
            for i in range(len(qi)):
                rows = np.flatnonzero(near[i][bucket])
                rows = rows[vi[rows] != qi[i]]
                score = np.sqrt(((v[rows] - q[i]) ** 2).sum(axis=1))
                best = _best(vi[rows], score, k)
                found_q.append(np.full(len(best), qi[i]))
                found_v.append(vi[rows][best])
                found_d.append(score[best])
        return pa.table({n: pa.array(np.concatenate(a)) for n, a in (("query_id", found_q), ("vec_id", found_v), ("score", found_d))})

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding of the vectors that take part, one for each id."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = ~F.exists(vector_col, lambda x: x != 0)
    fit = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad & ~zero)
    return fit.groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(vector_col).alias("embedding"))


def measured_reach(base: DataFrame, queries: DataFrame, known: Mapping[int, Hashes], k: int, recall: float, sample: int, seed: int) -> dict[int, float]:
    """For each length of vector, the summed gap within which the buckets of that share of the true k nearest lie. It is
    measured on at most `sample` queries of each length, those first in a hashed order, against every row of base: their
    matrix is what is sent to the tasks, and k rows a query come back."""
    first = Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id")
    picked = queries.select("vec_id", "embedding", F.size("embedding").alias("dim")).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample)
    rows = picked.select("vec_id", "embedding").orderBy("vec_id").toArrow()
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in rows.combine_chunks().to_batches():
        for dim, at, x in _by_length(batch, 1):
            asked[dim] = (batch.column(0).to_numpy()[at], x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {dim: [(np.zeros(0), np.zeros(0, np.int64), np.zeros((0, dim)))] * len(ids) for dim, (ids, _) in asked.items()}
        for batch in batches:
            for dim, at, x in _by_length(batch, 1):
                ids = batch.column(0).to_numpy()[at]
                for i, (own, q) in enumerate(zip(*asked.get(dim, ((), ())), strict=True)):
                    score = np.sqrt(((x - q) ** 2).sum(axis=1))
                    other = np.flatnonzero(ids != own)
                    other = other[_best(ids[other], score[other], k)]
                    joined = [np.concatenate(p) for p in zip(held[dim][i], (score[other], ids[other], x[other]), strict=True)]
                    best = _best(joined[1], joined[0], k)
                    held[dim][i] = tuple(p[best] for p in joined)
        for dim, (own, _) in asked.items():
            for query, (score, ids, x) in zip(own.tolist(), held[dim], strict=True):
                columns = [pa.array([query] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(score), pa.array(list(x), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score", "embedding"])

    true = _ranked(base.select("vec_id", "embedding").mapInArrow(run, "query_id long, vec_id long, score double, embedding array<double>"), k)
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for row in true.select("query_id", "embedding").orderBy("query_id").collect() if asked else []:
        found.setdefault(len(row["embedding"]), []).append((row["query_id"], np.array(row["embedding"])))
    reach = {dim: math.inf for dim in known}
    for dim, hits in found.items():
        ids, x = asked[dim]
        at = np.searchsorted(ids, [q for q, _ in hits])
        reach[dim] = float(np.quantile(known[dim].reach(x[at], np.array([v for _, v in hits])), recall))
    return reach


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    tables: int = 8,
    hashes: int | None = None,
    recall: float = 0.95,
    sample: int = 64,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by Euclidean distance among the candidates in the buckets
    that it probes, nearest first, ties to the smaller id. is_query is a condition on vec_id.

    Vectors null, zero or with null or non-finite components take no part, nor do rows without id. Of rows that repeat an
    id the smallest vector counts. Vectors are compared with those of their own length. Other columns are ignored.

    Each of the tables joins `hashes` cross-polytope hashes (by default as many as leave about eight rows to a bucket, two at
    least, so buckets grow in number with the table). A query probes the buckets whose gaps, summed over the hashes, are
    within a reach that measured_reach takes from a bounded sample of queries and all rows, so that `recall` of the true
    neighbours lie within it. The first hash names a cell, which a query meets once however many of its buckets it probes;
    a cell is dealt to blocks of about block vectors by a hash of their ids, and so are its queries, and a block is one
    group: a cell with a third of all rows is many tasks' work. Of vectors that are equal only the k + 1 smallest ids are
    looked at, which loses nothing: none beyond them can be among a query's k nearest. Should a query's buckets hold fewer
    than k candidates, it is compared with all buckets of a table, that is with every row.

    Only the number of vectors in each cell is broadcast: tables * 2 * width rows for each length of vector.
    """
    fit = stored(usable(vectors, id_col, vector_col), "ann-vectors")
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    base = stored(fit.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "ann-base")
    queries = fit.where(is_query)
    sizes = {r["dim"]: r["count"] for r in base.groupBy(F.size("embedding").alias("dim")).count().collect()}
    known = {d: Hashes(d, tables, hashes or max(2, round(math.log(max(n / 8, 2)) / math.log(2 * _width(d)))) if d > 1 else 1, seed) for d, n in sizes.items()}
    reach = measured_reach(base, queries, known, k, recall, sample, seed)
    coded = stored(_coded(base, known), "ann-coded")
    first = stored(_search(coded, _probing(queries, known, reach), known, k, block), "ann-found")
    served = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = stored(queries.join(served, queries["vec_id"] == served["query_id"], "left_anti"), "ann-short")
    if not short.isEmpty():
        every = _probing(short, known, dict.fromkeys(known, math.inf)).where("tab = 0")
        rest = _search(coded.where("tab = 0"), every, known, k, block)
        first = first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    return _ranked(first, k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(coded: DataFrame, probing: DataFrame, known: Mapping[int, Hashes], k: int, block: int) -> DataFrame:
    cell = ["dim", "tab", "code"]
    held = coded.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("v_blocks"))
    asked = probing.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("q_blocks"))
    blocks = F.broadcast(held.join(asked, cell))

    def dealt(rows: DataFrame, own: str, other: str, extra: str) -> DataFrame:
        return (
            rows.join(blocks, cell)
            .withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(f"{own}s")).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .select(*cell, "v_block", "q_block", "vec_id", "embedding", extra)
        )

    key = [*cell, "v_block", "q_block"]
    left = dealt(probing, "q_block", "v_block", "left").groupBy(*key)
    right = dealt(coded, "v_block", "q_block", "rest").groupBy(*key)
    found = left.cogroup(right).applyInArrow(_nearest(k, known), "query_id long, vec_id long, score double")
    return _ranked(found.distinct(), k).select("query_id", "vec_id", "score")
