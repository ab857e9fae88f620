"""Vectors as codes of their parts: codebooks by Lloyd's rounds over integers, with one lower bound for each group of entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.tables import in_slices, join_counted, stored

#: Integers of this size or more are refused: four squared differences of them don't fit 63 bits.
_LARGEST = 1 << 28
#: Bounds are kept in 16 bits, rounded down; what lies above is cut to the largest.
_HIGHEST = float(np.finfo(np.float16).max)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c, in floating point as long as that is exact."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * float(most) ** 2 * x.shape[1] < 2**52:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)


def entry_groups(entries: np.ndarray, groups: int) -> np.ndarray:
    """The group of each entry, by five rounds of k-means over the entries from evenly spaced ones."""
    groups = min(groups, len(entries))
    centres = entries[np.linspace(0, len(entries) - 1, groups).round().astype(int)].astype(np.float64)
    for _ in range(5):
        own = ((entries[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (own == g).any():
                centres[g] = entries[own == g].mean(axis=0)
    return own


@dataclass
class Codebook:
    """Entries of one part position, the group of each, and how far entries moved in the last round."""

    entries: np.ndarray
    groups: np.ndarray
    moved: np.ndarray

    @property
    def group_count(self) -> int:
        return int(self.groups.max()) + 1

    def assign(self, x: np.ndarray, own: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(nearest entry of each row, exact squared distance, lower bounds by group, distances computed). own and low are the
        last round's; without them all entries are scanned. A bound holds for the group's entries other than the row's own.

        A group is left out only if its bound, less what its entries moved at most, is above the exact distance to the row's
        entry, by more than rounding can be: what ties is always compared, and goes to the lower index."""
        groups = [np.flatnonzero(self.groups == g) for g in range(self.group_count)]
        n = len(x)
        if own is None:
            all_ = squared_distances(x, self.entries)
            own = all_.argmin(axis=1)
            best = all_[np.arange(n), own]
            rest = all_.astype(np.float64)
            rest[np.arange(n), own] = np.inf
            low = np.stack([rest[:, g].min(axis=1) for g in groups], axis=1)
            return own, best, _rounded_down(np.sqrt(low)), all_.size
        before = own
        # each row against its own entry only
        best = ((x - self.entries[own]) ** 2).sum(axis=1)
        first = best.copy()
        farthest = np.array([self.moved[g].max() for g in groups])
        low = np.maximum(low.astype(np.float64) - farthest * (1 + 1e-9), 0)
        reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-9) + 1e-6
        scan, own, computed, seconds = low <= reach[:, None], own.copy(), n, {}
        for g, members in enumerate(groups):
            rows = np.flatnonzero(scan[:, g])
            if not len(rows):
                continue
            found = squared_distances(x[rows], self.entries[members])
            computed += found.size
            seconds[g] = rows, found
            at = found.argmin(axis=1)
            d, e = found[np.arange(len(rows)), at], members[at]
            nearer = (d < best[rows]) | ((d == best[rows]) & (e < own[rows]))
            best[rows[nearer]], own[rows[nearer]] = d[nearer], e[nearer]
        for g, (rows, found) in seconds.items():
            others = np.where(groups[g][None, :] == own[rows][:, None], np.inf, found.astype(np.float64))
            low[rows, g] = np.sqrt(others.min(axis=1))
        # a row that left its entry has to count it among its group's others
        left = np.flatnonzero(own != before)
        home = self.groups[before[left]]
        low[left, home] = np.minimum(low[left, home], np.sqrt(first[left].astype(np.float64)))
        return own, best, _rounded_down(low), computed


def _rounded_down(x: np.ndarray) -> np.ndarray:
    near = np.minimum(x, _HIGHEST).astype(np.float16)
    return np.where(near > x, np.nextafter(near, np.float16(-np.inf)), near).astype(np.float16)


def _ints(column: pa.Array, dims: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
    if len(x) and np.abs(x).max() >= _LARGEST:
        raise ValueError(f"a component times the scale is {_LARGEST} or more in size")
    return x


def _assigned(books, dims: int, last: bool):
    """Rows (id, label, ints, codes, bounds) in, the same assigned anew out; if last, (id, label, codes, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[Codebook] = books.value
        width = dims // len(own)
        starts = np.cumsum([0, *[b.group_count for b in own]])
        for batch in in_slices(batches, 8192):
            n = batch.num_rows
            x = _ints(batch.column("ints"), dims)
            again = "codes" in batch.schema.names
            if again:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).reshape(n, len(own))
                bounds = np.frombuffer(b"".join(batch.column("bounds").to_pylist()), np.float16).reshape(n, starts[-1])
            to, low, error = np.zeros((n, len(own)), np.uint16), np.zeros((n, starts[-1]), np.float16), np.zeros(n, np.int64)
            for p, book in enumerate(own):
                span = slice(starts[p], starts[p + 1])
                held = (codes[:, p].astype(np.int64), bounds[:, span]) if again else (None, None)
                to[:, p], d, low[:, span], _ = book.assign(x[:, p * width : (p + 1) * width].astype(np.int64), *held)
                error += d
            blobs = lambda a: pa.array([row.tobytes() for row in a], pa.binary())
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), blobs(to), pa.array(error)], ["id", "label", "codes", "error"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("ints"), blobs(to), blobs(low)], ["id", "label", "ints", "codes", "bounds"])

    return run


def _sums(parts: int, entries: int, dims: int):
    """A task's sums and counts of the parts that each entry has: parts * entries * (width + 1) rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dims // parts
        total = np.zeros((parts * entries, width + 1), np.int64)
        seen = False
        for batch in batches:
            seen, n = seen or batch.num_rows > 0, batch.num_rows
            x = _ints(batch.column("ints"), dims).reshape(n * parts, width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).reshape(n, parts)
            slot = (codes.astype(np.int64) + np.arange(parts) * entries).ravel()
            np.add.at(total, slot, np.column_stack([x.astype(np.int64), np.ones(n * parts, np.int64)]))
        if seen:
            slot, at = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[slot, at])], ["slot", "at", "total"])

    return run


def _moved_to_means(books: list[Codebook], state: DataFrame, dims: int) -> list[Codebook]:
    """Each entry at the componentwise floor of its parts' mean; an entry without parts stays."""
    entries, width = len(books[0].entries), dims // len(books)
    partial = state.select("ints", "codes").mapInArrow(_sums(len(books), entries, dims), "slot int, at int, total long")
    sums: dict[tuple[int, int], int] = {(r["slot"], r["at"]): int(r["s"]) for r in partial.groupBy("slot", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).collect()}
    out = []
    for p, book in enumerate(books):
        new = book.entries.copy()
        for e in range(entries):
            if n := sums.get((p * entries + e, width)):
                new[e] = [sums.get((p * entries + e, k), 0) // n for k in range(width)]
        moved = np.sqrt(((new - book.entries).astype(np.float64) ** 2).sum(axis=1))
        out.append(Codebook(new, book.groups, moved))
    return out


def _usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def code_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64,
    rounds: int = 2, scale: int = 256,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, codes (indexes of a part's entry, 16 bits each, little-endian), error) for each row whose vector can be
    coded, and each part position's codebook.

    A component x becomes the integer floor(scale * x); a vector is cut into equal consecutive parts. A position's codebook
    starts as that part of the vectors with the smallest ids (ties by the vectors themselves, null ids last), one entry each.
    Each round assigns parts to the nearest entry, ties to the lower index, and moves entries to their parts' floored means;
    then parts are assigned once more. error is the sum of a row's squared distances.

    Entries of a position are clustered into about a tenth as many groups (Yinyang). With its code a row keeps one lower bound
    for each group, in 16 bits; a later round computes the exact distance to the row's own entry and scans only groups whose
    bound, less the farthest move of their entries, doesn't exceed it. What comes to the driver and goes to the tasks are
    codebooks and their sums, whose size doesn't depend on the rows.

    Rows are left out if the vector is null or holds nulls, NaN or infinities, or has another length than most have (the
    longer of equally many). Rows that repeat an id are coded each for itself. With fewer rows than entries the codebooks are
    shorter. An empty table gives no rows and no codebooks. Components of 2^28 / scale or more in size are an error.
    """
    kind, label_kind = vectors.schema[id_col].dataType.simpleString(), vectors.schema[label_col].dataType.simpleString()
    narrow = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(_usable(F.col("v")))
    lengths = narrow.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    dims = lengths[0]["n"] if lengths else 0
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    if not dims:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, label {label_kind}, codes binary, error long"), []
    ints = stored(narrow.where(F.size("v") == dims).select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("int")).alias("ints")), "codes-ints")
    first = ints.orderBy(F.asc_nulls_last("id"), "ints").limit(entries).select("ints").collect()
    width = dims // parts
    books = []
    for p in range(parts):
        start = np.array([r["ints"][p * width : (p + 1) * width] for r in first], np.int64)
        books.append(Codebook(start, entry_groups(start, -(-entries // 10)), np.zeros(len(start))))
    state, context = ints, vectors.sparkSession.sparkContext
    for k in range(rounds):
        schema = f"id {kind}, label {label_kind}, ints array<int>, codes binary, bounds binary"
        state = stored(state.mapInArrow(_assigned(context.broadcast(books), dims, False), schema), f"codes-round{k}")
        books = _moved_to_means(books, state, dims)
    final = state.mapInArrow(_assigned(context.broadcast(books), dims, True), f"id {kind}, label {label_kind}, codes binary, error long")
    return stored(final, "codes"), [b.entries for b in books]


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def code_table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **params) -> DataFrame:
    """Per coded row: id, code (two hex digits an index, so 256 entries at most), error, label_error (the error of all rows with
    an equal label; null labels are equal) and codebooks_sha256 (see code_vectors). Labels of very many rows are joined where
    they are."""
    if params.get("entries", 64) > 256:
        raise ValueError("two hex digits name 256 entries")
    coded, books = code_vectors(vectors, id_col, vector_col, label_col, **params)
    key = F.coalesce(F.concat(F.lit("s"), F.col("label").cast("string")), F.lit("z"))
    rows = coded.withColumn("key", key)
    per_label = stored(rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "codes-labels")
    # of each index's two bytes the first is the lower one
    code = F.lower(F.regexp_replace(F.hex("codes"), "(..)00", "$1"))
    return join_counted(rows, per_label, "key").select(
        F.col("id").alias(id_col), code.alias("code"), "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256")
    )
