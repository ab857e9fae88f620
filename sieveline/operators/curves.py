"""Ranking metrics of many configurations and several labels from one sort of their scores.

Rows are dealt to ranges of (keys, falling score, id) and cut into pieces of one configuration and label, of which two bits a row are
kept: is it positive, and does a new score begin. What lies before a piece is added up from a table of a row a piece, and a second pass
over the bits has all places and sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.sources.shared import stored

#: Rows of a piece at the most, but for one Arrow batch.
_PIECE = 200_000
_COUNTS = ("n", "tp", "head_n", "head_tp", "tail_n", "tail_tp")


def _changes(column: pa.Array) -> np.ndarray:
    """Which values are not the one before; nulls are one value, and so are NaNs."""
    out = np.ones(len(column), bool)
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    out[1:] = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    out[1:] |= pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        nan = lambda x: pc.fill_null(pc.is_nan(x), False)
        out[1:] &= ~pc.and_(nan(a), nan(b)).to_numpy(zero_copy_only=False)
    return out


#: Of a piece's values: their sum, that of their squares, those of its first and last score, and of the scores between sums of values, of
#: values by place, of places and of squared places, places being mid-ranks within the piece.
_VALUES = ("v", "vv", "head_v", "tail_v", "in_v", "in_rv", "in_r", "in_rr")


def _values(v: np.ndarray, own: np.ndarray) -> list[float]:
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    sums, size = np.add.reduceat(v, first), np.diff(np.append(first, len(v)))
    inner = slice(1, -1)
    mid, s, n = (first + (size + 1) / 2)[inner], sums[inner], size[inner]
    return [*map(float, (v.sum(), (v * v).sum(), sums[0], sums[-1] if len(sums) > 1 else 0.0, s.sum(), (mid * s).sum(), (mid * n).sum(), (mid * mid * n).sum()))]


def _cut(keys: Sequence[str], labels: Sequence[str], piece: int, value: bool):
    """Sorted rows (keys, score, labels) to pieces."""

    def pieces(held: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        whole = lambda c: pa.concat_arrays(rows.column(c).chunks)
        score = whole("score")
        new_key = np.ones(rows.num_rows, bool)
        if keys:
            new_key = np.logical_or.reduce([_changes(whole(k)) for k in keys])
        else:
            new_key[1:] = False
        group = np.cumsum(new_key | _changes(score))
        marks = [whole(y).fill_null(-1).to_numpy(zero_copy_only=False) for y in labels]
        values = whole("_v").to_numpy(zero_copy_only=False) if value else np.zeros(0)
        first, out = np.flatnonzero(new_key), []
        for a, b in zip(first, np.append(first[1:], len(new_key)), strict=True):
            for i, y in enumerate(marks):
                at = np.flatnonzero(y[a:b] >= 0) + a
                if not len(at):
                    continue
                hit, own = y[at] > 0, group[at]
                begins = np.append(True, own[1:] != own[:-1])
                head, tail = own == own[0], (own == own[-1]) & (own[-1] != own[0])
                counts = [len(at), hit.sum(), head.sum(), hit[head].sum(), tail.sum(), hit[tail].sum()]
                out.append((int(a), int(at[0]), int(at[-1]), i, number, *map(int, counts), *(_values(values[at], own) if value else []), np.packbits(hit).tobytes() + np.packbits(begins).tobytes()))
        if out:
            columns = [pa.array(c) for c in zip(*out, strict=True)]
            named = [whole(k).take(columns[0]) for k in keys]
            yield pa.RecordBatch.from_arrays([*named, columns[3].cast(pa.int32()), columns[4], score.take(columns[1]), score.take(columns[2]), *columns[5:]], [*keys, "label", "_seq", "hi", "lo", *_COUNTS, *(_VALUES if value else ()), "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= piece:
                yield from pieces(held, number)
                number, held, rows = number + 1, [], 0
        if held:
            yield from pieces(held, number)

    return run


def _sums(keys: Sequence[str]):
    """Pieces with what is before them to their sums; the first and the last score of a piece, which may be in others, only have
    places here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, bits, before, positive, pos, limits in zip(*[batch.column(c).to_pylist() for c in ("n", "bits", "before", "positive", "pos", "limits")], strict=True):
                raw = np.frombuffer(bits, np.uint8)
                hit, begins = (np.unpackbits(x, count=n).astype(bool) for x in (raw[: len(raw) // 2], raw[len(raw) // 2 :]))
                ends = np.append(np.flatnonzero(begins)[1:], n)
                ctp = hit.cumsum(dtype=np.int64)[ends - 1]
                tp, size = np.diff(ctp, prepend=0)[1:-1].astype(float), np.diff(ends, prepend=0)[1:-1].astype(float)
                cn, ctp = (before + ends[1:-1]).astype(float), (positive + ctp[1:-1]).astype(float)
                limits = np.array(limits, np.int64)
                order = np.argsort(limits, kind="stable")
                sums = np.zeros((3, len(limits)))
                if len(limits) and before < limits.max():
                    m = min(n, int(limits.max()) - before)
                    at = np.flatnonzero(hit[:m])
                    gain = 1 / np.log2(before + np.arange(m) + 2.0)
                    bucket = np.searchsorted(limits[order], before + at + 1)
                    sums[0, order] = np.bincount(bucket, minlength=len(limits)).cumsum()
                    sums[1, order] = np.bincount(bucket, gain[at], minlength=len(limits)).cumsum()
                    sums[2] = np.append(0.0, gain.cumsum())[np.clip(np.minimum(limits, pos) - before, 0, m)]
                out.append((float((tp * ctp / cn).sum()), float((tp * (cn - ctp - (size - tp) / 2)).sum()), *sums.tolist()))
            if out:
                kinds = (pa.float64(), pa.float64(), *[pa.list_(pa.float64())] * 3)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]], [*keys, "area", "beaten", "hits", "dcg", "ideal"])

    return run


def limit(rate: Column) -> Column:
    """Rows of a review queue of this rate."""
    return F.greatest(F.ceil(F.col("rows") * rate), F.lit(1))


def measured(df: DataFrame, keys: Sequence[str], labels: Sequence[str], rates: Sequence[float] = (), own: str | None = None, value: str | None = None, id_col: str = "sample_row_id", score: str = "score", piece: int = _PIECE) -> DataFrame:
    """For each configuration (keys, none of which is null) and label: label (its place in labels), rows and pos (labelled rows and positives), area (of
    tp * precision over distinct scores), beaten (for a positive, negatives above it and half of those at its score) and, for each
    rate and then for the rate in the column own (equal in all rows of a configuration), arrays: limits, and hits, dcg and ideal
    of the places up to it. With value, a column without nulls: spearman_value, the correlation of values with mid-ranks by rising score. Ties go by id; null scores come last. Labels are 0, 1 or null; rows without one have no place for it."""
    marks, on = [f"_y{i}" for i in range(len(labels))], [*keys, "label"]
    kept = [*keys, *(["_own"] if own else [])]
    rate = [F.col(own).cast("double").alias("_own")] if own else []
    narrow = df.select(*keys, *rate, F.col(score).cast("double").alias("score"), F.col(id_col).alias("_id"), *[F.col(y).cast("byte").alias(m) for y, m in zip(labels, marks, strict=True)], *([F.col(value).cast("double").alias("_v")] if value else []))
    order = [*keys, F.desc("score"), F.asc("_id")]
    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in kept)
    schema = f"{kinds + ', ' if kept else ''}label int, _seq long, hi double, lo double, {', '.join([*[f'{c} long' for c in _COUNTS], *[f'{c} double' for c in _VALUES if value]])}, bits binary"
    sorted_ = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, "score", *marks, *(["_v"] if value else []))
    pieces = stored(sorted_.mapInArrow(_cut(kept, marks, piece, value is not None), schema), "pieces")
    over = Window.partitionBy(*on)
    earlier = over.orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    known = pieces.drop("bits").withColumns({
        "before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "positive": F.coalesce(F.sum("tp").over(earlier), F.lit(0)),
        "rows": F.sum("n").over(over), "pos": F.sum("tp").over(over),
    })
    cuts = [limit(F.lit(float(r))) for r in rates] + ([limit(F.col("_own"))] if own else [])
    limits = F.array(*[c.cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    known = stored(known.withColumn("limits", limits).drop("_own"), "pieces-before")
    own_sums = pieces.select(*on, "_seq", "n", "bits").join(F.broadcast(known.select(*on, "_seq", "before", "positive", "pos", "limits")), [*on, "_seq"])  # a row a piece
    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    sums = own_sums.mapInArrow(_sums(on), f"{kinds + ', ' if keys else ''}label int, area double, beaten double, hits array<double>, dcg array<double>, ideal array<double>")
    # the scores at pieces' ends, added up over the pieces that have them
    head = known.select(*on, F.col("hi").alias("at"), F.col("head_n").alias("n"), F.col("head_tp").alias("tp"), "before", "positive")
    tail = known.where("tail_n > 0").select(*on, F.col("lo").alias("at"), F.col("tail_n").alias("n"), F.col("tail_tp").alias("tp"), (F.col("before") + F.col("n") - F.col("tail_n")).alias("before"), (F.col("positive") + F.col("tp") - F.col("tail_tp")).alias("positive"))
    ends = head.unionByName(tail).groupBy(*on, "at").agg(F.sum("n").cast("double").alias("n"), F.sum("tp").cast("double").alias("tp"), F.min("before").alias("before"), F.min("positive").alias("positive"))
    cn, ctp = F.col("before") + F.col("n"), F.col("positive") + F.col("tp")
    zeros = [F.array(*[F.lit(0.0) for _ in cuts]).cast("array<double>").alias(c) for c in ("hits", "dcg", "ideal")]
    edges = ends.select(*on, (F.col("tp") * ctp / cn).alias("area"), (F.col("tp") * (cn - ctp - (F.col("n") - F.col("tp")) / 2)).alias("beaten"), *zeros)
    total = sums.unionByName(edges).groupBy(*on).agg(
        F.sum("area").alias("area"), F.sum("beaten").alias("beaten"),
        *[F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(len(cuts))]).cast("array<double>").alias(c) for c in ("hits", "dcg", "ideal")],
    )
    sizes = known.groupBy(*on).agg(F.max("rows").alias("rows"), F.max("pos").alias("pos"), F.first("limits").alias("limits"))
    found = sizes.join(total, on)
    return stored(found.join(_correlation(known, on), on) if value else found, "measured")


def _correlation(known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Correlation of pieces' values with the mid-ranks of their scores. A piece's places are shifted by the rows before it, which
    its sums allow; the scores at its ends are added up over pieces. Falling places are rising ranks with the sign turned."""
    part = [*on, F.col("before").cast("double").alias("b"), (F.col("n") - F.col("head_n") - F.col("tail_n")).alias("n"), *[f"in_{x}" for x in ("v", "rv", "r", "rr")]]
    b, n = F.col("b"), F.col("n")
    inner = known.select(*part).select(*on, (b * F.col("in_v") + F.col("in_rv")).alias("rv"), (b * b * n + 2 * b * F.col("in_r") + F.col("in_rr")).alias("rr"))
    head = known.select(*on, F.col("hi").alias("at"), F.col("head_n").alias("n"), F.col("head_v").alias("v"), "before")
    tail = known.where("tail_n > 0").select(*on, F.col("lo").alias("at"), F.col("tail_n").alias("n"), F.col("tail_v").alias("v"), (F.col("before") + F.col("n") - F.col("tail_n")).alias("before"))
    ends = head.unionByName(tail).groupBy(*on, "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.min("before").alias("before"))
    mid = F.col("before") + (F.col("n") + 1) / 2
    sums = inner.unionByName(ends.select(*on, (mid * F.col("v")).alias("rv"), (mid * mid * F.col("n")).alias("rr"))).groupBy(*on).agg(F.sum("rv").alias("rv"), F.sum("rr").alias("rr"))
    own = known.groupBy(*on).agg(F.sum("n").cast("double").alias("n"), F.sum("v").alias("v"), F.sum("vv").alias("vv"))
    cov = F.col("rv") - F.col("v") * (F.col("n") + 1) / 2
    spread = (F.col("rr") - F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2))) * (F.col("vv") - F.col("v") * F.col("v") / F.col("n"))
    return own.join(sums, on).select(*on, F.round(-F.try_divide(cov, F.sqrt(F.greatest(spread, F.lit(0.0)))), 9).alias("spearman_value"))
