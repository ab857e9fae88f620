"""Quality scores by histogram gradient-boosted trees over statistics of a text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.labels import held_out, training_rows

_BYTE = np.arange(256)


def _bytes(of: bytes) -> np.ndarray:
    return np.isin(_BYTE, np.frombuffer(of, np.uint8))


_LOWER, _UPPER, _DIGIT = ((lo <= _BYTE) & (hi >= _BYTE) for lo, hi in ((97, 122), (65, 90), (48, 57)))
_SPACE, _LINE, _STOP, _COMMA = _bytes(b" \t\n\x0b\x0c\r"), _bytes(b"\n"), _bytes(b".!?"), _bytes(b",;:")
_HIGH, _LEAD = _BYTE >= 128, (_BYTE & 0xC0) == 0xC0
_LOUD, _PIPE = _bytes(b"!?"), _bytes(b"|")
_ODD = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _STOP | _COMMA | _HIGH)
#: Shares of a text's bytes.
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _COMMA, _LEAD, _LOUD, _PIPE, _ODD]).astype(float).T
STATISTICS = (
    "lower", "upper", "digit", "space", "line_end", "stop", "comma", "accented", "loud", "pipe", "odd",
    "log_bytes", "log_words", "word_bytes", "distinct_words", "top_word", "odd_ended", "capital_words", "lone_marks",
    "log_lines", "line_words", "distinct_lines", "top_byte", "byte_entropy",
)


def statistics(text: str | None) -> np.ndarray:
    """The numbers named in STATISTICS, over the whole text; zeros for an empty one."""
    data = (text or "").encode()
    if not data:
        return np.zeros(len(STATISTICS))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts / len(data)
    seen = share[share > 0]
    words, lines = data.split(), data.split(b"\n")
    n, distinct = max(1, len(words)), set(words)
    firsts = np.frombuffer(b"".join(w[:1] for w in words), np.uint8)
    lasts = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    alone = sum(len(w) == 1 and bool(_ODD[w[0]]) for w in distinct)
    tallies: dict[bytes, int] = {}
    for w in words:
        tallies[w] = tallies.get(w, 0) + 1
    own = (
        np.log1p(len(data)), np.log1p(len(words)), (len(data) - counts[_SPACE].sum()) / n, len(distinct) / n,
        max(tallies.values(), default=0) / n, (_ODD | _LOUD)[lasts].sum() / n, _UPPER[firsts].sum() / n, alone / n,
        np.log1p(len(lines)), len(words) / len(lines), len(set(lines)) / len(lines), share.max(), -(seen * np.log2(seen)).sum(),
    )
    return np.concatenate([share @ _CLASSES, own])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees in arrays: node i of a tree has the children 2i + 1 and 2i + 2; a node that wasn't split
    sends everything left, to leaves of equal value."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities. All rows go down one tree together, a level at a time."""
        depth, rows = int(np.log2(self.leaf.shape[1])), np.arange(len(x))
        raw = np.full(len(x), self.base)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-np.clip(raw, -35, 35)))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 5, ridge: float = 1.0
) -> Trees:
    """Logistic loss; splits are sought in histograms of gradients over quantile bins. One label only, or no rows at all,
    gives no trees and the prior (0.5 for no rows)."""
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1)
    inner, leaves = 2**depth - 1, 2**depth
    base = float(np.log(prior / (1 - prior)))
    empty = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if n == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # bin b: x <= edges[b]
    flat = binned + np.arange(width) * bins
    raw, features, thresholds, values = np.full(n, base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (many, width, bins)
            g, h, c = (
                np.bincount(cell, np.repeat(w, width), minlength=many * width * bins).reshape(shape).cumsum(axis=2)
                for w in (grad, hess, np.ones(n))
            )
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
            gain[(c < least) | (ct - c < least)] = -np.inf
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -np.inf
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9:
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        g, h = np.bincount(at, grad, minlength=leaves), np.bincount(at, hess, minlength=leaves)
        leaf = -rate * g / (h + ridge)
        raw = raw + leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.stack(features), np.stack(thresholds), np.stack(values), base)


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(t.as_py()).tolist() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])


def _scores(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(x), pa.float64())], ["id", "score"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", divisor: int = 5, left: int = 0, most: int = 20_000) -> Trees:
    """Trees from at most `most` labelled documents that aren't held out (most x 24 numbers come to the driver)."""
    train = training_rows(docs, labels, id_col, text_col, label_col, held_out(id_col, divisor, left), most)
    rows = train.select("label", "text").mapInArrow(_with_statistics, "label int, x array<double>").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    y = rows["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows come in no fixed order; sums then do
    return fit_trees(x[order], y[order])


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    divisor: int = 5, left: int = 0, threshold: float = 0.3, most: int = 20_000,
) -> DataFrame:
    """Per row of docs: id, held_out (crc32 of the id as text modulo divisor is left; a null id counts as 0), score (0 to
    1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Labels of held-out rows are never read into the fit, and nothing but the text goes into a score. Null and empty texts
    score as a text of zero statistics. Without labels all score 0.5. Rows that repeat an id are scored each for itself.
    Other columns are ignored. An empty table gives no rows.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, divisor, left, most)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scores(model), f"id {kind}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out("id", divisor, left).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
