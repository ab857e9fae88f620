"""Toxicity by weak supervision: many voters, a generative model of their votes, and a linear classifier on its posterior."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.labels import held_out, training_rows
from sieveline.llm.tables import stored

_WORD = re.compile(r"[^\W\d_]+")
_PREFIXES, _SUFFIXES, _LONGEST = (3, 4, 5, 6, 7, 8), (3, 4, 5), 24
#: Voters on groups of the lexicon's words, and on groups of patterns; texts of fewer words than this they don't call clean.
_LEXICON_VOTERS, _PATTERN_VOTERS, _LEAST_WORDS = 8, 48, 5
#: Words that vote on their own, whatever the labels say of them.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "pathetic", "worthless", "disgusting", "trash",
    "garbage", "scum", "clown", "clowns", "fool", "fools", "jerk", "liar", "pig", "pigs", "vermin", "filth", "filthy", "ugly",
    "hate", "kill", "die", "shut", "freak", "imbecile", "coward", "degenerate", "subhuman", "parasite", "parasites",
    "dummkopf", "abschaum", "arschloch", "trottel", "connard", "salaud", "ordure", "crétin", "imbécile", "estúpido", "basura",
    "idiota", "imbécil", "asqueroso",
)


def features_of(word: str) -> list[str]:
    """A lower-case word's features: itself, its beginnings and its ends."""
    found = [f"={word}"] if len(word) <= _LONGEST else []
    found += [f"^{word[:n]}" for n in _PREFIXES if len(word) >= n]
    return found + [f"{word[-n:]}$" for n in _SUFFIXES if len(word) >= n]


def features_in(words: set[str]) -> set[str]:
    """The features of a text's distinct words; one that two of them or more have is also a feature with 2 before it."""
    counts = Counter(f for w in words for f in features_of(w))
    return counts.keys() | {f"2{f}" for f, n in counts.items() if n > 1}


def _words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of either label each feature occurs, summed over a batch."""
    for batch in batches:
        tallies = (Counter(), Counter())
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tallies[bool(label)].update(features_in(_words(text)))
        names = sorted(tallies[0].keys() | tallies[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([tallies[y][f] for f in names], pa.int64()) for y in (1, 0))], ["feature", "toxic", "clean"]
        )


class _Finder:
    """Which of the chosen features a text has. What a word has is remembered, for so many words at most."""

    def __init__(self, place: dict[str, int], remembered: int = 200_000):
        self.place, self.most, self.known = place, remembered, {}
        self.bases = {f.removeprefix("2") for f in place}

    def __call__(self, text: str | None) -> set[int]:
        known, found, again = self.known, set(), set()
        for word in _words(text):
            own = known.get(word)
            if own is None:
                if len(known) >= self.most:
                    known.clear()
                own = known[word] = tuple(f for f in features_of(word) if f in self.bases)
            if own:
                again.update(found.intersection(own))
                found.update(own)
        place = self.place
        return {place[f] for f in found if f in place} | {place[f"2{f}"] for f in again if f"2{f}" in place}


def _presence(place: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(place)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            has = pa.array([sorted(find(t)) for t in texts], pa.list_(pa.int16()))
            long = pa.array([sum(1 for _, _ in zip(_WORD.finditer(t or ""), range(_LEAST_WORDS), strict=False)) == _LEAST_WORDS for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), has, long], ["id", "has", "long"])

    return run


@dataclass(frozen=True)
class LabelModel:
    """What voters do given the class. rates[y, j, v]: how often voter j votes v - 1 (-1: clean, 0: abstains, 1: toxic) on
    rows of class y. parent[j] is the voter that j depends on within a class (-1: none), and given[y, j, u, v] how often j
    votes v - 1 there if its parent votes u - 1."""

    prior: float
    rates: np.ndarray
    parent: np.ndarray
    given: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        code = votes.astype(np.int64) + 1
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent):
            odds = np.log(self.rates[1, j] / self.rates[0, j]) if p < 0 else np.log(self.given[1, j] / self.given[0, j])
            logit += odds[code[:, j]] if p < 0 else odds[code[:, p], code[:, j]]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _strongest_tree(counts: np.ndarray, voters: int) -> np.ndarray:
    """Each voter's parent in the spanning tree of largest mutual information within the classes (Chow and Liu)."""
    told = np.zeros((voters, voters))
    for own in counts:
        pairs = own.reshape(voters, 3, voters, 3).transpose(0, 2, 1, 3) + 0.05
        n = pairs.sum(axis=(2, 3), keepdims=True)
        share = pairs / n
        told += n[:, :, 0, 0] * (share * np.log(share / share.sum(axis=3, keepdims=True) / share.sum(axis=2, keepdims=True))).sum(axis=(2, 3))
    parent, source, best = np.full(voters, -1), np.zeros(voters, np.int64), told[0].copy()
    best[0] = -np.inf
    for _ in range(voters - 1):
        j = int(best.argmax())
        parent[j], best[j] = source[j], -np.inf
        closer = (told[j] > best) & (best > -np.inf)
        best[closer], source[closer] = told[j][closer], j
    return parent


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 40, every: int = 5, smooth: float = 1.0) -> LabelModel:
    """A generative model of votes (rows x voters of -1, 0, 1) by EM, without any label: the share of toxic rows, prior,
    is all that is given. Rows start as toxic that are in the share of highest mean votes.

    A voter's rates of voting either way are its accuracies. Correlations within a class are kept where they are strongest:
    every voter but one depends on one other, in a tree that is fitted anew every so many rounds, with tables of both
    voters' votes; the first rounds take voters as independent."""
    n, voters = votes.shape
    cell = np.arange(voters) * 3 + votes.astype(np.int64) + 1
    hot = np.zeros((n, 3 * voters), np.float32)
    hot[np.arange(n)[:, None], cell] = 1
    mean = votes.mean(axis=1)
    q = np.where(mean > np.quantile(mean, 1 - prior), 0.9, 0.1 * prior)
    parent = np.full(voters, -1)
    for turn in range(rounds):
        counts = np.stack([(hot * w[:, None]).T @ hot for w in (1 - q.astype(np.float32), q.astype(np.float32))]).astype(np.float64)
        if turn and turn % every == 0:
            parent = _strongest_tree(counts, voters)
        single = np.diagonal(counts, axis1=1, axis2=2).reshape(2, voters, 3)
        rates = (single + smooth) / (single.sum(axis=2, keepdims=True) + 3 * smooth)
        given = np.zeros((2, voters, 3, 3))
        for j, p in enumerate(parent):
            if p >= 0:  # a row of few votes is drawn to the voter's own rates
                both = counts[:, 3 * p : 3 * p + 3, 3 * j : 3 * j + 3] + 5 * smooth * rates[:, j, None, :]
                given[:, j] = both / both.sum(axis=2, keepdims=True)
        model = LabelModel(prior, rates, parent, given)
        q = model.posterior(votes)
    return model


def fit_linear(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, width: int, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Adam over all rows; rows and cols are the places of ones in a sparse matrix."""
    n = len(target)
    w, bias = np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], minlength=n) + bias, -30, 30)))
        off = (p - target) / n
        grad = np.append(np.bincount(cols, off[rows], minlength=width) + ridge * w, off.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


@dataclass(frozen=True)
class Linear:
    weights: dict[str, float]
    bias: float


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    divisor: int = 3, left: int = 1, most: int = 20_000, chosen: int = 2500, patterns: int = 256, support: int = 3, purity: float = 0.6,
) -> Linear:
    """The classifier, from at most `most` labelled documents that aren't held out.

    Words' beginnings, ends and whole words are counted by label in Spark; the `chosen` features that tell the classes apart
    best (by likelihood ratio) become the classifier's. Voters are groups of the lexicon's words, and groups of the first
    `patterns` features of which `purity` of the texts that have them are labelled toxic, dealt in turn: one votes toxic on a text with any of its group,
    clean on one with none, and abstains on a short text with none. Labels choose patterns and give the share of toxic
    texts; the label model is fitted to votes alone. What comes to the driver is bounded: most rows, each with some of the
    chosen features, in Arrow arrays.
    """
    away = held_out(id_col, divisor, left)
    train = stored(training_rows(docs, labels, id_col, text_col, label_col, away, most), "toxicity")
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    toxic, clean = sum(n for y, n in sizes.items() if y > 0), sum(n for y, n in sizes.items() if y <= 0)
    if not toxic or not clean:
        return Linear({}, 0.0 if not toxic + clean else float(np.log((toxic + 0.5) / (clean + 0.5))))
    both = F.col("toxic") + F.col("clean")
    share = both / (toxic + clean)

    def gain(n: Column, of: int) -> Column:
        """What a class adds to the log likelihood if the feature has a rate of its own in it."""
        rest = of - n
        return F.when(n > 0, n * F.log(n / (of * share))).otherwise(0.0) + F.when(rest > 0, rest * F.log(rest / (of * (1 - share)))).otherwise(0.0)

    counted = (
        train.select("label", "text").mapInArrow(_tally, "feature string, toxic long, clean long")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((both >= support) & (both <= 0.5 * (toxic + clean) + support))
        .withColumn("gain", F.round(gain(F.col("toxic"), toxic) + gain(F.col("clean"), clean), 6))
    )
    top = counted.orderBy(F.desc("gain"), "feature").limit(chosen).collect()
    names = sorted({r["feature"] for r in top} | {f"={w}" for w in LEXICON})
    place = {f: i for i, f in enumerate(names)}
    pattern = [place[r["feature"]] for r in top if r["toxic"] >= purity * (r["toxic"] + r["clean"])][:patterns]
    word = [place[f"={w}"] for w in LEXICON]
    groups = [word[i::_LEXICON_VOTERS] for i in range(_LEXICON_VOTERS)] + [pattern[i::_PATTERN_VOTERS] for i in range(min(_PATTERN_VOTERS, len(pattern)))]
    texts = train.select(F.col("id").cast("string").alias("id"), "text")
    rows = texts.mapInArrow(_presence(place), "id string, has array<smallint>, long boolean").toArrow().combine_chunks().sort_by("id")
    has = rows["has"].combine_chunks()
    lengths, cols = np.diff(has.offsets.to_numpy()), has.flatten().to_numpy().astype(np.int32)
    at = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    silent = np.where(rows["long"].to_numpy(), -1, 0)
    votes = np.repeat(silent[:, None], len(groups), axis=1).astype(np.int8)
    for j, group in enumerate(groups):
        votes[at[np.isin(cols, group)], j] = 1
    del rows, has
    share = min(max(toxic / (toxic + clean), 1e-3), 1 - 1e-3)
    q = fit_label_model(votes, share).posterior(votes)
    w, bias = fit_linear(at, cols, q, len(names))
    return Linear({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-3}, bias)


def _scores(model: Linear, text_at: int):
    names = list(model.weights)
    place, weights = {f: i for i, f in enumerate(names)}, np.array([model.weights[f] for f in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(place)
        for batch in batches:
            raw = [model.bias + sum(weights[i] for i in sorted(find(t.as_py()))) for t in batch.column(text_at)]
            score = 1 / (1 + np.exp(-np.clip(np.array(raw, float), -35, 35)))
            yield batch, score

    return run


def _only_scores(model: Linear):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in _scores(model, 1)(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["id", "score"])

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    divisor: int = 3, left: int = 1, threshold: float = 0.7, most: int = 20_000,
) -> DataFrame:
    """Per row of docs: id, held_out (crc32 of the id as text modulo divisor is left; a null id counts as 0), score (0 to
    1, higher: label 1 likelier) and predicted (1 if score >= threshold).

    Labels of held-out rows are never read into the fit; only a text's words go into its score. Null and empty texts score
    as texts without any feature. Labels of one kind only give all documents the same score, none at all 0.5. Rows that
    repeat an id are scored each for itself. Other columns are ignored. An empty table gives no rows.
    """
    model = fit_toxicity(docs, labels, id_col, text_col, label_col, divisor, left, most)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(_only_scores(model), f"id {kind}, score double").select(
        F.col("id").alias(id_col), held_out("id", divisor, left).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = 0.7, **params) -> DataFrame:
    """docs without the rows that score threshold or more; rows pass through their scan's tasks, nothing is shuffled."""
    model = fit_toxicity(docs, labels, text_col=text_col, **params)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, score in _scores(model, at)(batches):
            yield batch.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
