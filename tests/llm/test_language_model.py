"""The n-gram model against plain dictionaries of counts; the filter's promises; odd texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import language_model as lm
from sieveline.llm import queries
from sieveline.llm.bloom import CountFilter, Levels
from sieveline.llm.labels import held_out
from tests.llm.fixtures import LONG, SF, no_documents, odd_documents, rows_of

FIELDS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def plain(texts, trained, order, growth):
    """Counts in dictionaries, cut to levels, without a filter: what the model is but for false hits."""
    levels = Levels(growth)
    middle = lambda n: float(levels.middles[levels.of(np.array([n]))[0]])
    counts = [Counter() for _ in range(order)]
    padded = lambda text: ["<"] * (order - 1) + words(text)
    for text in trained:
        own = padded(text)
        for k in range(order):
            counts[k].update(tuple(own[i - k : i + 1]) for i in range(order - 1, len(own)))
    n, v = sum(counts[0].values()), len(counts[0])
    powers = [0.0]
    for k in range(1, order):
        each = Counter(middle(c) for c in counts[k - 1].values())
        low, high = 0.0, 1.0
        for _ in range(50):
            at = (low + high) / 2
            low, high = (at, high) if sum(m * c**at for c, m in each.items()) < len(counts[k]) else (low, at)
        powers.append(low)
    out = []
    for text in texts:
        own, base, score, known = padded(text), 0.0, 0.0, 0
        found = {}
        for i in range(order - 1, len(own)):
            c = counts[0][(own[i],)]
            known += c > 0
            p = (c + 1) / (n + v + 1)
            base += math.log10(p)
            found[i, 0] = c
            for k in range(1, order):
                context = found[i - 1, k - 1] if i > order - 1 else len(trained)
                found[i, k] = min(middle(counts[k][tuple(own[i - k : i + 1])]), context, found[i, k - 1])
                if context > 0:
                    give = context ** powers[k]
                    p = (found[i, k] + give * p) / (context + give)
            score += math.log10(p)
        out.append((len(own) - order + 1, known, n, base, score))
    return out


def close(got, want):
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], abs=1e-6, rel=1e-9)


def test_query_equals_plain_counts(spark):
    """Tokens and base exactly; the model's score but for false hits of the filter, a few in a hundred unseen pairs, which only
    make a text likelier."""
    docs = rows_of("documents")
    away = [crc32(str(d["doc_id"]).encode()) % 7 == 2 for d in docs]
    want = plain([d["text"] for d in docs], [d["text"] for d, a in zip(docs, away, strict=True) if not a], 2, 1.3)
    got = {r["doc_id"]: r for r in queries.op12_language_model(spark, SF).collect()}
    assert len(got) == len(docs)
    gained = []
    for d, a, w in zip(docs, away, want, strict=True):
        r = got[d["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (a, *w[:3])
        assert r["base_score"] == pytest.approx(w[3], rel=1e-9, abs=1e-6) and w[4] - 1e-6 <= r["score"] <= 0
        gained.append((r["score"] - w[4]) / -w[4])
    assert max(gained) < 0.01 and any(away)
    unseen = [got[d["doc_id"]] for d, a in zip(docs, away, strict=True) if a]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders_windows_and_answers_by_parts(spark, monkeypatch, order):
    """Scores by tables at every task, by answers from the parts, and in windows of a few tokens are the same, and those of dictionaries."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"W{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 50) for _ in range(120)] + [None, "", " \t"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    away = F.col("doc_id") % 5 == 2
    want = plain(texts, [t for i, t in enumerate(texts) if i % 5 != 2], order, 1.3)
    monkeypatch.setattr(lm, "_PART", 500)
    monkeypatch.setattr(lm, "_MERGED", 50)
    monkeypatch.setattr(lm, "_GATHERED", 300)
    for most, window in ((1 << 28, 1 << 20), (0, 1 << 20), (1 << 28, 7), (0, 7)):
        monkeypatch.setattr(lm, "_WINDOW", window)
        got = sorted(lm.score_texts(df, away, order=order, hashes=30, most_bytes=most).collect())
        assert all(r["held_out"] == (r["doc_id"] % 5 == 2) for r in got)
        close([tuple(r)[2:] for r in got], want)


def test_levels_and_filter():
    levels = Levels(1.3)
    assert levels.starts[:6].tolist() == [1, 2, 3, 4, 5, 6] and levels.starts[-1] > 1 << 61
    assert levels.of(np.array([0, 1, 2, 1 << 40])).tolist()[:3] == [0, 1, 2]
    counts = np.arange(1, 100_000)
    assert np.abs(levels.middles[levels.of(counts)] / counts - 1).max() < 0.16
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 60_000).astype(np.uint64)
    own = levels.of(rng.zipf(1.5, len(keys)).clip(max=10**9))
    held = CountFilter.of(keys, own, 6)
    found = held.levels(keys)
    assert (found >= own).all() and (found > own).mean() < 0.02
    assert 13 * own.sum() < 64 * len(held.words) < 15 * own.sum()
    assert (held.levels(rng.integers(0, 1 << 63, 100_000).astype(np.uint64)) > 0).mean() < 0.012


def test_words_are_told_apart():
    texts = ["a b  ab\tA", None, "", "é\x0bÉ", "x" * 7 + " " + "x" * 8 + " " + "x" * 9 + " " + "x" * 300 + " " + "x" * 301, "a\x00 a"]
    h, n = lm.word_hashes(texts)
    assert n.tolist() == [4, 0, 0, 2, 5, 2]
    own = h.tolist()
    assert own[0] == own[3] == own[12] and len(set(own)) == 11  # É isn't lower-cased
    long = [LONG, "B " * 1000]
    assert lm.word_hashes(long)[1].tolist() == [200_000, 1000]


def test_probabilities_add_up(spark):
    """Over all words and one unknown, after a context that is known: 1 but for what levels round."""
    texts = ["a b a c a b", "b a c", "c a a b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trained = lm.train(df.select("text"), 2, 1.3, 30)
    each = [f"a {w}" for w in ("a", "b", "c")]
    rows = spark.createDataFrame([(t, t) for t in ["a", *each, "a zzz"]], "id string, text string")
    held = {(r["kind"], r["part"]): lm._table_of(r, 30) for r in trained.tables.collect()}
    model = lm.Model(**{**vars(trained.model), "tables": held})
    tokens, n = lm.tokens_of([r["text"] for r in rows.collect()])
    p = 10 ** lm.log_probabilities(tokens, lm.places(n), model, model.look)[1]
    after_a = p[1:2].tolist() + [p[i] for i in (3, 6, 9, 12)]  # the end of "a", then the second words
    assert sum(after_a) == pytest.approx(1, abs=1e-9)


def test_odd_rows(spark):
    rows = lm.score_texts(odd_documents(spark), held_out("doc_id", 7, 2)).collect()
    assert len(rows) == 11 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[6]["n_tokens"] == 200_001
    assert not by[None]["held_out"] and by[3]["score"] == by[4]["score"]
    assert lm.score_texts(no_documents(spark), held_out("doc_id", 7, 2)).count() == 0
    alone = lm.score_texts(odd_documents(spark), F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in alone} == {(0, 0, 0.0, 0.0)}
    assert lm.score_texts(odd_documents(spark), F.lit(True), most_bytes=-1).count() == 11


@pytest.mark.parametrize("order", [1, 2, 3])
def test_passes_over_few_tables_at_a_time(spark, monkeypatch, order):
    """Tables that a task doesn't hold at once are dealt to passes; scores are the same to the last digit."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(0, 80)) % 200) for _ in range(150)] + [None, "", " \t"]
    df = spark.createDataFrame([(i % 140, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm, "_PART", 2000)
    trained = lm.train(df.select("text"), order)
    rows = df.select(F.col("doc_id").alias("id"), "text")
    assert len(lm._passes(trained)) == 1
    want = sorted(map(tuple, lm.score_rows(rows, trained).collect()))
    monkeypatch.setattr(lm, "_WINDOW", 50)
    monkeypatch.setattr(lm, "_TOGETHER", 400)
    held = trained.bytes // 4 if order > 1 else 1
    monkeypatch.setattr(lm, "_HELD", held)
    passes = lm._passes(trained)
    assert len(passes) == 1 if order == 1 else len(passes) > 2
    dealt = [trained.tables.where(p).select("kind", "part", F.length("data").alias("size")).collect() for p in passes]
    assert sorted((r["kind"], r["part"]) for own in dealt for r in own) == sorted((r["kind"], r["part"]) for r in trained.tables.collect())
    assert all(len(own) == 1 or sum(r["size"] for r in own) <= held for own in dealt[:-1]) and all(r["kind"] > 1 for own in dealt[:-1] for r in own)
    assert sorted(map(tuple, lm.score_rows(rows, trained).collect())) == want
