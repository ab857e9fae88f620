"""Rare sources are paid their targets."""

from __future__ import annotations

from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import labels, mixing, queries
from tests.oracle import bag

RARE = {"c1": 200, "c2": 300, "c3": 4_000, "c4": 25_000, "c5": 60_000, "c6": 100_000}


def test_plan_pays_each_source_its_own_target(spark):
    sizes = {"a": 12_000_000, "b": 20_000_000 - 12_000_000 - sum(RARE.values()), **RARE}
    cells = []
    for name, size in sizes.items():
        cuts = [size * (k * k if name in ("c3", "c5") else 16 * k) // 256 for k in range(17)]  # some even, some not
        cells += [(f"s{name}", f"{k:x}", cuts[k + 1] - cuts[k]) for k in range(16)]
    taken, target = defaultdict(float), {}
    for r in mixing.source_plan(spark.createDataFrame(cells, "skey string, shard string, size long"), (5, 2, 1), 3, 20_000).collect():
        assert 0 <= r["quota"] <= 3 * r["n"]
        taken[r["skey"]] += r["quota"] * r["cell_size"] / max(r["n"], 1)
        target[r["skey"]] = r["target"]
    assert len(target) == len(sizes)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in target), {s: (taken[s], target[s]) for s in target}


def test_documents_of_rare_sources_stay(spark):
    rows = [(k, " ".join(f"w{k}.{i}" for i in range(400)), "ab"[k % 2]) for k in range(100)]
    rows += [(1000 + k, " ".join(["x"] * (3 + k)), f"r{k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source, taken, target = {r[0]: r[2] for r in rows}, defaultdict(int), {}
    for r in mixing.mix_sources(docs, blocks=200).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target if s[0] == "r") and len(target) == 8


def quotients(votes, seats, limit):
    """Seats one after the other to the highest quotient left, ties to the first."""
    got = [0] * len(votes)
    for _ in range(min(seats, sum(limit))):
        i = max((i for i in range(len(votes)) if got[i] < limit[i]), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def test_seats_equal_quotients_one_by_one(spark):
    rng, rows, want = np.random.default_rng(1), [], {}
    for g in range(40):
        n = int(rng.integers(1, 20))
        votes = [float(x) for x in rng.choice([rng.pareto(0.5, n) * 10, rng.integers(0, 6, n)])]
        seats = int(rng.choice([0, 5, 100, 3000]))
        limit = [max(int(rng.choice([v * seats / max(sum(votes), 1) + rng.integers(0, 24), seats + 1])), int(v > 0)) for v in votes]
        rows += [(g, f"{g:02d}-{i:02d}", v, seats, m) for i, (v, m) in enumerate(zip(votes, limit, strict=True))]
        want |= {f"{g:02d}-{i:02d}": q for i, q in enumerate(quotients(votes, seats, limit))}
    df = spark.createDataFrame(rows, "g int, name string, v double, s long, m long")
    assert {r["name"]: r["quota"] for r in mixing._seats(df, "v", "s", F.col("m"), ["g"], ["name"]).collect()} == want


@pytest.mark.parametrize("sizes", [[(200, 40, "a"), (4, 3, "r")], [(60, 400, "a"), (60, 300, "b"), (3, 200, "c"), (1, 1, "d"), (5, 0, "e"), (2, 90, None)], [(1, 1, "a")]])
def test_query_and_sql_agree_on_rare_sources(spark, sizes):
    rows, k = [], 0
    for count, words, source in sizes:
        for i in range(count):
            own = source if source != "r" else f"r{i}"
            rows.append((k, " ".join(f"w{k}" for _ in range(words * (1 + k % 3) if words > 3 else words)), own))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    found = con.execute(queries.ORACLES["op3_mix_sources"])
    names = [c[0] for c in found.description]
    mine, theirs = bag(got.columns, got.collect()), bag(names, found.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])


def test_training_rows_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(k // 500, f"text {k}") for k in range(1500)], "doc_id long, text string")
    known = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0)], "doc_id long, toxic int")
    for most in (1, 700, 5000):
        rows = labels.training_rows(docs, known, "doc_id", "text", "toxic", labels.held_out("doc_id", 3, 7), most).collect()
        assert len(rows) == min(most, 1500) and len({r["text"] for r in rows}) == len(rows)
        assert rows == labels.training_rows(docs.repartition(3), known, "doc_id", "text", "toxic", labels.held_out("doc_id", 3, 7), most).collect()
