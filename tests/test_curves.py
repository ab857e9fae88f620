"""Metrics of one sort against plain sums, and what is written for them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.operators import curves
from sieveline.plans import catalog


def _expected(own: pd.DataFrame, y: str, rates):
    own = own[own[y].notna()].sort_values(["score", "id"], ascending=[False, True], na_position="last")
    hit, n = own[y].to_numpy(float), len(own)
    group = own["score"].ne(own["score"].shift()).to_numpy() & ~(own["score"].isna() & own["score"].shift().isna()).to_numpy()
    group[0] = True
    ends = np.append(np.flatnonzero(group)[1:], n)
    tp = np.diff(np.append(0, hit.cumsum()[ends - 1]))
    area = (tp * hit.cumsum()[ends - 1] / ends).sum()
    gain, at = 1 / np.log2(np.arange(n) + 2), []
    for k in (max(math.ceil(n * r), 1) for r in rates):
        at.append((k, hit[:k].sum(), (hit * gain)[:k].sum(), gain[: min(k, int(hit.sum()))].sum()))
    return n, hit.sum(), area, at


@pytest.mark.parametrize("piece", [1, 50, 200_000])
def test_one_sort_equals_plain_sums_over_many_pieces(spark, piece):
    rng, rates = np.random.default_rng(4), (0.01, 0.3, 0.1)
    rows = pd.DataFrame({"id": range(600), "k": ["a"] * 250 + ["b"] * 350, "own": [0.25] * 250 + [0.5] * 350, "score": rng.integers(0, 9, 600) / 8, "y": rng.choice([0, 1, None], 600), "z": rng.choice([0, 1], 600), "v": rng.random(600)})
    rows.loc[::50, "score"] = None
    df = spark.createDataFrame([tuple(None if x is None or x != x else x for x in r) for r in rows.astype(object).itertuples(index=False)], "id long, k string, own double, score double, y int, z int, v double")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "37")
    try:
        found = curves.measured(df, ["k"], ["y", "z"], rates, own="own", value="v", id_col="id", piece=piece).collect()
    finally:
        spark.conf.set(conf, before)
    assert len(found) == 4
    for r in found:
        own = rows[rows["k"] == r["k"]]
        n, pos, area, at = _expected(own, ("y", "z")[r["label"]], [*rates, own["own"].iloc[0]])
        assert (r["rows"], r["pos"]) == (n, pos) and r["area"] == pytest.approx(area)
        for i, (k, hits, dcg, ideal) in enumerate(at):
            assert (r["limits"][i], r["hits"][i]) == (k, hits)
            assert r["dcg"][i] == pytest.approx(dcg) and r["ideal"][i] == pytest.approx(ideal)
        if r["label"] == 1:
            ranks = own["score"].fillna(-1).rank()
            assert r["spearman_value"] == pytest.approx(np.corrcoef(ranks, own["v"])[0, 1], abs=1e-8)


def _stored_by(monkeypatch, *modules):
    made = []
    for m in modules:
        was = m.stored
        monkeypatch.setattr(m, "stored", lambda df, label, was=was: (made.append((label, df.columns)), was(df, label))[1])
    return made


def test_several_labels_and_rates_take_one_sort(spark, monkeypatch):
    made = _stored_by(monkeypatch, curves)
    scores = spark.range(50).select(*[F.lit("x").alias(c) for c in catalog.CONFIG], F.col("id").alias("sample_row_id"), (F.col("id") / 50).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("y_cri_high"), (F.col("id") % 2).cast("int").alias("y_any_risk"))
    assert len(catalog.grid_rows(scores).collect()) == 1
    assert [label for label, _ in made] == ["pieces", "pieces-before", "measured"] and "sample_row_id" not in made[0][1]
