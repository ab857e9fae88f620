"""Operators against plain Python on a few rows, and properties that hold for any rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sieveline.functions import cleaning
from sieveline.operators import evolve, learn, metrics, ordering, pareto, ranking, statistics, validation
from sieveline.operators.ordering import with_place
from sieveline.sources import readers, writers

COLUMNS = ("a", "b", "c")


def _rows(spark, n=40, seed=3):
    x = np.random.default_rng(seed).random((n, 3)).round(6)
    return x, spark.createDataFrame([(i, int(i % 3 == 0), *map(float, r)) for i, r in enumerate(x)], "sample_row_id long, y_cri_high int, a double, b double, c double")


@pytest.mark.parametrize("method", sorted(ranking.SCORERS))
def test_scorers_equal_numpy(spark, method):
    x, df = _rows(spark)
    norm = ranking.normalized(df, df, ["minmax"], COLUMNS)
    weights = ranking.weights(norm, ["normalization"], ["equal"], COLUMNS)
    got = {r["sample_row_id"]: r["score"] for r in ranking.scored(norm, weights, ["normalization"], [method], COLUMNS).collect()}
    unit = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    raw = evolve.score(unit, np.full(3, 1 / 3), method)
    want = (raw - raw.min()) / (raw.max() - raw.min())
    assert np.allclose([got[i] for i in range(len(x))], want, atol=2e-9)


def test_weights_sum_to_one_and_scale_free_normalisations_agree(spark):
    _, df = _rows(spark)
    norm = ranking.normalized(df, df, columns=COLUMNS)
    for r in ranking.weights(norm, ["normalization"], columns=COLUMNS).collect():
        assert math.isclose(r["a"] + r["b"] + r["c"], 1.0, abs_tol=1e-9)
    by = {}
    for r in norm.collect():
        by.setdefault(r["sample_row_id"], {})[r["normalization"]] = [r[c] for c in COLUMNS]
    assert all(np.allclose(v["minmax"], v["vector"]) and np.allclose(v["minmax"], v["sum"]) for v in by.values())


def test_places_have_ties_by_id_and_no_gaps(spark):
    df = spark.createDataFrame([(i, round((i % 5) / 5, 3)) for i in range(23)], "id long, s double")
    rows = sorted(with_place(df, [], "s", "id").collect(), key=lambda r: r["_place"])
    assert [r["_place"] for r in rows] == list(range(1, 24))
    assert [(r["s"], r["id"]) for r in rows] == sorted(((r["s"], r["id"]) for r in rows), key=lambda t: (-t[0], t[1]))
    assert {r["_rows"] for r in rows} == {23}


def _long(spark, scores, labels):
    return spark.createDataFrame([("k", i, y, s) for i, (s, y) in enumerate(zip(scores, labels, strict=True))], "k string, sample_row_id long, y int, score double")


def test_average_precision_and_auc_by_hand(spark):
    long = _long(spark, [0.9, 0.8, 0.8, 0.3, 0.1], [1, 1, 0, 0, None])
    assert metrics.average_precision(long, ["k"]).first()["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3, abs=1e-9)
    assert metrics.roc_auc(long, ["k"]).first()["roc_auc"] == pytest.approx(3.5 / 4)
    one = _long(spark, [0.2, 0.4], [0, 0])
    assert metrics.average_precision(one, ["k"]).first()["average_precision"] == 0.0
    assert metrics.roc_auc(one, ["k"]).first()["roc_auc"] is None


def test_top_sizes_are_ceilings_of_doubles(spark):
    table = metrics.threshold_table(_long(spark, [i / 100 for i in range(100)], [1] * 100), ["k"], [0.07])
    assert table.first()["selected"] == 8  # ceil(100 * 0.07) in IEEE doubles


def test_front_has_no_dominated_solution(spark):
    x = np.random.default_rng(5).integers(0, 6, (60, 6)) / 5
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "seq long, " + ", ".join(f"{o} double" for o in pareto.OBJECTIVES))
    dominated = {i for i in range(60) for j in range(60) if (x[j] <= x[i]).all() and (x[j] < x[i]).any()}
    assert {r["seq"] for r in pareto.front(df).select("seq").collect()} == set(range(60)) - dominated


def test_holm_is_monotone_and_at_least_raw(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "comparison string, p double")
    got = {r["comparison"]: r["holm"] for r in statistics.holm(df, "p").collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5})


def test_bca_interval_covers_the_observed_value():
    x = np.random.default_rng(1).normal(0.3, 0.1, 800)
    low, high = statistics.bca_interval(x, 0.3)
    assert low < 0.3 < high and 0.3 < high - low < 0.5


def test_best_cut_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    s, y = rng.random(200).round(9), rng.integers(0, 2, 200)
    want = max(((2 * y[s >= c].sum() / ((s >= c).sum() + y.sum()), -c) for c in np.arange(1, 1000) / 1000 if (s >= c).any()))
    got = validation.best_cut(_long(spark, s.tolist(), y.tolist()), ["k"]).first()
    assert (got["f1"], got["cut"]) == pytest.approx((want[0], -want[1]), abs=1e-8)


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(6)
    x = np.stack([rng.random(3000), rng.integers(0, 5, 3000), np.exp(rng.normal(0, 9, 3000)), np.full(3000, 7.0)], axis=1)
    df = spark.createDataFrame([(*map(float, r), None) for r in x] + [(None,) * 5], "a double, b double, c double, d double, e double")
    shares = (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)
    for bins, few in ((1024, 4096), (4, 3)):
        got = ordering.percentiles(df, list("abcde"), shares, bins, few)
        assert got["e"] == [None] * 6
        for j, c in enumerate("abcd"):
            assert got[c] == pytest.approx(np.quantile(x[:, j], shares), rel=1e-12)


def test_percentiles_end_on_any_distribution(spark, monkeypatch):
    """A million log-normal values over 300 decades, both infinities, NaN, ties, constants and two values only: a sketch and a
    counting pass, and one pass more where brackets are large."""
    rng = np.random.default_rng(9)
    n = 1_000_000
    x = {"wide": np.exp(rng.normal(0, 110, n).clip(-340, 340)), "ends": rng.normal(size=n), "same": np.full(n, -3.0), "ties": np.where(rng.random(n) < 0.7, 0.0, rng.random(n)), "two": (rng.random(n) < 0.5) * 1e300}
    x["ends"][:1000], x["ends"][1000:3000], x["ends"][3000:9000] = np.inf, -np.inf, np.nan
    assert np.log10(x["wide"].max() / x["wide"].min()) > 290
    df = spark.createDataFrame(pd.DataFrame(x)).repartition(4).persist()
    shares = (0.0, 0.001, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)
    passes = []
    for f in ("_counted", "_narrowed"):
        monkeypatch.setattr(ordering, f, lambda *a, f=getattr(ordering, f), n=f: (passes.append(n), f(*a))[1])
    for few, most in ((200_000, 1), (2_000, 2)):
        passes.clear()
        got = ordering.percentiles(df, [*x], shares, few=few)
        assert len(passes) <= most, passes
        for c, v in x.items():
            own = np.sort(v[~np.isnan(v)])
            at = [p * (len(own) - 1) for p in shares]
            want = [a if (a := own[int(np.floor(i))]) == (b := own[int(np.ceil(i))]) else (np.ceil(i) - i) * a + (i - np.floor(i)) * b for i in at]
            assert got[c] == pytest.approx(want, rel=1e-12), c
    df.unpersist()


def test_percentiles_of_few_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(nan, inf, nan, 1), (1.0, -inf, nan, None), (3.0, None, None, 4), (None, inf, nan, 1)], "a double, b double, c double, d int")
    got = ordering.percentiles(df, list("abcd"), (0.0, 0.5, 1.0))
    assert got == {"a": [1.0, 2.0, 3.0], "b": [-inf, inf, inf], "c": [None] * 3, "d": [1.0, 1.0, 4.0]}
    between = ordering.percentiles(df, ["b"], (0.25,))["b"][0]
    assert np.isnan(between)
    assert ordering.percentiles(df.where("false"), ["a"], (0.5,)) == {"a": [None]}


def _range_sizes(table, keys):
    return [r["count"] for r in table.groupBy("_range").count().collect()]


@pytest.mark.parametrize("scores", [lambda rng, n: np.where(rng.random(n) < 0.99, rng.random(n) / 1000, rng.random(n)), lambda rng, n: np.where(rng.random(n) < 0.5, 0.0, rng.random(n)), lambda rng, n: np.exp(rng.normal(0, 30, n))])
def test_ranges_are_of_equal_depth(spark, scores):
    """Scores crowded near 0, half of them equal, and money over many decades."""
    n = 40_000
    s = scores(np.random.default_rng(5), n)
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "id": np.arange(n), "s": s}))
    sizes = _range_sizes(ordering.dealt(df, ["k", F.desc("s"), "id"], 16, "t"), ["k"])
    assert len(sizes) == 16 and max(sizes) <= 2 * n / 16, sizes
    got = {r["id"]: r["_place"] for r in with_place(df, ["k"], "s", "id", buckets=16).select("id", "_place").collect()}
    order = np.lexsort((np.arange(n), -s))
    assert [got[i] for i in order.tolist()] == list(range(1, n + 1))


def test_logistic_models_equal_a_solver(spark):
    rng = np.random.default_rng(8)
    n = 500
    x = rng.random((n, 3)) * [1, 5, 100]
    y = (rng.random(n) < 1 / (1 + np.exp(-(3 * x[:, 0] - x[:, 1] + 1)))).astype(float)
    df = spark.createDataFrame([(i, *r, int(t) if i % 9 else None) for i, (r, t) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "sample_row_id long, a double, b double, c double, y int")
    models = {"a+b": ["a", "b"], "c": ["c"], "a+b+c": ["a", "b", "c"]}
    got = learn.logistic_models(df, models, "y", c=0.5)
    known = np.arange(n) % 9 > 0
    for m, names in models.items():
        z = np.column_stack([np.ones(known.sum()), *[x[known, "abc".index(c)] for c in names]])
        w, ridge = np.zeros(len(names) + 1), np.diag([0.0, *[2.0] * len(names)])
        for _ in range(100):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y[known]) + ridge @ w)
        assert got[m] == pytest.approx(w, abs=1e-8)
    assert learn.reestimated_models(df, df, models, "y").count() == 3 * n


@pytest.mark.parametrize(("kind", "n", "window"), [("plane", 30_000, 200), ("cloud", 100_000, 4096), ("ties", 5000, 16), ("same", 300, 8)])
def test_front_equals_brute_force(spark, kind, n, window):
    """Most solutions on the front; few; many equal objectives; all equal."""
    rng = np.random.default_rng(4)
    x = {"plane": lambda: (lambda d: np.column_stack([d[:, :5], d[:, 5] + (rng.random(n) < 0.97) * 3]))(rng.dirichlet(np.ones(6), n)), "cloud": lambda: rng.random((n, 6)), "ties": lambda: rng.integers(0, 4, (n, 6)).astype(float), "same": lambda: np.ones((n, 6))}[kind]()
    df = spark.createDataFrame(pd.DataFrame({"seq": np.arange(n), **{f"o{k + 1}": x[:, k] for k in range(6)}})).repartition(4)
    got = {r["seq"] for r in pareto.front(df, window=window).select("seq").collect()}
    order, kept, want = np.argsort(x.sum(axis=1), kind="stable"), np.zeros((0, 6)), set()
    for i in order.tolist():
        if not ((kept <= x[i]).all(axis=1) & (kept < x[i]).any(axis=1)).any():
            kept = np.vstack([kept, x[i]])
            want.add(i)
    want = {i for i in want if not ((kept <= x[i]).all(axis=1) & (kept < x[i]).any(axis=1)).any()}
    assert got == want and len(want) > 0


def test_mid_ranks_of_many_columns(spark):
    rng = np.random.default_rng(6)
    n = 6000
    x = {"a": np.where(rng.random(n) < 0.5, 0.0, rng.random(n).round(2)), "b": rng.random(n), "c": np.full(n, 2.0), "d": np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 4, n))}
    pdf = pd.DataFrame({"k": np.arange(n) % 2, "id": np.arange(n) // 2, **x})
    want = pdf.groupby("k")[list(x)].rank()
    df = spark.createDataFrame(pdf).withColumn("d", F.when(~F.isnan("d"), F.col("d")))
    rows = ordering.mid_ranked(df.repartition(7), list(x), "id", ["k"]).collect()
    assert len(rows) == n
    for r in rows:
        own = want.loc[2 * r["id"] + r["k"]]
        assert [r[c] for c in x] == [None if np.isnan(own[c]) else own[c] for c in x]


def test_running_sums_equal_numpy(spark):
    rng = np.random.default_rng(7)
    v = rng.choice([-0.5, 0.0, 0.25, 0.2501, 0.9, 1.0, 1.7], 400)
    df = spark.createDataFrame([(f"k{i % 2}", float(x)) for i, x in enumerate(v)], "k string, v double")
    for down in (True, False):
        rows = ordering.running(df, ["k"], "v", {"n": F.count(F.lit(1))}, down, buckets=16).collect()
        assert len(rows) == 14
        for r in rows:
            own = v[int(r["k"][1]) :: 2]
            assert (r["n"], r["c_n"]) == ((own == r["v"]).sum(), (own >= r["v"] if down else own <= r["v"]).sum())


def test_empty_tables_give_no_rows(spark):
    empty = spark.createDataFrame([], "k string, sample_row_id long, y int, score double")
    for df in (metrics.average_precision(empty, ["k"]), metrics.roc_auc(empty, ["k"]), metrics.threshold_table(empty, ["k"]), validation.best_cut(empty, ["k"])):
        assert df.count() == 0


def test_csv_round_trip_and_markdown(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("﻿column,role,type,used_as_feature\na,feature,numeric,True\nb,target,,false\n", encoding="utf-8")
    assert readers.csv_header(spark, str(path))[0] == "column"
    manifest = readers.manifest(spark, str(path))
    assert [(r["column"], r["used_as_feature"]) for r in manifest.orderBy("column").collect()] == [("a", True), ("b", False)]
    assert readers.line_count(spark, str(path)) == 2
    added = spark.createDataFrame([("b", "target", "numeric", True), ("c", "feature", "numeric", True)], "column string, role string, type string, used_as_feature boolean")
    merged = {r["column"]: r["used_as_feature"] for r in writers.upsert_manifest(manifest, added).collect()}
    assert merged == {"a": True, "b": True, "c": True}
    assert writers.markdown_rows(spark.createDataFrame([("x|y", None)], "p string, q string")) == "| p | q |\n| --- | --- |\n| x\\|y |  |\n"


def test_search_returns_an_archive_with_the_size_asked_for(spark):
    x, df = _rows(spark, 60)
    assert len(evolve.decode(np.linspace(0, 1, evolve.GENES))[0]) == len(evolve.CRITERIA)
    assert evolve.decode(np.zeros(evolve.GENES))[0].sum() == pytest.approx(1)


def test_objectives_of_a_search_equal_the_metrics(spark):
    rng = np.random.default_rng(9)
    s, y, a = rng.random(50).round(6), rng.integers(0, 2, 50).astype(float), rng.integers(0, 2, 50).astype(float)
    y[:5] = np.nan
    got = evolve.objectives(s, y, a, 0.1, 4)
    long = _long(spark, s.tolist(), [None if math.isnan(v) else int(v) for v in y]).withColumn("rate", F.lit(0.1))
    own = metrics.at_own_rate(long, ["k"], "rate").first()
    other = metrics.at_own_rate(_long(spark, s.tolist(), a.astype(int).tolist()).withColumn("rate", F.lit(0.1)), ["k"], "rate").first()
    ap = metrics.average_precision(long, ["k"]).first()["average_precision"]
    assert got == pytest.approx([1 - ap, 1 - own["ndcg"], 1 - own["f1"], 1 - other["f1"], 0.1, 4 / len(evolve.CRITERIA)], abs=1e-8)


def test_decoded_configurations_keep_what_takes_part(spark):
    rows = [(1, True, False, True, 2.0, 5.0, 6.0), (2, False, False, False, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "seq long, " + ", ".join(f"sel_{c} boolean" for c in COLUMNS) + ", " + ", ".join(f"weight_{c} double" for c in COLUMNS))
    got = {r["seq"]: r for r in pareto.decoded(df, COLUMNS).collect()}
    assert (got[1]["a"], got[1]["b"], got[1]["c"], got[1]["criteria_share"]) == pytest.approx((0.25, 0.0, 0.75, 2 / 3))
    assert (got[2]["a"], got[2]["b"], got[2]["c"]) == (0.0, 0.0, 0.0)


def test_hypervolume_of_a_box():
    assert evolve.hypervolume(np.array([[0.55, 0.0], [1.0, 0.0]]), 1.1, 40_000) == pytest.approx(0.5, abs=0.01)
    assert evolve.hypervolume(np.array([[0.0, 0.0]]), 1.0, 1000) == 1.0


def test_dirichlet_draws_choose_solutions(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, rng.random(6))) for i in range(12)], "seq long, " + ", ".join(f"{o} double" for o in pareto.OBJECTIVES))
    rows = statistics.dirichlet_choices(df, pareto.TARGET_WEIGHTS, draws=60).collect()
    assert sum(r["times"] for r in rows) == 60 and {r["seq"] for r in rows} <= set(range(12))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, statistics.dirichlet_choices(df, pareto.TARGET_WEIGHTS, draws=60).collect()))


def test_small_expressions(spark):
    row = spark.createDataFrame([(0.0, "a_b  c_d")], "x double, t string").select(cleaning.sigmoid("x").alias("s"), cleaning.caption("t").alias("c")).first()
    assert row["s"] == 0.5 and row["c"] == "a b c d"


def test_importance_and_spread(spark):
    class Trees:
        class featureImportances:  # noqa: N801
            @staticmethod
            def toArray():  # noqa: N802
                return np.array([1.0, 3.0, 0.0])

    rows = learn.importance(Trees, ["a", "b", "c"], spark, 2).collect()
    assert [(r["feature"], r["importance"]) for r in rows] == [("b", 0.75), ("a", 0.25)]
    grid = spark.createDataFrame([(0.1,), (0.2,), (0.4,)], "val_ap double")
    assert learn.grid_spread(grid).first().asDict() == {"configurations": 3, "best": 0.4, "median": 0.2, "range": 0.3, "iqr": 0.15}


def test_writers_and_sizes(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    writers.write_table(df, f"{tmp_path}/t")
    writers.write_table(df.where("a = 1"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1
    assert [r["size_mb"] for r in readers.sizes_mb(spark, f"{tmp_path}/t").where("file LIKE 'part-%'").collect()][:1] == [0.0]
    writers.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, readers.csv_typed(spark, f"{tmp_path}/c", "a int, b string").collect())) == [(1, "x"), (2, "y")]
    writers.write_report(df, f"{tmp_path}/r")
    writers.write_summary(spark, {"rows": 2}, f"{tmp_path}/s")
    assert "rows" in writers.text_report("Title", {"rows": 2}) and spark.read.text(f"{tmp_path}/s").count() > 0


def test_pca_shares_equal_eigenvalues(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 3)) @ np.array([[1.0, 0.5, 0.0], [0.0, 2.0, 0.3], [0.0, 0.0, 0.1]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    rows = sorted(map(tuple, learn.pca_shares(df, COLUMNS).collect()))
    want = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1] / 3
    assert [r[1] for r in rows] == pytest.approx(want, abs=1e-8) and rows[-1][2] == pytest.approx(1)


def test_a_candidate_that_fails_is_a_row(spark, monkeypatch):
    def broken(y):
        raise ValueError("no such model")

    monkeypatch.setitem(learn.CANDIDATES, "broken", broken)
    rng = np.random.default_rng(12)
    rows = [(i, int(x + rng.normal() * 0.5 > 0), float(x), "k" if x > 0 else None) for i, x in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "lot_id long, y int, x double, c string")
    train, val = learn.prepared(df.where("lot_id < 80"), [df.where("lot_id >= 80")], ["x"], ["c"])
    table, models = learn.candidate_metrics(train, val, "y", ["broken", "logistic"])
    got = {r["model"]: r for r in table.collect()}
    assert got["broken"]["error"] == "no such model" and got["broken"]["cal_ap"] is None and models.keys() == {"logistic"}
    assert got["logistic"]["error"] is None and got["logistic"]["raw_auc"] > 0.8 and table.first()["model"] == "logistic"
    scores = learn.predicted(models["logistic"], val, "p").select("p").collect()
    assert len(scores) == 40 and all(0 <= r["p"] <= 1 for r in scores)
