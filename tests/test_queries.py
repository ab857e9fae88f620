"""Every query of the catalog that SQL can express, against DuckDB over whole tables."""

from __future__ import annotations

from functools import cache

import pytest

import __spark_entry__
from sieveline.operators import resampling
from sieveline.plans import catalog
from sieveline.sources import fixtures
from sieveline.sources.shared import stored
from tests.oracle import same, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def tables_made_once():
    """Tables that many queries start from are made by the first that needs them."""
    with pytest.MonkeyPatch.context() as patch:
        lots = fixtures.lots
        patch.setattr(fixtures, "lots", cache(lambda spark, sf_dir: stored(lots(spark, sf_dir), "lots")))
        for name in ("criteria_rows", "_wide", "_grid", "_evaluated", "_resampled", "_front"):
            patch.setattr(catalog, name, cache(getattr(catalog, name)))
        yield


@pytest.fixture(scope="module")
def duck():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


def test_entry_is_the_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["sample_row_id", "score", "rank"]
    ranks = [r["rank"] for r in df.collect()]
    assert sorted(ranks) == list(range(1, 101))


def test_every_oracle_has_a_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_comparison_of_resamples(spark):
    rows = {(r["strategy"], r["metric"]): r for r in catalog.bootstrap_comparison(spark, SF).collect()}
    assert rows.keys() == {(s, m) for s in ("baseline", "consensus") for m in ("average_precision", "f1_at_rate")}
    boot = catalog._resampled(spark, SF, resampling.exact_repeats)[1].collect()
    at = {(r["strategy"], r["iteration"]): r for r in boot}
    assert len(at) == 3000
    for (strategy, metric), r in rows.items():
        gaps = [at[strategy, i][metric] - at["raw", i][metric] for i in range(1000)]
        better = sum(g > 0 for g in gaps) / 1000
        assert r["mean_difference"] == pytest.approx(sum(gaps) / 1000) and r["probability_better"] == pytest.approx(better)
        assert r["raw_p"] == pytest.approx(2 * min(better, 1 - better)) and r["raw_p"] <= r["holm"] <= 1
        assert r["favoured"] == (strategy if sum(gaps) > 0 else "raw") and min(gaps) <= r["ci_low"] <= r["ci_high"] <= max(gaps)
        assert (r["advantage"], r["advantage_low"], r["advantage_high"]) == (-r["mean_difference"], -r["ci_high"], -r["ci_low"])
