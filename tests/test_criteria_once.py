"""What queries write of the criteria that they start from."""

from __future__ import annotations

from sieveline.plans import catalog
from sieveline.sources import fixtures
from tests.test_curves import _stored_by


def test_both_splits_come_from_one_table_without_training_rows(spark, monkeypatch):
    made = _stored_by(monkeypatch, catalog)
    val, test = catalog._val_and_test(spark, "/root/testdata/sf0.001")
    assert [label for label, _ in made] == ["criteria"]
    assert {r["split"] for r in val.sparkSession.read.parquet(*{f.rsplit("/", 1)[0] for f in val.inputFiles()}).select("split").distinct().collect()} == {"val", "test"}


def test_predictions_write_only_what_they_read_of_lots(spark, monkeypatch):
    made = _stored_by(monkeypatch, fixtures)
    fixtures.predictions(spark, "/root/testdata/sf0.001")
    assert [(label, set(columns)) for label, columns in made] == [("lots", {"lot_id", *fixtures.SCORES})]
