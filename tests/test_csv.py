"""CSV files against Python's csv module, from many splits."""

from __future__ import annotations

import csv
import io
import random
from collections import Counter

import pytest

from sieveline.sources import readers


def text_of(rows, seed, ends="\n"):
    """Fields quoted where they must be, and at times where they needn't."""
    rng = random.Random(seed)
    field = lambda x: '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\r\n') or rng.random() < 0.2 else x
    return "".join(",".join(map(field, r)) + ends for r in rows)


def read(spark, tmp_path, files, split):
    for i, text in enumerate(files):
        (tmp_path / f"part-{i}.csv").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = readers.csv_strings(spark, str(tmp_path))
        return df.columns, [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize(("split", "ends"), [("900b", "\n"), ("2000b", "\r\n"), ("1g", "\n")])
def test_records_equal_the_csv_module(spark, tmp_path, split, ends):
    rng = random.Random(3)
    pieces = ["a", "b c", ",", '"', "\n", "\r\n", "ü", "", "x" * 30, "\n\n", '"\n"', "'", "\\", '\\"', " "]
    rows = [["id", "first, name", 'the "text"']] + [[str(i), *("".join(rng.choices(pieces, k=rng.randint(0, 6))) for _ in range(2))] for i in range(150)]
    text = text_of(rows, 1, ends)
    files = ["﻿" + text, text_of(rows[:1] + rows[5:9], 2, ends)]
    columns, got = read(spark, tmp_path, files, split)
    assert columns == rows[0]
    want = Counter(tuple(c or None for c in r) for f in files for r in [*csv.reader(io.StringIO(f.removeprefix("﻿"), newline=""))][1:])
    assert Counter(got) == want, (list((Counter(got) - want).items())[:3], list((want - Counter(got)).items())[:3])


def test_ragged_rows_blank_lines_and_an_open_quote(spark, tmp_path):
    text = 'a,b\n1\n\n2,x,more\n3,""\n4,"never closed\nso it goes on\n'
    assert read(spark, tmp_path, [text], "8b")[1][:3] != [] and sorted(read(spark, tmp_path, [text], "8b")[1])[:3] == [("1", None), ("2", "x"), ("3", None)]
    (tmp_path / "part-0.csv").write_text("")
    assert readers.csv_header(spark, str(tmp_path)) == []


def test_typed(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,v,s\n1,2.5,"a,b"\n2,oops,\n')
    rows = sorted(readers.csv_typed(spark, str(tmp_path), "k int, v double, s string").collect(), key=lambda r: r["k"])
    assert [tuple(r) for r in rows] == [(1, 2.5, "a,b"), (2, None, None)]
