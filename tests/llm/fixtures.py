"""Small tables with everything that may be odd about a row."""

from __future__ import annotations

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHING = ("id", "fp", "mask", "value", "key", "size", "taken", "copies", "pieces", "target", "shard", "slot", "line", "drop", "score", "label", "hub", "rid", "component", "toxic", "held_out", "start", "end", "bucket", "block")
DOCS = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in CLASHING)
LONG = "one two three four five six seven eight nine ten\n" * 20_000


def odd_documents(spark):
    extra = ("x",) * len(CLASHING)
    texts = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (2, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, "the quick brown fox jumps over the lazy dog", "en", "a"), (3, "", None, None), (4, None, "en", "a"), (5, " \t\n", "en", "b"), (6, LONG, "en", "b"),
        (None, "a text without id", "en", None), (7, "zwei Wörter", "de", "ä"), (8, "\n\n", "en", "c"), (9, "same same", "en", "c"),
    ]
    return spark.createDataFrame([(*t, None, *extra) for t in texts], DOCS)


def no_documents(spark):
    return spark.createDataFrame([], DOCS)


def some_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (9, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def rows_of(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()
