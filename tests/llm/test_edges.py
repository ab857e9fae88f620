"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns: every operator has a defined result."""

from __future__ import annotations

import gzip
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import decontaminate, lines, mixing, nearcopies, neighbours, quality, sharding, simhash, tokens, toxicity, warc
from sieveline.llm.components import connected_components
from sieveline.llm.tables import new_path
from tests.llm.fixtures import LONG, no_documents, no_labels, odd_documents, some_labels

ITEMS = "item_id long, text string, doc_id string"


def test_simhash(spark):
    groups = simhash.near_duplicate_groups(odd_documents(spark)).collect()
    assert len(groups) == 11
    by = {r["doc_id"]: r for r in groups}
    assert by[2]["component_id"] == 1 and by[4]["component_id"] == 3 and by[5]["fingerprint"] == "0" * 16
    kept = simhash.drop_near_duplicates(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 9]
    assert simhash.near_duplicate_groups(no_documents(spark)).count() == 0


def _brute_components(fps, bits):
    """{fingerprint: least of its component}, by comparing all pairs."""
    own, part = np.array(fps, np.int64).view(np.uint64), {f: f for f in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(own[:i] ^ own[i]) <= bits).tolist():
            low, high = sorted((root(fps[i]), root(fps[j])))
            part[high] = low
    return {f: root(f) for f in fps}


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize(("bits", "groups", "each", "flips", "per_cell"), [(3, 60, 12, 4, 40), (3, 40, 5, 6, 1 << 16), (10, 30, 30, 10, 50), (0, 5, 3, 2, 4)])
def test_simhash_index_equals_brute_force(spark, bits, groups, each, flips, per_cell):
    """Many cells, one cell, dense clouds under a wide bound, and equality."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, groups, dtype=np.uint64)
    base[: groups // 2] = base[0] ^ (base[: groups // 2] & np.uint64(0xFFFF))  # half of them lie close together
    fps = sorted({_signed(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, flips), replace=False))) for b in base for _ in range(each)} | {0, -1})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), bits, per_cell)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    want = _brute_components(fps, bits)
    assert {f: got.get(f, f) for f in fps} == want
    assert links.count() <= 8 * len(fps)


def test_near_duplicates_that_share_an_id_are_told_apart(spark):
    words = [" ".join(f"{w}{i}" for i in range(40)) for w in "ab"]
    docs = spark.createDataFrame([(1, words[0]), (2, words[0]), (2, words[1])], "doc_id long, text string")
    for drop in (simhash.drop_near_duplicates, nearcopies.drop_near_copies):
        assert sorted((r["doc_id"], r["text"]) for r in drop(docs).collect()) == [(1, words[0]), (2, words[1])]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}


@pytest.mark.parametrize(("score", "drop"), [(toxicity.score_toxicity, toxicity.drop_toxic), (quality.score_quality, None)])
def test_classifiers(spark, score, drop):
    docs = odd_documents(spark)
    for labels in (some_labels(spark), no_labels(spark)):
        rows = score(docs, labels).collect()
        assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows} == {0.5}
    assert score(no_documents(spark), some_labels(spark)).count() == 0
    if drop:
        kept = drop(docs, no_labels(spark))
        assert kept.columns == docs.columns and kept.count() == 11


def test_mix(spark):
    docs = odd_documents(spark)
    rows = mixing.mix_sources(docs, keep=["lang"]).collect()
    assert len(rows) == 11 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["doc_id"]: r["size"] for r in rows}[6] == 200_000 and {r["doc_id"]: r["size"] for r in rows}[4] == 0
    written = mixing.written_mix(docs)
    assert written.columns == docs.columns
    got = Counter()
    for r in written.collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    want = Counter()
    for r in rows:
        want[r["doc_id"]] += r["taken"]
    assert +got == +want
    assert mixing.mix_sources(no_documents(spark)).count() == 0 and mixing.written_mix(no_documents(spark)).count() == 0


def test_sharding(spark):
    rows = sharding.shard_documents(odd_documents(spark), shards=4).collect()
    counts = Counter(r["shard"] for r in rows)
    assert sum(counts.values()) == 11 and max(counts.values()) - min(counts.values()) <= 1
    assert sharding.shard_documents(no_documents(spark)).count() == 0
    hot = spark.range(160).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 80, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("text"))
    placed = sharding.shard_documents(hot).collect()
    assert set(Counter(r["shard"] for r in placed).values()) == {10}


PAGES = "page_id long, url string, html string, payload string, refers_to long, page long"


def test_warc(spark):
    pages = [
        (3, "http://a/3", "<p>x</p>", "p", 1, 1), (1, "http://a/1\r\nX: y", "<p>x</p>", "p", 1, 1), (2, None, None, "p", 1, 1), (4, "http://a/4", "", "p", 1, 1),
        (5, "http://a/5", "é" * 300_000, "p", 1, 1), (5, "http://a/5", "é" * 300_000, "p", 1, 1), (6, "u", "a\r\n\r\nWARC/1.1\r\n\r\nb", "p", 1, 1),
    ]
    got = sorted(warc.archive_pages(spark.createDataFrame(pages, PAGES)).collect(), key=lambda r: (r["page_id"], r["record_type"]))
    assert [(r["page_id"], r["record_type"], r["refers_to"]) for r in got] == [
        (1, "response", None), (2, "response", None), (3, "revisit", 1), (4, "revisit", 2), (5, "response", None), (5, "revisit", 5), (6, "response", None),
    ]
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).count() == 0
    path = new_path(spark, "round-trip")
    own = spark.createDataFrame(pages, PAGES).select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    warc.write_archives(own, path, min_bytes=9)
    back = {r["page_id"]: r["payload"] for r in warc.read_archives(spark, path).collect() if r["record_type"] == "response"}
    assert back == {p[0]: (p[2] or "").encode() for p in pages}  # payloads under nine bytes are all responses


def test_warc_records_are_members_with_names_of_their_own(spark):
    noise = np.random.default_rng(2).integers(0x4E00, 0x9FFF, 7_000_000).astype(np.uint16).tobytes().decode("utf-16-le")
    pages = [(1, "u", "x"), (1, "u", "x"), (1, "u", "y"), (None, None, "x"), (2, "u", noise), (3, "u", "z")]  # one of more than 16 MB
    path = new_path(spark, "members")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, payload string").coalesce(1), path, bytes_per_file=1 << 20)
    files = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    members = [m for f in files for m in warc._unpacked(f) if m]
    assert len(members) == 6 and len(files) > 2 and sorted(gzip.decompress(f) for f in files) == sorted(b"".join(warc._unpacked(f)) for f in files)
    assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
    names = [re.search(rb"WARC-Record-ID: (\S+)", m)[1] for m in members]
    assert len(set(names)) == 6 and {re.search(rb"WARC-Refers-To: (\S+)", m)[1] for m in members if b"WARC-Refers-To:" in m} <= set(names)
    assert {r["page_id"] for r in warc.read_archives(spark, path).where("payload_bytes > 16777216").collect()} == {2}


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 0.5]), (100, [3.0, 4.0])]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<double>, rank int, code string")
    got = neighbours.nearest_neighbours(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 8), (0, 3, 2), (0, 4, 100), (100, 1, 2), (100, 2, 8), (100, 3, 0), (100, 4, 1)]
    assert got[0]["score"] == 0.0 and got[3]["score"] == pytest.approx(20**0.5, rel=1e-15)
    assert neighbours.nearest_neighbours(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog", "x"), (2, None, "x"), (None, "", "x"), (1, "The quick brown fox jumps over the lazy dog", "x")], ITEMS)
    docs = odd_documents(spark)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 1), (2, 1)]
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 8
    assert decontaminate.contaminated(docs, items.where("false")).count() == 0
    assert decontaminate.contaminated(no_documents(spark), items).count() == 0


def test_indexes_of_few_postings_find_the_same(spark):
    text = [f"what is the colour of stone number {i} in the long row of stones? it is shade {i * i} of grey" for i in range(40)]
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(text)], ITEMS)
    whole, parts = list(decontaminate.item_indexes(items)), list(decontaminate.item_indexes(items, most=50))
    assert len(whole) == 1 and len(parts) > 3
    passage = "so they asked " + text[7] + " and went home"
    found = lambda ix: {i.ids[k]: v for i in ix for k, v in i.matches(passage, 0.6, 0.6).items()}
    assert found(whole).keys() == found(parts).keys() and 7 in found(whole)


def test_lines(spark):
    docs = odd_documents(spark)
    rows = lines.drop_common_lines(docs, min_docs=2).collect()
    assert len(rows) == 11
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_lines"], by[1]["n_dropped"], by[1]["text"]) == (1, 1, "") and by[4]["n_lines"] == 1 and by[8]["n_lines"] == 3
    assert by[6]["n_dropped"] == 0 and by[6]["text"] == LONG
    assert lines.drop_common_lines(docs, min_docs=3).where("n_dropped > 0").count() == 3  # a row that repeats an id is a document
    assert lines.drop_common_lines(docs, min_docs=4).where("n_dropped > 0").count() == 0
    for shift in (0, 2000):  # with and without a line that more than a thousand documents have
        many = spark.range(shift, shift + 1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("Hot line\n"), (F.col("id") % (60 + shift)).cast("string")).alias("text"))
        got = Counter((r["n_dropped"], r["text"] == "") for r in lines.drop_common_lines(many, min_docs=20).collect())
        assert got == ({(2, True): 1500} if not shift else {(1, False): 1500})
    assert lines.drop_common_lines(no_documents(spark)).count() == 0


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_rules_keep_the_sum(spark, rule):
    rows = tokens.section_tokens(odd_documents(spark), fields=("source", "text"), rule=rule).collect()
    totals = Counter()
    for r in rows:
        totals[r["doc_id"], r["field"]] += r["tokens"]
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    assert totals[6, "text"] > 100_000 and all(n == pytest.approx(round(n)) or rule == "share" for n in totals.values())
    assert tokens.section_tokens(no_documents(spark)).count() == 0


def test_token_on_a_boundary_goes_where_the_rule_says():
    ends, cuts = np.array([2, 6, 9]), np.array([3, 9])  # the second token has one byte before the cut, three after
    got = {rule: tokens.attribute(ends, cuts, rule).tolist() for rule in tokens.RULES}
    assert got == {"first": [2, 1], "last": [1, 2], "most": [1, 2], "share": [1.25, 1.75]}
