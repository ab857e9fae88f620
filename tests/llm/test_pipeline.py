"""Each stage on its own input, and run() against the stages' brute-force versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline
from sieveline.llm import queries
from tests.llm.fixtures import SF, no_documents, odd_documents, rows_of
from tests.llm.test_nearcopies import brute_copies
from tests.llm.test_queries import brute_leaks


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_run_equals_brute_force(spark):
    docs = rows_of("documents")
    toxic = {r["doc_id"] for r in queries.op2_toxicity(spark, SF).collect() if r["score"] >= 0.7}
    left = [d for d in docs if d["doc_id"] not in toxic]
    components = brute_copies(left)
    left = [d for d in left if d["doc_id"] in set(components.values())]
    leaks = {d for d, _ in brute_leaks(left, rows_of("benchmark"))}
    left = [d for d in left if d["doc_id"] not in leaks]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} <= {d["doc_id"] for d in left}

    # the mix: its weights, without an excess beyond three times a source's size
    sizes = defaultdict(int)
    for d in left:
        sizes[d["source"]] += _words(d["text"])
    names, total = sorted(sizes), sum(sizes.values())
    target, full = {}, set()
    while True:
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names) if s not in full}
        free = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else free * weight[s] / sum(weight.values()) for s in names}
        over = {s for s in weight if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    whole = {d["doc_id"]: d["text"] for d in left}
    mixed = corpus_pipeline.mix(spark, spark.createDataFrame(left, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    for r in mixed:
        taken[r["source"]] += _words(r["text"])
        assert r["text"] in whole[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert all(abs(taken[s] - target[s]) <= 0.01 * total for s in names)
    # what comes out is the mix's rows, whole, with a shard
    columns = mixed[0].asDict().keys()
    assert [*got[0].asDict()] == [*columns, "shard", "slot"]
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(tuple(r) for r in mixed)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
            n, most = out.count(), docs.count()
            if name in ("toxicity", "near_copies", "decontamination"):
                # of eleven rows three have one text and four are blank
                assert n == (6 if name == "near_copies" else 11) * (most > 0)
            elif name == "sharding":
                assert n == most and set(out.columns) == {*docs.columns, "shard", "slot"}
            else:
                assert (n > 0) == (most > 0)
