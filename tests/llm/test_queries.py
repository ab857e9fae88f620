"""The numbered queries over whole tables, against SQL or a brute-force version."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import tiktoken
import xxhash

from sieveline.llm import decontaminate, neighbours, quality, queries, tokens, toxicity
from tests.llm.fixtures import SF, rows_of
from tests.oracle import same, tables


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), tables(SF), queries.ORACLES[name])


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(docs):
    """{(id, fingerprint): component}"""
    prints = [(d["doc_id"], brute_fingerprint(d["text"])) for d in docs]
    left, out = set(range(len(prints))), {}
    while left:
        reach, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            reach.add(i)
            near = {j for j in left if (prints[i][1] ^ prints[j][1]).bit_count() <= 3}
            left -= near
            todo += near
        for i in reach:
            out[prints[i]] = min(prints[j][0] for j in reach)
    return out


def test_simhash_equals_brute_force(spark):
    got = {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in queries.op1_simhash(spark, SF).collect()}
    assert got == brute_groups(rows_of("documents"))


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    s, y = np.asarray(score)[order], np.asarray(label)[order]
    ranks = np.array([(np.flatnonzero(s == v).mean() + 1) for v in s])
    return (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())


@pytest.mark.parametrize(("query", "label", "divisor", "left", "threshold"), [(queries.op2_toxicity, "toxic", 3, 1, 0.7), (queries.op10_quality, "quality", 5, 0, 0.3)])
def test_scores_hold_on_held_out_rows(spark, query, label, divisor, left, threshold):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    docs = rows_of("documents", sf)
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % divisor == left) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold) for r in rows)
    known = {x["doc_id"]: x[label] for x in rows_of("labels", sf) if x[label] is not None}
    away = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert _auc([s for s, _ in away], [y for _, y in away]) > 0.85


def test_label_model_recovers_what_votes_were_drawn_from():
    """Votes of known accuracies, half of them drawn together with another voter's: no label is given."""
    rng = np.random.default_rng(3)
    n, voters, prior = 20_000, 14, 0.15
    y = (rng.random(n) < prior).astype(int)
    right = rng.uniform(0.65, 0.95, (2, voters))  # P(votes for the class | it votes, class)
    speaks = rng.uniform(0.6, 0.95, voters)
    votes = np.where(rng.random((n, voters)) < speaks, np.where(rng.random((n, voters)) < right[y], 2 * y[:, None] - 1, 1 - 2 * y[:, None]), 0)
    copies = {9: 2, 10: 3, 11: 4, 12: 5, 13: 6}
    for j, p in copies.items():
        same = rng.random(n) < 0.6
        votes[same, j] = votes[same, p]
    model = toxicity.fit_label_model(votes.astype(np.int8), prior)
    want = np.stack([np.stack([(votes[y == c] == v).mean(axis=0) for v in (-1, 0, 1)], axis=1) for c in (0, 1)])
    assert np.abs(model.rates - want).max() < 0.03
    edges = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert len(edges) == voters - 1 and all(frozenset(e) in edges for e in copies.items())
    for j, p in copies.items():
        child, parent = (j, p) if model.parent[j] == p else (p, j)
        for c in (0, 1):
            both = np.array([[((votes[y == c, parent] == u) & (votes[y == c, child] == v)).sum() for v in (-1, 0, 1)] for u in (-1, 0, 1)])
            seen = both.sum(axis=1) > 100
            assert np.abs(model.given[c, child] - both / both.sum(axis=1, keepdims=True))[seen].max() < 0.06
    q = model.posterior(votes.astype(np.int8))
    assert ((q > 0.5) == y).mean() > 0.96 and abs(q.mean() - prior) < 0.02


def test_toxicity_scores_equal_plain_sums(spark):
    """The fitted weights, added up text by text without batches, caches or numbered features."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in queries.op2_toxicity(spark, SF).collect()}
    assert len(model.weights) > 100
    for d in rows_of("documents"):
        words = {w.lower() for w in re.findall(r"[^\W\d_]+", (d["text"] or "").lower())}
        counts = Counter()
        for w in words:
            counts.update([f"={w}"] * (len(w) <= 24) + [f"^{w[:k]}" for k in range(3, 9) if len(w) >= k] + [f"{w[-k:]}$" for k in range(3, 6) if len(w) >= k])
        raw = model.bias + sum(model.weights.get(f, 0) + (model.weights.get(f"2{f}", 0) if k > 1 else 0) for f, k in counts.items())
        assert got[d["doc_id"]] == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)


def _plain_trees(x, y, trees, depth, rate, bins, least, ridge):
    """Boosting row by row: every split of every node is tried on the rows themselves."""
    edges = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(x.shape[1])]
    raw = [float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))] * len(y)
    for _ in range(trees):
        p = [1 / (1 + np.exp(-r)) for r in raw]
        g, h = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            split = []
            for rows in nodes:
                total, best = (sum(g[i] for i in rows), sum(h[i] for i in rows)), (1e-9, None, None)
                for j in range(x.shape[1]):
                    for e in edges[j]:
                        low = [i for i in rows if x[i, j] <= e]
                        if min(len(low), len(rows) - len(low)) < least:
                            continue
                        a, b = sum(g[i] for i in low), sum(h[i] for i in low)
                        gain = a * a / (b + ridge) + (total[0] - a) ** 2 / (total[1] - b + ridge) - total[0] ** 2 / (total[1] + ridge)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, j, e)
                _, j, e = best
                split += [rows, []] if j is None else [[i for i in rows if x[i, j] <= e], [i for i in rows if x[i, j] > e]]
            nodes = split
        for rows in nodes:
            step = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
            for i in rows:
                raw[i] += step
    return [1 / (1 + np.exp(-r)) for r in raw]


def test_boosted_trees_equal_plain_ones():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 3)), 1)
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=90) * 0.4) > 0).astype(float)
    params = {"trees": 4, "depth": 3, "rate": 0.3, "bins": 8, "least": 4, "ridge": 1.0}
    model = quality.fit_trees(x, y, **params)
    assert model.predict(x) == pytest.approx(_plain_trees(x, y, **params), abs=1e-9)
    for row, score in zip(x, model.predict(x), strict=True):  # and the arrays, walked node by node
        raw = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            raw += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-12)


def test_quality_scores_equal_rows_scored_one_by_one(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    got = {r["doc_id"]: r["score"] for r in queries.op10_quality(spark, SF).collect()}
    for d in rows_of("documents"):
        assert got[d["doc_id"]] == pytest.approx(model.predict(quality.statistics(d["text"])[None])[0], abs=1e-9)


def test_mix_comes_near_its_targets_and_agrees_on_rerun(spark):
    rows = queries.op3_mix_sources(spark, SF).collect()
    assert Counter(rows) == Counter(queries.op3_mix_sources(spark, SF).collect())
    source = {d["doc_id"]: d["source"] for d in rows_of("documents")}
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    total = sum(r["size"] for r in rows)
    assert all(abs(taken[s] - target[s]) <= 0.01 * total for s in target)


def test_shards_keep_their_law_and_gather_copies(spark):
    rows = queries.op4_sharding(spark, SF).collect()
    docs = {d["doc_id"]: (d["text"] or "") for d in rows_of("documents")}
    counts = Counter(r["shard"] for r in rows)
    assert sum(counts.values()) == len(docs) and set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for r in rows:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, crc32(text), "rows", None)


def test_shards_cut_few_edges(spark):
    """Rows away from the shard that has most of their group: at most a twentieth of those of a random deal."""
    sf = "/root/testdata/sf0.01"
    docs = {d["doc_id"]: (d["text"] or "") for d in rows_of("documents", sf)}
    rows, rng = queries.op4_sharding(spark, sf).collect(), np.random.default_rng(1)

    def cut(shard_of):
        groups = defaultdict(Counter)
        for doc, text in docs.items():
            groups[text][shard_of[doc]] += 1
        # a group of more rows than a shard has must be cut
        return sum(g.total() - max(g.values()) for g in groups.values() if g.total() <= len(docs) // 16)

    dealt = cut({d: int(s) for d, s in zip(docs, rng.permutation(np.arange(len(docs)) % 16), strict=True)})
    assert dealt > 50 and cut({r["doc_id"]: r["shard"] for r in rows}) <= 0.05 * dealt


@pytest.mark.parametrize(("sf", "most"), [("/root/testdata/sf0.01", 1.0), ("/root/testdata/sf0.1", 0.6)])
def test_neighbours_against_brute_force(spark, sf, most):
    """Recall, exact order and scores, and the share of rows that a query is compared with."""
    data = rows_of("embeddings", sf)
    ids, x = np.array([d["vec_id"] for d in data]), np.array([d["embedding"] for d in data], float)
    got = defaultdict(list)
    for r in queries.op6_nearest_neighbours(spark, sf).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    found = 0
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0}
    at = {i: k for k, i in enumerate(ids.tolist())}
    for q, hits in got.items():
        hits.sort()
        d = np.sqrt(((x - x[at[q]]) ** 2).sum(axis=1))
        best = [i for _, i in sorted(zip(d.tolist(), ids.tolist(), strict=True)) if i != q][:10]
        found += len(set(best) & {v for _, v, _ in hits})
        assert [r for r, _, _ in hits] == list(range(1, 11))
        assert [(s, v) for _, v, s in hits] == sorted((s, v) for _, v, s in hits)
        assert all(s == pytest.approx(d[at[v]], rel=1e-12, abs=1e-12) for _, v, s in hits)
    assert found / (10 * len(got)) >= 0.9
    base = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    known = {64: neighbours.Hashes(64, 8, 2, 42)}
    reach = neighbours.measured_reach(base, base.where("vec_id % 100 = 0"), known, 10, 0.95, 64, 42)[64]
    share = np.mean([(known[64].reach(np.repeat(x[at[q]][None], len(x), axis=0), x) <= reach).mean() for q in got])
    assert 0.05 < share <= most


def brute_leaks(docs, items):
    """{(doc, item)}: all items scored in all passages, without an index."""
    items = [(i["item_id"], i["text"]) for i in items if decontaminate.words_of(i["text"])]
    bags = [Counter(decontaminate.words_of(t)) for _, t in items]
    df, n, mean = Counter(w for b in bags for w in b), len(items), np.mean([b.total() for b in bags])
    weights = []
    for bag in bags:
        raw = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * bag.total() / mean)) for w, tf in bag.items()}
        weights.append({w: v / sum(raw.values()) for w, v in raw.items()})
    stride, out = max(b.total() for b in bags), set()
    for d in docs:
        words = decontaminate.words_of(d["text"])
        for at in range(0, max(1, len(words) - stride), stride):
            passage = words[at : at + 2 * stride]
            there = set(passage)
            for (item, text), w in zip(items, weights, strict=True):
                if sum(v for t, v in w.items() if t in there) >= 0.6 and all(decontaminate.overlap(p, passage) >= 0.6 for p in decontaminate.question_and_answer(text)):
                    out.add((d["doc_id"], item))
    return out


def test_leaks_equal_brute_force(spark):
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, SF).collect()}
    want = brute_leaks(rows_of("documents"), rows_of("benchmark"))
    assert got == want and want


def test_tokens_equal_brute_force(spark):
    with open(tokens.VOCABULARY, "rb") as file:
        encoding = tokens.Encoder(file.read()).encoding
    assert isinstance(encoding, tiktoken.Encoding)
    want = {}
    for d in rows_of("documents"):
        text = d["text"] or ""
        counts, lines, at = Counter(), text.encode().split(b"\n"), 0
        owner = np.repeat(np.arange(len(lines)), [len(x) + 1 for x in lines])
        for token in encoding.encode_ordinary(text):
            counts[int(owner[at])] += 1
            at += len(encoding.decode_single_token_bytes(token))
        want |= {(d["doc_id"], s): counts[s] for s in range(len(lines))}
    got = {(r["doc_id"], r["section"]): r["tokens"] for r in queries.op9_token_counts(spark, SF).collect()}
    assert got == want
