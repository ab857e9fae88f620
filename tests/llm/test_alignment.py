"""Linked tokens against whole texts encoded one by one, and odd texts."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sieveline.llm import alignment, queries
from tests.llm.fixtures import SF, no_documents, odd_documents, rows_of

A = Tokenizer.from_file(alignment.BYTE_TOKENS)
A.encode_special_tokens = True
B = SentencePieceProcessor(model_file=alignment.PIECE_TOKENS)
BYTES = alignment.byte_level()


def tokens_of(text):
    """(ids, bytes) of both kinds from the whole text, or none."""
    if not text:
        return [], []
    a = [(i, bytes(BYTES[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    own = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == own == b"".join(x for _, x in b) else ([], [])


def plain(texts):
    docs, seen = [], Counter()
    for text in texts:
        a, b = tokens_of(text)
        ends = [[], []]
        for out, own in zip(ends, (a, b), strict=True):
            at = 0
            for _, x in own:
                at += len(x)
                out.append(at)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, at = [], [0, 0]
        for cut in cuts:
            members = []
            for k, own in enumerate((a, b)):
                stop = ends[k].index(cut) + 1
                members.append([i for i, _ in own[at[k] : stop]])
                at[k] = stop
            groups.append(members)
        links = Counter((x, y) for left, right in groups for x in left for y in right)
        seen.update(links.keys())
        docs.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (x, _), n in seen.items():
        most[x] = max(most[x], n)
    return [
        (
            n_a, n_b, len(groups), sum(links.values()), sum(k for p, k in links.items() if seen[p] == most[p[0]]), sum(k * seen[p] for p, k in links.items()),
            hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else "",
        )
        for n_a, n_b, groups, links in docs
    ], seen, most


def values(r):
    return r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]


def test_query_equals_whole_texts(spark):
    docs = rows_of("documents")
    want, _, _ = plain([d["text"] for d in docs])
    got = Counter((r["doc_id"], values(r)) for r in queries.op13_token_alignment(spark, SF).collect())
    assert got == Counter((d["doc_id"], w) for d, w in zip(docs, want, strict=True))


ODD = [
    "a", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n", "\n a", "\t\ta  b", "<|endoftext|> </s> <s>", "x▁y", "▁", "中文字 \U0001f600 á", "ﬁn Å",
    "a　 b", "  x", "don't I'll we've  'S", "\x00 a\x00", "\x1c b", "a\x1f b \x85 c", "1234 5678.90", "a" * 3000, " " * 500 + "x" + " " * 500, "\n" * 2000 + " x", None, "", "a", "é " * 50,
]


def test_odd_texts_equal_whole_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").repartition(3)
    want, _, _ = plain(ODD)
    assert {r["doc_id"]: values(r) for r in alignment.align_tokens(docs).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("size", [None, 40])
def test_flushes_hot_ids_and_forgotten_chunks_change_nothing(spark, monkeypatch, size):
    """Many flushes, ids dealt to several tasks, and a memory for few chunks."""
    texts = [""] * 700 + [f"the {w} of the row {i % 7}" for i, w in enumerate(["stone", "Stone", "stones", "ston", "x" * 80] * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    if size:
        monkeypatch.setattr(alignment, "_LINKS", size)
        monkeypatch.setattr(alignment, "_DOCS", 300)
        monkeypatch.setattr(alignment, "_KNOWN", 3)
        monkeypatch.setattr(alignment, "_PER_TASK", size)
    want, seen, most = plain(texts)
    assert {r["doc_id"]: values(r) for r in alignment.align_tokens(docs).collect()} == dict(enumerate(want))
    assert {(r["a"], r["b"]): (r["n_docs"], r["best"]) for r in alignment.linked_ids(docs).collect()} == {p: (n, n == most[p[0]]) for p, n in seen.items()}


def test_odd_rows(spark):
    rows = alignment.align_tokens(odd_documents(spark)).collect()
    assert len(rows) == 11 and {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
    by = {r["doc_id"]: r for r in rows}
    assert values(by[4]) == values(by[3]) == (0, 0, 0, 0, 0, 0, "") and by[6]["n_a"] > 100_000 and values(by[1]) == values(by[2])
    assert alignment.align_tokens(no_documents(spark)).count() == 0 and alignment.linked_ids(no_documents(spark)).count() == 0
