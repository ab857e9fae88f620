"""Vector codes against plain rounds over all entries, and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from sieveline.llm import codebooks

VECTORS = "vec_id long, embedding array<double>, label int, code string, error long, key string, id int"


def plain(rows, parts, entries, rounds, scale):
    """{id: (codes, error)} and the codebooks, by comparing each part with each entry in whole numbers."""
    kept = sorted((i, [int(np.floor(scale * x)) for x in v]) for i, v in rows)
    width = len(kept[0][1]) // parts
    part = {(i, p): v[p * width : (p + 1) * width] for i, v in kept for p in range(parts)}
    books = [[part[i, p] for i, _ in kept[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest():
        return {k: min((distance(x, c), e) for e, c in enumerate(books[k[1]])) for k, x in part.items()}

    for _ in range(rounds):
        own = nearest()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [part[i, p] for i, _ in kept if own[i, p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = nearest()
    return {i: ([own[i, p][1] for p in range(parts)], sum(own[i, p][0] for p in range(parts))) for i, _ in kept}, books


@pytest.mark.parametrize(("parts", "entries", "rounds", "scale"), [(4, 24, 3, 256), (2, 40, 4, 3), (8, 500, 1, 16)])
def test_codes_equal_plain_rounds(spark, parts, entries, rounds, scale):
    """Fine and coarse integers: the coarse ones tie often."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=16) + 3 * (i % 5)).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, v, 0, "x", 1, "x", 1) for i, v in rows], VECTORS).repartition(5)
    got, books = codebooks.code_vectors(df, parts=parts, entries=entries, rounds=rounds, scale=scale)
    want, plain_books = plain(rows, parts, entries, rounds, scale)
    assert {r["id"]: (np.frombuffer(r["codes"], np.uint16).tolist(), r["error"]) for r in got.collect()} == want
    assert [b.tolist() for b in books] == plain_books


def test_bounds_leave_groups_out_and_lose_no_tie():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (3000, 4)) + 200 * rng.integers(0, 6, (3000, 1))
    entries = x[:64].copy()
    book = codebooks.Codebook(entries, codebooks.entry_groups(entries, 7), np.zeros(64))
    own, best, low, _ = book.assign(x, None, None)
    share = []
    for _ in range(6):
        new = book.entries + rng.integers(-3, 4, book.entries.shape)
        new[1::9] = new[::9][: len(new[1::9])]  # equal entries tie
        book = codebooks.Codebook(new, book.groups, np.sqrt(((new - book.entries) ** 2).sum(axis=1).astype(float)))
        own, best, low, computed = book.assign(x, own, low)
        every = codebooks.squared_distances(x, new)
        assert (own == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
        others = np.where(np.arange(64) == own[:, None], np.inf, np.sqrt(every))
        for g in range(book.group_count):
            assert (low[:, g] <= others[:, book.groups == g].min(axis=1) + 1e-9).all()
        share.append(computed / every.size)
    assert np.mean(share) < 0.6, share


def test_large_integers_are_exact():
    x, c = np.array([[2**27, -(2**27)]]), np.array([[-(2**27), 2**27], [2**27 - 1, -(2**27)]])
    assert codebooks.squared_distances(x, c).tolist() == [[2**57, 1]]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(5, [1.0, 0.0]), (1, [1.0, -0.001]), (1, [1.0, -0.001]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    labels = [1, None, 2, 1, 1, 1, 1, None, 1, 1]
    df = spark.createDataFrame([(*v, y, "x", 1, "x", 1) for v, y in zip(vectors, labels, strict=True)], VECTORS)
    got = sorted(codebooks.code_table(df, parts=2, entries=3, rounds=2).collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"] or 0))
    # second parts -1, -1, 0 and 256 start from entries -1, -1 and 0; the third moves to 128, then to 256; equal entries tie to the first
    assert [(r["vec_id"], r["code"], r["error"]) for r in got] == [(1, "0000", 0), (1, "0000", 0), (5, "0000", 1), (None, "0002", 0)]
    assert [r["label_error"] for r in got] == [0, 0, 1, 0]
    assert len({r["codebooks_sha256"] for r in got}) == 1
    assert codebooks.code_table(df.where("false"), parts=2).count() == 0
    with pytest.raises(ValueError):
        codebooks.code_table(df, parts=3)
