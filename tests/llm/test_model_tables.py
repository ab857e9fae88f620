"""Tables of the n-gram model: a task merges one part, and those of many parts are looked up at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sieveline.llm import language_model as lm
from sieveline.llm.bloom import CountFilter, Levels


def test_a_task_merges_one_part(spark, monkeypatch):
    """By a hash of its number, parts meet in some tasks, which then read several times as much as others."""
    monkeypatch.setattr(lm, "_PART", 400)
    df = spark.createDataFrame([(" ".join(f"w{i * j % 997}" for j in range(40)),) for i in range(60)], "text string")
    trained = lm.train(df)
    assert trained.model.parts > 20
    files = trained.tables.groupBy(F.input_file_name()).agg(F.countDistinct("part").alias("parts"), F.count(F.lit(1)).alias("tables")).collect()
    assert len(files) == trained.model.parts and all(r["parts"] == 1 and r["tables"] <= 2 for r in files)


def test_parts_are_looked_up_together():
    rng, parts, levels = np.random.default_rng(5), 17, Levels(1.3)
    tables, keys = {}, {k: np.unique(rng.integers(0, 1 << 64, 20_000, np.uint64)) for k in (1, 2, 3)}
    for k, own in keys.items():
        counts = rng.zipf(1.5, len(own)).clip(max=10**6)
        for part, s, e in lm._by_part(own, parts):
            tables[k, part] = (own[s:e], counts[s:e].astype(np.uint32)) if k == 1 else CountFilter.of(own[s:e], levels.of(counts[s:e]), 6)
    tables[1, 4] = (tables[1, 4][0], tables[1, 4][1].astype(np.uint64) + np.uint64(1 << 33))
    del tables[2, 3], tables[1, 5]
    held = [{at: t for at, t in tables.items() if at[1] % 2 == i} for i in (0, 1)]
    model = lm.Model(3, 0, 0, 0, [0.0] * 3, levels, parts, packs=[lm.Pack.of(x, parts) for x in [*held, {}]])
    for k, own in keys.items():
        asked = rng.permutation(np.concatenate([own, rng.integers(0, 1 << 64, 5000, np.uint64)]))
        want, part = np.zeros(len(asked)), lm.part_of(asked, parts)
        for p in range(parts):
            if (k, p) in tables:
                want[part == p] = lm.answer(tables[k, p], asked[part == p], levels)
        assert (model.look(k, asked) == want).all() and want.any()
    assert model.held(2).tolist() == [p != 3 for p in range(parts)] and not model.held(4).any()
