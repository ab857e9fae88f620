"""Items of which one word is altered are still found."""

from __future__ import annotations

from sieveline.llm.decontaminate import overlap, question_and_answer
from tests.llm.fixtures import rows_of


def test_one_altered_word_loses_no_part():
    cases = 0
    for item in rows_of("benchmark"):
        parts = question_and_answer(item["text"])
        words, at = [*parts[0], *parts[1]], 0
        for part in parts:
            for i in range(at, at + len(part)):
                passage = ["before"] * 5 + words[:i] + ["altered"] + words[i + 1 :] + ["after"] * 5
                # of a part of two words, one is half
                assert all(overlap(p, passage) >= 0.6 for p in parts if len(p) > 2), (item["item_id"], i)
                cases += 1
            at += len(part)
    assert cases > 1000


def test_words_out_of_order_or_far_apart_do_not_count():
    part = "alpha beta gamma delta".split()
    assert overlap(part, part[::-1]) == 0.25
    assert overlap(part, "alpha x x x x beta x x x x gamma x x x x delta".split()) == 0.25
    assert overlap(part, "x alpha beta y delta x".split()) == 0.75
