"""The table of quality rules."""

from quillpack.llm.quality_rules import RULES


def test_long_texts_are_not_rejected_for_their_length():
    assert [(r.least, r.most) for r in RULES if r.measure == "n_words"] == [(50, float("inf"))]
