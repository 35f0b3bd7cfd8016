"""Findings of round 4."""

import random

import public_tokenizers as files

from tests.llm.test_llm import table
from tracelake.llm import bpe, suffix_tree_lm


def test_suffix_tree_answers_move_once(spark, monkeypatch):
    """A step's exchange to the blocks holds the answers of the step before, not all so far."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["a b", "b c", "c a", "d"]) for _ in range(80))) for k in range(100)]
    seen = []
    to_blocks = suffix_tree_lm._to_blocks
    monkeypatch.setattr(suffix_tree_lm, "_to_blocks", lambda answers, parts: seen.append(answers.count()) or to_blocks(answers, parts))
    assert suffix_tree_lm.score(table(spark, rows)).count() == len(rows)
    assert len(seen) == 9 and max(seen) <= 4 * (16 + 1), seen  # four blocks, with a row for each of 16 ranges and one that names it


def test_bpe_matches_each_word_once():
    """Words between spaces are matched and merged once; ids are those of the pattern over the whole text."""
    codec = bpe.Codec(files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)
    codec.encode("one two, three two, one two, three")
    assert not codec.memo.keys() - {"one", " two", ",", " three", " one"} and set(codec.words) == {"two,", "three", "one"}
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice("ab1é.,'s\n\t\xa0　\x1c\x85   ") for _ in range(rng.randrange(30)))
        assert codec.encode(text) == codec.matches(text), repr(text)
