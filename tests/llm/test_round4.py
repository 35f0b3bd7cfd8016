"""Findings of round 3."""

import random

import numpy as np

from tests.llm.test_edges import _tree
from tests.llm.test_llm import table
from tracelake.llm import ngram_join, suffix_tree_lm


def test_suffix_tree_learns_rare_and_long_contexts(spark):
    """Words that occur some ten times, and a word that only the three before it tell."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        words = []
        for _ in range(40):
            j, a, b = rng.randrange(200), rng.randrange(2), rng.randrange(2)
            words += [f"w{j}", f"v{j}", f"x{a}", "of", f"y{b}", f"z{a}{b}"]
        rows.append((k, " ".join(words)))
    want, retained = _tree(rows, suffix_tree_lm.TreePlan())
    assert sum(c[0][:1] == b"w" for c in retained if len(c) == 1) > 150 and any(len(c) == 3 for c in retained)
    got = suffix_tree_lm.score(table(spark, rows)).collect()
    assert np.allclose([r["score"] for r in got], [want[r["doc_id"]] for r in got], rtol=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.6 * sum(r["base_score"] for r in held)


def test_near_copies_are_compared_with_few_leaders(spark, monkeypatch):
    """Candidate pairs of a group of near copies go with its number."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        words = list(base)
        words[rng.randrange(300)] = f"r{k}"
        rows.append((k, " ".join(words)))
    seen = []
    verified = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *rest: seen.append(pairs.count()) or verified(pairs, *rest))
    got = ngram_join.similarity_components(table(spark, rows), n=3, threshold=0.9).collect()
    assert {r["component_id"] for r in got} == {0} and len(got) == 120
    assert sum(seen) <= 3 * len(rows), seen
