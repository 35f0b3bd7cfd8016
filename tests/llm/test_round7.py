"""Findings of round 6."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from tests.llm.test_edges import _tree
from tests.llm.test_llm import table
from tracelake.llm import quality, suffix_tree_lm


def test_symbols_of_many_texts_as_of_each_alone(monkeypatch):
    """A chunk's distinct words are looked up once; words of letters, with signs after them or not, need no pattern."""
    rng = random.Random(1)
    blanks = [" ", "  ", "\n", "\x1c", "\x85", "　", "\t \t"]
    plain = ["the", "The", "THE", "x.", "Xy,", "é!!", "İ.", "$$$"]
    pool = [*plain, "a1", "...", "_", "é,b", "́", "²", "ǅx", "a.b.", "it's", "-a"]
    texts = [None, "", " ", " \n ", " a a ", "a", "a a"]
    texts += ["".join(rng.choice(blanks) + rng.choice(pool[: rng.choice([2, len(pool)])]) for _ in range(rng.randrange(40))) + rng.choice(["", *blanks]) for _ in range(500)]
    # by the pattern, a word at a time
    want = []
    for t in texts:
        split = (t or "").split()
        want.append([n for w, before in zip(split, [None, *split], strict=False) for n in ((quality.REPEAT,) if w == before else map(quality.number, quality.symbols(w)))])
    words, lookups = quality.Words(), []

    class Counted(type(words.memo)):
        def __getitem__(self, word):
            lookups.append(word)
            return super().__getitem__(word) if word in self else self.__missing__(word)

    words.memo = Counted()
    assert [x.tolist() for x in words.of_all(pa.array(texts, pa.string()))] == want
    assert [x.tolist() for x in words.of_all(pa.array(texts, pa.string())[5:90])] == want[5:90] and words.of_all(pa.array([], pa.string())) == []
    assert 0 < len(lookups) <= 2 * (len(pool) + 2)
    vectors = np.random.default_rng(2).normal(size=(quality.NUMBERS, 8))
    runs = [np.arange(n, dtype=np.int32) for n in (0, 1, 31, 32, 63, 64, 95, 96, 97, 128, 40_000)]
    for ids, got in zip(runs, quality.pooled_all([i % quality.NUMBERS for i in runs], vectors), strict=True):
        n = len(ids)
        cuts = [k for k in range(0, n, 64) if not k or n - k >= 32]
        means = [vectors[ids[a:b] % quality.NUMBERS].mean(axis=0) for a, b in zip(cuts, [*cuts[1:], n], strict=False)]
        alone = np.concatenate([vectors[ids % quality.NUMBERS].mean(axis=0), np.max(means, axis=0), np.min(means, axis=0), [np.log1p(n)]]) if n else np.zeros(25)
        assert np.allclose(got, alone)
    monkeypatch.setattr(quality, "_PARTS", None)
    assert all(len(quality.numbers(w)) in (2, 4) for w in plain[:-1])


def test_suffix_tree_asks_for_the_next_level_along_with_its_sums(spark, monkeypatch):
    """A block is made up again once a level: its sums over a level's contexts and its strings of the next level leave together."""
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["a b", "b c", "c a", "d"]) for _ in range(80))) for k in range(100)]
    plan, seen, spread = suffix_tree_lm.TreePlan(order=3), [], suffix_tree_lm._spread

    def counted(sent, parts):
        seen.append({r["kind"] for r in sent.select("kind").distinct().collect()})
        return spread(sent, parts)

    monkeypatch.setattr(suffix_tree_lm, "_spread", counted)
    want, _ = _tree(rows, plan)
    got = suffix_tree_lm.score(table(spark, rows), plan).collect()
    assert np.allclose([r["score"] for r in got], [want[r["doc_id"]] for r in got], rtol=1e-9)
    assert seen == [{0}, {0}, {0, 1}, {0, 1}, {1}], seen


def test_suffix_tree_blocks():
    """Words of a block are those between ASCII blanks; an extension told where contexts are tested is the same; numbers keep their low bytes."""
    rng = random.Random(2)
    texts = [None, "", " ", "\n a", "a "] + ["".join(rng.choice(["a", "B", "É", "é", "\x85", "　", " ", "\t", "\x0b", "\x1c", "\xa0", "Z ", "aB "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    made = [suffix_tree_lm.Block(suffix_tree_lm.Block.code(list(range(len(texts))), texts, [True] * len(texts))) for _ in range(2)]
    whole, told = made
    placed = np.empty(len(whole.order), np.uint64)
    placed[whole.order] = whole.words[whole.word]
    split = [[*(t or "").encode().lower().split(), b""] for t in texts]
    assert whole.lengths.tolist() == list(map(len, split)) and placed.tolist() == [xxhash.xxh3_64_intdigest(w) for s in split for w in s]
    for block in made:
        block.know(block.unigrams(), 10**4, 30, suffix_tree_lm.TreePlan(), 4)
    for _ in range(2):
        whole.extend()
        told.extend(whole.tested)
        for name in ("live", "first", "context", "run", "shorter", "asked", "ended", "next_keys"):
            assert (getattr(whole, name) == getattr(told, name)).all(), name
        for block in made:
            block.take(np.full(len(block.asked), 2))
    for values in ([], [0, 3], [255, 256], [1, 2**64 - 1]):
        planes = suffix_tree_lm._planes(np.array(values, np.uint64))
        assert suffix_tree_lm._from_planes(planes).tolist() == values and len(planes) == 1 + len(values) * max(1, -(-max(values, default=0).bit_length() // 8))
