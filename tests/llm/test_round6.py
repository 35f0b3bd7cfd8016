"""Findings of round 5."""

import random

from tests.llm.test_llm import table
from tracelake.llm import ngram_join, quality


def test_units_write_joining_links_only(spark, monkeypatch):
    """A large group of near copies that no leader joins leaves rows in proportion to its number, and all its links."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(240):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 9])):
            words[rng.randrange(300)] = f"r{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    sets = [{tuple(w[i : i + 3]) for i in range(298)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    seen, write = {}, ngram_join.Scratch.table

    def counted(self, df, name):
        out = write(self, df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join.Scratch, "table", counted)
    # without leaders and small buckets all is compared in units
    monkeypatch.setattr(ngram_join, "_may", lambda *rest: ngram_join.F.lit(False))
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 100)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(table(spark, rows), n=3, threshold=0.9).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < len(rows)
    # blocks of 100: a head of a unit meets three of them
    assert seen["open_units"] > 200 and seen["wanted"] <= len(rows) and seen["links"] <= 3 * seen["open_units"], seen


def test_joining_pairs_against_brute_force():
    rng = random.Random(9)
    np = ngram_join.np
    sets = [np.array(sorted(rng.sample(range(24), rng.randrange(14, 21))), np.uint64) for _ in range(60)]
    component = np.array([k // 2 if k < 10 else k for k in range(60)])
    both = lambda i, j: len(set(sets[i].tolist()) & set(sets[j].tolist()))
    for one, two in ((np.arange(60), np.arange(60)), (np.arange(0, 60, 3), np.setdiff1d(np.arange(60), np.arange(0, 60, 3)))):
        similar = [(i, j) for i in one.tolist() for j in two.tolist() if i != j and 5 * both(i, j) >= 4 * (len(sets[i]) + len(sets[j]) - both(i, j))]
        x, y = ngram_join._joining(sets, one, two, component, 4, 5)
        found = list(zip(x.tolist(), y.tolist(), strict=True))
        assert set(found) <= set(similar) and len(found) < 60

        def joined(pairs):
            label = component.copy()
            for i, j in pairs:
                label[label == max(label[i], label[j])] = min(label[i], label[j])
            return label.tolist()

        assert joined(found) == joined(similar) and len(set(joined(found))) > 1


def test_neighbours_of_frequent_symbols_are_counted_by_pair(monkeypatch):
    """The sums are those of all pairs; only pairs of two rare numbers are added a component at a time."""
    np, plan = ngram_join.np, quality.QualityPlan()
    rng = np.random.default_rng(3)
    components, signs = quality.index_vectors(plan)
    texts = [np.where(rng.random(n) < 0.9, rng.integers(0, 40, n), rng.integers(0, quality.NUMBERS, n)).astype(np.int32) for n in (0, 1, 2, 700, 3000)]
    vectors = np.zeros((quality.NUMBERS, plan.size))
    np.put_along_axis(vectors, components, signs, axis=1)
    want = np.zeros_like(vectors)
    for t in texts:
        for k in range(1, plan.window + 1):
            np.add.at(want, t[k:], vectors[t[:-k]])
            np.add.at(want, t[:-k], vectors[t[k:]])
    added, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, w=None, minlength=0: added.append(len(x) * (w is not None)) or bincount(x, w, minlength))
    assert (quality.neighbour_sums(texts, components, signs, plan) == want).all()
    assert sum(added) < 0.1 * 24 * sum(map(len, texts))


def test_symbols_of_words_as_of_each_alone():
    """Repeats, words of one, two and more numbers, words that share numbers, and a memo that is full."""
    words, rng = quality.Words(), random.Random(4)
    pool = ["the", "The", "a1", "x.", "...", "_", "é,b", "\u0301", "12", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600))]
    for n in (0, 1, 2, 50, 3000):
        text = [rng.choice(pool[: rng.choice([3, 9, 600])]) for _ in range(n)]
        want = [x for w, before in zip(text, [None, *text], strict=False) for x in ((quality.REPEAT,) if w == before else quality.numbers(w))]
        assert words.of(" ".join(text)).tolist() == want
    assert words.of(None).tolist() == [] and all(isinstance(c, int) for c in words.memo.values())
    words.memo.update((f"filler{k}", 0) for k in range(300_001))
    assert words.of("the x.").tolist() == [*quality.numbers("the"), *quality.numbers("x.")] and len(words.memo) == 2
