"""Long repetitive texts and vectors of extreme size."""

import hashlib
import random

import numpy as np
import pytest

from tracelake.llm import bwt_dedup, embed_dedup
from tests.llm.test_llm import _components


def removed(texts, width):
    seen = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("slice_", [bwt_dedup.SLICE, 97])
def test_repetitive_texts(spark, monkeypatch, slice_):
    monkeypatch.setattr(bwt_dedup, "SLICE", slice_)
    rng = random.Random(1)
    noise = lambda n: bytes(rng.randrange(33, 126) for _ in range(n))
    line, block = noise(90) + b"\n", noise(450)
    texts = [b"a" * 300, b"a" * 299, b"a" * 201, b"a" * 200, b"b" * 200, noise(150) + b"c" * 400 + noise(100), b"c" * 250 + noise(60), b"ab" * 300, noise(10) + b"ba" * 120, line * 5, line * 2 + noise(50), block + noise(30) + block, noise(20) + block[:300], (noise(40) + b"-" * 230) * 2, noise(700)]
    table = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts)], "doc_id long, text string")
    if slice_ != bwt_dedup.SLICE:  # tasks run in other processes, so the slices are tried here
        for t in texts:
            kinds, runs = bwt_dedup.own_kinds(t, 200)
            covered = np.zeros(len(t), int)
            for first, n in zip(kinds[2].tolist(), kinds[3].tolist(), strict=True):
                covered[first : first + n] += 1
            twice = {t[i : i + 200] for i in range(len(t) - 199) if t.find(t[i : i + 200], t.find(t[i : i + 200]) + 1) >= 0}
            for a, b in zip(*(r.tolist() for r in runs), strict=True):
                covered[a : b + 1] = 1
                assert all(t[i : i + 200] in twice for i in range(a, b + 1))
            assert covered[: len(t) - 199].all()
        return
    for r, t, gone in zip(bwt_dedup.dedup_digest(table).orderBy("doc_id").collect(), texts, removed(texts, 200), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert (r["n_removed"], r["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), r["doc_id"]


def test_periodic_texts_have_few_kinds():
    for unit in ("a", "ab", "one line of text that is there again and again\n"):
        data = (unit * (400_000 // len(unit))).encode()
        kinds, runs = bwt_dedup.own_kinds(data, 200)
        assert len(kinds[0]) < 200 and len(runs[0]) == 1 and runs[0][0] < 170 and runs[1][0] >= len(data) - 400  # the ends are left to the merge


def test_very_long_repetitive_texts(spark):
    rows = [(0, "a" * 8_000_000), (1, "ab" * 2_000_000), (2, "the same line of some length\n" * 200_000), (3, "a" * 8_000_000), (4, "kept as it is, being short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in bwt_dedup.dedup_digest(docs).collect()}
    assert got == {i: (len(t), len(t) if i < 4 else 0, int(i < 4)) for i, t in rows}


def test_vectors_of_extreme_size(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 6))
    rows = [(k, 1, (base[k % 4] * 10.0 ** rng.choice([-200, -150, 0, 150, 200]) * (1 + 0.01 * rng.normal(size=6))).tolist()) for k in range(40)]
    rows += [(100, 1, [1e-200, 2e200]), (101, 1, [1e-200, 1e-200]), (102, 1, [1e200, 1e200]), (103, 1, [5e-324, 0.0]), (104, 1, [1e308, 0.0])]
    unit = [np.array(v) / np.abs(v).max() for _, _, v in rows]
    linked = lambda i, j: len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= 0.98
    roots = _components(len(rows), linked)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == {rows[i][0]: (sum(linked(i, j) for j in range(len(rows)) if j != i), rows[roots[i]][0]) for i in range(len(rows))}
