"""Toxicity by the nearest labelled examples.

Terms are words and the beginnings of words; those that labelled toxic
documents hold more often than others make the vocabulary.  Examples without any
of them are not indexed, and a text without any scores one constant: the rate of
toxic ones among such examples.  Each other labelled example is a TF-IDF vector of length 1 in an inverted index whose lists keep the
largest weight of each block of examples.  A query adds the block maxima of its
terms, takes blocks from the highest bound down, and stops when the k-th best
cosine beats the next bound, so its neighbours are
exact within the vocabulary.  Votes weighted by
distance, shrunk towards the rate of the examples, give score and evidence.

Fitting is bounded: at most ``examples`` labelled rows (by hash of the id).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import Scratch
from tracelake.llm.text import chunks, crc_fold, extended

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class ToxicityPlan:
    examples: int = 20_000
    neighbours: int = 25
    #: Lengths of word beginnings that are terms besides whole words.
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    #: A term needs so many toxic examples, this likelihood-ratio statistic, and this ratio of rates.
    least_toxic: int = 3
    least_g2: float = 14.0
    least_ratio: float = 3.0
    block: int = 32
    #: Votes of an average example that every score starts with.
    shrink: float = 1.0
    threshold: float = 0.3
    folds: int = 4
    held_out: int = 2


def terms_of(word: str, beginnings: tuple[int, ...]) -> list[str]:
    """Terms of one white-space separated word: each run of letters, and its beginnings (marked by a star)."""
    out = []
    for run in _LETTERS.findall(word):
        out.append(run)
        out += [run[:k] + "*" for k in beginnings if len(run) > k]
    return out


def words_in(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class BlockMaxIndex:
    """Exact nearest examples by cosine over sparse non-negative vectors."""

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], ids: list[int], terms: int, block: int):
        order = sorted(range(len(vectors)), key=lambda k: (max(vectors[k], key=lambda t: (vectors[k][t], t)), len(vectors[k]), ids[k]))
        self.block, self.n = block, len(order)
        self.labels = np.array([labels[k] for k in order], np.float64)
        self.ids = np.array([ids[k] for k in order], np.int64)
        blocks = -(-self.n // block)
        self.most = np.zeros((terms, blocks))
        lists: list[list[tuple[int, float]]] = [[] for _ in range(terms)]
        for place, k in enumerate(order):
            for t, w in vectors[k].items():
                lists[t].append((place, w))
                self.most[t, place // block] = max(self.most[t, place // block], w)
        self.place = [np.array([p for p, _ in x], np.int64) for x in lists]
        self.weight = [np.array([w for _, w in x]) for x in lists]
        edges = np.arange(blocks + 1) * block
        self.start = [np.searchsorted(p, edges) for p in self.place]

    def nearest(self, query: dict[int, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k best, best first, ties by place; only positive cosines."""
        terms = [t for t in query if len(self.place[t])]
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0)
        bound = np.array([query[t] for t in terms]) @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        places, values = np.zeros(0, np.int64), np.zeros(0)
        for b in order.tolist():
            if bound[b] <= 0 or (len(values) >= k and values[k - 1] > bound[b] + 1e-9):
                break
            got = np.zeros(self.block)
            for t in terms:
                a, z = self.start[t][b], self.start[t][b + 1]
                if z > a:
                    got[self.place[t][a:z] - b * self.block] += query[t] * self.weight[t][a:z]
            hit = np.flatnonzero(got > 0)
            places, values = np.concatenate([places, hit + b * self.block]), np.concatenate([values, got[hit]])
            best = np.lexsort((places, -np.round(values, 9)))[:k]
            places, values = places[best], values[best]
        return places, values


class ToxicityModel:
    """Vocabulary, index and rates; small enough to go with each task."""

    def __init__(self, plan: ToxicityPlan, terms: list[str], examples: list[tuple[int, int, dict[int, int]]], counts: tuple[int, int, int]):
        """counts: examples, examples without terms, toxic ones among the latter."""
        self.plan = plan
        self.number = {t: i for i, t in enumerate(terms)}
        total, bare, bare_toxic = counts
        df = Counter(chain.from_iterable(x for _, _, x in examples))
        self.idf = np.array([math.log((1 + total) / (1 + df[i])) + 1 for i in range(len(terms))])
        self.index = BlockMaxIndex([self.vector(x) for _, _, x in examples], [y for _, y, _ in examples], [k for k, _, _ in examples], len(terms), plan.block)
        self.rate = (sum(y for _, y, _ in examples) + bare_toxic) / max(1, total)
        self.bare_rate = (bare_toxic + self.rate) / (bare + 1)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.known: dict[tuple, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "known": {}}

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + math.log(c)) * self.idf[t] for t, c in sorted(counts.items())}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    def counts(self, text: str | None) -> dict[int, int]:
        memo, words = self.memo, words_in(text)
        for w in set(words).difference(memo):
            if len(memo) > 200_000:
                memo.clear()
                return self.counts(text) if len(words) < 200_000 else self._slow(words)
            memo[w] = tuple(self.number[t] for t in terms_of(w, self.plan.beginnings) if t in self.number)
        return dict(Counter(chain.from_iterable(filter(None, map(memo.__getitem__, words)))))

    def _slow(self, words: list[str]) -> dict[int, int]:
        return dict(Counter(self.number[t] for w in words for t in terms_of(w, self.plan.beginnings) if t in self.number))

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """(score, ids of the nearest examples, their cosines)."""
        counts = self.counts(text)
        if not counts:
            return self.bare_rate, [], []
        key = tuple(sorted(counts.items()))
        if key not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            places, cosines = self.index.nearest(self.vector(counts), self.plan.neighbours)
            votes = 1 / (1.05 - np.minimum(cosines, 1))
            got = (votes @ self.index.labels[places] + self.plan.shrink * self.rate) / (votes.sum() + self.plan.shrink)
            self.known[key] = (float(got), self.index.ids[places].tolist(), np.round(cosines, 6).tolist())
        return self.known[key]


def fit(docs: DataFrame, labels: DataFrame, plan: ToxicityPlan = ToxicityPlan()) -> ToxicityModel:
    """Fit on rows of ``labels(doc_id, toxic)`` outside the held-out fold.

    Rows with a null id or label are left out; an id that repeats counts once,
    toxic if any of its rows is, with the first of its texts in their order.  Without labelled rows every score is 0.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", plan.folds) != plan.held_out))
    sample = sample.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(plan.examples)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most plan.examples rows of 16 bytes
    rows = scratch.table(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        n = [0, 0]
        for part in chunks(batches):
            for t, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                n[y] += 1
                seen[y].update({x for w in set(words_in(t)) for x in terms_of(w, plan.beginnings)})
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(["", *names]), pa.array([n[0], *(seen[0][x] for x in names)], pa.int64()), pa.array([n[1], *(seen[1][x] for x in names)], pa.int64())], names=["term", "clean", "toxic"])

    found = rows.mapInArrow(count, "term string, clean long, toxic long")
    found = found.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = found.where(f"toxic >= {plan.least_toxic} or term = ''")
    found = scratch.table(found, "terms")
    whole = found.where("term = ''").first()
    clean, toxic = (whole["clean"], whole["toxic"]) if whole else (0, 0)
    if not toxic:
        scratch.clear(keep=[])
        return ToxicityModel(plan, [], [], (clean, clean, 0))
    share = F.col("toxic") / toxic
    other = (F.col("clean") + 0.5) / (clean + 1)
    mean = (F.col("toxic") + F.col("clean")) / (clean + toxic)
    part = lambda n, p, q: n * (p * F.log((p + 1e-12) / (q + 1e-12)) + (1 - p) * F.log((1 - p + 1e-12) / (1 - q + 1e-12)))
    g2 = 2 * (part(F.lit(toxic), share, mean) + part(F.lit(max(1, clean)), F.col("clean") / max(1, clean), mean))
    chosen = found.where("term <> ''").withColumn("g2", g2).where((F.col("g2") >= plan.least_g2) & (share >= plan.least_ratio * other)).orderBy(F.desc("g2"), "term")
    terms = [r["term"] for r in chosen.select("term").collect()]  # terms of at most plan.examples texts
    number = {t: i for i, t in enumerate(terms)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            got = [Counter(number[x] for w in words_in(t) for x in terms_of(w, plan.beginnings) if x in number) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array([list(c) for c in got], pa.list_(pa.int32())), pa.array([list(c.values()) for c in got], pa.list_(pa.int64()))], names=["doc_id", "y", "t", "c"])

    made = scratch.table(rows.mapInArrow(vectors, "doc_id long, y int, t array<int>, c array<long>"), "vectors")
    bare = made.where("size(t) = 0").agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    examples = [(r["doc_id"], r["y"], dict(zip(r["t"], r["c"], strict=True))) for r in made.where("size(t) > 0").collect()]  # bounded as plan.examples
    scratch.clear(keep=[])
    return ToxicityModel(plan, terms, sorted(examples, key=lambda x: (x[0], x[1])), (len(examples) + bare[0], bare[0], bare[1]))


def score(docs: DataFrame, model: ToxicityModel, evidence: bool = False) -> DataFrame:
    """``docs`` with score and predicted (and neighbours, cosines): every whole text; a null or empty one scores as one without terms.

    Columns of ``docs`` with these names are replaced.
    """
    added = ["score", "predicted", *(["neighbours", "cosines"] if evidence else [])]
    kept = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = extended(kept.schema, "score double, predicted int" + ", neighbours array<bigint>, cosines array<double>" * evidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = shared.value
        for part in chunks(batches):
            got = [use.score(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            columns = [*part.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= use.plan.threshold) for g in got], pa.int32())]
            if evidence:
                columns += [pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])
        use.memo.clear()  # the worker lives on
        use.known.clear()

    return kept.mapInArrow(run, schema)


def held_out(plan: ToxicityPlan = ToxicityPlan()):
    """Column: whether a document's id is in the fold that nothing is learnt from (null id: not)."""
    return F.coalesce(crc_fold("doc_id", plan.folds) == plan.held_out, F.lit(False)).alias("held_out")
