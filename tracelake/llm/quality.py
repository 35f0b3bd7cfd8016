"""Quality classifier: random-indexing word vectors and a two-layer network.

A word's parts and their shapes are symbols, numbered by hash.  Each number has
a sparse ternary index vector; a symbol's vector adds up the index vectors of
its neighbours in all documents, scaled, plus its own.  A document is the mean
of its symbols' vectors and, over runs of 64 symbols, the largest and smallest
value of each component.  A hidden layer and a logistic output are trained with
numpy; a temperature fitted on rows set aside calibrates the probabilities.

Word vectors cover every document and every word.  The network is fitted on at
most ``examples`` labelled rows (by hash of the id).
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import Scratch
from tracelake.llm.text import chunks, crc_fold, extended

_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_RUN = 64
#: Runs whose vectors are added up at once.
_RUNS = 256
#: Numbers of symbols; words that share one share a vector.
NUMBERS = 1 << 14
#: Numbers whose neighbours are counted by pair.
FREQUENT = 64


@dataclass(frozen=True)
class QualityPlan:
    examples: int = 12_000
    size: int = 48
    nonzero: int = 6
    window: int = 2
    hidden: int = 24
    epochs: int = 60
    rate: float = 0.004
    decay: float = 1e-3
    seed: int = 11
    threshold: float = 0.3
    folds: int = 5
    held_out: int = 0


def shape(part: str) -> str:
    """Class of a part of a word."""
    if part[0].isdigit():
        return f"<digits{min(len(part), 6)}>"
    if not part[0].isalpha():
        return f"<sign{min(len(part), 4)}>"
    case = "upper" if len(part) > 1 and part.isupper() else "title" if part[0].isupper() else "lower" if part.islower() else "mixed"
    return f"<{case}{min(len(part) // 4, 5)}>"


def symbols(word: str) -> list[str]:
    """Parts of a word (letters in lower case), each with its shape."""
    return [x for p in _PARTS.findall(word) for x in (p.lower(), shape(p))]


def number(symbol: str) -> int:
    return xxhash.xxh3_64_intdigest(symbol.encode()) & (NUMBERS - 1)


REPEAT = number("<repeat>")
_OTHER = 1 << 62  # marks a word of other than two numbers
_shape_number = lru_cache(maxsize=None)(number)  # shapes are few
_LOWER = [number(shape("a" * (4 * k + 1))) for k in range(6)]
_SIGNS = ".,;:!?#$%&*|"


@lru_cache(maxsize=4096)
def _sign_numbers(signs: str) -> tuple[int, int]:
    return number(signs), _shape_number(shape(signs))


def numbers(word: str) -> tuple[int, ...]:
    """Numbers of a word's symbols; words of letters, with signs after them or not, which are most, need no pattern."""
    if word.isalpha():
        if word.islower():
            return number(word), _LOWER[min(len(word) // 4, 5)]
        return number(word.lower()), _shape_number(shape(word))
    letters = word.rstrip(_SIGNS)
    if letters.isalpha():
        return *numbers(letters), *_sign_numbers(word[len(letters) :])
    return tuple(n for p in _PARTS.findall(word) for n in (number(p.lower()), _shape_number(shape(p))))


class _Memo(dict):
    """A word as one whole number: its two numbers, which most words have; others are marked, with where theirs stand in ``others`` and how many."""

    def __init__(self):
        super().__init__()
        self.others = array("i")

    def clear(self) -> None:
        super().clear()
        self.others = array("i")

    def __missing__(self, word: str) -> int:
        found = numbers(word)
        if len(found) == 2:
            code = found[0] << 14 | found[1]
        else:
            code = _OTHER | len(self.others) << 31 | len(found)
            self.others.extend(found)
        self[word] = code
        return code


class Words:
    """Numbers of symbols; remembered by word up to a bound."""

    def __init__(self):
        self.memo = _Memo()

    def of(self, text: str | None) -> np.ndarray:
        """Numbers of a text's symbols; a word like the one before it is one REPEAT."""
        return self.of_all(pa.array([text], pa.string()))[0]

    def of_all(self, texts: pa.StringArray) -> list[np.ndarray]:
        """The same of each text; distinct words are numbered once."""
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        split = pc.utf8_split_whitespace(texts)  # cuts as str.split does, with an empty word at either end that is blank
        coded = split.flatten().dictionary_encode()
        place, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
        codes = np.fromiter(map(memo.__getitem__, words.tolist()), np.int64, len(words))
        others = np.array(memo.others, np.int32)
        firsts = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy()))
        same = np.zeros(len(place), bool)
        same[1:] = place[1:] == place[:-1]
        same[firsts[firsts < len(place)]] = False  # the word before belongs to another text
        same &= (words != "")[place]
        marked = codes >= _OTHER
        many = np.where(marked, codes & 0x7FFFFFFF, 2)[place]
        ends = np.append(0, np.cumsum(np.where(same, 1, many)))
        starts = ends[:-1]
        out = np.empty(ends[-1], np.int32)
        other = marked[place]
        two = ~(same | other)
        other &= ~same
        at, pairs = starts[two], codes[place[two]]
        out[at], out[at + 1] = pairs >> 14, pairs & (NUMBERS - 1)
        out[starts[same]] = REPEAT
        many = many[other]
        along = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(starts[other], many) + along] = others[np.repeat((codes[place[other]] ^ _OTHER) >> 31, many) + along]
        return [out[a:b] for a, b in pairwise(ends[firsts].tolist())]


def index_vectors(plan: QualityPlan) -> tuple[np.ndarray, np.ndarray]:
    """(components, signs) of the entries of each number's index vector."""
    rng = np.random.default_rng(plan.seed)
    return rng.random((NUMBERS, plan.size)).argsort(axis=1)[:, : plan.nonzero], rng.choice([-1.0, 1.0], (NUMBERS, plan.nonzero))


def neighbour_sums(texts: list[np.ndarray], components: np.ndarray, signs: np.ndarray, plan: QualityPlan) -> np.ndarray:
    """For each number the sum of the index vectors of its neighbours within ``window``, over whole texts (whole numbers)."""
    gap = np.full(plan.window, NUMBERS, np.int32)  # stands between texts and has no entries
    ids = np.concatenate([x for t in texts for x in (t, gap)] or [gap])
    vectors = np.zeros((NUMBERS + 1, plan.size))
    np.put_along_axis(vectors[:NUMBERS], components, signs, axis=1)
    # neighbours of the most frequent numbers (shapes, for the most part) are counted by pair, which is one addition for all components
    often = np.argsort(np.bincount(ids, minlength=NUMBERS + 1)[:NUMBERS])[-FREQUENT:]
    rank = np.full(NUMBERS + 1, -1)
    rank[often] = np.arange(FREQUENT)
    ranks = rank[ids]
    counts = np.zeros((NUMBERS + 1) * FREQUENT)
    total = np.zeros((NUMBERS + 1) * plan.size)
    for k in range(1, plan.window + 1):
        x, y, p, q = ids[:-k], ids[k:], ranks[:-k], ranks[k:]
        for other, of in ((x, q), (y, p)):
            some = of >= 0
            counts += np.bincount(other[some].astype(np.int64) * FREQUENT + of[some], minlength=len(counts))
        rare = (p < 0) & (q < 0) & (x < NUMBERS) & (y < NUMBERS)
        x, y = x[rare], y[rare]
        for one, two in ((x, y), (y, x)):
            at = one.astype(np.int64) * plan.size
            for j in range(plan.nonzero):
                total += np.bincount(at + components[:, j][two], signs[:, j][two], len(total))
    total, counts = total.reshape(-1, plan.size), counts.reshape(-1, FREQUENT)
    total += counts @ vectors[often]
    counts[often] = 0  # both of a pair are frequent: added from either side above
    total[often] += counts.T @ vectors
    return total[:NUMBERS]


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest run means, and the logarithm of the length."""
    return pooled_all([ids], vectors)[0]


def pooled_all(texts: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """The same of each text, in a row."""
    out = np.zeros((len(texts), 3 * vectors.shape[1] + 1))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    some = np.flatnonzero(lengths)
    if not len(some):
        return out
    lengths = lengths[some]
    rest = lengths % _RUN
    runs = lengths // _RUN + np.where((rest >= _RUN // 2) | (lengths < _RUN), np.minimum(rest, 1), 0)  # a short rest goes with the run before it
    ids = np.concatenate([texts[k] for k in some])
    first = np.cumsum(runs) - runs
    starts = (np.arange(runs.sum()) - np.repeat(first, runs)) * _RUN + np.repeat(np.cumsum(lengths) - lengths, runs)
    sums = np.empty((len(starts), vectors.shape[1]))
    for a in range(0, len(starts), _RUNS):
        b = min(a + _RUNS, len(starts))
        stop = len(ids) if b == len(starts) else starts[b]
        sums[a:b] = np.add.reduceat(vectors.take(ids[starts[a] : stop], axis=0, mode="clip"), starts[a:b] - starts[a], axis=0)
    means = sums / np.diff(np.append(starts, len(ids)))[:, None]
    out[some] = np.hstack([np.add.reduceat(sums, first) / lengths[:, None], np.maximum.reduceat(means, first), np.minimum.reduceat(means, first), np.log1p(lengths)[:, None]])
    return out


@dataclass
class Network:
    """relu hidden layer, logistic output, temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, plan: QualityPlan) -> Network:
    """Adam on the logistic loss; every fifth row only sets the temperature."""
    rng = np.random.default_rng(plan.seed)
    aside = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    tx, ty = x[~aside], y[~aside]
    net = Network(tx.mean(axis=0), tx.std(axis=0) + 1e-3, rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], plan.hidden)), np.zeros(plan.hidden), rng.normal(0, np.sqrt(1 / plan.hidden), plan.hidden), 0.0)
    z = np.clip((tx - net.mean) / net.scale, -8, 8)
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    epochs = max(plan.epochs // 2, min(400, 90_000 // max(1, len(z))))
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for a in range(0, len(z), 128):
            k = order[a : a + 128]
            h = np.maximum(z[k] @ values[0] + values[1], 0)
            d = (1 / (1 + np.exp(-np.clip(h @ values[2] + values[3][0], -50, 50))) - ty[k]) / len(k)
            dh = np.outer(d, values[2]) * (h > 0)
            grads = [z[k].T @ dh + plan.decay * values[0], dh.sum(axis=0), h.T @ d + plan.decay * values[2], np.array([d.sum()])]
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= plan.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(values[3][0])
    if aside.any():
        logits, target = net.logits(x[aside]), y[aside]
        loss = lambda t: float(np.mean(np.logaddexp(0, logits / t) - target * logits / t))
        net.temperature = min((float(t) for t in np.geomspace(0.25, 8, 61)), key=loss)
    return net


@dataclass
class QualityModel:
    plan: QualityPlan
    vectors: np.ndarray | None
    network: Network | None
    rate: float

    def scores(self, texts: pa.StringArray, words: Words) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.rate)
        return self.network.probabilities(pooled_all(words.of_all(texts), self.vectors))


def fit(docs: DataFrame, labels: DataFrame, plan: QualityPlan = QualityPlan()) -> QualityModel:
    """Fit on rows of ``labels(doc_id, quality)`` outside the held-out fold.

    Rows with a null id or label are left out; an id that repeats counts once,
    good if any of its rows is, with the first of its texts in their order.  With labels of one kind only, or none, every
    score is their rate (0.5 for none).
    """
    scratch = Scratch(docs.sparkSession, "quality")
    sample = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", plan.folds) != plan.held_out))
    sample = sample.groupBy("doc_id").agg(F.max((F.col("quality") > 0).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(plan.examples)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most plan.examples rows of 16 bytes
    rows = scratch.table(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "sample")
    components, signs = index_vectors(plan)
    names = [f"v{k}" for k in range(plan.size)]

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros((NUMBERS, plan.size))
        for part in chunks(batches):
            total += neighbour_sums(words.of_all(part.column(0)), components, signs, plan)
        hit = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(hit), *(pa.array(total[hit, k], pa.float32()) for k in range(plan.size))], names=["word", *names])

    near = docs.select("text").mapInArrow(context, "word long, " + ", ".join(f"{n} float" for n in names)).groupBy("word").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # at most NUMBERS rows
    vectors = np.zeros((NUMBERS, plan.size))
    np.put_along_axis(vectors, components, signs / np.sqrt(plan.nonzero), axis=1)
    if len(near):
        sums = near[names].to_numpy(np.float64)
        vectors[near["word"].to_numpy()] += sums / np.maximum(1e-9, np.sqrt((sums**2).sum(axis=1, keepdims=True)))
    vectors = vectors.astype(np.float32)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in chunks(batches):
            got = pooled_all(words.of_all(part.column(1)), vectors).tolist()
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(2), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    made = rows.select("doc_id", "text", "y").mapInArrow(pool, "doc_id long, y int, x array<double>").toPandas().sort_values(["doc_id"], kind="stable")
    scratch.clear(keep=[])
    rng = np.random.default_rng(plan.seed)
    made = made.iloc[rng.permutation(len(made))]
    y = made["y"].to_numpy(np.float64)
    rate = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < rate < 1:
        return QualityModel(plan, None, None, rate)
    return QualityModel(plan, vectors, train(np.array(made["x"].tolist()), y, plan), rate)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with score and predicted for every whole text (null or empty: as a text without words); columns of these names are replaced."""
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use, words = shared.value, Words()
        for part in chunks(batches):
            got = use.scores(part.column(part.schema.get_field_index("text")), words)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got), pa.array((got >= use.plan.threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, extended(kept.schema, "score double, predicted int"))


def held_out(plan: QualityPlan = QualityPlan()):
    """Column: whether a document's id is in the fold that nothing is learnt from (null id: not)."""
    return F.coalesce(crc_fold("doc_id", plan.folds) == plan.held_out, F.lit(False)).alias("held_out")
