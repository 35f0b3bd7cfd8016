"""Null and repeated ids, repeated rows, clashing column names, and the stages of the pipeline against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as files
import pytest
import tokenizers

import corpus_pipeline
from tests.llm.test_llm import EDGE, _components, shingles, table
from tracelake.llm import bpe, bwt_dedup, embed_dedup, mixing, ngram_join, quality, suffix_tree_lm, token_files, toxicity

#: Names that operators use inside.
CLASHES = ["_at", "_w", "_bits", "at", "word", "mask", "rid", "rid2", "cut_rid", "firsts", "lasts", "_uses", "uses", "nth_use", "of_source", "last_places", "_source", "_ends", "_first", "key", "row", "t1", "t2", "stays", "comp"]


def documents(spark, rows):
    """(doc_id, text, source) rows with more columns whose names clash."""
    more = ", ".join(f"`{c}` long" for c in CLASHES)
    return spark.createDataFrame([(*r, *([7] * len(CLASHES))) for r in rows], f"doc_id long, text string, source string, n_chars int, {more}")


def near(rng, words, n):
    return [rng.choice(words) for _ in range(n)]


def test_ngram_join_with_null_and_repeated_ids(spark):
    a = [f"w{k}" for k in range(60)]
    b, c = a[:-1] + ["x"], a[:-2] + ["y", "z"]
    other, third = [f"v{k}" for k in range(60)], [f"z{k}" for k in range(60)]
    rows = [(1, a), (None, b), (2, c), (5, other), (5, a), (None, other), (None, other[:-1] + ["q"]), (9, None), (None, None), (1, a), (None, third), (None, third)]
    texts = [None if w is None else " ".join(w) for _, w in rows]
    sets = [shingles(t, 5) for t in texts]
    label = _components(len(rows), lambda i, j: sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    least = {}
    for k, g in enumerate(label):
        ids = [rows[i][0] for i in range(len(rows)) if label[i] == g and rows[i][0] is not None]
        least[k] = min(ids, default=None)
    docs = documents(spark, [(i, t, None, 0) for (i, _), t in zip(rows, texts, strict=True)])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(docs).collect())
    assert got == Counter((rows[k][0], len(sets[k]), least[k]) for k in range(len(rows)))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    # a stays with the smallest id, the other group keeps id 5, rows without words stay
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:2]) for r in kept.collect()) == sorted([("1", "w0"), ("5", "v0"), ("9", ""), ("None", ""), ("None", "z0")])


def test_ngram_join_of_many_near_copies(spark):
    """Groups with a common prefix, groups in one bucket, and pairs that only members far from a leader have."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(30)]
    base = [near(rng, words, 80) for _ in range(2)]
    rows = []
    for k in range(260):
        t = list(base[k % 2])
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            t[rng.randrange(len(t))] = f"u{rng.randrange(12)}"
        rows.append((k, " ".join(t)))
    for n, num in ((3, 9), (5, 8), (1, 7)):
        sets = [shingles(t, n) for _, t in rows]
        want = _components(len(rows), lambda i, j, s=sets, m=num: 10 * len(s[i] & s[j]) >= m * len(s[i] | s[j]))
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.similarity_components(table(spark, rows), n, num / 10).collect()}
        assert got == dict(enumerate(want))


def test_embeddings_with_repeated_ids(spark):
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(1, 0, at(0)), (1, 0, at(90)), (2, 0, at(92)), (3, 0, at(1)), (None, 1, at(10)), (4, 1, at(0)), (6, 1, at(20)), (8, 2, at(0)), (8, 2, at(0))]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 2, 4, False), (4, 1, 4, True), (6, 1, 4, False), (8, 1, 8, True), (8, 1, 8, True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_dedup_texts(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = text(260)
    rows = [(1, text(30) + shared + text(30)), (2, shared[20:] + text(300)), (None, text(50) + shared), (3, text(400)), (3, text(400)), (4, "twice " * 60), (5, None), (6, ""), (7, "short"), (7, "short"), (8, text(20_000) + shared + text(90_000))]
    docs = documents(spark, [(i, t, "s", 0) for i, t in rows])
    seen = Counter(d[i : i + 200] for _, t in rows if (d := (t or "").encode()) for i in range(len(d) - 199))
    want = []
    for key, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        want.append((str(key), None if t is None else bytes(x for x, g in zip(d, gone[:-1], strict=True) if not g).decode(errors="ignore")))
    got = bwt_dedup.dedup_texts(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, ((str(r["doc_id"]), r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_mixing_keeps_columns_of_any_name(spark):
    docs = documents(spark, [(i, "w " * (i % 7), "ab"[i % 2], 0) for i in range(60)] + [(None, "w w", None, 0)])
    got = mixing.mixed_documents(docs)
    assert got.schema == docs.schema and {r["at"] for r in got.collect()} == {7}


def test_classifiers_take_repeated_ids_and_odd_columns(spark):
    rng = random.Random(1)
    bad, good = ["vile", "hateful", "scum"], ["calm", "kind", "plain", "river", "stone"]
    rows = [(k, " ".join(near(rng, good, 20) + (near(rng, bad, 3) if k % 3 == 0 else []))) for k in range(240)]
    rows += [(0, "calm kind"), (0, "vile scum"), (None, "vile")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows if k is not None] + [(None, 1)], "doc_id long, y int").selectExpr("doc_id", "y AS toxic", "1 - y AS quality")
    docs = documents(spark, [(i, t, None, 0) for i, t in rows])
    for module in (toxicity, quality):
        one, two = (sorted(((str(r["doc_id"]), r["text"], round(r["score"], 9), r["at"]) for r in module.score(d, module.fit(d, labels)).collect()), key=str) for d in (docs, docs.repartition(5)))
        assert one == two


def test_toxicity_votes_against_brute_force(spark):
    rng = random.Random(3)
    bad, good = ["vile", "hateful", "scum", "rot", "filth"], [f"calm{k}" for k in range(30)]
    rows = [(k, " ".join(near(rng, good, 12) + (near(rng, bad, 1 + k % 4) if k % 3 == 0 else near(rng, bad, 1) if k % 10 == 1 else []))) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    index, plan = model.index, model.plan
    dense = np.zeros((index.n, len(index.place)))
    for t, (places, weights) in enumerate(zip(index.place, index.weight, strict=True)):
        dense[places, t] = weights
    assert index.n > 50
    for r in toxicity.score(table(spark, rows), model, evidence=True).collect():
        query = model.vector(model.counts(r["text"])) if model.counts(r["text"]) else {}
        cosines = dense @ np.array([query.get(t, 0.0) for t in range(dense.shape[1])])
        best = np.lexsort((np.arange(index.n), -np.round(cosines, 9)))[: plan.neighbours]
        best = best[cosines[best] > 0]
        assert np.allclose(r["cosines"], cosines[best], atol=1e-6) and r["neighbours"] == index.ids[best].tolist()
        votes = 1 / (1.05 - np.minimum(cosines[best], 1))
        want = (votes @ index.labels[best] + plan.shrink * model.rate) / (votes.sum() + plan.shrink) if len(best) else model.bare_rate
        assert np.isclose(r["score"], want) and r["predicted"] == int(want >= plan.threshold)


def test_word_vectors_against_brute_force():
    plan = quality.QualityPlan(size=16, nonzero=3)
    components, signs = quality.index_vectors(plan)
    dense = np.zeros((quality.NUMBERS, plan.size))
    for n in range(quality.NUMBERS):
        for c, s in zip(components[n], signs[n], strict=True):
            dense[n, c] += s
    words = quality.Words()
    texts = [words.of(t) for t in ("one two three two", "", "a", "A-1 b,b b b c", None)]
    want = np.zeros_like(dense)
    for ids in texts:
        for i in range(len(ids)):
            for j in range(max(0, i - plan.window), min(len(ids), i + plan.window + 1)):
                if i != j:
                    want[ids[i]] += dense[ids[j]]
    assert (quality.neighbour_sums(texts, components, signs, plan) == want).all() and want.any()
    assert words.of("b b b").tolist().count(quality.REPEAT) == 2
    for w in ("plain", "a", "Title", "UPPER", "mIxed", "été", "ß", "x1", "12", "a.b", "_", "x²", "\u0345", "ªb", "longerwordthanmost"):
        assert list(quality.numbers(w)) == [quality.number(x) for x in quality.symbols(w)], w


def test_library_ids_as_the_library_gives_them(spark):
    path = files.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|> y  z"), (4, "<|endoftext"), (5, None), (None, "null id"), (7, "a b"), (7, "a b")]
    folder, manifest = token_files.write_token_files(documents(spark, [(i, t, None, 0) for i, t in rows]), path, by_word=True)
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_file_digest(folder, manifest).collect())
    want = Counter()
    for key, t in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[key, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert got == want


def _tree(rows, plan):
    """Scores by a suffix tree of nested dictionaries, as the module describes it."""
    docs = {key: [*(t or "").encode().lower().split(), None] for key, t in rows}
    train = [w for key, w in docs.items() if key is None or zlib.crc32(str(key).encode()) % plan.folds != plan.held_out]
    count = [Counter(tuple(w[i : i + k]) for w in train for i in range(len(w) - k + 1)) for k in range(1, plan.order + 2)]
    total, distinct = sum(count[0].values()), len(count[0])
    fine = lambda s: all(count[len(s[i:]) - 1][s[i:]] >= plan.least for i in range(len(s))) and all(count[len(s[:i]) - 1][s[:i]] >= plan.least for i in range(1, len(s)))
    counted = lambda context, w: count[0][(w,)] >= plan.least and count[len(context) - 1][context] >= plan.least and usable(context)

    def usable(context):
        """A context whose words, each after those before it, were all counted."""
        return len(context) == 1 or (usable(context[:-1]) and count[len(context) - 2][context[:-1]] >= plan.least and count[0][context[-1:]] >= plan.least)

    base = lambda w: (count[0][(w,)] + plan.add) / (total + plan.add * (distinct + 1))
    retained = {}

    def probability(before, w, depth):
        if not depth or len(before) < depth:
            return base(w) if not depth else probability(before, w, depth - 1)
        context = tuple(before[len(before) - depth :])
        shorter = probability(before, w, depth - 1)
        if context not in retained:
            return shorter
        times, s, kinds = retained[context]
        c = count[depth][(*context, w)] if counted(context, w) else 0
        return (c + (times - s + kinds) * shorter) / (times + kinds)

    for depth in range(1, plan.order + 1):
        followers = defaultdict(set)
        for w in train:
            for i in range(depth, len(w)):
                followers[tuple(w[i - depth : i])].add(w[i])
        for context, after in followers.items():
            times = count[depth - 1][context]
            if times < plan.least or not usable(context):
                continue
            known = {w: count[depth][(*context, w)] for w in after if counted(context, w)}
            if not known:
                continue
            s, kinds = sum(known.values()), len(known)
            gained = sum(c * (np.log(c - 1) - np.log(probability(list(context), w, depth - 1))) for w, c in known.items() if c > 1)
            s2 = sum(c for c in known.values() if c > 1)
            gained += -s2 * np.log(times + kinds) + ((times - s2) * np.log((times - s + kinds) / (times + kinds)) if times > s2 else 0)
            if gained >= plan.gain * times:
                retained[context] = (times, s, kinds)
    score = {key: sum(np.log10(probability(w[:i], w[i], plan.order)) for i in range(len(w))) for key, w in docs.items()}
    return score, retained


@pytest.mark.parametrize("order", [1, 2, 3])
def test_suffix_tree_scores(spark, order):
    rng = random.Random(4)
    rows = list(EDGE) + [(20 + k, " ".join(rng.choice(["a b", "b c", "c a", "d", f"r{rng.randrange(400)}"]) for _ in range(80))) for k in range(200)]
    plan = suffix_tree_lm.TreePlan(order=order)
    want, retained = _tree(rows, plan)
    assert any(len(c) == min(order, 2) for c in retained)
    for r in suffix_tree_lm.score(table(spark, rows), plan).collect():
        assert np.isclose(r["score"], want[r["doc_id"]], rtol=1e-9), (r, want[r["doc_id"]])


def test_suffix_tree_grows_with_the_corpus(spark):
    contexts = []
    for n in (60, 600):
        rng = random.Random(2)
        rows = [(k, " ".join(f"w{(j := rng.randrange(n))} v{j}" for _ in range(200))) for k in range(n)]
        contexts.append(len(_tree(rows, suffix_tree_lm.TreePlan(order=1))[1]))
        assert suffix_tree_lm.score(table(spark, rows), suffix_tree_lm.TreePlan(order=1)).count() == n
    assert contexts[1] > 5 * contexts[0]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, over a small folder with its own labels."""
    rng = random.Random(8)
    mild = [f"{a}{b}" for a in ("sun", "tree", "lake", "hill", "moss", "fern", "dew", "oak") for b in ("", "s", "let", "side", "land", "ful", "like", "ward")]
    vile = ["zorkscum", "vilegrub", "hatespew", "rotfilth"]
    rows = []
    for k in range(160):
        words = near(rng, mild, 60)
        if k % 4 == 1:
            for _ in range(6):
                words[rng.randrange(60)] = rng.choice(vile)
        rows.append((k, " ".join(words), "en", "abc"[k % 3], 0))
    passage = " ".join(near(rng, mild, 70))
    rows += [(200 + k, " ".join(near(rng, mild, 40)) + " " + passage, "en", "a", 0) for k in range(3)]
    rows += [(300, rows[2][1], "en", "b", 0), (301, rows[2][1] + " end", "en", None, 0), (302, None, "en", "c", 0), (303, "", "en", "c", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 1)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.createDataFrame(rows, schema), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = [tuple(r) for r in docs.collect()]
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r[0] for r in kept[name]}
    toxic = {r[0] for r in rows if any(v in (r[1] or "") for v in vile)}
    assert ids("toxicity") == {r[0] for r in rows} - toxic
    left = [r for r in rows if r[0] in ids("toxicity")]
    sets = [shingles(r[1], 5) for r in left]
    groups = _components(len(left), lambda i, j: sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))
    assert ids("ngram_join") == {left[g][0] for g in groups} and len(kept["ngram_join"]) == len(set(groups))
    seen = Counter(d[i : i + 200] for r in kept["ngram_join"] if (d := (r[1] or "").encode()) for i in range(len(d) - 199))
    for r in kept["ngram_join"]:
        d = (r[1] or "").encode()
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        text = None if r[1] is None else bytes(b for b, g in zip(d, gone[:-1], strict=True) if not g).decode(errors="ignore")
        assert (r[0], text) in {(x[0], x[1]) for x in kept["bwt_dedup"]}
    assert any(passage[100:300] in (r[1] or "") for r in kept["ngram_join"]) and not any(passage[100:300] in (r[1] or "") for r in kept["bwt_dedup"])
    uses = Counter(r[0] for r in kept["source_mixing"])
    before = spark.read.parquet(f"{tmp_path}/out-bwt_dedup")
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) for r in mixing.taken_words(before).collect() if r["taken"]}
    assert uses == taken
    own = bpe.codec(files.path("byte_bpe_multi_50k.tiktoken"), files.PATTERN)
    for r in kept["byte_bpe"]:
        assert list(r[5]) == np.frombuffer(own.encode(r[1] or ""), "<u4").tolist()
