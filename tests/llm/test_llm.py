"""Operators of the llm subpackage against brute force, and their edge cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as files
import pytest
import tiktoken

from tracelake.llm import bpe, bwt_dedup, embed_dedup, media, mixing, ngram_join, quality, suffix_tree_lm, token_files, toxicity

RANKS = files.path("byte_bpe_multi_50k.tiktoken")
EDGE = [(0, None), (1, ""), (2, " \n\t"), (3, "a"), (4, "same text here"), (5, "same text here"), (6, "é" * 300), (7, "word " * 5000), (8, "\U0001f600 x\x1c y")]


def table(spark, rows):
    """With more columns, some of them named like results."""
    return spark.createDataFrame([(i, t, None if i % 2 else "s", i) for i, t in rows], "doc_id long, text string, source string, score long")


def test_rank_queue_orders():
    q = bpe.RankQueue(50_000)
    entries = [(random.Random(k).randrange(50_000), k) for k in range(500)]
    for r, p in entries:
        q.push(r, p)
    got = []
    while q.top:
        got.append(q.pop())
    assert got == sorted(entries)


def test_bpe(spark):
    own = bpe.codec(RANKS, files.PATTERN)
    other = tiktoken.Encoding("o", pat_str=files.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["ab" * 20000, "<|endoftext|>"] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x300), rng.randrange(0x2000, 0x3100)])) for _ in range(40)) for _ in range(300)]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == other.encode_ordinary(t)
    rows = {r["doc_id"]: r for r in bpe.round_trip_digest(table(spark, EDGE), RANKS, files.PATTERN).collect()}
    for i, t in EDGE:
        ids = other.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.decode(bpe.encode(table(spark, EDGE), RANKS, files.PATTERN), RANKS, files.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in coded.collect())


def _components(n, linked):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(n)]


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_ngram_join(spark, n, num, den):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(200)]
    base = [[rng.choice(words) for _ in range(rng.choice([15, 60, 150]))] for _ in range(6)]
    rows = list(EDGE)
    for k in range(150):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((20 + k, " ".join(t)))
    sets = [shingles(t, n) for _, t in rows]
    want = _components(len(rows), lambda i, j: sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similarity_components(table(spark, rows), n, num / den).collect()}
    assert got == {rows[i][0]: (len(sets[i]), rows[want[i]][0]) for i in range(len(rows))}
    kept = {r["doc_id"] for r in ngram_join.one_of_each(table(spark, rows), n, num / den).collect()}
    assert kept == {rows[i][0] for i in set(want)}


def test_mixing(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, " ".join("w" * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(900, None, "b")], "doc_id long, text string, source string")
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == 901 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: r["target"] for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1
    for s, t in targets.items():
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - t) <= 0.01 * t + 20
    again = mixing.taken_words(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)
    used = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    assert used == {r["doc_id"]: -(-r["taken"] // r["size"]) for r in rows if r["taken"]}


@pytest.mark.parametrize("most", [4096, 2])
def test_bwt_dedup(spark, most):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    base = [text(400) for _ in range(4)]
    rows = list(EDGE) + [(8 + k, x) for k, x in enumerate(["ab" * 200, "b" * 200, "b" * 200], 1)]
    for k in range(50):
        b, i = rng.choice(base), rng.randrange(200)
        t = text(rng.randrange(40)) + b[i : i + rng.randrange(100, 300)] + text(rng.randrange(40))
        rows.append((50 + k, t))
    seen = Counter(d[i : i + 200] for _, t in rows if (d := (t or "").encode()) for i in range(len(d) - 199))
    for r in bwt_dedup.dedup_digest(table(spark, rows), 200, most).collect():
        d = (dict(rows)[r["doc_id"]] or "").encode()
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(d, gone[:-1], strict=True) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(300):
        t = rng.choice(40, 4, replace=False)
        w = rng.random(4) + 0.1
        vectors.append(dict(zip(t.tolist(), (w / np.sqrt(w @ w)).tolist(), strict=True)))
    index = toxicity.BlockMaxIndex(vectors, [0] * 300, list(range(300)), 40, 16)
    for q in vectors[:60]:
        want = sorted((round(sum(w * v.get(t, 0) for t, w in q.items()), 9) for v in vectors), reverse=True)[:10]
        assert np.allclose(index.nearest(q, 10)[1], want)


def test_classifiers(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    tox = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, tox).select("doc_id", toxicity.held_out(), "score", "predicted").join(labels, "doc_id").where("held_out").toPandas()
    assert rows[rows.toxic == 1].predicted.mean() > 0.75 and rows[rows.toxic == 0].predicted.mean() < 0.05
    good = quality.fit(docs, labels)
    rows = quality.score(docs, good).select("doc_id", quality.held_out(), "score", "predicted").join(labels, "doc_id").where("held_out").toPandas()
    assert rows[rows.quality == 1].predicted.mean() > 0.97 and rows[rows.quality == 0].predicted.mean() < 0.2
    for module, model in ((toxicity, tox), (quality, good)):
        scored = module.score(table(spark, EDGE), model).collect()
        assert len(scored) == len(EDGE) and all(0 <= r["score"] <= 1 for r in scored)
        empty = module.fit(docs.limit(0), labels.limit(0))
        assert module.score(table(spark, EDGE), empty).count() == len(EDGE)


def test_media(spark):
    for data in (b"", b"a", b"\xff" * 70 + b"\xfe\x00" * 200, bytes(range(256)) * 40):
        payload = media.pad(data)
        blob = media.write_avi(payload)
        back, avi = media.read_payload(blob)
        assert back == payload and len(payload) % 64 == 0
        at, n = avi.frames[0]
        frame = media._parse_frame(blob[at : at + n])
        plain = media._coefficients(frame)[1].reshape(-1) - 256  # the plain decoder reads the same
        assert plain[: len(payload)].tolist() == list(payload[: plain.size])
    rows = {r["doc_id"]: r for r in media.stored_digest(table(spark, EDGE)).collect()}
    for i, t in EDGE:
        p = media.pad((t or "").encode())
        assert (rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.shots(np.repeat(np.eye(16)[[0, 5, 9]], 6, axis=0)) == [(0, 5), (6, 11), (12, 17)]
    assert media.clips(media.store(table(spark, EDGE))).count() >= len(EDGE)


@pytest.mark.parametrize("tile", [1024, 20])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 16))
    rows = [(k, int(rng.integers(2)), [float(np.float32(x)) for x in centres[rng.integers(5)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.2])]) for k in range(150)]
    rows += [(200, None, rows[0][2]), (201, 1, None), (202, 1, [0.0] * 16), (203, 1, [float("nan")] * 16), (204, 1, [1.0] * 15 + [None]), (205, 1, []), (206, 1, [1.0, 2.0]), (207, 1, [1.0, 2.0])]
    fine = [r[1] is not None and bool(r[2]) and all(x is not None and np.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]

    def linked(i, j):
        if not (fine[i] and fine[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2])):
            return False
        a, b = np.array(rows[i][2]), np.array(rows[j][2])
        return a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98

    roots = _components(len(rows), linked)
    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, tile=tile).collect()}
    assert got == {rows[i][0]: (links[i], rows[roots[i]][0], roots[i] == i) for i in range(len(rows))}


def test_embeddings_with_null_ids_link(spark):
    at = lambda x: [float(np.cos(x)), float(np.sin(x))]
    rows = [(5, 0, at(0)), (None, 0, at(0.15)), (7, 0, at(0.3)), (None, 1, at(0)), (None, 1, at(0)), (9, 2, at(0))]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    want = [(5, 1, 5, True), (None, 2, 5, False), (7, 1, 5, False), (None, 1, None, True), (None, 1, None, True), (9, 0, 9, True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_suffix_tree(spark):
    rng = random.Random(4)
    rows = list(EDGE) + [(20 + k, " ".join(rng.choice(["a b", "b c", "c a", "d"]) for _ in range(80))) for k in range(200)]
    got = suffix_tree_lm.score(table(spark, rows)).toPandas()
    words = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    count = Counter(w for i, x in words.items() if zlib.crc32(str(i).encode()) % 10 for w in x)
    n, v = sum(count.values()), len(count)
    for r in got.itertuples():
        w = words[r.doc_id]
        base = sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert np.isclose(base, r.base_score) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
    held = got[got.held_out & (got.doc_id >= 20)]
    assert held.score.sum() > held.base_score.sum()


def test_suffix_tree_counts_the_same_contexts_at_any_size():
    block = suffix_tree_lm.Block(suffix_tree_lm.Block.code([1], ["a b " * 40], [True], suffix_tree_lm.WordHashes()))
    block.know(block.unigrams(), 10**9, 3, suffix_tree_lm.TreePlan(), 4)
    block.extend()
    assert block.stands.sum() == 80 and block.counted.sum() == 79  # all but the first word; the end occurs once


def test_token_files(spark):
    rng = np.random.default_rng(1)
    ranks = rng.integers(0, 2**32, 1000, dtype=np.uint64).astype(np.uint32) >> rng.integers(0, 32, 1000).astype(np.uint32)
    assert (token_files.unpack(*token_files.pack(ranks), len(ranks)) == ranks).all()
    own = token_files.LibraryEncoder(files.path("byte_bpe_50k.json"), False)
    rng = random.Random(5)
    odd = ["".join(rng.choice("ab é1.,'s\n\t\xa0\u3000\x1c  ") for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert token_files.LibraryEncoder(files.path("byte_bpe_50k.json"), True).encode(odd) == own.encode(odd)
    docs = table(spark, EDGE)
    folder, manifest = token_files.write_token_files(docs, files.path("byte_bpe_50k.json"), by_word=True)
    got, start = {r["doc_id"]: r for r in token_files.token_file_digest(folder, manifest).collect()}, 0
    for i, t in EDGE:
        ids = own.encode([t or ""])[0] + b"\0\0\0\0"
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4


def test_empty_tables(spark):
    docs = table(spark, EDGE).limit(0)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    folder, manifest = token_files.write_token_files(docs, files.path("byte_bpe_50k.json"), by_word=True)
    for df in (bpe.round_trip_digest(docs, RANKS, files.PATTERN), ngram_join.similarity_components(docs), mixing.taken_words(docs), bwt_dedup.dedup_digest(docs), media.stored_digest(docs), suffix_tree_lm.score(docs), embed_dedup.near_duplicates(vectors), token_files.token_file_digest(folder, manifest)):
        assert df.count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"] and rows.count() > 0
