"""Filter audit, packing and conversation repair against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers as files
import pytest
from tokenizers import Tokenizer

from tracelake.llm import conversations, filter_audit, packing

SPACE = " \t\n\x0b\f\r"


# --- filter audit -------------------------------------------------------------


def failures(rows):
    """Set of failed filters of each (doc_id, text, lang) row."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = t.encode().split()
        out.append({"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t]})
    return out


def audit_by_hand(rows, labels):
    failed = failures(rows)
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    out, shapley = [], Counter()
    for part in sorted({lang or "" for _, _, lang in rows}):
        own = [(i, f) for (i, _, lang), f in zip(rows, failed, strict=True) if (lang or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                shapley[part, x] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None)])
    return sorted([*r, shapley[r[0], r[1][r[2] - 1]]] for r in out)


def audit_rows():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    rows = [(0, None, "en"), (1, "", None), (2, "", ""), (3, " \n\t ", "en"), (4, "A" * 50_000, "de"), (5, "\x1c \xa0 #", "en"), (None, "", "en"), (None, "same", "en"), (7, "same", "en"), (7, "same", "en"), (8, "same", "de"), (7, "other", "fr"), (9, "x " * 100, "fr")]
    for k in range(120):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([50, 99, 100, 101, 150])))
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.2:
            t += " 5%"
        rows.append((20 + k, t if rng.random() < 0.6 else rng.choice(rows)[1], rng.choice(["en", "de", None, "a'b"])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 140, 3), 21, 21, None]]
    return rows, labels


def test_filter_audit(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, 1, True, 0) for r in rows], "doc_id long, text string, lang string, n long, A boolean, key long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    report = filter_audit.order_report(filter_audit.audit(docs, table), list(filter_audit.FILTERS))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert report.columns == columns
    assert sorted(map(list, report.collect())) == audit_by_hand(rows, labels)
    assert filter_audit.order_report(filter_audit.audit(docs.limit(0), table.limit(0)), list("ABCDE")).count() == 0
    assert filter_audit.audit(docs, table.limit(0)).count() == len({r[2] or "" for r in rows})


def test_interactions(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    joint = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], frozenset(r["filters"])): r for r in filter_audit.interactions(joint, list("ABCDE")).collect()}
    failed = [(lang or "", {x for x in f if f[x]}) for (_, _, lang), f in zip(rows, failures(rows), strict=True)]
    for (part, some), r in got.items():
        own = [f for p, f in failed if p == part]
        assert r["joint"] == sum(some <= f for f in own)
        assert r["exactly"] == sum(some == f for f in own)
        assert r["survivors"] == sum(not some & f for f in own)
    for part in {p for p, _ in got}:  # dividends of the subsets of a set add up to what the set removes
        total = sum(r["dividend"] for (p, _), r in got.items() if p == part)
        assert total == sum(bool(f) for p, f in failed if p == part)


# --- packing ------------------------------------------------------------------


def best_two_fit(lengths, capacity):
    """One sequence at a time over a plain list."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], capacity
        for n in list(left):
            if n <= gap:
                own.append(n)
                left.remove(n)
                gap -= n
        if gap:
            room = gap + own[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if own[-1] < a + b <= room]
            if pairs:
                _, a, b = max(pairs)
                left.remove(a)
                left.remove(b)
                left.append(own.pop())
                left.sort(reverse=True)
                own += [a, b]
        out.append(sorted(own, reverse=True))
    return out


@pytest.mark.parametrize(("seed", "capacity", "many"), [(1, 50, 60), (2, 50, 200), (3, 20, 150), (4, 100, 90), (5, 31, 1), (6, 64, 250)])
def test_plan_packs_as_one_sequence_at_a_time(seed, capacity, many):
    rng = random.Random(seed)
    top = rng.choice([capacity, capacity // 2, capacity // 3 + 1])
    lengths = [rng.randrange(1, top + 1) for _ in range(many)] + [capacity] * 3
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = packing.plan(counts, capacity)
    want = best_two_fit(lengths, capacity)
    got = defaultdict(list)
    for n in range(1, capacity + 1):
        ranks = np.arange(counts[n])
        if len(ranks):
            for s, o in zip(*(x.tolist() for x in plan.place(np.full(len(ranks), n), ranks)), strict=True):
                got[s].append((o, n))
    assert plan.sequences == len(want) == len(got)
    assert sorted(sorted((n for _, n in g), reverse=True) for g in got.values()) == sorted(want)
    for g in got.values():
        at = 0
        for o, n in sorted(g):
            assert o == at
            at += n
        assert at <= capacity


def test_plan_is_as_small_for_large_counts():
    rng = np.random.default_rng(3)
    shape = rng.integers(0, 200, 2049)
    shape[0] = 0
    small, large = packing.plan(shape), packing.plan(shape * 1_000_000)
    assert len(large.length) < 4 * len(small.length) and large.sequences <= small.sequences * 1_000_000 * 1.001
    assert large.sequences * 2048 < 1.02 * 1_000_000 * int((shape * np.arange(2049)).sum()) + 2048
    assert packing.plan(np.zeros(2049, np.int64)).sequences == 0


def test_pack(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "same text", "same text", "é" * 300, "word " * 9000, "<|endoftext|> x", "\U0001f600 x\x1c y"] + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(1, 900))) for _ in range(80)]
    rows = [(k if k % 7 else None, t, k, "x") for k, t in enumerate(texts)] + [(3, "again 3", 1, "y"), (3, "again 3", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, piece string")
    path, capacity = files.path("byte_bpe_50k.json"), 256
    tokenizer = Tokenizer.from_file(path)
    packed = packing.pack(docs, path, capacity=capacity, by_word=True)
    got = packed.collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        start = 0
        lengths = [len(ids)] if len(ids) <= capacity else [len(ids) % capacity] * (len(ids) % capacity > 0) + [capacity] * (len(ids) // capacity)
        for piece, n in enumerate(lengths):
            want[i, piece, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
            start += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    assert len(bins) == len(best_two_fit([r["length"] for r in got], capacity))
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in got:
        at = 4 * r["offset"]
        assert bytes(whole[r["sequence_id"]]["ids"])[at : at + 4 * r["length"]] == bytes(r["ids"])
    assert packing.pack(docs.limit(0), path, by_word=True).count() == 0


# --- conversations ------------------------------------------------------------


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        which = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if which == 1:
            text = ""
        if which == 2:
            text = "".join(c for c in text if c not in ".!?")
        if which == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(which, 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def cheapest(own):
    """(cost, edits, repaired rows) by searching backwards with whole strings; up to four inserts in a row."""
    seen, fates = set(), []
    for _, _, role, text in own:
        body = text.strip(SPACE)
        fates.append("gone" if not body or (role, text) in seen else "cut" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {(len(own), q, 4): (0, "", ()) if q in ("", "a") else None for q in ("", "s", "u", "a")}

    def least(i, q, inserts):
        if (i, q, inserts) in best:
            return best[i, q, inserts]
        found = []

        def add(cost, label, rest, out=None):
            if rest is not None:
                found.append((cost + rest[0], label + rest[1], ((out,) if out else ()) + rest[2]))

        if i == len(own):
            if q in ("", "a"):
                found.append((0, "", ()))
        else:
            _, _, role, text = own[i]
            more = fates[i] == "cut"
            add(3, "D", least(i + 1, q, 0))
            if fates[i] != "gone":
                if (q, role[:1]) in legal:
                    add(more, "K", least(i + 1, role[:1], 0), (role, text))
                for r in ("user", "assistant"):
                    if (q, r[0]) in legal:
                        add(2 + more, "R", least(i + 1, r[0], 0), (r, text))
        if inserts < 4:
            for r in ("user", "assistant"):
                if (q, r[0]) in legal:
                    add(2, "I", least(i, r[0], inserts + 1), (r, ""))
        best[i, q, inserts] = min(found) if found else None
        return best[i, q, inserts]

    return least(0, "", 0)


def audit_of(own):
    own, seen, faults = in_order(own), set(), Counter()
    for _, _, role, text in own:
        body = text.strip(SPACE)
        faults["blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""] += 1
        seen.add((role, text))
    turns = [r[1] for r in own if r[1] is not None]
    cost, edits, rows = cheapest(own)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, digest), rows


def conversation_rows(seed, many):
    rng = random.Random(seed)
    rows = [(None, None, None, None), (None, 3, "user", "x."), (900, None, "user", "a."), (900, None, None, "b."), (901, 0, "", ""), (902, 0, "system", "only."), (903, 0, "upper", "u."), (903, 1, "Assistant", "A."), (904, 5, "user", "\x1c"), (905, 1, "user", "same."), (905, 1, "user", "same."), (905, 1, "assistant", "tie.")]
    for conv in range(many):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn + (turn > 3), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool"]), rng.choice(["Yes.", "No!", "Cut off", "", " \n", "é? ", "Yes.", "Well, no. x", None])))
    return rows


@pytest.mark.parametrize("block", [conversations.BLOCK, 1, 3])
def test_conversation_repair(spark, block):
    rows = conversation_rows(13, 150 if block > 3 else 40)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, part long, edits string")
    after = damaged(rows)
    got_damage = [tuple(r) for r in conversations.damage(df).collect()]
    assert Counter(got_damage) == Counter(after)
    by = defaultdict(list)
    for r in after:
        by[r[0]].append(r)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_audit(conversations.damage(df), df, block).collect()}
    want = {c: audit_of(by[c]) for c in {r[0] for r in rows}}
    assert got == {c: w[0] for c, w in want.items()}
    out = defaultdict(list)
    for r in conversations.repaired_rows(conversations.damage(df), block).collect():
        out[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    assert {c: [x[1:] for x in sorted(v)] for c, v in out.items()} == {c: list(w[1]) for c, w in want.items() if w[1]}


def test_long_conversation_in_blocks(spark):
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(400)}" + rng.choice([".", ""])) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    a, b = (conversations.repair_audit(df, df, n).collect() for n in (64, 5000))
    assert a == b and len(a) == 1
    r = a[0]
    assert r["cost"] == sum({"I": 2, "R": 2, "D": 3, "K": 0}[e] for e in r["audit"]) + sum(0 if rows[i][3].endswith(".") else 1 for i, e in enumerate(r["audit"].replace("I", "")) if e != "D")
    assert len(conversations.Front.memo) < 2000


def test_conversations_of_empty_tables(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair_audit(conversations.damage(df), df).count() == 0 and conversations.repaired_rows(df).count() == 0
    one = spark.createDataFrame([(5,)], "conv_id long")
    assert tuple(conversations.repair_audit(df, one).first()) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
