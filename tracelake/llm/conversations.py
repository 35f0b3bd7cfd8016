"""Conversation structure repair by weighted finite-state composition.

Three machines are composed, lazily, into one:

* the input acceptor: a conversation's rows in order, each as a symbol of what
  the costs depend on (initial of the role, whether it must go, truncated);
* the edit transducer: keep (K), rerole to user or assistant (R), delete (D),
  insert a user or assistant row (I), with costs;
* the grammar acceptor of role initials ``(s?(ua)+)?`` with the states START,
  AFTER_S, AFTER_U, AFTER_A; START and AFTER_A accept.

Weights are (cost, label string), ordered by cost and then the string; times is
(sum, concatenation), plus is the minimum.  The composed machine has no useful
cycle: inserts cost something and two in a row reach all states, so arcs are
taken a row at a time, at most two inserts and then what becomes of the row, and
the shortest path follows the rows in topological order.  Strings are never
compared as such: two paths to the same row that differ do so before either ends
(an edit string settles its output roles, and both end with an edit of the row),
so it is enough to keep the order among the at most four states.  What follows
from (order and differences of costs, symbol) is kept, which makes a lazily
determinised machine with few states.

A conversation is cut into blocks of rows.  A block is a 4 x 4 matrix of weights
between grammar states; products of these run over the blocks of a conversation
in order, with four backpointers a block, and each block then finds its own part
of the path.  No task holds a conversation's rows, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.scratch import Scratch, partitions_for
from tracelake.llm.text import extended

START, AFTER_S, AFTER_U, AFTER_A = range(4)
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Rows of a block at most.
BLOCK = 1024
#: First faults of a row.
NONE, BLANK, DUPLICATE, CUT = range(4)

_WORD = r"[^\x20\x09-\x0D]"
_INITIALS = "sua"


# --- grammar, edits and their composition -----------------------------------


def after(state: int, initial: str) -> int | None:
    """State of the grammar acceptor after a role initial; None if it has no such arc."""
    if initial == "s":
        return AFTER_S if state == START else None
    if initial == "u":
        return None if state == AFTER_U else AFTER_U
    if initial == "a":
        return AFTER_A if state == AFTER_U else None
    return None


def due(state: int) -> str:
    """Role that a rerole or insert gives in this state."""
    return "assistant" if state == AFTER_U else "user"


def tail(state: int) -> tuple[int, str]:
    """(cost, inserts) from a state at the end of a conversation to an accepting one."""
    return {START: (0, ""), AFTER_A: (0, ""), AFTER_U: (INSERT, "I"), AFTER_S: (2 * INSERT, "II")}[state]


def symbol(kind: int, fate: int) -> int:
    """A row as a symbol of the input acceptor; kind: 0, or 1 + place of the role's initial in "sua"."""
    return 3 * kind + (2 if fate in (BLANK, DUPLICATE) else 1 if fate == CUT else 0)


def row_arcs(sym: int) -> dict[int, dict[int, tuple[int, str]]]:
    """state -> state -> least (cost, labels) over one row with the inserts before it."""
    kind, fate = divmod(sym, 3)
    initial = _INITIALS[kind - 1] if kind else ""
    stay = TRUNCATED if fate == 1 else 0
    out: dict[int, dict[int, tuple[int, str]]] = {}
    for first in range(4):
        found: dict[int, tuple[int, str]] = {}

        def reach(state: int | None, cost: int, labels: str, found=found) -> None:
            if state is not None and (state not in found or (cost, labels) < found[state]):
                found[state] = cost, labels

        state = first
        for inserts in range(3):
            cost, labels = INSERT * inserts, "I" * inserts
            reach(state, cost + DELETE, labels + "D")
            if fate != 2:
                reach(after(state, initial), cost + stay, labels + "K")
                reach(after(state, due(state)[0]), cost + REROLE + stay, labels + "R")
            state = after(state, due(state)[0])
        out[first] = found
    return out


ARCS = [row_arcs(sym) for sym in range(12)]

#: Inserts that lead from one state to another, for bounds on useful costs.
_STEPS = {(START, AFTER_U): 1, (START, AFTER_A): 2, (AFTER_S, AFTER_U): 1, (AFTER_S, AFTER_A): 2, (AFTER_U, AFTER_A): 1, (AFTER_A, AFTER_U): 1}


def useful(costs: dict[int, int]) -> set[int]:
    """States that some least path may still use.

    A state that another one reaches by inserts for less is of no use.  AFTER_A
    does all that AFTER_S does, and all that START does but for a kept first
    system row, which it deletes instead.
    """
    dear = {b for (a, b), n in _STEPS.items() if a in costs and b in costs and costs[b] > costs[a] + n * INSERT}
    if AFTER_A in costs:
        dear |= {b for b, more in ((START, DELETE), (AFTER_S, 0)) if b in costs and costs[b] > costs[AFTER_A] + more}
    return set(costs) - dear


class Front:
    """Weights of the paths that end at a row boundary, relative to the least cost: ((state, cost), ..) from the least string to the greatest."""

    memo: dict[tuple, tuple] = {}

    @classmethod
    def step(cls, front: tuple, sym: int) -> tuple[int, tuple, dict[int, tuple[int, str]]]:
        """(cost to add, next front, state -> (state before, labels))."""
        found = cls.memo.get((front, sym))
        if not found:
            found = cls.memo[front, sym] = cls._step(front, sym)
        return found

    @staticmethod
    def _step(front: tuple, sym: int) -> tuple[int, tuple, dict[int, tuple[int, str]]]:
        best: dict[int, tuple[int, int, str, int]] = {}
        for order, (state, cost) in enumerate(front):
            for to, (more, labels) in ARCS[sym][state].items():
                weight = (cost + more, order, labels, state)
                if to not in best or weight < best[to]:
                    best[to] = weight
        kept = useful({s: w[0] for s, w in best.items()})
        low = min(best[s][0] for s in kept)
        ranked = sorted(kept, key=lambda s: best[s][1:3])
        return low, tuple((s, best[s][0] - low) for s in ranked), {s: (best[s][3], best[s][2]) for s in kept}


def block_matrix(symbols: bytes) -> tuple[list[int], list[int]]:
    """Of a block, for each state before and after: cost (-1: no useful path), and place of the path's string among those from the same state."""
    costs, orders = [-1] * 16, [0] * 16
    for first in range(4):
        front, total = ((first, 0),), 0
        for sym in symbols:
            more, front, _ = Front.step(front, sym)
            total += more
        for order, (state, cost) in enumerate(front):
            costs[4 * first + state], orders[4 * first + state] = total + cost, order
    return costs, orders


def block_path(symbols: bytes, first: int, last: int) -> list[str]:
    """Labels of each row on the least path of a block between two states."""
    front, back = ((first, 0),), []
    for sym in symbols:
        _, front, pointers = Front.step(front, sym)
        back.append(pointers)
    out, state = [], last
    for pointers in reversed(back):
        state, labels = pointers[state]
        out.append(labels)
    return out[::-1]


def product(front: list[tuple[int, int]], costs: list[int], orders: list[int]) -> tuple[list[tuple[int, int]], bytes]:
    """A front, (state, cost) from the least string on, times a block's matrix; with the state before for each state."""
    best: dict[int, tuple[int, int, int, int]] = {}
    for order, (state, cost) in enumerate(front):
        for to in range(4):
            more = costs[4 * state + to]
            weight = (cost + more, order, orders[4 * state + to], state)
            if more >= 0 and (to not in best or weight < best[to]):
                best[to] = weight
    ranked = sorted(best, key=lambda s: best[s][1:3])
    return [(s, best[s][0]) for s in ranked], bytes(best[s][3] if s in best else 0 for s in range(4))


# --- conversations -----------------------------------------------------------


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(``conv_id:turn``) % 20.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats
    the row with the same turn, 4 sets the role user.  A null id or turn counts
    as one space in that string, a null role or text is one space; id and turn
    themselves stay null.
    """
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    which = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    base = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), which.alias("which")).where("which <> 0")
    copies = F.explode(F.when(F.col("which") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return base.select(
        "conv_id",
        "turn",
        F.when(F.col("which") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("which") == 1, F.lit("")).when(F.col("which") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy"),
    ).drop("copy")


def _numbered(rows: DataFrame, block: int) -> DataFrame:
    """Sorted rows with part, block and at: the task, the block of one conversation in it and the row in that, in order of the conversation.

    Right only as written: write it before use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at, now = TaskContext.get().partitionId(), -1, 0, object()
        for batch in batches:
            numbers, places = [], []
            for conv in batch.column(0).to_pylist():
                if conv != now or at + 1 >= block:
                    now, number, at = conv, number + 1, 0
                else:
                    at += 1
                numbers.append(number)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int64()), pa.array(numbers, pa.int64()), pa.array(places, pa.int32())], names=[*batch.schema.names, "part", "block", "at"])

    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    parts = partitions_for(rows.sparkSession)
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, extended(rows.schema, "part long, block long, at int"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [block_matrix(x) for x in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["conv_id", "part", "block", "costs", "orders"])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted blocks: the state of the least path before and after each, and the inserts at the conversation's end."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, blocks in groupby(rows(), key=lambda r: r[0]):
        front, back, keys = [(START, 0)], bytearray(), []
        for _, part, number, costs, orders in blocks:
            front, before = product(front, costs, orders)
            back += before
            keys.append((part, number))
        _, _, state = min((cost + tail(s)[0], order, s) for order, (s, cost) in enumerate(front))
        end, out = tail(state)[1], []
        for i in range(len(keys) - 1, -1, -1):
            first = back[4 * i + state]
            out.append((*keys[i], first, state, end))
            state, end = first, ""
            if len(out) == 4096 or not i:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.string())], names=["part", "block", "first", "last", "end"])
                out = []


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, part, number, symbols, fates, first, last, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            path = block_path(symbols, first, last)
            path[-1] += end
            rows += [(conv, part, number, at, fate, labels) for at, (fate, labels) in enumerate(zip(fates, path, strict=True))]
        if rows:
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.column(0).type), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.int32()), pa.array(c[5], pa.string())], names=["conv_id", "part", "block", "at", "fate", "edits"])


def _blocks(numbered: DataFrame) -> DataFrame:
    """(conv_id, part, block, symbols, fates): a row for each block; first faults need the whole conversation only for duplicates."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    word = F.col("text").rlike(_WORD)
    cut = ~F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(~word, BLANK).when(cut, CUT).otherwise(NONE)
    light = numbered.select("conv_id", "part", "block", "at", kind.alias("kind"), fault.alias("fault"), F.unhex(F.sha2("text", 256)).alias("digest"), "role")
    # the first of each role and text; the minimum is taken before rows move, so a text repeated without end is no burden
    firsts = light.where(F.col("fault") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min(F.struct("part", "block", "at")).alias("p"))
    marks = light.select("part", "block", "conv_id", F.struct("at", "kind", "fault").alias("m")).unionByName(firsts.select("p.part", "p.block", "conv_id", F.struct(F.col("p.at").alias("at"), F.lit(-1).alias("kind"), F.lit(0).alias("fault")).alias("m")))
    grouped = marks.groupBy("part", "block").agg(F.max("conv_id").alias("conv_id"), F.collect_list("m").alias("marks"))  # at most 2 * BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, fates = [], []
            for marks in batch.column(3).to_pylist():
                first = {m["at"] for m in marks if m["kind"] < 0}
                rows = sorted((m["at"], m["kind"], m["fault"]) for m in marks if m["kind"] >= 0)
                fate = [f if f == BLANK or at in first else DUPLICATE for at, _, f in rows]
                fates.append(fate)
                symbols.append(bytes(symbol(k, f) for (_, k, _), f in zip(rows, fate, strict=True)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(symbols, pa.binary()), pa.array(fates, pa.list_(pa.int32()))], names=["conv_id", "part", "block", "symbols", "fates"])

    kind_of = numbered.schema["conv_id"].dataType.simpleString()
    return grouped.select("conv_id", "part", "block", "marks").mapInArrow(run, f"conv_id {kind_of}, part long, block long, symbols binary, fates array<int>")


def _in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """All rows of a conversation in one task, in order; they stream through it."""
    return rows.repartition(partitions_for(rows.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *keys)


def _edited(rows: DataFrame, block: int) -> DataFrame:
    """(conv_id, part, block, at, kind, turn, role, text, fate, edits): for each row of a conversation its edits (kind 0) and the row itself (kind 1)."""
    scratch = Scratch(rows.sparkSession, "conversations")
    numbered = scratch.table(_numbered(rows, block), "rows")
    blocks = scratch.table(_blocks(numbered), "blocks")
    id_type = numbered.schema["conv_id"].dataType.simpleString()
    matrices = blocks.select("conv_id", "part", "block", "symbols").mapInArrow(_matrices, f"conv_id {id_type}, part long, block long, costs array<long>, orders array<int>")
    states = _in_order(matrices, "part", "block").mapInArrow(_states, "part long, block long, first int, last int, end string")
    edits = blocks.join(states, ["part", "block"]).select("conv_id", "part", "block", "symbols", "fates", "first", "last", "end").mapInArrow(_edits, f"conv_id {id_type}, part long, block long, at int, fate int, edits string")
    turn_type = numbered.schema["turn"].dataType.simpleString()
    both = edits.select("conv_id", "part", "block", "at", F.lit(0).alias("kind"), F.lit(None).cast(turn_type).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "fate", "edits").unionByName(
        numbered.select("conv_id", "part", "block", "at", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("int").alias("fate"), F.lit(None).cast("string").alias("edits"))
    )
    return both


def _outputs(state: int, edits: str, role: str, text: str) -> tuple[int, list[tuple[str, str, str]]]:
    """State after the edits of a row, and the rows (edit, role, text) that they put out."""
    out = []
    for edit in edits:
        if edit == "D":
            continue
        kept = role if edit == "K" else due(state)
        out.append((edit, kept, "" if edit == "I" else text))
        state = after(state, kept[0])
    return state, out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def repaired_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of every repaired conversation; a conversation of which nothing is left has none.

    ``rows`` (conv_id, turn, role, text) are taken by turn, nulls first; rows of
    one turn by role and text.  Null roles and texts are one space.  Null ids
    are one conversation.  Extra columns are dropped.
    """
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    id_type = plain.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            c = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[0], kind), pa.array(c[1], pa.int64()), *[pa.array(c[k], pa.string()) for k in (2, 3, 4)]], names=["conv_id", "place", "edit", "role", "text"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield batch

        for conv, own in groupby(_stream(typed()), key=lambda r: r[0]):
            state, place, edits = START, 0, ""
            for _, _, _, _, which, _, role, text, _, got in own:
                if which == 0:
                    edits = got
                    continue
                state, out = _outputs(state, edits, role, text)
                for edit, r, t in out:
                    held.append((conv, place, edit, r, t))
                    place += 1
                if len(held) >= 2000:
                    yield flush()
        if held:
            yield flush()

    return _in_order(_edited(plain, block), "part", "block", "at", "kind").mapInArrow(run, f"conv_id {id_type}, place long, edit string, role string, text string")


def repair_audit(rows: DataFrame, every: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each ``conv_id`` of ``every``.

    ``rows`` as in ``repaired_rows``.  Counts and gaps are of the rows as given,
    audit and cost of the cheapest repair, the digest of the repaired lines
    ``role:text``.  A conversation without rows has zeros, an empty audit and
    the digest of the empty string.  Rows of a conversation stream through one
    task in order, as the digest needs; of them only the audit string grows.
    """
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    id_type = plain.schema["conv_id"].dataType.simpleString()
    lone = every.select("conv_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held = None, []

        def flush() -> pa.RecordBatch:
            c = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[0], kind), *[pa.array(c[k], pa.int64()) for k in range(1, 7)], pa.array(c[7], pa.string()), pa.array(c[8], pa.string())], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield batch

        for conv, own in groupby(_stream(typed()), key=lambda r: r[0]):
            faults, illegal, cost, audit, state, lines = [0] * 4, 0, 0, [], START, 0
            least = greatest = turn_before = before = None
            turns, sha, edits, fate = 0, hashlib.sha256(), "", NONE
            for _, _, _, _, which, turn, role, text, own_fate, got in own:
                if which < 0:
                    continue
                if which == 0:
                    fate, edits = own_fate, got
                    continue
                faults[fate] += 1
                cost += sum({"I": INSERT, "R": REROLE, "D": DELETE}.get(e, 0) for e in edits) + (TRUNCATED if fate == CUT and "D" not in edits else 0)
                audit.append(edits)
                illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
                before = role[:1]
                if turn is not None:
                    least, greatest, turns, turn_before = turn if least is None else least, turn, turns + (turn != turn_before), turn
                state, out = _outputs(state, edits, role, text)
                for _, r, t in out:
                    sha.update((("\n" if lines else "") + r + ":" + t).encode())
                    lines += 1
            gaps = 0 if least is None else greatest - least + 1 - turns
            held.append((conv, gaps, *faults[1:], illegal, cost, "".join(audit), sha.hexdigest()))
            if len(held) >= 1000:
                yield flush()
        if held:
            yield flush()

    edited = _edited(plain, block)
    empty = lone.select(F.col("conv_id").cast(id_type), F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("at"), F.lit(-1).alias("kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in edited.schema.fields[5:]])
    return _in_order(edited.unionByName(empty), "part", "block", "at", "kind").mapInArrow(run, f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
