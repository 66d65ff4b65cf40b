"""Repair of conversations' structure by the cheapest edits, reconstructed in linear space."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Costs. Deleting is required for blank and repeated turns; a truncated turn that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A block of turns: what one task holds at once, or one turn.
BLOCK_TURNS, BLOCK_BYTES = 16_384, 8 << 20
BLANKS = " \t\n\x0b\x0c\r"
#: States of `(s?(ua)+)?`: at the start, after the system turn, after a user's, after an assistant's. What a turn of user or assistant leads to.
STATES, _ACCEPTED = range(4), {0: 0, 3: 0}
_NEXT = {(0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3, (0, "s"): 1}
_WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
NO_WAY = 1 << 60
NAMES = {"u": "user", "a": "assistant"}


def _inserted(state: int, n: int) -> int:
    for _ in range(n):
        state = _NEXT[state, _WANTED[state]]
    return state


#: What it takes to end in an accepted state, by turns that are inserted last.
_ENDS = {p: min((INSERT * k, "I" * k) for k in range(3) if _inserted(p, k) in _ACCEPTED) for p in STATES}


@functools.cache
def _turn(kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """For one turn the cheapest edits that lead from state p to q, of equal ones the least in ASCII: (p, q) to (cost, edits).

    kind: the role's initial (s, u, a, else x), in upper case if the turn is truncated; d if it must go. Edits are I for each turn
    inserted before it, and then D, K or R; no such word begins another.
    """
    cost, out = TRUNCATED * kind.isupper(), {}
    for p in STATES:
        for k in range(3):
            at, before = _inserted(p, k), INSERT * k
            ways = [(at, before + DELETE, "D")]
            if kind != "d":
                ways.append((_NEXT[at, _WANTED[at]], before + REROLE + cost, "R"))
                if (at, kind.lower()) in _NEXT:
                    ways.append((_NEXT[at, kind.lower()], before + cost, "K"))
            for q, c, letter in ways:
                out[p, q] = min(out.get((p, q), (NO_WAY, "")), (c, "I" * k + letter))
    return out


@functools.cache
def _step(kind: str) -> list[tuple[int, int, int, int]]:
    """A turn as (p, q, cost, rank): rank is the place of its edits among all that begin in p."""
    ways = _turn(kind)
    rank = {p: sorted(e for (a, _), (_, e) in ways.items() if a == p) for p in STATES}
    return [(p, q, c, rank[p].index(e)) for (p, q), (c, e) in ways.items()]


Vector = list[tuple[int, int]]


def _forward(vector: Vector, step: list[tuple[int, int, int, int]]) -> Vector:
    """For every state what it costs to come there, and the rank of its audit among the states'.

    No audit of as many turns begins another, so the first edit in which two differ decides, and ranks carry that on.
    """
    best: list = [(NO_WAY, 0, 0)] * 4
    for p, q, cost, rank in step:
        if vector[p][0] < NO_WAY:
            best[q] = min(best[q], (vector[p][0] + cost, vector[p][1], rank))
    order = sorted({b[1:] for b in best if b[0] < NO_WAY})
    return [(b[0], order.index(b[1:])) if b[0] < NO_WAY else (NO_WAY, 0) for b in best]


def _backward(costs: list[int], step: list[tuple[int, int, int, int]]) -> list[int]:
    """For every state what it costs from there to the end."""
    out = [NO_WAY] * 4
    for p, q, cost, _ in step:
        out[p] = min(out[p], costs[q] + cost)
    return out


def _at(state: int) -> Vector:
    return [(0, 0) if p == state else (NO_WAY, 0) for p in STATES]


def _crossing(forward: Vector, backward: list[int]) -> int:
    """The state in which the cheapest ways cross, of equal ones the one whose audit is least."""
    return min((f[0] + b, f[1], q) for q, (f, b) in enumerate(zip(forward, backward, strict=True)) if f[0] < NO_WAY)[2]


def _hirschberg(kinds: str, p: int, q: int) -> str:
    """The audit of turns from state p to q: vectors from both ends meet in the middle, then each half for itself."""
    if len(kinds) < 2:
        return _turn(kinds)[p, q][1] if kinds else ""
    middle = len(kinds) // 2
    forward, backward = _at(p), [0 if s == q else NO_WAY for s in STATES]
    for kind in kinds[:middle]:
        forward = _forward(forward, _step(kind))
    for kind in reversed(kinds[middle:]):
        backward = _backward(backward, _step(kind))
    between = _crossing(forward, backward)
    return _hirschberg(kinds[:middle], p, between) + _hirschberg(kinds[middle:], between, q)


def audit(kinds: str, entry: int = 0, end: int | None = None) -> str:
    """The cheapest edits of turns of these kinds, least in ASCII of equal ones; without `end`, those that end a conversation."""
    return _known_audit(kinds, entry, end) if len(kinds) <= 32 else _audit(kinds, entry, end)


@functools.lru_cache(1 << 16)
def _known_audit(kinds: str, entry: int, end: int | None) -> str:
    """Short conversations are often alike."""
    return _audit(kinds, entry, end)


def _audit(kinds: str, entry: int, end: int | None) -> str:
    if end is not None:
        return _hirschberg(kinds, entry, end)
    forward = _at(entry)
    for kind in kinds:
        forward = _forward(forward, _step(kind))
    end = _crossing(forward, [_ENDS[q][0] for q in STATES])
    return _hirschberg(kinds, entry, end) + _ENDS[end][1]


def _numbered(most_turns: int, most_bytes: int):
    """Numbers sorted turns (at) and deals them to blocks, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        block, turns, size = at, 0, 0
        for batch in batches:
            lengths = pc.add(pc.binary_length(batch.column("text")), pc.binary_length(batch.column("role"))).to_pylist()
            blocks = []
            for n in lengths:
                if turns and (turns >= most_turns or size + n > most_bytes):
                    block, turns, size = block + 1, 0, 0
                turns, size = turns + 1, size + n
                blocks.append(block)
            numbers = pa.array(range(at, at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers, pa.array(blocks, pa.int64())], [*batch.schema.names, "at", "block"])

    return run


def _segments(turns: pa.Table, repeated: pa.Table) -> pa.Table:
    """A block's turns as one row for each conversation in it, with a letter for every turn's kind."""
    turns, again = turns.sort_by("at"), set(repeated.column("at").to_pylist())
    rows: list[list] = []
    for conv, at, initial, blank, truncated in zip(*(turns.column(c).to_pylist() for c in ("conv_id", "at", "initial", "blank", "truncated")), strict=True):
        kind = "d" if blank or at in again else (initial.upper() if truncated else initial)
        if not rows or rows[-1][0] != conv:
            rows.append([conv, turns.column("block")[0].as_py(), []])
        rows[-1][2].append(kind)
    conv, block, kinds = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.table([pa.array(conv, pa.int64()), pa.array(block, pa.int64()), pa.array(["".join(k) for k in kinds], pa.string())], names=["conv_id", "block", "kinds"])


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment what it costs from each state to each, with ranks: 16 numbers of each kind, -1 where there is no way."""
    for batch in batches:
        costs, ranks = [], []
        for kinds in batch.column("kinds").to_pylist():
            vectors = [_at(p) for p in STATES]
            for kind in kinds:
                vectors = [_forward(v, _step(kind)) for v in vectors]
            costs.append([c if c < NO_WAY else -1 for v in vectors for c, _ in v])
            ranks.append([r for v in vectors for _, r in v])
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), pa.array(costs, kind), pa.array(ranks, kind)], ["conv_id", "block", "costs", "ranks"])


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states in which a conversation enters and leaves each of its segments. A conversation's transfers are held at once, 32 numbers a block."""
    held: list[tuple[int, list]] = []
    owner = None

    def solved() -> pa.RecordBatch:
        forward, backward = [_at(0)], [[_ENDS[q][0] for q in STATES]]
        for _, step in held:
            forward.append(_forward(forward[-1], step))
        for _, step in reversed(held):
            backward.append(_backward(backward[-1], step))
        states = [_crossing(f, b) for f, b in zip(forward, reversed(backward), strict=True)]
        ends = [*states[1:-1], None]
        columns = [pa.array([owner] * len(held), pa.int64()), pa.array([b for b, _ in held], pa.int64()), pa.array(states[:-1], pa.int32()), pa.array(ends, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "block", "entry", "leaves"])

    for batch in batches:
        for conv, block, costs, ranks in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "costs", "ranks")), strict=True):
            if held and conv != owner:
                yield solved()
                held.clear()
            owner = conv
            held.append((block, [(k // 4, k % 4, c, r) for k, (c, r) in enumerate(zip(costs, ranks, strict=True)) if c >= 0]))
    if held:
        yield solved()


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [audit(k, 0 if p is None else p, q) for k, p, q in zip(*(batch.column(c).to_pylist() for c in ("kinds", "entry", "leaves")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("conv_id"), pa.array([p or 0 for p in batch.column("entry").to_pylist()], pa.int32()), batch.column("kinds"), pa.array(found, pa.string())], ["block", "conv_id", "entry", "kinds", "audit"])


SCHEMA = "conv_id long, at long, step int, turn long, edit string, fault string, was string, role string, text string"


def _edited(turns: pa.Table, plans: pa.Table) -> pa.Table:
    """A block's turns with their edits, and the inserted ones before (or, at a conversation's end, after) them."""
    turns = turns.sort_by("at")
    audits = {c: (p, k, a) for c, p, k, a in zip(*(plans.column(n).to_pylist() for n in ("conv_id", "entry", "kinds", "audit")), strict=True)}
    convs, roles = turns.column("conv_id").to_pylist(), turns.column("role").to_pylist()
    source, steps, edits, faults, given = [], [], [], [], []
    i = 0
    while i < len(convs):
        state, kinds, letters = audits[convs[i]]
        k, step = 0, 0
        for letter in letters:
            at = min(k, len(kinds) - 1)
            if letter == "I" or letter == "R":
                wanted = _WANTED[state]
                state, role = _NEXT[state, wanted], NAMES[wanted]
            else:
                role = roles[i + at]
                if letter == "K":
                    state = _NEXT[state, kinds[at].lower()]
            source.append(i + at)
            steps.append(step)
            edits.append(letter)
            given.append(role)
            step += 1
            if letter == "I":
                faults.append(None)
            else:
                faults.append("d" if kinds[at] == "d" else "truncated" if kinds[at].isupper() else None)
                k, step = k + 1, 0 if k + 1 < len(kinds) else step
        i += len(kinds)
    rows = turns.take(pa.array(source, pa.int64()))
    new = pa.array([e == "I" for e in edits], pa.bool_())
    edit, fault = pa.array(edits, pa.string()), pa.array(faults, pa.string())
    fault = pc.if_else(pc.equal(fault, "d").fill_null(False), pc.if_else(rows.column("blank").combine_chunks(), "blank", "duplicate"), fault)
    none, text, turn = pa.scalar(None, pa.string()), rows.column("text").combine_chunks(), rows.column("turn").combine_chunks()
    columns = [rows.column("conv_id"), rows.column("at"), pa.array(steps, pa.int32()), pc.if_else(new, pa.scalar(None, pa.int64()), turn), edit, fault]
    columns += [pc.if_else(new, none, rows.column("role").combine_chunks()), pa.array(given, pa.string()), pc.if_else(new, "", text)]
    return pa.table(columns, names=[f.split()[0] for f in SCHEMA.split(", ")])


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def repaired(conversations: DataFrame, block_turns: int = BLOCK_TURNS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The turns of conversations (conv_id, turn, role, text) with the cheapest edits that give roles `(system? (user assistant)+)?`.

    Returns per turn conv_id, at and step (a conversation's rows are in order by both), turn, edit (K kept, R given another role, D deleted, I
    inserted; of an inserted one turn and was are null, the text is empty), fault (blank, duplicate, truncated or null: the first that
    holds), was (its role), role (the repaired one; a deleted turn's own) and text.

    Turns are ordered by turn (nulls first), role, text. A role counts by its first letter (s, u, a; others have none). Blank: nothing but
    white space; duplicate: role and text were there before in the conversation; both must be deleted (2). Truncated: the last
    character that isn't white space is none of `.!?`; it costs 5 more if it stays. Keeping costs 0, another role 1, inserting 5. Of equally cheap
    audits (the edits' letters in order) the least in ASCII is taken.

    A conversation of any length is dealt over blocks of bounded size by a range sort. A block's part of it
    is a transfer matrix between the four states of the pattern; vectors over those matrices from both ends meet at each
    block's edges, then inside blocks at each middle (Hirschberg), so no table of all costs is held. One conversation's matrices,
    32 numbers a block, are held by one task. Repeated turns are found by a join on digests, not by group.

    A null role or text is empty; rows with a null conv_id are one conversation; repeated rows are duplicates. Other columns aren't
    read. An empty table gives an empty result.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32), F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    initial, bare = F.substring("role", 1, 1), _bare(F.col("text"))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial")
    # What is asked of a turn's texts later is worked out once; only edits and digests read the texts again.
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    dealt = dealt.select("conv_id", "turn", "role", "text", initial, (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.unhex(said).alias("print"))
    schema = "conv_id long, turn long, role string, text string, initial string, blank boolean, truncated boolean, print binary, at long, block long"
    turns = cut(dealt.mapInArrow(_numbered(block_turns, block_bytes), schema), "turns")
    kinds = turns.select("block", "conv_id", "at", "initial", "blank", "truncated")
    prints = turns.select(F.struct("conv_id", "print").alias("print"), "block", "at")
    first = prints.groupBy("print").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("print", "first")
    repeated = cut(prints.join(first, "print").where("at > first").select("block", "at"), "repeated")
    segments = cut(kinds.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_segments, "conv_id long, block long, kinds string"), "segments")
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    long = segments.groupBy(F.col("conv_id").alias("_conv")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    transfers = segments.join(long, same, "left_semi").mapInArrow(_transfers, "conv_id long, block long, costs array<long>, ranks array<long>")
    crossings = transfers.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_crossings, "conv_id long, block long, entry int, leaves int")
    crossings = cut(crossings.withColumnsRenamed({"conv_id": "_conv", "block": "_block"}), "crossings")
    plans = segments.join(crossings, (F.col("block") == F.col("_block")) & same, "left").select("conv_id", "block", "kinds", "entry", "leaves")
    plans = cut(plans.mapInArrow(_audited, "block long, conv_id long, entry int, kinds string, audit string"), "audits")
    for old in (repeated, segments, crossings):
        drop(old)
    return turns.select("block", "conv_id", "turn", "role", "text", "blank", "at").groupBy("block").cogroup(plans.groupBy("block")).applyInArrow(_edited, SCHEMA)


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in AUDIT.split(", ")]
    rows: list[tuple] = []
    owner, state = None, None

    def row() -> tuple:
        gaps = state["high"] - state["low"] + 1 - state["turns"] if state["turns"] else 0
        return (owner, gaps, *(state[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(state["audit"]), state["sha"].hexdigest())

    def written() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k < 7 else pa.string()) for k, v in enumerate(zip(*rows, strict=True))], names)
        rows.clear()
        return out

    for batch in batches:
        for conv, turn, edit, fault, was, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "fault", "was", "role", "text")), strict=True):
            if state is None or conv != owner:
                if state:
                    rows.append(row())
                owner = conv
                state = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0) | {"low": None, "high": None, "last": None, "audit": [], "sha": hashlib.sha256(), "said": False}
            state["audit"].append(edit)
            state["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if fault:
                state[fault] += 1
            if edit != "I":
                if turn is not None and turn != state["high"]:
                    state["low"] = turn if state["low"] is None else state["low"]
                    state["high"], state["turns"] = turn, state["turns"] + 1
                if state["last"] is not None and (state["last"], was[:1]) not in _LEGAL:
                    state["illegal"] += 1
                state["last"] = was[:1]
            if edit != "D":
                state["sha"].update(f"{chr(10) if state['said'] else ''}{role}:{text}".encode())
                state["said"] = True
        if rows:
            yield written()
    if state:
        rows.append(row())
        yield written()


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation of repaired(): conv_id, gaps (numbers missing between the least and the largest turn), counts of blank, duplicate
    and truncated turns, illegal (neighbours that aren't system user, user assistant or assistant user), cost, audit (all edits' letters) and repaired_sha256 (of
    `role:text` of all that stay, joined by newlines). Turns stream through the task that has the conversation; what it holds is the audit."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "at", "step").mapInArrow(_summed, AUDIT)
