"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, beginning with user.
Dynamic programming over that automaton chooses for each turn whether it stays, is relabelled (``RELABEL``), is merged
into the turn before (``MERGE``), or follows an inserted empty turn (``INSERT``); the cheapest sequence wins, ties by the
order keep, merge, relabel, insert.  The repaired sequence is rendered, one fragment for each input turn: joined in
order, a conversation's fragments are its formatted text.

A conversation may be of any length.  Turns fall into chunks of ``CHUNK`` turn numbers.  A chunk gives a matrix of costs
(state before, state after) under (min, +), a product that groups freely, so chunks of chunks are handled the same way,
level by level, until every conversation is short; then states go back down, and every chunk is repaired on its own.

Rows that are equal in every column count once; turns of one number are ordered by role and text; a null turn comes
first.  Null roles and texts are empty; a role other than system, user, assistant must be relabelled.  Rows without
conv_id are one conversation, whose conv_id is null in the result.  A text's own "<|" would end a turn: a zero-width
space is put between its signs.  Turns of one number, or of none, stay in one chunk however many they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import at_exit, discard, stash

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, MERGE, INSERT = 2.0, 1.0, 3.0
CHUNK, FAN = 256, 1024
FAR = 1e18

#: Turns that may follow each state.
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def _moves() -> dict[int, list[tuple[int, int, float, tuple]]]:
    """For each own role (0: unknown): (before, after, cost, actions) of every way to take a turn."""
    out: dict[int, list] = {}
    for own in range(4):
        ways = []
        for before in range(4):
            for after in (SYSTEM, USER, ASSISTANT):
                price = 0.0 if after == own else RELABEL
                word = "keep" if after == own else "relabel"
                if after in _NEXT[before]:
                    ways.append((before, after, price, (word,)))
                if after == before:
                    ways.append((before, after, price + MERGE, ("merge",)))
                for middle in _NEXT[before]:
                    if after in _NEXT[middle]:
                        ways.append((before, after, price + INSERT, ("insert", ROLES[middle - 1], word)))
        rank = {"keep": 0, "merge": 1, "relabel": 2, "insert": 3}
        ways.sort(key=lambda w: (w[2], rank[w[3][0]]))
        best: dict = {}
        for w in ways:
            best.setdefault((w[0], w[1]), w)
        out[own] = list(best.values())
    return out


MOVES = _moves()


def _own(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state to each state over a run of turns."""
    table = np.full((4, 4), FAR)
    np.fill_diagonal(table, 0.0)
    for r in roles:
        new = np.full((4, 4), FAR)
        for before, after, cost, _ in MOVES[_own(r)]:
            new[:, after] = np.minimum(new[:, after], table[:, before] + cost)
        table = new
    return table


def repair(roles: list[str | None], entry: int = START, leave: int | None = None) -> tuple[float, list[tuple[int, tuple]]]:
    """Cost, and for each turn (state after, actions), from a state to a state (None: the cheapest)."""
    cost, back = [FAR] * 4, []
    cost[entry] = 0.0
    for r in roles:
        new, how = [FAR] * 4, [None] * 4
        for move in MOVES[_own(r)]:
            c = cost[move[0]] + move[2]
            if c < new[move[1]]:
                new[move[1]], how[move[1]] = c, move
        back.append(how)
        cost = new
    state = min(range(4), key=lambda s: (cost[s], s)) if leave is None else leave
    total, out = cost[state], []
    for how in reversed(back):
        before, after, _, actions = how[state]
        out.append((after, actions))
        state = before
    return total, out[::-1]


def route(tables: list[np.ndarray], entry: int, leave: int | None) -> list[int]:
    """States at the end of each of a row of chunks, on the cheapest way."""
    cost, back = np.full(4, FAR), []
    cost[entry] = 0.0
    for m in tables:
        ways = cost[:, None] + m
        back.append(ways.argmin(0))
        cost = ways.min(0)
    state = int(cost.argmin()) if leave is None else leave
    out = []
    for b in reversed(back):
        out.append(state)
        state = int(b[state])
    return out[::-1]


def _groups(batches, keys: int):
    """Runs of rows with equal leading columns of batches sorted by them, as lists of rows."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield key, held
                held, key = [], row[:keys]
            held.append(row)
    if held:
        yield key, held


def _send(rows, names_types, size=5000):
    """Rows as Arrow batches of bounded size."""
    schema = pa.schema(names_types)
    held = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_MATRIX = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("costs", pa.list_(pa.float64()))]
_STATES = [("conv_id", pa.int64()), ("chunk", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("is_first", pa.bool_()), ("is_last", pa.bool_())]


def _compose(batches):
    """Matrices of runs of chunks: (conv_id, chunk // FAN)."""

    def rows():
        for key, group in _groups(batches, 2):
            total = None
            for r in group:
                m = np.array(r[3]).reshape(4, 4)
                total = m if total is None else (total[:, :, None] + m[None]).min(1)
            yield (*key, total.ravel().tolist())

    return _send(rows(), _MATRIX)


def _route_groups(batches):
    """Entry and end states of each chunk of a run whose own entry and end are known (conv_id, up, chunk, costs, entry, leave, first, last)."""

    def rows():
        for key, group in _groups(batches, 2):
            tables = [np.array(r[3]).reshape(4, 4) for r in group]
            entry, leave, first, last = group[0][4:8]
            ends = route(tables, entry, leave)
            for k, (r, end) in enumerate(zip(group, ends)):
                yield (key[0], r[2], entry, end, first and k == 0, last and k == len(group) - 1)
                entry = end

    return _send(rows(), _STATES)


def chunk_states(matrices: DataFrame) -> DataFrame:
    """(conv_id, chunk, entry, leave, is_first, is_last) of matrices (conv_id, chunk, costs), level by level."""
    longest = matrices.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    sort = lambda df: df.repartition("conv_id", "up").sortWithinPartitions("conv_id", "up", "chunk")
    ddl = "conv_id long, chunk long, entry int, leave int, is_first boolean, is_last boolean"
    if longest <= FAN:
        whole = matrices.select("conv_id", F.lit(0).cast("long").alias("up"), "chunk", "costs", F.lit(START).alias("entry"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("first"), F.lit(True).alias("last"))
        return stash(whole.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_route_groups, ddl), "states")
    up = matrices.withColumn("up", F.floor(F.col("chunk") / FAN))
    composed = stash(sort(up.select("conv_id", "up", "chunk", "costs")).mapInArrow(_compose, "conv_id long, chunk long, costs array<double>"), "matrices")
    above = chunk_states(composed)
    known = up.join(above.select("conv_id", F.col("chunk").alias("up"), "entry", "leave", F.col("is_first").alias("first"), F.col("is_last").alias("last")), ["conv_id", "up"])
    out = stash(sort(known.select("conv_id", "up", "chunk", "costs", "entry", "leave", "first", "last")).mapInArrow(_route_groups, ddl), "states")
    discard(composed, above)
    return out


def _escaped(text: str | None) -> str:
    return (text or "").replace("<|", "<​|")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, place, role, action, inserted, rendered) of turns (conv_id, turn, role, text): one row a turn.

    role: after the repair; action: keep, relabel, merge or insert; inserted: role of the empty turn put before, or
    null; place: order among the turns of the chunk.
    """
    clean = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62)))).distinct()
    dealt = lambda df, *more: df.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", *more)

    def matrices(batches):
        return _send(((*key, matrix([r[3] for r in group]).ravel().tolist()) for key, group in _groups(batches, 2)), _MATRIX)

    ordered = clean.select("conv_id", "chunk", "turn", "role", "text")
    costs = stash(dealt(ordered, F.asc_nulls_first("turn"), "role", "text").select("conv_id", "chunk", "turn", "role").mapInArrow(matrices, "conv_id long, chunk long, costs array<double>"), "matrices")
    states = chunk_states(costs)
    discard(costs)
    at_exit(turns.sparkSession, states._stash_path)
    both = ordered.join(states, ["conv_id", "chunk"])

    def render(batches):
        def rows():
            for (conv, _), group in _groups(batches, 2):
                entry, leave, first, last = group[0][5:9]
                _, done = repair([r[3] for r in group], entry, leave)
                for k, (r, (after, actions)) in enumerate(zip(group, done)):
                    role = ROLES[after - 1]
                    if actions[0] == "merge":
                        piece, inserted = "\n" + _escaped(r[4]), None
                    else:
                        inserted = actions[1] if actions[0] == "insert" else None
                        piece = "" if first and k == 0 else "<|im_end|>\n"
                        piece += f"<|im_start|>{inserted}\n<|im_end|>\n" if inserted else ""
                        piece += f"<|im_start|>{role}\n{_escaped(r[4])}"
                    if last and k == len(group) - 1:
                        piece += "<|im_end|>\n"
                    yield (None if conv == -(2**63) else conv, r[2], k, role, actions[0], inserted, piece)

        return _send(rows(), [("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("rendered", pa.string())])

    laid = dealt(both.select("conv_id", "chunk", "turn", "role", "text", "entry", "leave", "is_first", "is_last"), F.asc_nulls_first("turn"), "role", "text")
    return laid.mapInArrow(render, "conv_id long, turn long, place int, role string, action string, inserted string, rendered string")
