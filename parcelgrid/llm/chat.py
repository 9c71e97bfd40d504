"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in
turns, the assistant last. Dynamic programming over that automaton finds the
cheapest way to make a conversation legal: merging a turn into the one before,
relabelling it, or inserting empty turns. Costs of a stretch of turns form a
small matrix (state before, state after), and matrices of neighbouring
stretches multiply (min-plus), so a conversation of any length is solved in
stretches: matrices first, the states between stretches next, the choices
inside each stretch last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelgrid.session import durable

ROLES = ("system", "user", "assistant")
#: Other names roles go by.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant",
           "developer": "system"}
#: States: nothing yet, then the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs: a known role is changed only where merging and inserting cost more.
MERGE, RELABEL, GUESS, INSERT = 2, 8, 1, 5
FAR = 1 << 40
#: Turns of a stretch at most.
STRETCH = 50_000
OPEN, CLOSE, JOIN = "<|{}|>\n", "<|end|>\n", "\n\n"


@cache
def moves(role: int) -> list[list[tuple[int, str, tuple[int, ...]] | None]]:
    """[state][state after]: cheapest (cost, action, roles of inserted turns) for a turn of ``role``; 0 is an unknown role."""
    out: list[list] = [[None] * 4 for _ in range(4)]
    for before in range(4):
        for after in (SYSTEM, USER, ASSISTANT):
            name = 0 if role == after else GUESS if role == 0 else RELABEL
            label = "" if role == after else "relabel"
            ways = []
            if after in FOLLOWS[before]:
                ways.append((name, label or "keep", ()))
            if before == after:
                ways.append((name + MERGE, "+".join(filter(None, (label, "merge"))), ()))
            for extra in FOLLOWS[before]:
                if after in FOLLOWS[extra] and extra != SYSTEM:
                    ways.append((name + INSERT, "+".join(filter(None, ("insert", label))), (extra,)))
            out[before][after] = min(ways, default=None, key=lambda w: (w[0], w[1]))
    return out


#: Cost and inserted turns that end a conversation legally from each state.
ENDS = {START: (0, ()), SYSTEM: (2 * INSERT, (USER, ASSISTANT)), USER: (INSERT, (ASSISTANT,)), ASSISTANT: (0, ())}


def forward(roles: list[int], costs: list[int]) -> list[list[int]]:
    """Cheapest cost of every state before the first and after each turn."""
    rows = [costs]
    for role in roles:
        m, last = moves(role), rows[-1]
        rows.append([min([last[s] + m[s][t][0] for s in range(4) if m[s][t]], default=FAR) for t in range(4)])
    return rows


def stretch(roles: list[int]) -> list[int]:
    """Costs from each state to each state over the turns, 16 numbers."""
    return [min(x, FAR) for s in range(4) for x in forward(roles, [0 if t == s else FAR for t in range(4)])[-1]]


def choices(roles: list[int], start: int, end: int) -> list[tuple[int, int, int]]:
    """(state before, state after, cost) of each turn on a cheapest way from ``start`` to ``end``."""
    rows = forward(roles, [0 if t == start else FAR for t in range(4)])
    out = []
    for i in range(len(roles) - 1, -1, -1):
        m = moves(roles[i])
        before = min((s for s in range(4) if m[s][end]), key=lambda s: (rows[i][s] + m[s][end][0], s))
        out.append((before, end, m[before][end][0]))
        end = before
    return out[::-1]


def joined_states(parts: list[list[int]]) -> list[tuple[int, int]]:
    """(state before, state after) of each stretch on a cheapest legal way through all of them."""
    rows = [[0, FAR, FAR, FAR]]
    for p in parts:
        rows.append([min(rows[-1][s] + p[4 * s + t] for s in range(4)) for t in range(4)])
    end = min(range(4), key=lambda s: (rows[-1][s] + ENDS[s][0], -s))
    out = []
    for i in range(len(parts) - 1, -1, -1):
        before = min(range(4), key=lambda s: (rows[i][s] + parts[i][4 * s + end], s))
        out.append((before, end))
        end = before
    return out[::-1]


def _markup(before: int, after: int, action: str, inserted: tuple[int, ...]) -> str:
    if action.endswith("merge"):
        return JOIN
    head = CLOSE if before != START else ""
    return head + "".join(OPEN.format(ROLES[x - 1]) + CLOSE for x in inserted) + OPEN.format(ROLES[after - 1])


def _stretches(b: pa.RecordBatch) -> Iterator[tuple[list[int], list[int]]]:
    """(places, roles) of the turns of each row, one row at a time."""
    column = b.column("_turns")
    at, flat = column.offsets.to_numpy(), column.values
    pos, code = flat.field("_pos").to_numpy(), flat.field("_code").to_numpy()
    for i, j in zip(at[:-1], at[1:]):
        yield pos[i:j].tolist(), code[i:j].tolist()


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, position, turn, role, new_role, action, cost, rendered) of every row of ``turns``.

    ``turns`` has conv_id, turn, role and text. Turns are ordered by turn
    (nulls last), role and text; position counts them from 0. The pieces
    ``rendered``, joined in that order, are the whole repaired conversation:
    each holds the markup that closes what is open, empty inserted turns, its
    own opening and its text; the last one also what ends the conversation.
    Null or empty texts are empty turns, unknown and null roles take the
    cheapest role, a null conv_id is a conversation of its own, and repeated
    rows are turns each. Other columns are not looked at.

    Rows are dealt by ranges of (conversation, order, place in the input), so a
    conversation with very many turns spans several tasks, equal turns too; a
    task's share of it is cut into stretches of at most ``STRETCH`` turns.
    """
    name = F.lower(F.trim("role"))
    for alias, role in ALIASES.items():
        name = F.when(name == alias, F.lit(role)).otherwise(name)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), name), F.lit(0)).cast("int")
    order = [F.asc("conv_id"), F.asc_nulls_last("turn"), F.asc("role"), F.asc("text")]
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The place parts only rows that are equal in all that is looked at, so it need not be the same in every run.
    rows = durable(turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_id")).repartitionByRange(
        parts, *order, "_id").sortWithinPartitions(*order, "_id").select(
        "conv_id", "turn", "role", "text", code.alias("_code"), F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_pos")))
    # The lower 33 bits of _pos number the rows of a partition.
    run = F.floor(F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)) / STRETCH)

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = [stretch(codes) for _, codes in _stretches(b)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(costs, pa.list_(pa.int64()))], [*b.schema.names, "_costs"])

    listed = rows.groupBy("conv_id", "_part", run.alias("_run")).agg(F.sort_array(F.collect_list(F.struct("_pos", "_code"))).alias("_turns")).select(
        "conv_id", F.col("_turns")[0]["_pos"].alias("_stretch"), F.size("_turns").cast("bigint").alias("_n"), "_turns")
    kind = turns.schema["conv_id"].dataType.simpleString()
    stretches = durable(listed.mapInArrow(
        cost, f"conv_id {kind}, _stretch bigint, _n bigint, _turns array<struct<_pos: bigint, _code: int>>, _costs array<bigint>"))

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for some in (x.as_py() for x in b.column("_all")):
                at = 0
                for k, (x, (before, after)) in enumerate(zip(some, joined_states([x["_costs"] for x in some]))):
                    out.append((x["_stretch"], before, after, at, k == len(some) - 1))
                    at += x["_n"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()))],
                ["_stretch", "_before", "_after", "_at", "_last"])

    ways = stretches.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_stretch", "_n", "_costs"))).alias("_all")).select(
        "_all").mapInArrow(connect, "_stretch bigint, _before int, _after int, _at bigint, _last boolean")

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

    def written(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)],
                                          ["_pos", "position", "new_role", "action", "cost", "_head", "_tail"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for (pos, roles), r in zip(_stretches(b), b.select(["_before", "_after", "_at", "_last"]).to_pylist()):
                for i, (p, role, (before, after, paid)) in enumerate(zip(pos, roles, choices(roles, r["_before"], r["_after"]))):
                    _, action, inserted = moves(role)[before][after]
                    tail, head = "", _markup(before, after, action, inserted)
                    if r["_last"] and i == len(roles) - 1:
                        more, extra = ENDS[after]
                        paid += more
                        tail = CLOSE + "".join(OPEN.format(ROLES[e - 1]) + CLOSE for e in extra)
                        action += "+insert" if extra else ""
                    out.append((p, r["_at"] + i, ROLES[after - 1], action, paid, head, tail))
                if len(out) >= STRETCH:
                    yield written(out)
                    out = []
            yield written(out)

    chosen = stretches.select("_stretch", "_turns").join(durable(ways), "_stretch").select(
        "_turns", "_before", "_after", "_at", "_last").mapInArrow(
            choose, "_pos bigint, position bigint, new_role string, action string, cost bigint, _head string, _tail string")
    return rows.join(durable(chosen), "_pos").select(
        "conv_id", "position", "turn", "role", "new_role", "action", "cost",
        F.concat("_head", F.coalesce("text", F.lit("")), "_tail").alias("rendered"))
