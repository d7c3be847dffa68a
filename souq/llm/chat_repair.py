"""Chat formatting with minimum-cost role repair (operator 4).

A conversation's turns are read by an automaton over the roles of messages.
Dynamic programming finds the cheapest way to make the sequence legal: a turn
keeps its role or is relabelled, and either joins the message before it (same
role) or starts a message, after inserted empty messages where the automaton
needs them.  Turns are then rendered as consecutive pieces whose
concatenation is the formatted conversation.

Scale: the cost of a run of turns is a small (min, +) matrix over states, and
such matrices multiply.  Conversations of up to ``block_turns`` turns are
handled as they come out of one shuffle.  Longer ones are cut into blocks by a
range partitioning: blocks are reduced to matrices in parallel, one row per
block finds the states at the block borders, and the blocks are then repaired
in parallel between those states.  No task holds a long conversation.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, persist_shared, small_batches, table

ROLES = ("system", "user", "assistant", "tool")
#: which role a message may have after one of another role ("" is the beginning), and which may be last
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
LAST = ("assistant",)
MERGE, RELABEL, INSERT = 1, 3, 2

STATES = ("", *ROLES)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _insertions() -> dict[tuple[int, int], tuple[str, ...]]:
    """The fewest empty messages that lead from a message of one role to the next of another."""
    out = {}
    for s in range(len(STATES)):
        paths, seen = [(s, ())], set()
        while paths:
            more = []
            for at, ins in paths:
                for name in NEXT[STATES[at]]:
                    t = STATES.index(name)
                    if (s, t) not in out:
                        out[s, t] = ins
                    if t not in seen:
                        seen.add(t)
                        more.append((t, (*ins, name)))
            paths = more
    return out


INSERTIONS = _insertions()
FAR = 1 << 40


def _end(state: int) -> tuple[int, tuple[str, ...]]:
    """Cost and insertions that make a message of this state a legal last one."""
    if STATES[state] in LAST:
        return 0, ()
    ways = [(*INSERTIONS[state, STATES.index(r)], r) for r in LAST if (state, STATES.index(r)) in INSERTIONS]
    best = min(ways, key=lambda w: (len(w), w))
    return INSERT * len(best), best


END = [_end(s) for s in range(len(STATES))]


def _step(role: int) -> list[list[int]]:
    """Cost from the state before a turn of this role (0: none of the known) to the state after it."""
    cost = [[FAR] * len(STATES) for _ in STATES]
    for s in range(len(STATES)):
        for t in range(1, len(STATES)):
            ways = [INSERT * len(INSERTIONS[s, t])] if (s, t) in INSERTIONS else []
            if s == t:
                ways.append(MERGE)
            if ways:
                cost[s][t] = min(ways) + (0 if t == role else RELABEL)
    return cost


STEP = [_step(r) for r in range(len(STATES))]


def _forward(roles: list[int], entry: list[int]) -> list[list[int]]:
    """Cheapest cost of every state after each turn."""
    out = [entry]
    for r in roles:
        c, f = STEP[r], out[-1]
        out.append([min(f[s] + c[s][t] for s in range(len(STATES))) for t in range(len(STATES))])
    return out


def best_states(roles: list[int], entry: int = 0, leave: int | None = None) -> list[int]:
    """The states after each turn on a cheapest way from ``entry`` (to ``leave``, or to a legal end).

    Ties go to the earlier role in the order system, user, assistant, tool,
    from the last turn back.
    """
    f = _forward(roles, [0 if s == entry else FAR for s in range(len(STATES))])
    if leave is None:
        leave = min(range(1, len(STATES)), key=lambda s: (f[-1][s] + END[s][0], s))
    states = [leave]
    for i in range(len(roles) - 1, 0, -1):
        t = states[-1]
        states.append(min(range(len(STATES)), key=lambda s: (f[i][s] + STEP[roles[i]][s][t], s)))
    return states[::-1]


def block_matrix(roles: list[int]) -> list[int]:
    """Cheapest cost from every state before a block to every state after it, row by row."""
    out = []
    for s in range(len(STATES)):
        out += _forward(roles, [0 if x == s else FAR for x in range(len(STATES))])[-1]
    return [min(x, FAR) for x in out]


def border_states(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """States before and after each block of one conversation on a cheapest way."""
    n = len(STATES)
    f = [[0 if s == 0 else FAR for s in range(n)]]
    for m in matrices:
        f.append([min(f[-1][s] + m[s * n + t] for s in range(n)) for t in range(n)])
    states = [min(range(1, n), key=lambda s: (f[-1][s] + END[s][0], s))]
    for i in range(len(matrices) - 1, -1, -1):
        t = states[-1]
        states.append(min(range(n), key=lambda s: (f[i][s] + matrices[i][s * n + t], s)))
    states = states[::-1]
    return list(zip(states[:-1], states[1:]))


def _clean(text: str | None) -> str:
    return (text or "").replace("<|im_", "< |im_")


def repair_block(roles: list[int], texts: list[str | None], entry: int, leave: int | None, last: bool) -> list[tuple]:
    """(new role, action, inserted roles, cost, rendered piece) of each turn of a block."""
    out, before = [], entry
    states = best_states(roles, entry, leave)
    for i, (r, text, t) in enumerate(zip(roles, texts, states)):
        insert = INSERT * len(INSERTIONS[before, t]) if (before, t) in INSERTIONS else FAR
        joined = before == t and MERGE <= insert
        added = () if joined else INSERTIONS[before, t]
        cost = (MERGE if joined else insert) + (0 if r == t else RELABEL)
        action = "+".join((["relabel"] if r != t else []) + (["merge"] if joined else [])) or "keep"
        if joined:
            piece = "\n" + _clean(text)
        else:
            piece = f"{CLOSE}\n" if before else ""
            piece += "".join(f"{OPEN}{x}\n{CLOSE}\n" for x in added) + f"{OPEN}{STATES[t]}\n{_clean(text)}"
        if last and i == len(roles) - 1:
            cost, added = cost + END[t][0], added + END[t][1]
            piece += f"{CLOSE}\n" + "".join(f"{OPEN}{x}\n{CLOSE}\n" for x in END[t][1])
        out.append((STATES[t], action, ",".join(added), cost, piece))
        before = t
    return out


OUT = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
                 ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("cost", pa.int64()),
                 ("rendered", pa.string())])
OUT_DDL = ("conv_id long, position long, turn long, role string, new_role string, action string, inserted string, "
           "cost long, rendered string")


def _blocks(batches, key: tuple[str, ...]):
    """Consecutive rows of equal key out of sorted batches, as lists of dicts.

    A block that a batch boundary cuts is carried over; blocks are bounded.
    """
    carried: list[dict] = []
    for b in batches:
        rows = carried + b.to_pylist()
        groups = [list(g) for _, g in groupby(rows, key=lambda r: tuple(r[k] for k in key))]
        carried = groups.pop() if groups else []
        yield from groups
    if carried:
        yield carried


def _emit(batches, key):
    cols: list[list] = [[] for _ in OUT]
    for g in _blocks(batches, key):
        r0 = g[0]
        done = repair_block([r["known"] for r in g], [r["text"] for r in g], r0["entry"], r0["leave"], r0["last"])
        for i, (r, d) in enumerate(zip(g, done)):
            for c, v in zip(cols, (r["conv_id"], r0["before"] + i + 1, r["turn"], r["role"], *d)):
                c.append(v)
        if len(cols[0]) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT)], schema=OUT)
            cols = [[] for _ in OUT]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, OUT)], schema=OUT)


def _matrices(batches):
    for g in _blocks(batches, ("conv_id", "block")):
        yield pa.RecordBatch.from_arrays(
            [pa.array([g[0]["conv_id"]], pa.int64()), pa.array([g[0]["block"]], pa.int32()), pa.array([len(g)], pa.int64()),
             pa.array([block_matrix([r["known"] for r in g])], pa.list_(pa.int64()))], ["conv_id", "block", "turns", "cost"])


def _borders(t: pa.Table) -> pa.Table:
    t = t.sort_by("block")
    at = border_states(t.column("cost").to_pylist())
    n = t.column("turns").to_numpy()
    before = np.concatenate(([0], np.cumsum(n)[:-1]))
    last = [i == len(at) - 1 for i in range(len(at))]
    return pa.table({"conv_id": t.column("conv_id"), "block": t.column("block"), "before": pa.array(before, pa.int64()),
                     "entry": pa.array([a for a, _ in at], pa.int32()), "leave": pa.array([b for _, b in at], pa.int32()),
                     "last": pa.array(last)})


def repair(turns: DataFrame, block_turns: int = 2048) -> DataFrame:
    """Repaired and rendered turns of every conversation.

    ``turns`` has conv_id, turn, role, text; other columns are ignored.
    Returns one row per different turn: conv_id, position (from 1), turn, role,
    new_role, action (keep, relabel, merge, relabel+merge), inserted (roles of
    the empty messages before it, after the last turn those that end the
    conversation), cost, rendered.  The pieces ``rendered`` of a conversation,
    concatenated by position, are its formatted text; the costs add up to the
    cheapest repair.

    Defined cases: exactly repeated rows count once; turns of equal number are
    ordered by a hash of role and text; null turns come last; role names are
    trimmed and lower-cased, a null or unknown role has to be relabelled; null
    text is empty; a null conv_id is a conversation of its own; ``<|im_`` in a
    text is rendered ``< |im_``; an empty table gives an empty result.
    """
    small_batches(turns.sparkSession)
    role = F.lower(F.trim("role"))
    known = F.coalesce(*[F.when(role == r, F.lit(i + 1)) for i, r in enumerate(ROLES)], F.lit(0))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        "role", "text").distinct() \
        .withColumn("known", known).withColumn("tie", F.xxhash64("role", "text"))
    order = [F.col("turn").asc_nulls_last(), F.col("tie")]
    long_ = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_turns)
    long_ = persist_shared(long_)
    size = long_.agg(F.count(F.lit(1)).alias("convs"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns")).first()
    n_long = size.turns
    long_ = checked_broadcast(long_, size.convs)
    same = rows["conv_id"].eqNullSafe(long_["conv_id"])
    short = rows.join(long_, same, "left_anti") if n_long else rows
    # conversations come whole out of one shuffle, in order
    short = short.select("*", F.lit(0).alias("entry"), F.lit(None).cast("int").alias("leave"), F.lit(True).alias("last"),
                         F.lit(0).cast("long").alias("before")) \
        .repartition("conv_id").sortWithinPartitions("conv_id", *order)
    out = short.mapInArrow(lambda b: _emit(b, ("conv_id",)), OUT_DDL)
    if not n_long:
        return out
    cut = rows.join(long_, same, "left_semi") \
        .repartitionByRange(-(-n_long // block_turns), F.col("conv_id").asc_nulls_first(), *order)
    cut = persist_shared(cut.withColumn("block", F.spark_partition_id()))
    by_block = ["conv_id", "block"]
    matrices = cut.select(*by_block, "turn", "tie", "known").repartition(*by_block) \
        .sortWithinPartitions(*by_block, *order).mapInArrow(_matrices, "conv_id long, block int, turns long, cost array<long>")
    borders = persist_shared(matrices.groupBy("conv_id").applyInArrow(
        _borders, "conv_id long, block int, before long, entry int, leave int, last boolean"))
    blocks = cut.alias("c").join(borders.alias("b"), F.col("c.conv_id").eqNullSafe(F.col("b.conv_id"))
                                 & (F.col("c.block") == F.col("b.block"))) \
        .select("c.*", "before", "entry", "leave", "last") \
        .repartition(*by_block).sortWithinPartitions(*by_block, *order)
    return out.union(blocks.mapInArrow(lambda b: _emit(b, ("conv_id", "block")), OUT_DDL))


def render(repaired: DataFrame) -> DataFrame:
    """(conv_id, text) of conversations short enough for one row each."""
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "rendered"))), lambda x: x["rendered"]), "").alias("text"))


def op4_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 4 over all conversations."""
    return repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
