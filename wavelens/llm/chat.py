"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant.
Every input turn is taken in its role or another, merged into the turn before it, or taken after an empty turn is put in;
each has a cost, and dynamic programming over the automaton's four states finds the cheapest repair (of equals, the action
listed first wins). The repaired turns are rendered with role headers and end marks.

Costs along a stretch of turns form a min-plus matrix over the states, and matrices compose. Turns are therefore dealt by
ranges of (conversation, turn), so that a conversation of any length is cut into stretches of bounded size; only the
matrices of the few conversations that cross a range meet in one place, which tells each stretch the states it begins and
ends in. The result has one row per input turn, whose ``rendered`` pieces in order of ``pos`` make up the conversation.

Turns are ordered by turn (null first), then by a hash of role and text, so ties and repeated rows have a fixed order. Null
texts are empty; null or unknown roles may take any role at a low cost; a null conversation id is one conversation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Other names of the three roles.
ALIASES = {"system": 1, "developer": 1, "user": 2, "human": 2, "prompter": 2, "assistant": 3, "bot": 3, "gpt": 3, "model": 3, "ai": 3}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
RELABEL, GUESS, MERGE, INSERT = 2.0, 1.0, 1.0, 3.0
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
INF = float("inf")


def _relabel(r: int, x: int) -> float:
    return 0.0 if r == x else GUESS if r == 0 else RELABEL


def _moves() -> tuple[np.ndarray, list]:
    """Cost of going from one state to another with a turn of each role, and how: (inserted role or 0, merged)."""
    cost = np.full((4, 4, 4), INF)
    how = [[[None] * 4 for _ in range(4)] for _ in range(4)]

    def offer(r, q, x, c, action):
        if c < cost[r, q, x]:
            cost[r, q, x], how[r][q][x] = c, action

    for r in range(4):
        for q in range(4):
            for x in (SYSTEM, USER, ASSISTANT):
                if (q, x) in LEGAL:
                    offer(r, q, x, _relabel(r, x), (0, False))
                if q == x:
                    offer(r, q, x, MERGE + _relabel(r, x), (0, True))
                for y in (SYSTEM, USER, ASSISTANT):
                    if (q, y) in LEGAL and (y, x) in LEGAL:
                        offer(r, q, x, INSERT + _relabel(r, x), (y, False))
    return cost, how


COST, HOW = _moves()
#: What it costs to end in each state, and the empty turns that are then put in.
FINAL = np.array([0.0, 2 * INSERT, INSERT, 0.0])
TAIL = ((), (USER, ASSISTANT), (ASSISTANT,), ())


def transfer(roles: list[int]) -> np.ndarray:
    """The min-plus matrix of a stretch of turns."""
    m = np.full((4, 4), INF)
    np.fill_diagonal(m, 0.0)
    for r in roles:
        m = (m[:, :, None] + COST[r][None]).min(1)
    return m


def repair(roles: list[int], begin: int, end: int) -> list[int]:
    """The state after each turn on a cheapest way from ``begin`` to ``end``."""
    best = np.full(4, INF)
    best[begin] = 0
    back = []
    for r in roles:
        step = best[:, None] + COST[r]
        back.append(step.argmin(0))
        best = step.min(0)
    out, at = [], end
    for b in reversed(back):
        out.append(at)
        at = int(b[at])
    return out[::-1]


def role_code(column: str):
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(F.col(column)))), F.lit(0))


def _stretches(batches, keys: int):
    """Whole groups of consecutive rows with equal first ``keys`` columns, as (key, list of rows)."""
    key, rows = None, []
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, pos, role, action, inserted, rendered): one row per turn, in order of pos within its conversation."""
    scratch = Scratch(df.sparkSession, "chat")
    conv_type, turn_type = (df.schema[c].dataType.simpleString() for c in (conv, turn))
    rows = df.select(F.col(conv).alias("c"), F.col(turn).alias("t"), role_code(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"), F.xxhash64(role, text).alias("h"))
    ranged = rows.repartitionByRange("c", "t", "h").sortWithinPartitions("c", "t", "h", "x", "r")
    dealt = scratch.save(ranged.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("pos"), "c", "t", "r", "x"))

    def matrices(batches):
        out = [(*k, transfer([r for (r,) in rows]).ravel().tolist()) for k, rows in _stretches(batches, 2)]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), arrow_conv, pa.list_(pa.float64())))], ["p", "c", "m"])

    arrow_turn = to_arrow_type(df.schema[turn].dataType)
    arrow_conv = to_arrow_type(df.schema[conv].dataType)
    small = dealt.select("p", "c", "pos", "r").repartition("p", "c").sortWithinPartitions("p", "c", "pos")
    stretch = scratch.save(small.select("p", "c", "r").mapInArrow(matrices, f"p int, c {conv_type}, m array<double>"))
    # all stretches of a conversation in order: at most as many as there are ranges
    chains = stretch.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("p", "m"))).alias("s"))

    def ends(batches):
        for batch in batches:
            p, c, b, e, last = [], [], [], [], []
            for conv_id, chain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best, steps = np.array([0.0, INF, INF, INF]), []
                for s in chain:
                    step = best[:, None] + np.array(s["m"]).reshape(4, 4)
                    steps.append(step.argmin(0))
                    best = step.min(0)
                at = int((best + FINAL).argmin())
                for k in range(len(chain) - 1, -1, -1):
                    p.append(chain[k]["p"]), c.append(conv_id), e.append(at), last.append(k == len(chain) - 1)
                    at = int(steps[k][at])
                    b.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, arrow_conv), pa.array(b, pa.int32()), pa.array(e, pa.int32()), pa.array(last, pa.bool_())], ["p", "c", "b", "e", "last"])

    states = scratch.save(chains.mapInArrow(ends, f"p int, c {conv_type}, b int, e int, last boolean"))

    def render(batches):
        out = [[] for _ in range(7)]

        def flush():
            types = [arrow_conv, arrow_turn, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], [conv, turn, "pos", "role", "action", "inserted", "rendered"])
            for x in out:
                x.clear()
            return batch

        size = 0
        for (_, c), rows in _stretches(batches, 2):
            begin, end, last = rows[0][4:7]
            path = repair([r[2] for r in rows], begin, end)
            q = begin
            for i, ((pos, t, r, x, *_), to) in enumerate(zip(rows, path)):
                put, merged = HOW[r][q][to]
                piece = "\n" + x if merged else (CLOSE if q != START else "") + (OPEN.format(ROLES[put]) + CLOSE if put else "") + OPEN.format(ROLES[to]) + x
                inserted = [ROLES[put]] if put else []
                if last and i == len(rows) - 1:
                    piece += CLOSE + "".join(OPEN.format(ROLES[y]) + CLOSE for y in TAIL[to])
                    inserted += [ROLES[y] for y in TAIL[to]]
                for lst, v in zip(out, (c, t, pos, ROLES[to], "merge" if merged else "keep" if r == to else "relabel", ",".join(inserted), piece)):
                    lst.append(v)
                size += len(piece)
                q = to
            if size > 1 << 20:
                size = 0
                yield flush()
        yield flush()

    known = dealt.join(states.select(F.col("p").alias("_p"), F.col("c").alias("_c"), "b", "e", "last"), (F.col("p") == F.col("_p")) & F.col("c").eqNullSafe(F.col("_c")))
    ready = known.select("p", "c", "pos", "t", "r", "x", "b", "e", "last").repartition("p", "c").sortWithinPartitions("p", "c", "pos")
    return ready.mapInArrow(render, f"`{conv}` {conv_type}, `{turn}` {turn_type}, pos long, role string, action string, inserted string, rendered string")

