"""Chat formatting: repair of role sequences at least cost, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant.
Each row may be kept, relabelled, merged into the turn before it, or preceded by an empty turn; costs are KEEP 0, MERGE 1,
RELABEL 2 (1 from an unknown role) and INSERT 3. Dynamic programming over the automaton's four states finds the cheapest
repair; of equal ones it takes the first in the order of `moves`.

A conversation may hold any share of all rows. Rows are dealt out by ranges of (conversation, turn) and cut into segments
of at most `SEGMENT` rows of one conversation. A segment gives its least cost from each state to each; these small
matrices are chained for each conversation, which fixes the states between segments; then every segment is repaired and
rendered apart.

Output is one row per input row: its rendered piece holds any empty turn before it, and the end of the conversation after
the last one. Pieces of a conversation in order are its text.

Defined results: null text is empty; null or unknown roles are relabelled; null turns come first; equal rows keep no order
among them, as none can be told. Rows with null conversation form one of null id. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylake.llm.groups import whole_groups
from keylake.session import materialize

SEGMENT = 1024
ROLES = ("system", "user", "assistant")
#: Other names of roles.
SAME = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
START = 3  # the state before any turn; the others are the role of the last turn
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3
#: Empty turns that end a conversation from each state.
ENDING = {START: (), 0: (1, 2), 1: (2,), 2: ()}
FAR = 1 << 40


def role_number(role: str | None) -> int:
    """Number of a role's name, by any of its names; 3 if unknown."""
    name = (role or "").strip().lower()
    name = SAME.get(name, name)
    return ROLES.index(name) if name in ROLES else 3


def moves(state: int, role: int) -> list[tuple[int, int, int, bool]]:
    """(cost, new state, inserted role or -1, merged) of every way to take a row of this role in this state."""
    out = []
    for target in (role, *(r for r in range(3) if r != role)) if role < 3 else range(3):
        cost = 0 if target == role else UNKNOWN if role == 3 else RELABEL
        if target in LEGAL[state]:
            out.append((cost, target, -1, False))
        if state == target:
            out.append((cost + MERGE, target, -1, True))
        out.extend((cost + INSERT, target, between, False) for between in LEGAL[state] if target in LEGAL[between])
    return out


MOVES = [[moves(s, r) for r in range(4)] for s in range(4)]
#: BEST[role][from, to]: the cheapest move and its cost.
BEST = [{(s, t): min((m for m in MOVES[s][r] if m[1] == t), key=lambda m: m[0], default=None) for s in range(4) for t in range(4)} for r in range(4)]
COST = np.array([[[BEST[r][s, t][0] if BEST[r][s, t] else FAR for t in range(4)] for s in range(4)] for r in range(4)], np.int64)


def transfer(roles: np.ndarray) -> np.ndarray:
    """Least cost of a segment from each state to each."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        out = np.minimum((out[:, :, None] + COST[r][None, :, :]).min(axis=1), FAR)
    return out


def chain(matrices: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """((entry, exit) of each segment, cost) of one conversation, its ending included."""
    cost, back = np.where(np.arange(4) == START, 0, FAR), []
    for m in matrices:
        total = cost[:, None] + m
        back.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), FAR)
    ending = cost + np.array([INSERT * len(ENDING[s]) for s in range(4)])
    state = int(ending.argmin())
    least, path = int(ending[state]), []
    for b in reversed(back):
        path.append((int(b[state]), state))
        state = int(b[state])
    return path[::-1], least


def walk(roles: np.ndarray, entry: int, leave: int) -> list[tuple[int, int, int, bool]]:
    """The moves of a segment from its entry to its exit state, at least cost."""
    cost, back = np.where(np.arange(4) == entry, 0, FAR), []
    for r in roles:
        total = cost[:, None] + COST[r]
        back.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), FAR)
    out, state = [], leave
    for r, b in zip(reversed(roles), reversed(back), strict=True):
        before = int(b[state])
        out.append(BEST[r][before, state])
        state = before
    return out[::-1]


def _turn(role: int, text: str = "") -> str:
    return f"<|{ROLES[role]}|>\n{text}"


CLOSE = "<|end|>\n"


def _number_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a segment and a place to rows sorted by conversation."""
    at, rows, last = TaskContext.get().partitionId() << 32, 0, None
    for b in batches:
        conv = b.column(0).to_numpy()
        seg, place = np.zeros(len(conv), np.int64), np.zeros(len(conv), np.int64)
        for k, c in enumerate(conv.tolist()):
            if c != last or rows == SEGMENT:
                at, rows, last = at + 1, 0, c
            seg[k], place[k] = at, rows
            rows += 1
        roles = pa.array([role_number(r) for r in b.column(2).to_pylist()], pa.int32())
        yield pa.record_batch([pa.array(seg), pa.array(place), *b.columns, roles], ["seg", "place", *b.schema.names, "number"])


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, cuts in whole_groups(batches, 1):
        seg, conv, roles = (t.column(k).to_numpy() for k in (0, 1, 3))
        cost = [transfer(roles[a:b]).ravel() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.record_batch([pa.array(conv[cuts[:-1]]), pa.array(seg[cuts[:-1]]), pa.array([c.tolist() for c in cost], pa.list_(pa.int64())), pa.array(np.diff(cuts).astype(np.int64))], ["conv", "seg", "cost", "rows"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, cuts in whole_groups(batches, 1):
        seg, costs = t.column(1).to_numpy(), np.array(t.column(2).to_pylist(), np.int64).reshape(-1, 4, 4)
        rows = t.column(3).to_numpy()
        start = np.cumsum(rows) - rows
        entry, leave, last = np.zeros(len(seg), np.int32), np.zeros(len(seg), np.int32), np.zeros(len(seg), bool)
        total = np.zeros(len(seg), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            path, total[a:b] = chain(costs[a:b])
            entry[a:b], leave[a:b] = zip(*path, strict=True)
            last[b - 1] = True
            start[a:b] -= start[a]
        yield pa.record_batch([pa.array(seg), pa.array(entry), pa.array(leave), pa.array(last), pa.array(total), pa.array(start)], ["seg", "entry", "leave", "last", "total", "start"])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, cuts in whole_groups(batches, 1):
        number, entry, leave, last = (t[c].to_numpy() for c in ("number", "entry", "leave", "last"))
        texts = t["text"].to_pylist()
        n = len(t)
        out_role, action, inserted, cost, piece = [""] * n, [""] * n, [""] * n, [0] * n, [""] * n
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            state = int(entry[a])
            for k, (price, new, between, merged) in enumerate(walk(number[a:b], state, int(leave[a])), int(a)):
                close = CLOSE if state != START and not merged else ""
                empty = _turn(between) + CLOSE if between >= 0 else ""
                text = texts[k] or ""
                out_role[k], inserted[k], cost[k] = ROLES[new], ROLES[between] if between >= 0 else "", price
                action[k] = ("keep" if new == number[k] else "relabel") + ("+merge" if merged else "")
                piece[k] = "\n" + text if merged else close + empty + _turn(new, text)
                state = new
            if last[a]:
                piece[b - 1] += CLOSE + "".join(_turn(r) + CLOSE for r in ENDING[state])
                cost[b - 1] += INSERT * len(ENDING[state])
        yield pa.record_batch([t["conv"].combine_chunks(), t["turn"].combine_chunks(), t["role"].combine_chunks(), pa.array(out_role), pa.array(action), pa.array(inserted), pa.array(cost, pa.int64()), t["total"].combine_chunks(), t["seg"].combine_chunks(), pa.array(t["start"].to_numpy() + t["place"].to_numpy()), pa.array(piece)], ["conv", "turn", "role", "out_role", "action", "inserted", "cost", "conv_cost", "seg", "place", "piece"])


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input row: conv_id, turn, role, out_role, action, inserted, cost, conv_cost, piece, seg, and place, the row's place in its conversation from 0."""
    missing = F.lit(-(1 << 63)).cast("long")
    rows = turns.select(F.coalesce(F.col(conv_col).cast("long"), missing).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    # equal rows are dealt out by a number of their own, or they would meet in one range
    dealt = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange("conv", "turn", "tie", "own").sortWithinPartitions("conv", "turn", "tie", "own").select("conv", "turn", "role", "text")
    dealt = materialize(dealt.mapInArrow(_number_segments, "seg long, place long, conv long, turn long, role string, text string, number int"), "turns")
    order = dealt.select("seg", "conv", "place", "number")
    costs = order.repartition("seg").sortWithinPartitions("seg", "place").mapInArrow(_transfers, "conv long, seg long, cost array<long>, rows long")
    ends = costs.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(_chains, "seg long, entry int, leave int, last boolean, total long, start long")
    ready = dealt.join(ends, "seg").repartition("seg").sortWithinPartitions("seg", "place")
    out = ready.mapInArrow(_render, "conv long, turn long, role string, out_role string, action string, inserted string, cost long, conv_cost long, seg long, place long, piece string")
    return out.select(F.when(F.col("conv") != missing, F.col("conv")).alias("conv_id"), "turn", "role", "out_role", "action", "inserted", "cost", "conv_cost", "seg", "place", "piece")
