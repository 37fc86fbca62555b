"""Chat formatting: minimum-cost role repair by dynamic programming over an automaton of legal turns, then rendering.

Legal: an optional system turn, then user and assistant in turn, user first. A turn may be kept, relabelled, merged into the
turn before it, or preceded by an inserted empty turn; the sequence of least total cost is taken, ties by
the order in which the moves are listed.

A step of the automaton is a small (min, +) matrix, so a conversation of any length is repaired in bounded
chunks: each chunk gives its matrix, a conversation's matrices are folded to the state in which each chunk is entered, and each
chunk then retraces its own part. A conversation with a third of all rows is so many chunks in as many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROLES = ("system", "user", "assistant")
START = 3
#: State (role of the last turn, or START) to roles that may follow.
LEGAL = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
ALIASES = {"system": 0, "developer": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "gpt": 2, "bot": 2, "model": 2, "ai": 2}
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
CHUNK = 512
INFINITE = 1 << 60
OPEN, CLOSE, JOINT = "<|{}|>\n", "\n<|end|>\n", "\n\n"
#: A mark's beginning within a text, with the backslashes that tell it from a mark; escape() adds one, unescape() takes one.
MARK, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
SCHEMA = "chunk long, seq int, action string, new_role string, inserted string, escaped int, rendered string"


def role_of(name: str | None) -> int | None:
    return ALIASES.get((name or "").strip().lower())


def escape(text: str) -> tuple[str, int]:
    """A text in which nothing reads as a mark, and how many places were changed."""
    return MARK.subn(r"<\1\\|", text)


def unescape(text: str) -> str:
    """The text that escape() was given."""
    return ESCAPED.sub(r"<\1|", text)


def moves(state: int, role: int | None) -> list[tuple[int, int, str, int | None]]:
    """(cost, next state, action, inserted role) of every way to take a turn of this role."""
    out = []
    for to in (0, 1, 2):
        change = 0 if role == to else RELABEL_UNKNOWN if role is None else RELABEL
        action = "keep" if role == to else "relabel"
        if to in LEGAL[state]:
            out.append((change, to, action, None))
        if to == state:
            out.append((change + MERGE, to, "merge", None))
        out += [(change + INSERT, to, action, x) for x in LEGAL[state] if to in LEGAL[x]]
    return out


MOVES = {(s, r): moves(s, r) for s in (0, 1, 2, START) for r in (0, 1, 2, None)}


def transfer(roles: list[int | None], start: int) -> list[int]:
    """Least cost of ending in each state after these turns, entered in state start."""
    cost = [INFINITE] * 4
    cost[start] = 0
    for r in roles:
        new = [INFINITE] * 4
        for s in range(4):
            if cost[s] < INFINITE:
                for c, to, _, _ in MOVES[s, r]:
                    new[to] = min(new[to], cost[s] + c)
        cost = new
    return cost


def retrace(roles: list[int | None], start: int, end: int) -> list[tuple[int, str, int | None]]:
    """(role, action, inserted role) of each turn along the first least-cost path from start to end."""
    rest = [[INFINITE] * 4 for _ in roles] + [[0 if s == end else INFINITE for s in range(4)]]
    for k in range(len(roles) - 1, -1, -1):
        for s in range(4):
            rest[k][s] = min((c + rest[k + 1][to] for c, to, _, _ in MOVES[s, roles[k]]), default=INFINITE)
    out, s = [], start
    for k, r in enumerate(roles):
        c, to, action, inserted = next(m for m in MOVES[s, r] if m[0] + rest[k + 1][m[1]] == rest[k][s])
        out.append((to, action, inserted))
        s = to
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, conv, ...) rows in order to their chunk and place: a chunk is a run of one conversation, CHUNK rows at most."""
    key, chunk, seq = object(), -1, 0
    for batch in batches:
        chunks, seqs = [], []
        conv = batch.column(1).to_pylist()
        for pid, c in zip(batch.column(0).to_pylist(), conv, strict=True):
            if c != key or seq == CHUNK:
                key, chunk, seq = c, chunk + 1, 0
            chunks.append((pid << 33) + chunk)
            seqs.append(seq)
            seq += 1
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(chunks, pa.int64()), pa.array(seqs, pa.int32())], [*batch.schema.names[1:], "chunk", "seq"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["chunk"] != held[0]["chunk"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk", pa.int64()), ("costs", pa.list_(pa.int64()))])
    for run in _runs(batches):
        roles = [role_of(r["role"]) for r in run]
        yield pa.RecordBatch.from_pylist([{"chunk": run[0]["chunk"], "costs": [c for s in range(4) for c in transfer(roles, s)]}], schema)


def entered(matrices: list[tuple[int, list[int]]]) -> list[tuple[int, int, int]]:
    """(chunk, state it is entered in, state it is left in) along a least-cost path through chunks in order."""
    rest = [[INFINITE] * 4 for _ in matrices] + [[0] * 4]
    for k in range(len(matrices) - 1, -1, -1):
        m = matrices[k][1]
        for s in range(4):
            rest[k][s] = min(min(m[4 * s + t] + rest[k + 1][t], INFINITE) for t in range(4))
    out, s = [], START
    for k, (chunk, m) in enumerate(matrices):
        t = next(t for t in range(4) if m[4 * s + t] + rest[k + 1][t] == rest[k][s])
        out.append((chunk, s, t))
        s = t
    return out


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, chunk, costs) sorted by (conv, chunk) to the states of each chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_())])
    key, held = None, []

    def done() -> pa.RecordBatch:
        states = entered(held)
        return pa.RecordBatch.from_pylist([{"chunk": c, "enter": a, "leave": b, "last": k == len(states) - 1} for k, (c, a, b) in enumerate(states)], schema)

    for batch in batches:
        for row in batch.to_pylist():
            if held and row["conv"] != key:
                yield done()
                held = []
            key = row["conv"]
            held.append((row["chunk"], row["costs"]))
    if held:
        yield done()


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk", pa.int64()), ("seq", pa.int32()), ("action", pa.string()), ("new_role", pa.string()), ("inserted", pa.string()), ("escaped", pa.int32()), ("rendered", pa.string())])
    for run in _runs(batches):
        path = retrace([role_of(r["role"]) for r in run], run[0]["enter"], run[0]["leave"])
        out, before = [], run[0]["enter"]
        for k, (row, (role, action, inserted)) in enumerate(zip(run, path, strict=True)):
            text, escaped = escape(row["text"] or "")
            if action == "keep" and row["role"].strip().lower() != ROLES[role]:
                action = "rename"
            if action == "merge":
                piece = JOINT + text
            else:
                piece = ("" if before == START else CLOSE) + ("" if inserted is None else OPEN.format(ROLES[inserted]) + CLOSE) + OPEN.format(ROLES[role]) + text
            if row["last"] and k == len(run) - 1:
                piece += CLOSE
            out.append({"chunk": row["chunk"], "seq": row["seq"], "action": action, "new_role": ROLES[role], "inserted": None if inserted is None else ROLES[inserted], "escaped": escaped, "rendered": piece})
            before = role
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, turn_col, place, role, new_role, action, inserted, escaped, rendered) of every row.

    action: keep, rename (another name of the same role), relabel or merge. rendered: the row's part of the formatted
    conversation; the parts in order of place are the whole. Turns go by turn_col,
    nulls first, then role and text; equal rows follow each other and are merged like other turns of one role. A null or
    unknown role is relabelled at the lowest cost. A null text is an empty turn. What would read as a mark
    within a text is escaped; `escaped` counts such places. Rows of a null conversation form one of
    their own. An empty table gives no rows.
    """
    source = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").alias("role"), F.col(f"`{text_col}`").alias("text"))
    kinds = dict(source.dtypes)
    ordered = source.repartitionByRange("conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text")
    shape = f"conv {kinds['conv']}, turn {kinds['turn']}, role {kinds['role']}, text {kinds['text']}, chunk long, seq int"
    chunked = written(ordered.select(F.spark_partition_id().alias("pid"), "conv", "turn", "role", "text").mapInArrow(_chunks, shape), "chunks")
    by_chunk = lambda df: df.repartition("chunk").sortWithinPartitions("chunk", "seq")
    matrices = by_chunk(chunked.select("chunk", "seq", "role")).mapInArrow(_matrices, "chunk long, costs array<long>")
    convs = chunked.where("seq = 0").select("chunk", "conv")
    entries = matrices.join(convs, "chunk").repartition("conv").sortWithinPartitions("conv", "chunk").select("conv", "chunk", "costs").mapInArrow(_entries, "chunk long, enter int, leave int, last boolean")
    entries = written(entries, "entries")
    rendered = by_chunk(chunked.select("chunk", "seq", "role", "text").join(entries, "chunk")).mapInArrow(_render, SCHEMA)
    out = chunked.drop("text").join(rendered, ["chunk", "seq"])
    place = F.col("chunk").cast("decimal(20,0)") * CHUNK + F.col("seq")
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), place.alias("place"), "role", "new_role", "action", "inserted", "escaped", "rendered")
