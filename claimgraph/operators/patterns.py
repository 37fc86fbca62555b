"""Row patterns: runs of rows, in the order of a key, that a pattern of steps describes, with agreement between rows.

A step takes rows of a kind, a least and a most number of them, and may ask that a row's features equal those of the row that another step took last. Rows
that no step can take part a key into islands, found by a scan, and no match crosses an island's edge: islands are the unit of work, so a key
of any size is many tasks, and only rows that some step takes go to Python. Matches are leftmost, then longest, and do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running_total


@dataclass(frozen=True)
class Step:
    """What a step is called, how many rows it takes (no most: any number), and with which steps' last rows its rows agree on which
    features. Agreement with the step's own name is agreement with its row before. A row agrees with a step that has taken none."""

    name: str
    least: int = 1
    most: int | None = 1
    agrees: tuple[tuple[str, str], ...] = ()


def longest(kinds: Sequence[int], features: Sequence[dict], steps: Sequence[Step], start: int) -> list[tuple[int, int]] | None:
    """The longest match from a row on: for each step the places of its rows, from and before; none if there is no match.

    kinds: a bit per step for each row. Threads (step, rows it took, the last row of each step) go over the rows once, side by side; of
    threads alike in what they can still do, the one that gave earlier steps more rows stays.
    """
    best, threads = None, {(0, 0, (None,) * len(steps)): ((start, start),)}

    def ready(threads: dict) -> dict:
        """Threads at every step where the next row can go; a step that has its least may be left."""
        out, todo = {}, list(threads.items())
        while todo:
            (at, n, last), spans = todo.pop(0)
            if (at, n, last) in out:
                continue
            out[at, n, last] = spans
            if at < len(steps) and n >= steps[at].least:
                end = spans[-1][1]
                todo.append(((at + 1, 0, last), (*spans, (end, end))))
        return out

    for i in range(start, len(kinds) + 1):
        threads = ready(threads)
        done = [spans for (at, _, _), spans in threads.items() if at == len(steps)]
        best = done[0][:-1] if done and i > start else best
        if i == len(kinds):
            break
        moved = {}
        for (at, n, last), spans in threads.items():
            if at == len(steps) or not kinds[i] >> at & 1 or (steps[at].most is not None and n >= steps[at].most):
                continue
            if all(last[k] is None or features[last[k]].get(f) == features[i].get(f) for k, f in _references(steps, at)):
                took = (*last[:at], i, *last[at + 1 :])
                # Rows that nothing refers to later are forgotten, and so are counts beyond the least of a step without a most.
                needed = {k for later in range(at, len(steps)) for k, _ in _references(steps, later)}
                took = tuple(x if k in needed else None for k, x in enumerate(took))
                count = min(n + 1, steps[at].least) if steps[at].most is None else n + 1
                moved.setdefault((at, count, took), (*spans[:-1], (spans[-1][0], i + 1)))
        threads = moved
        if not threads:
            break
    return list(best) if best else None


def _references(steps: Sequence[Step], at: int) -> list[tuple[int, str]]:
    names = [s.name for s in steps]
    return [(names.index(other), f) for other, f in steps[at].agrees]


def matches(kinds: Sequence[int], features: Sequence[dict], steps: Sequence[Step]) -> Iterator[list[tuple[int, int]]]:
    """Matches of an island from the left; the next begins behind the one before."""
    at = 0
    while at < len(kinds):
        found = longest(kinds, features, steps, at)
        if found:
            yield found
        at = found[-1][1] if found else at + 1


def _islands(steps: Sequence[Step], names: list[str], keys: int, place: pa.DataType, columns: pa.Schema):
    """Rows (keys, island, order, kinds, features...) sorted by keys, island and order to matches."""
    parts = pa.list_(pa.struct([("step", pa.string()), ("first", place), ("last", place), ("n", pa.int32())]))
    schema = pa.schema([*columns, ("first", place), ("last", place), ("n", pa.int32()), ("steps", parts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> list[tuple]:
            out, features = [], [dict(zip(names, r[2:], strict=True)) for r in rows]
            for spans in matches([r[1] for r in rows], features, steps):
                shown = [{"step": s.name, "first": rows[a][0], "last": rows[b - 1][0], "n": b - a} for s, (a, b) in zip(steps, spans, strict=True) if b > a]
                out.append((*key[:-1], rows[spans[0][0]][0], rows[spans[-1][1] - 1][0], spans[-1][1] - spans[0][0], shown))
            return out

        for batch in batches:
            made = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[: keys + 1] != key:
                    made += done() if key else []
                    key, rows = row[: keys + 1], []
                rows.append(row[keys + 1 :])
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)
        made = done() if key else []
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def match_rows(df: DataFrame, keys: list[str], order: str, steps: Sequence[Step], takes: dict[str, Column], features: dict[str, Column] | None = None) -> DataFrame:
    """(keys, first, last, n, steps): the matches of each key's rows in order; first and last are values of `order`, which no two rows of a key
    share, n counts rows, and steps names what each step took (step, first, last, n), those that took no rows left out.

    takes: for each step the rows that it may take; null counts as no. features are compared as they are, null with null. A match has one row
    at least. An island lies in one task's memory: rows in a row that steps take, not a whole key.
    """
    features = features or {}
    bits = F.lit(0)
    for i, s in enumerate(steps):
        bits = bits + F.when(F.coalesce(takes[s.name], F.lit(False)), 1 << i).otherwise(0)
    own = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{order}`").alias("at"), bits.alias("kinds"), *[c.alias(f"f_{n}") for n, c in features.items()])
    placed = running_total(own, keys, ["at"], F.when(F.col("kinds") == 0, 1).otherwise(0), "island").where("kinds > 0")
    placed = placed.select(*[F.col(f"`{k}`") for k in keys], F.col("island").cast("long").alias("island"), "at", "kinds", *[f"f_{n}" for n in features])
    by = [*[F.col(f"`{k}`") for k in keys], F.col("island")]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(placed.schema)
    kinds = dict(placed.dtypes)
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", first {kinds['at']}, last {kinds['at']}, n int, steps array<struct<step:string,first:{kinds['at']},last:{kinds['at']},n:int>>"
    run = _islands(steps, list(features), len(keys), arrow.field("at").type, pa.schema([arrow.field(k) for k in keys]))
    return placed.repartition(*by).sortWithinPartitions(*by, "at").mapInArrow(run, shape.removeprefix(", "))
