"""Running values in the order of a key, by an associative scan over sorted ranges.

Rows are sorted into ranges by key and order, so a key of any size lies in as many ranges as its rows need. A running value is an associative
composition: it is taken within each range, the ranges' last values are composed in a table of one row a range, and every row
takes what comes in from the ranges before. Nothing is gathered per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved


def _in_ranges(df: DataFrame, sort: list) -> DataFrame:
    return df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__at", F.monotonically_increasing_id())


def _same_keys(left: str, keys: list[str]) -> Column:
    """The columns `keys` equal the struct `left`, nulls too."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"{left}.k{i}"))
    return same


def _key(keys: list[str]) -> Column:
    return F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)])


def _next_range(ends: DataFrame) -> DataFrame:
    """ends (part, ...), a row a range, with the part of the next range that has rows."""
    return ends.withColumn("next", F.lead("part").over(Window.orderBy("part")))


def carried(df: DataFrame, keys: list[str], order: list, value: Column, name: str, resets: Column | None = None, own: bool = True) -> DataFrame:
    """Add the last value that is not null at or before each row of its key; before it only, if not `own`. A row that resets forgets
    what was before it; its own value counts. Null keys are a key of their own. `order` may hold columns such as F.desc("x")."""
    sort = [*[F.col(f"`{k}`") for k in keys], *order]
    marked = df.withColumn("__value", value).withColumn("__reset", F.coalesce(resets, F.lit(False)) if resets is not None else F.lit(False))
    placed = saved(_in_ranges(marked, sort), "ranged").withColumn("__part", F.shiftright("__at", 33))
    key = [F.col(f"`{k}`") for k in keys]
    back = F.lit(0)
    if resets is not None:
        back = F.sum(F.col("__reset").cast("long")).over(Window.partitionBy("__part", *key).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    local = placed.withColumn("__since", back)
    so_far = Window.partitionBy("__part", *key, "__since").orderBy("__at")
    local = local.withColumn("__last", F.last("__value", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    if not own:
        if resets is not None:
            raise ValueError("a row that resets counts its own value")
        local = local.withColumn("__before", F.last("__value", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1)))
    ends = local.groupBy(F.col("__part").alias("part")).agg(F.max_by(F.struct(_key(keys).alias("key"), "__since", "__last"), "__at").alias("end"))
    # Ranges that end with one key follow each other; a range with a reset in that key forgets what came in.
    within = Window.partitionBy("end.key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    ends = _next_range(ends).withColumn("resets", F.sum((F.col("end.__since") > 0).cast("int")).over(within))
    ends = ends.withColumn("out", F.last("end.__last", ignorenulls=True).over(Window.partitionBy("end.key", "resets").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)))
    incoming = ends.where("next is not null").select(F.col("next").alias("__next"), F.col("end.key").alias("__key"), F.col("out").alias("__in"))
    joined = local.join(F.broadcast(incoming), (F.col("__part") == F.col("__next")) & _same_keys("__key", keys), "left")  # a row a range
    shown = F.col("__last" if own else "__before")
    joined = joined.withColumn(name, F.when(F.col("__since") > 0, shown).otherwise(F.coalesce(shown, "__in")))
    return joined.drop("__at", "__part", "__value", "__reset", "__since", "__last", "__before", "__next", "__key", "__in")


def running_total(df: DataFrame, keys: list[str], order: list, value: Column, name: str) -> DataFrame:
    """Add the sum of value over the rows of the same keys up to this one; null values count nothing."""
    sort = [*[F.col(f"`{k}`") for k in keys], *order]
    placed = saved(_in_ranges(df.withColumn("__value", F.coalesce(value, F.lit(0))), sort), "ranged").withColumn("__part", F.shiftright("__at", 33))
    within = Window.partitionBy("__part", *[F.col(f"`{k}`") for k in keys]).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("__sum", F.sum("__value").over(within))
    ends = _next_range(local.groupBy(F.col("__part").alias("part")).agg(F.max_by(F.struct(_key(keys).alias("key"), "__sum"), "__at").alias("end")))
    out = F.sum("end.__sum").over(Window.partitionBy("end.key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    incoming = ends.withColumn("out", out).where("next is not null").select(F.col("next").alias("__next"), F.col("end.key").alias("__key"), F.col("out").alias("__in"))
    joined = local.join(F.broadcast(incoming), (F.col("__part") == F.col("__next")) & _same_keys("__key", keys), "left")  # a row a range
    return joined.withColumn(name, F.col("__sum") + F.coalesce("__in", F.lit(0))).drop("__at", "__part", "__value", "__sum", "__next", "__key", "__in")


# --- finite-state machines --------------------------------------------------------------------------------------------


class _Machine:
    """States and symbols as bytes. A function of states is a string with a byte per state, and a symbol's is a table for bytes.translate,
    which composes in one step."""

    def __init__(self, transitions: dict[tuple[str, str], str], start: str):
        self.states = sorted({start, *(s for s, _ in transitions), *transitions.values()})
        if len(self.states) > 255:
            raise ValueError("more than 255 states")
        number = {s: i for i, s in enumerate(self.states)}
        self.start, self.identity = number[start], bytes(range(len(self.states)))
        self.tables: dict[str, bytes] = {}
        for symbol in {i for _, i in transitions}:
            table = bytearray(range(256))
            for (s, i), t in transitions.items():
                if i == symbol:
                    table[number[s]] = number[t]
            self.tables[symbol] = bytes(table)

    def composed(self, keys: int, symbol_at: int):
        """Sorted rows to rows with __function, the composition of the symbols of their key in this range up to them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, function = None, self.identity
            for batch in batches:
                made, names = [], list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
                for own, symbol in zip(names, batch.column(symbol_at).to_pylist(), strict=True):
                    if own != key:
                        key, function = own, self.identity
                    table = self.tables.get(symbol)
                    function = function.translate(table) if table else function
                    made.append(function)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "__function"])

        return run


def states(df: DataFrame, keys: list[str], order: list[str], symbol: str, transitions: dict[tuple[str, str], str], start: str, name: str) -> DataFrame:
    """Add the state after each row: its key's symbols in order, through a finite-state machine; an unknown or null symbol keeps the state.

    A row carries the function that its range's symbols up to it are; what comes in from the ranges before is a function too, so
    ranges are worked through at the same time.
    """
    placed, names, machine = _functions(df, keys, order, symbol, transitions, start)
    ends = placed.groupBy(F.col("__part").alias("part")).agg(F.max_by(F.struct(_key(keys).alias("key"), "__function"), "__at").alias("end"))
    before = F.collect_list("end.__function").over(Window.partitionBy("end.key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    incoming = _next_range(ends).withColumn("all", before).where("next is not null")
    incoming = incoming.select(F.col("next").alias("__next"), F.col("end.key").alias("__key"), _applied(F.col("all"), machine).alias("__in"))
    joined = placed.join(F.broadcast(incoming), (F.col("__part") == F.col("__next")) & _same_keys("__key", keys), "left")
    number = _byte(F.col("__function"), F.coalesce("__in", F.lit(machine.start)))
    return joined.withColumn(name, F.element_at(names, number + 1)).drop("__at", "__part", "__function", "__next", "__key", "__in")


def final_states(df: DataFrame, keys: list[str], order: list[str], symbol: str, transitions: dict[tuple[str, str], str], start: str, name: str) -> DataFrame:
    """(keys, name): the state after each key's last row, see states(). A key's functions, one per range, are applied in the order of ranges."""
    placed, names, machine = _functions(df.select(*[F.col(f"`{k}`") for k in keys], *order, symbol), keys, order, symbol, transitions, start)
    key = [F.col(f"`{k}`") for k in keys]
    each = placed.groupBy("__part", *key).agg(F.max_by("__function", "__at").alias("f"))
    packed = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__part", "f"))).alias("__all"))
    return packed.select(*key, F.element_at(names, _applied(F.transform("__all", lambda x: x["f"]), machine) + 1).alias(name))


def _functions(df: DataFrame, keys: list[str], order: list[str], symbol: str, transitions: dict[tuple[str, str], str], start: str) -> tuple[DataFrame, Column, _Machine]:
    machine = _Machine(transitions, start)
    rest = [c for c in df.columns if c not in keys and c != symbol]
    ranged = _in_ranges(df.select(*[F.col(f"`{c}`") for c in [*keys, symbol, *rest]]), [F.col(f"`{c}`") for c in [*keys, *order]])
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", __function binary"
    placed = saved(ranged.mapInArrow(machine.composed(len(keys), len(keys)), shape), "functions").withColumn("__part", F.shiftright("__at", 33))
    return placed, F.array(*[F.lit(s) for s in machine.states]), machine


def _byte(function: Column, state: Column) -> Column:
    return F.conv(F.hex(function.substr(state + 1, F.lit(1))), 16, 10).cast("int")


def _applied(functions: Column, machine: _Machine) -> Column:
    return F.aggregate(functions, F.lit(machine.start), lambda s, f: _byte(f, s))
