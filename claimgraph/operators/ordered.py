"""Order-dependent operators over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .numbering import numbered
from .scan import carried, final_states


def nearest_preceding(df: DataFrame, keys: list[str], order: list[str], matches: Column, value: Column, name: str, back: int = 1) -> DataFrame:
    """Add the value of the nearest earlier row of the same keys for which `matches` holds, at least `back` rows before."""
    found = F.when(matches, value)
    if back == 1:
        return carried(df, keys, order, found, name, own=False)
    # Rows as probes at their place less `back`, and as what is found at their own place; places are numbers of the whole order.
    placed = saved(numbered(df.withColumn("__found", found), [*keys, *order], "__rn"), "placed")
    probes = placed.drop("__found").withColumns({"__place": F.col("__rn") - back, "__probe": F.lit(1)})
    values = placed.where("__found is not null").select(*[F.col(f"`{k}`") for k in keys], "__found", F.col("__rn").alias("__place"), F.lit(0).alias("__probe"))
    both = carried(probes.unionByName(values, allowMissingColumns=True), keys, ["__place", "__probe"], F.col("__found"), name)
    return both.where("__probe = 1").drop("__rn", "__place", "__probe", "__found")


def carry(df: DataFrame, keys: list[str], order: list[str], sets: Column, value: Column, resets: Column, name: str) -> DataFrame:
    """Add the last value set so far (the row's own included) since the last row that resets, whose own value counts."""
    return carried(df, keys, order, F.when(sets, value), name, resets)


def neighbours(df: DataFrame, keys: list[str], order: list[str], value: str, before: str, after: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(before, F.lag(value).over(w)).withColumn(after, F.lead(value).over(w))


def kth_occurrence_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """The k-th row of a key on the left with the k-th on the right.

    Places come from one global order by key and order, less the key's first place, so a key with most of the rows is no task of its own.
    """
    def placed(df: DataFrame, order: str) -> DataFrame:
        ranked = saved(numbered(df, [key, order], "__rn"), "places")
        first = ranked.groupBy(key).agg(F.min("__rn").alias("__first"))
        return ranked.join(first, key).withColumn("k", (F.col("__rn") - F.col("__first") + 1).cast("int")).drop("__rn", "__first")

    return placed(left, left_order).join(placed(right, right_order), [key, "k"])


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as a later write replaces an earlier one."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__last"))
    return last.select(*[F.col(f"__last.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])


def first_keys(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """Number distinct values per key 1, 2, ... by first appearance; pre-aggregated before it is ranked."""
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("first_at"))
    return firsts.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("first_at", value)))


def run_state(df: DataFrame, keys: list[str], order: str, symbol: str, transitions: dict[tuple[str, str], str], start: str, name: str) -> DataFrame:
    """Fold each key's symbols, in order, through a finite-state machine; an unknown symbol keeps the state."""
    return final_states(df, keys, [order], symbol, transitions, start, name)
