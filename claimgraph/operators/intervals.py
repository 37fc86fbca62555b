"""Joins on ranges, as equi-joins on nodes of a binary tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .numbering import numbered


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str) -> DataFrame:
    """Points joined to the spans of equal keys with low <= at < high, whatever the spans' lengths.

    Points and the spans' ends are numbered in one order, so a span is as long as the rows that lie in it, not as its values are. These numbers are
    the leaves of a binary tree. A span is filed under the fewest nodes that cover it, two a level at most, and a point under its ancestors, so the
    join is an equi-join, each pair is met once, and rows grow with the logarithm of the rows in a span. Null keys, null ends and empty spans join
    nothing. Filed rows compress well, so their files say little of their size: they are sorted and merged, never broadcast.
    """
    key, known = [F.col(f"`{k}`") for k in keys], F.lit(True)
    for k in key:
        known = known & k.isNotNull()
    rest = lambda df: F.struct(F.lit(0).alias("__row"), *[F.col(f"`{c}`") for c in df.columns if c not in keys])
    ends = F.array(F.struct(F.col(low).alias("place"), F.lit(0).alias("side")), F.struct(F.col(high).alias("place"), F.lit(1).alias("side")))
    told = spans.where(known & (F.col(low) < F.col(high))).withColumn("__id", F.monotonically_increasing_id())  # before ends are exploded, which share it
    marks = told.select(*key, rest(spans).alias("__span"), "__id", F.explode(ends).alias("__end"))
    # An end comes before the points at its place; the span itself goes with its low end.
    marks = marks.select(*key, F.col("__end.place").alias("__place"), F.col("__end.side").alias("__side"), "__id", F.when(F.col("__end.side") == 0, F.col("__span")).alias("__span"))
    own = points.where(known & F.col(at).isNotNull()).select(*key, F.col(at).alias("__place"), F.lit(2).alias("__side"), rest(points).alias("__point"))
    order = numbered(marks.unionByName(own, allowMissingColumns=True), [*keys, "__place", "__side"], "__n")
    starts = order.where("__side = 0").select("__id", "__span", (F.col("__n") + 1).alias("__low"))
    stops = order.where("__side = 1").select("__id", F.col("__n").alias("__high"))
    held = saved(starts.join(stops.hint("merge"), "__id").where("__low < __high").drop("__id"), "spans")
    levels = held.agg(F.max(_bits(F.col("__low"), F.col("__high")))).first()[0] or 0  # 63 at most
    filed = held.select("__span", F.explode(cover(F.col("__low"), F.col("__high"))).alias("__node"))
    above = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("__n", k).alias("n")) for k in range(levels)]).cast("array<struct<level:int,n:bigint>>")
    placed = order.where("__side = 2").select(*key, "__point", F.explode(above).alias("__node"))
    met = placed.join(filed.hint("merge"), "__node")
    return met.select(*key, *[F.col(f"{side}.`{c}`") for side, df in (("__point", points), ("__span", spans)) for c in df.columns if c not in keys])


def _bits(low: Column, high: Column) -> Column:
    """How many levels a span's nodes are on, at most: above the highest bit in which its ends differ nothing is left to cover."""
    return F.least(F.length(F.bin(low.bitwiseXOR(high))), F.lit(63))


def cover(low: Column, high: Column) -> Column:
    """The fewest nodes (level, n), each the whole numbers from n * 2^level to before (n + 1) * 2^level, that make up low .. high - 1."""
    node = "struct<level:int,n:bigint>"
    start = F.struct(low.alias("low"), high.alias("high"), F.array().cast(f"array<{node}>").alias("nodes"))
    one = lambda k, n: F.array(F.struct(k.cast("int").alias("level"), n.alias("n")))
    none = F.array().cast(f"array<{node}>")

    def up(s: Column, k: Column) -> Column:
        more = s["low"] < s["high"]
        left, right = more & (s["low"].bitwiseAND(1) == 1), more & (s["high"].bitwiseAND(1) == 1)
        right = right & (~left | (s["low"] + 1 < s["high"]))
        nodes = F.concat(s["nodes"], F.when(left, one(k, s["low"])).otherwise(none), F.when(right, one(k, s["high"] - 1)).otherwise(none))
        return F.struct(F.shiftright(s["low"] + F.when(left, 1).otherwise(0), 1).alias("low"), F.shiftright(s["high"], 1).alias("high"), nodes.alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0), _bits(low, high) - 1), start, up, lambda s: s["nodes"])


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def published(date_publ: Column) -> Column:
    """A publication date such as 20200115; null where it is none."""
    return F.when(date_publ.rlike("^[0-9]{8}$"), F.try_to_timestamp(date_publ, F.lit("yyyyMMdd")).cast("date"))
