"""Numbers in a global order without gathering the rows: sorted ranges, counts per range, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Add 1, 2, ... in the order given; ties in no fixed order."""
    ranged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("__at", 33)
    counts = ranged.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    offsets = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("offset"))  # a row per range
    joined = ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("offset") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).drop("__part", "__at", "offset")


def limited_chunks(df: DataFrame, order: list[str], limit: int, chunk: int, name: str = "chunk") -> DataFrame:
    """The first `limit` rows in order (a filter belongs before), with their chunk number from 1."""
    top = numbered(df.orderBy(*order).limit(limit), order, "__rn")
    return top.withColumn(name, (F.floor((F.col("__rn") - 1) / chunk) + 1).cast("long")).drop("__rn")
