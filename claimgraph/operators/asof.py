"""As-of joins: for each row the nearest earlier row of its key that agrees with it, by ranked tiers of agreement.

Agreement is equality of a few values, so each alternative of a tier is a stream of equal values: both sides, sorted together by key, values and
order, meet in one scan that carries the last row of the other side. A row is in the streams of the values it accepts and never
meets the rows of its key one by one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .scan import carried

#: Stands for any value of a feature; see accepting().
ANY = "*"


@dataclass(frozen=True)
class Alternative:
    """Columns of the searching side and of the found side that must be equal, one by one. A column of arrays stands for any of its values;
    null, or an array without values, agrees with nothing."""

    probe: list[Column] = field(default_factory=list)
    found: list[Column] = field(default_factory=list)


def with_any(value: Column) -> Column:
    """A found row's value, with the sign that those who take any value look for. Null is a value of its own."""
    return F.array(F.coalesce(value, F.lit("")), F.lit(ANY))


def accepting(*values: Column) -> Column:
    """The values that a searching row takes; null is a value of its own."""
    return F.array_distinct(F.array(*[F.coalesce(v, F.lit("")) for v in values]))


def _stream(df: DataFrame, columns: list[Column], tier: int, alternative: int) -> DataFrame:
    """df once for each combination of the values that its columns stand for, as __match."""
    df = df.select("*", *[F.lit(None).cast("string").alias("__none")] if not columns else [c.alias(f"__m{i}") for i, c in enumerate(columns)])
    kinds = dict(df.dtypes)
    for i in range(len(columns)):
        if kinds[f"__m{i}"].startswith("array"):
            df = df.withColumn(f"__m{i}", F.explode(f"__m{i}"))
        df = df.where(F.col(f"__m{i}").isNotNull())
    match = F.array(F.lit(f"{tier}.{alternative}"), *[F.col(f"__m{i}").cast("string") for i in range(len(columns))])
    return df.withColumns({"__tier": F.lit(tier), "__match": match}).drop("__none", *[f"__m{i}" for i in range(len(columns))])


def nearest_agreeing(probes: DataFrame, found: DataFrame, keys: list[str], order: list[str], tiers: list[list[Alternative]], value: Column, name: str, at: list[Column] | None = None) -> DataFrame:
    """probes with `name`, the value of the nearest earlier row of `found` with equal keys, and `name`_tier, the tier that gave it, from 0.

    A tier is a list of alternatives, of which any will do; the first tier with a match wins, then the row latest in order. Earlier means a smaller `order`
    (columns of found; those of probes have the same names, or are given by `at`); rows of found that tie in order are told apart by value, the
    greatest wins. Rows without a match get null; null keys join nothing. Repeated probes each get a row. Neither table may have columns that begin with two underscores.
    What the probes accept is worked out once and written, as the ranges' sample would work it out again; `found` should be cheap to read.
    """
    asks = {f"__a{t}_{a}_{i}": c for t, tier in enumerate(tiers) for a, one in enumerate(tier) for i, c in enumerate(one.probe)}
    whole = saved(probes.withColumns({"__id": F.monotonically_increasing_id(), **asks}), "probes")
    places = at or [F.col(f"`{o}`") for o in order]
    key_not_null = F.lit(True)
    for k in keys:
        key_not_null = key_not_null & F.col(f"`{k}`").isNotNull()
    left = whole.where(key_not_null).select("*", *[p.alias(f"__o{i}") for i, p in enumerate(places)])
    right = found.where(key_not_null).select("*", *[F.col(f"`{o}`").alias(f"__o{i}") for i, o in enumerate(order)], value.alias("__v"))
    place = [f"__o{i}" for i in range(len(order))]
    streams = None
    for t, tier in enumerate(tiers):
        for a, one in enumerate(tier):
            p = _stream(left, [F.col(f"__a{t}_{a}_{i}") for i in range(len(one.probe))], t, a).select(*[F.col(f"`{k}`") for k in keys], *place, "__tier", "__match", "__id", F.lit(0).alias("__side"), F.lit(None).cast(dict(right.dtypes)["__v"]).alias("__v"))
            f = _stream(right, one.found, t, a).select(*[F.col(f"`{k}`") for k in keys], *place, "__tier", "__match", F.lit(None).cast("long").alias("__id"), F.lit(1).alias("__side"), "__v")
            streams = p.unionByName(f) if streams is None else streams.unionByName(p).unionByName(f)
    held = F.when(F.col("__side") == 1, F.struct(*place, "__v"))
    # A number goes before keys and values, so that rows are sorted by it and seldom by texts.
    streams = streams.withColumn("__hash", F.xxhash64(*[F.col(f"`{k}`") for k in keys], "__match"))
    met = carried(streams, ["__hash", *keys, "__match"], [*place, "__side", "__v"], held, "__near").where("__side = 0 and __near is not null")
    best = met.groupBy("__id").agg(F.max_by(F.struct("__near.__v", "__tier"), F.struct(-F.col("__tier"), "__near")).alias("__best"))
    joined = whole.drop(*asks).join(best.hint("merge"), "__id", "left")  # its files are small for what they hold, so it isn't broadcast
    return joined.withColumns({name: F.col("__best.__v"), f"{name}_tier": F.col("__best.__tier")}).drop("__id", "__best")
