"""Owners of a tail of words: earlier texts that stand at its beginning or its end, one after the other, each consuming what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .asof import Alternative, nearest_agreeing

#: Two prime moduli below 2^31, so that products stay within a long, and their bases.
MODULI, BASES = (2147483647, 2147483629), (1_000_003, 998_244_353)
#: Fixed value: the conjunction that may be left between two owners.
AND = "и"


def prefix_sums(words: Column) -> Column:
    """Polynomial hashes of the first 0, 1, ... words, as structs (a, b, and the powers p, q of the bases)."""
    zero = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(1).cast("long").alias("p"), F.lit(1).cast("long").alias("q"))
    step = lambda h, m, base, w: (h * base + F.pmod(F.xxhash64(w), F.lit(m))) % m

    def more(all_: Column, w: Column) -> Column:
        last = F.element_at(all_, -1)
        (m, n), (x, y) = MODULI, BASES
        return F.concat(all_, F.array(F.struct(step(last["a"], m, x, w).alias("a"), step(last["b"], n, y, w).alias("b"), (last["p"] * x % m).alias("p"), (last["q"] * y % n).alias("q"))))

    return F.aggregate(words, F.array(zero), more)


def cut(sums: Column, start: Column, end: Column) -> Column:
    """The hash of the words from start to before end, as text with their number."""
    low, high, powers = F.get(sums, start), F.get(sums, end), F.get(sums, end - start)
    part = lambda h, p, m: F.pmod(high[h] - low[h] * powers[p] % m, F.lit(m))
    return F.concat_ws(":", (end - start).cast("string"), part("a", "p", MODULI[0]).cast("string"), part("b", "q", MODULI[1]).cast("string"))


def cuts(sums: Column, start: Column, end: Column, beginnings: bool = True, ends: bool = True) -> Column:
    """Hashes of all beginnings and ends of the words from start to before end: two numbers a word, no texts."""
    sizes = F.when(end > start, F.sequence(F.lit(1), end - start)).otherwise(F.array().cast("array<int>"))
    parts = [F.transform(sizes, lambda n: cut(sums, start, start + n))] * beginnings + [F.transform(sizes, lambda n: cut(sums, end - n, end))] * ends
    return F.array_distinct(F.concat(*parts))


def dealt(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df dealt out to all cores: a file of short texts is read by few tasks, but every text makes hashes."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *[F.col(f"`{c}`") for c in [*keys, order]])


def owners(tails: DataFrame, forms: DataFrame, keys: list[str], order: str, tail: str, form: str, conjunction: str = AND) -> tuple[DataFrame, DataFrame]:
    """((keys, order, step, owner), (keys, order, rest)): the owners of each tail, nearest first, and what of it is left without one.

    tails: (keys, order, tail); forms: (keys, order, form); (keys, order) names a row of each. An owner is the nearest earlier form that is, word by
    word, a beginning or an end of the tail, or begins with all of it. What it says is taken off the tail, with conjunctions at the ends of what
    is left, and the search goes on before that owner, until the tail is empty or none is found: as many rounds as the longest chain of owners.
    Words are parted by spaces. Texts are compared by two polynomial hashes, 62 bits, and the number of words. Null and empty texts own nothing
    and have no owners; their rest is the tail itself.
    """
    split = lambda c: F.filter(F.split(F.coalesce(F.col(c), F.lit("")), " "), lambda w: w != "")
    shaped = dealt(tails.select(*keys, order, tail), keys, order).select(*keys, F.col(order).alias("at"), split(tail).alias("words"))
    state = saved(shaped.withColumns({"sums": prefix_sums(F.col("words")), "low": F.lit(0), "high": F.size("words"), "before": F.col("at")}), "tails")
    filed = dealt(forms.select(*keys, order, form), keys, order).select(*keys, F.col(order).alias("before"), prefix_sums(split(form)).alias("sums"), F.size(split(form)).alias("size")).where("size > 0")
    whole = cut(F.col("sums"), F.lit(0), F.col("size"))
    filed = saved(filed.select(*keys, "before", "size", whole.alias("whole"), cuts(F.col("sums"), F.lit(0), F.col("size"), ends=False).alias("beginnings")), "forms")
    own = lambda: cuts(F.col("sums"), F.col("low"), F.col("high"))
    rest = cut(F.col("sums"), F.col("low"), F.col("high"))
    ways = [[Alternative([own()], [F.col("whole")]), Alternative([rest], [F.col("beginnings")])]]
    done, found, step = [], [], 0
    while True:
        asked = state.where("low < high")
        near = saved(nearest_agreeing(asked, filed, keys, ["before"], ways, F.struct("before", "size", "whole"), "owner").drop("owner_tier"), "owned")
        done += [state.where("low >= high").select(*keys, "at", "words", "low", "high"), near.where("owner is null").select(*keys, "at", "words", "low", "high")]
        met = near.where("owner is not null")
        if not met.limit(1).count():
            break
        step += 1
        found.append(met.select(*keys, F.col("at").alias(order), F.lit(step).alias("step"), F.col("owner.before").alias("owner")))
        size = F.col("owner.size")
        all_of_it = size >= F.col("high") - F.col("low")
        starts = cut(F.col("sums"), F.col("low"), F.col("low") + size) == F.col("owner.whole")
        low = F.when(all_of_it, F.col("high")).when(starts, F.col("low") + size).otherwise(F.col("low"))
        high = F.when(all_of_it | starts, F.col("high")).otherwise(F.col("high") - size)
        left = F.slice("words", low + 1, high - low)
        conjunctions = lambda ws: F.coalesce(F.array_position(F.transform(ws, lambda w: w != conjunction), True) - 1, F.lit(-1))
        skip_low, skip_high = conjunctions(left), conjunctions(F.reverse(left))
        low, high = F.when(skip_low < 0, high).otherwise(low + skip_low), F.when(skip_low < 0, high).otherwise(high - skip_high)
        state = saved(met.select(*keys, "at", "words", "sums", low.cast("int").alias("low"), high.cast("int").alias("high"), F.col("owner.before").alias("before")), "tails")
    chain = None
    for part in found:
        chain = part if chain is None else chain.unionByName(part)
    over = done[0]
    for part in done[1:]:
        over = over.unionByName(part)
    left = F.array_join(F.slice("words", F.col("low") + 1, F.greatest(F.col("high") - F.col("low"), F.lit(0))), " ")
    none = shaped.select(*keys, F.col("at").alias(order), F.lit(0).alias("step"), F.col("at").alias("owner")).limit(0)
    return chain if chain is not None else none, over.select(*keys, F.col("at").alias(order), left.alias("rest"))
