"""Which texts contain which: a join on shared runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved

#: Characters of a gram; rows filed under one gram in one task.
GRAM, POSTING = 4, 20_000


def grams(text: Column, n: Column) -> Column:
    """The distinct runs of n characters of a text; none where it is shorter."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, n)))


def containing(short: DataFrame, long: DataFrame, keys: list[str], text: str, longer: str, gram: int = GRAM, posting: int = POSTING) -> DataFrame:
    """Rows of short joined to the rows of long, of equal keys, whose text `longer` contains their `text`; see contained(). Each pair of rows is
    a row: counted() is for tables where the same texts stand in many rows. Nulls contain nothing; an empty text is in all of equal keys.
    """
    pairs = contained(short, long, keys, text, longer, gram, posting).withColumnsRenamed({"text": "__text", "longer": "__longer"})
    met = short.withColumn("__text", F.col(text)).join(pairs.hint("merge"), [*keys, "__text"]).drop("__text")
    return met.join(long.withColumn("__longer", F.col(longer)), [*keys, "__longer"]).drop("__longer")


def contained(short: DataFrame, long: DataFrame, keys: list[str], text: str, longer: str, gram: int = GRAM, posting: int = POSTING) -> DataFrame:
    """(keys, text, longer): the different texts of short with the different texts of long, of equal keys, that contain them.

    A long text is filed under the grams that short ones have; a short text looks only under its rarest one, so it meets the fewest long texts, and
    each of them once; what it meets is compared in full. Texts shorter than a gram are grams of their own length. A gram under which more
    than `posting` long texts are filed is dealt to several tasks. Copies are filed once.
    """
    key = [F.col(f"`{k}`") for k in keys]
    asked = saved(short.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("text")).distinct().withColumn("__id", F.monotonically_increasing_id()), "short")
    own = asked.select(*key, "__id", F.least(F.length("text"), F.lit(gram)).alias("__n"), "text")
    own = own.select(*key, "__id", "__n", F.explode(F.when(F.col("__n") == 0, F.array(F.lit(""))).otherwise(grams(F.col("text"), F.col("__n")))).alias("__gram"))
    wanted = own.select(*key, "__n", "__gram").distinct()
    lengths = sorted(r[0] for r in wanted.select("__n").distinct().collect())  # gram + 1 at most
    if not lengths:
        lengths = [gram]
    here = saved(long.where(F.col(longer).isNotNull()).select(*key, F.col(longer).alias("longer")).distinct().withColumn("__row", F.monotonically_increasing_id()), "long")
    filed = here.select(*key, "__row", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.array(F.lit("")).alias("g") if n == 0 else grams(F.col("longer"), F.lit(n)).alias("g")) for n in lengths])).alias("__g"))
    filed = filed.select(*key, "__row", F.col("__g.n").alias("__n"), F.explode("__g.g").alias("__gram"))
    filed = saved(filed.join(wanted, [*keys, "__n", "__gram"], "left_semi"), "grams")
    counts = filed.groupBy(*key, "__n", "__gram").agg(F.count("*").alias("__count"))
    rarest = own.join(counts.hint("merge"), [*keys, "__n", "__gram"], "left").groupBy(*key, "__id").agg(F.min_by(F.struct("__n", "__gram", "__count"), F.struct(F.coalesce("__count", F.lit(0)), "__gram")).alias("__r"))
    rarest = rarest.where("__r.__count is not null").select(*key, "__id", "__r.*")
    split = lambda c: F.ceil(c / posting).cast("int")
    looks = rarest.withColumn("__part", F.explode(F.sequence(F.lit(0), split(F.col("__count")) - 1))).drop("__count")
    many = counts.where(F.col("__count") > posting).select(*keys, "__n", "__gram", split(F.col("__count")).alias("__parts"))
    dealt = filed.join(many, [*keys, "__n", "__gram"], "left").withColumn("__part", F.pmod(F.xxhash64("__row"), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    looks = looks.join(asked.select("__id", "text").hint("merge"), "__id").drop("__id")
    dealt = dealt.join(here.select("__row", "longer").hint("merge"), "__row").drop("__row")
    met = looks.join(dealt.hint("merge"), [*keys, "__n", "__gram", "__part"]).where(F.contains("longer", "text"))
    return met.select(*key, "text", "longer")


def _two_least(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, least, second): the two least different values, null where there is but one."""
    first = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.min(value).alias("least"))
    rest = df.join(first, by).where(F.col(value) != F.col("least")).groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.min(value).alias("second"))
    return first.join(rest, by, "left")


def counted(short: DataFrame, long: DataFrame, keys: list[str], id_: str, text: str, other: str, longer: str, gram: int = GRAM, posting: int = POSTING) -> DataFrame:
    """(keys, id, n, first): for each id of short the pairs of its rows with the rows of long of another id whose `longer` contains their `text`, as their
    number and the least of these other ids; ids without any are left out.

    What is compared are different texts, and each brings its number of rows and its two least ids along, so no pair of rows is made: a
    text's least id counts unless it is the asking row's own. Pairs of one id are counted by a join on the id and taken off.
    """
    key = [F.col(f"`{k}`") for k in keys]
    asking = short.where(F.col(text).isNotNull() & F.col(id_).isNotNull()).groupBy(*key, F.col(id_).alias("__id"), F.col(text).alias("text")).agg(F.count("*").alias("__rows"))
    held = long.where(F.col(longer).isNotNull() & F.col(other).isNotNull()).groupBy(*key, F.col(other).alias("__id"), F.col(longer).alias("longer")).agg(F.count("*").alias("__rows"))
    asking, held = saved(asking, "asking"), saved(held, "held")
    sizes = held.groupBy(*key, "longer").agg(F.sum("__rows").alias("__rows")).join(_two_least(held, [*keys, "longer"], "__id"), [*keys, "longer"])
    pairs = saved(contained(asking, held, keys, "text", "longer", gram, posting).join(saved(sizes, "sizes").hint("merge"), [*keys, "longer"]), "pairs")
    ids = pairs.select(*key, "text", F.explode(F.array_compact(F.array("least", "second"))).alias("__one"))
    totals = pairs.groupBy(*key, "text").agg(F.sum("__rows").alias("__all")).join(_two_least(ids, [*keys, "text"], "__one"), [*keys, "text"])
    own = asking.join(held.withColumnRenamed("__rows", "__theirs").hint("merge"), [*keys, "__id"]).where(F.contains("longer", "text"))
    own = own.groupBy(*key, "__id", "text").agg(F.sum("__theirs").alias("__own"))
    found = asking.join(totals, [*keys, "text"]).join(own.hint("merge"), [*keys, "__id", "text"], "left")
    n = F.col("__rows") * (F.col("__all") - F.coalesce("__own", F.lit(0)))
    first = F.when(F.col("least") == F.col("__id"), F.col("second")).otherwise(F.col("least"))
    return found.groupBy(*key, F.col("__id").alias(id_)).agg(F.sum(n).alias("n"), F.min(first).alias("first")).where("n > 0")
