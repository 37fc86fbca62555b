"""How the sources of a language differ in their words.

1. Terms are counted in the tasks that read the texts, per language and source, in bounded dictionaries that are passed on when full;
   Spark sums them. A row without a term stands for the group itself, so groups without terms are known too.
2. Wide vectors: each kept term of a language becomes one row with an array that has a place for every source of that language. The arrays
   hold smoothed shares as integers (billionths, rounded down, plus one), so sums are exact in any order.
3. Higher-order functions give the differences of one source's place from those after it, and a sum per (language, place, place),
   combined in the tasks first, gives the distance of each pair of sources. The terms that a source has more of than its language come from the same rows.

The table of languages (sources and sums) is joined to the terms by language and a salt, so a language with most of the terms is many tasks
and nothing is broadcast but what Spark measures as small.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Distinct (source, term) entries that a task holds before it passes them on, and bytes of a text that it splits at a time.
HELD, CHUNK = 200_000, 1 << 20
LEAST_DOCUMENTS, SMOOTHING, SCALE, TOP, SALTS = 30, 5, 1_000_000_000, 50, 32

#: ASCII capitals to small letters, all else in ASCII that is no letter to a space; bytes beyond ASCII stay.
_TABLE = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in order, a bounded part of it at a time."""
    plain, at = text.translate(_TABLE), 0
    while at < len(plain):
        end = plain.find(b" ", at + CHUNK)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to (lang, source, term, n, df): occurrences and documents, summed over what the task holds."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = pa.array([None, *df], pa.binary()).cast(pa.string())
            size = len(terms)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array([0, *(n[t] for t in df)], pa.int64()), pa.array([0, *df.values()], pa.int64())], schema=_COUNTS)
        held.clear()

    size = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()), strict=True):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(df), set()
            for part in terms_of(text.as_py()):
                n.update(part)
                seen.update(part)
            df.update(seen)
            size += len(df) - before
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept)), in whole numbers throughout."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTHING)
    return F.call_function("div", above, wide(total + SMOOTHING * kept)).cast("long") + 1


def _salted(df: DataFrame, spec: DataFrame, salt: Column) -> DataFrame:
    """df with its language's row of spec, joined by language and salt."""
    copies = spec.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(copies, ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of the texts' sources.

    part 'pair': item is another source of the language, value the sum of absolute differences of shares over the language's kept terms
    (those in least_documents rows of it), 0 where it keeps none. part 'term': the `top` terms of which the source has the most above the
    language's share. Ranks go by value, then by the item's UTF-8 bytes. Null texts, languages and sources count as ''. Every row is a document,
    repeated ones too; other columns of docs are not looked at. A language with one source has no pairs; an empty table gives no rows.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, df long")
    summed = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    rows = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("entries"))
    rows = written(rows.where(F.col("term").isNull() | (F.col("df") >= least_documents)).drop("df"), "terms")

    sums = rows.select("lang", "term", F.explode("entries").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    vocabulary = rows.groupBy("lang").agg(F.count("term").alias("kept"))
    spec = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"), F.sum("total").alias("lang_total")).join(vocabulary, "lang")
    spec = written(spec, "languages")

    own = F.map_from_entries(F.transform("entries", lambda e: F.struct(e["source"], e["n"])))
    joined = _salted(rows, spec, F.xxhash64("term")).withColumn("own", own)
    count = lambda g: F.coalesce(F.try_element_at(F.col("own"), g["source"]), F.lit(0).cast("long"))
    share = lambda g: F.when(F.col("term").isNull(), F.lit(0).cast("long")).otherwise(_share(count(g), g["total"], F.col("kept")))
    joined = joined.withColumn("all", F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["n"]))
    wide = joined.select("lang", "term", "groups", F.transform("groups", share).alias("p"), F.transform("groups", count).alias("n"), F.when(F.col("term").isNotNull(), _share(F.col("all"), F.col("lang_total"), F.col("kept"))).alias("q"))
    wide = written(wide, "vectors")

    from_i = wide.select("lang", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 1)).alias("i"))
    apart = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.get("p", F.col("i"))))
    pairs = from_i.select("lang", "i", F.posexplode(apart).alias("k", "v")).groupBy("lang", "i", "k").agg(F.sum("v").alias("value"))
    both = F.array(F.struct("i", F.expr("i + 1 + k").alias("j")), F.struct(F.expr("i + 1 + k").alias("i"), F.col("i").alias("j")))
    named = _salted(pairs, spec.select("lang", "groups"), F.xxhash64("i", "k")).select("lang", "groups", "value", F.explode(both).alias("x"))
    named = named.select("lang", F.get("groups", F.col("x.i"))["source"].alias("source"), F.get("groups", F.col("x.j"))["source"].alias("item"), "value")

    above = F.filter(F.arrays_zip("groups", "p", "n"), lambda z: (z["n"] > 0) & (z["p"] > F.col("q")))
    more = wide.where("term is not null").select("lang", "term", "q", F.explode(above).alias("z"))
    more = more.select("lang", F.col("z.groups.source").alias("source"), F.col("term").alias("item"), (F.col("z.p") - F.col("q")).alias("value"))

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [(named.withColumn("rank", place), "pair"), (more.withColumn("rank", place).where(F.col("rank") <= top), "term")]
    first, second = (df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for df, part in parts)
    return first.unionByName(second)
