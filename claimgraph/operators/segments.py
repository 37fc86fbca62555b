"""Claims to clause segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import split_parts


def clause_segments(df: DataFrame, keys: list[str], parts: Column, separator: str = r",|;") -> DataFrame:
    """(keys, part, seg_id, text): parts (an array of texts) cut at separators; ids run through the whole row and count empty
    clauses, which are dropped. part is 0 for an undivided text, else 1, 2."""
    cut = df.select(*keys, parts.alias("__parts"))  # a column, so that the lambdas below do not cut the text anew for each clause
    part = lambda i: F.when(F.size("__parts") == 1, 0).otherwise(i + 1)
    pieces = F.flatten(F.transform("__parts", lambda p, i: F.transform(F.split(p, separator), lambda s: F.struct(part(i).alias("part"), F.trim(s).alias("text")))))
    rows = cut.select(*keys, F.posexplode(pieces).alias("at", "s"))
    return rows.select(*keys, F.col("s.part").alias("part"), (F.col("at") + 1).alias("seg_id"), F.col("s.text").alias("text")).where("text <> ''")


def claim_segments(df: DataFrame, keys: list[str], claim: str) -> DataFrame:
    """Segments of cleaned claims: cut once at the distinguishing phrase, then at commas and semicolons."""
    return clause_segments(df, keys, split_parts(F.regexp_replace(F.col(claim), r"\.\s*$", "")))


#: What is set aside before a claim is cut (formulas, numbers, units), in order, so that commas inside stay.
SURROGATES = (
    r"(об\s?/\s?с)",
    r"([A-Z<>\dλ]+\s?/([\d+],?\d{0,}|[а-я]+\.?))",
    r"([±+-]?\d+,?\d+[·*]\d+-?\+?\d+)",
    r"([A-Za-zА-Яа-я/\dαλ=]+=\d,?\d*[-λ…]?\d[,λ]?\d*[°]?)",
    r"(\d+[′']?[a-zфа-я]?(,\s\d+[′']?[a-zфа-я]?)+)",
    r"([±]?\d+,?\d*(\.{0,3}|…|-|\s-\s)\d+,?\d+[°%λ]?[CС]?)",
    r"([±]?\d+[,\.-]?\d*[°f%λ′']?([-ей]+|[CС]?))",
    r"([А-Яа-я]{1,4}\.\s?[%])",
    r"([A-Za-zА-Яа-я\d]+[<>=][A-Za-zА-Яа-я\d]+)",
)


def with_surrogates(text: Column) -> Column:
    """(text, originals): what the patterns find, pattern by pattern, replaced by 'REP1 ', 'REP2 ', ... where it first stands; plain
    numbers stay. restore() puts the originals back."""
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("originals"))

    def aside(s: Column, hit: Column) -> Column:
        at = F.instr(s["text"], hit)
        label = F.concat(F.lit("REP"), (F.size(s["originals"]) + 1).cast("string"), F.lit(" "))
        cut = F.concat(F.substring(s["text"], F.lit(1), at - 1), label, F.substring(s["text"], at + F.length(hit), F.length(s["text"])))
        found = (at > 0) & ~hit.rlike(r"^[0-9]+$")
        return F.struct(F.when(found, cut).otherwise(s["text"]).alias("text"), F.when(found, F.concat(s["originals"], F.array(hit))).otherwise(s["originals"]).alias("originals"))

    patterns = F.array(*[F.lit(p) for p in SURROGATES])
    return F.aggregate(patterns, state, lambda s, p: F.aggregate(F.regexp_extract_all(s["text"], p, F.lit(1)), s, aside))


def restore(text: Column, originals: Column) -> Column:
    """Surrogates back to what they stood for, highest number first so that REP1 does not eat REP10."""
    order = F.reverse(F.sequence(F.lit(0), F.size(originals) - 1))
    return F.when(F.size(originals) > 0, F.aggregate(order, text, lambda t, i: F.replace(t, F.concat(F.lit("REP"), (i + 1).cast("string"), F.lit(" ")), F.get(originals, i)))).otherwise(text)
