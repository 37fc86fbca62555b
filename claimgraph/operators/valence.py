"""Valences laid over tokens, as joins: which tokens after a verb are its object and its additions.

Tokens are rows (keys, ix, text, pos, case, mark). A valence is a row (lemma, alt, anchors, cases): alternatives of a verb in their order, the
words of which one must open it (none: it opens right after the verb), and the cases of its nominals. Where an opening stops is the nearest later row
of some kind, found by as-of joins; what lies between is an interval join by case. So a key of any size is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .asof import Alternative, nearest_agreeing
from .intervals import within
from .scan import carried

#: What can be an object, what ends its search, and how many tokens after a verb a further verb does not end it.
NOMINAL, BREAKS, SKIP = ("NOUN", "PRON", "NUM"), ("ADV", "SCONJ"), 3
NEVER = 2**31 - 1


def following(probes: DataFrame, rows: DataFrame, keys: list[str], since: Column, name: str, agree: list[Alternative] | None = None) -> DataFrame:
    """probes with name, the least ix at or after `since` of the rows of equal keys (that agree, where alternatives are given)."""
    back = rows.withColumn("back", -F.col("ix"))
    return nearest_agreeing(probes, back, keys, ["back"], [agree or [Alternative()]], F.col("ix"), name, at=[1 - since]).drop(f"{name}_tier")


def openings(verbs: DataFrame, tokens: DataFrame, valences: DataFrame, keys: list[str], skip: int = SKIP) -> DataFrame:
    """(keys, verb, alt, cases, low, high): for each verb (keys, verb, lemma) and alternative that opens, the places from `low` to before `high`.

    An alternative with anchors opens at the first of them after the verb. It stops at the next verb, `skip` tokens after the verb at least, and
    at the next token of BREAKS behind the opening. An anchor behind the verb's stop does not open.
    """
    asked = verbs.join(valences, "lemma").drop("lemma")
    some = asked.where(F.size("anchors") > 0)
    word = Alternative([F.col("anchors")], [F.lower("text")])
    opened = following(some, tokens, keys, F.col("verb") + 1, "low", [word]).where("low is not null")
    opened = opened.unionByName(asked.where(F.size("anchors") == 0).withColumn("low", F.col("verb") + 1)).drop("anchors")
    until = following(opened, tokens.where("pos = 'VERB'"), keys, F.greatest(F.col("low"), F.col("verb") + 1 + skip), "next_verb")
    until = following(until, tokens.where(F.col("pos").isin(*BREAKS)), keys, F.col("low") + 1, "next_break")
    # The verb that ends the side also bars an anchor behind it.
    until = following(until, tokens.where("pos = 'VERB'"), keys, F.col("verb") + 1 + skip, "side_end")
    high = F.least(F.coalesce("next_verb", F.lit(NEVER)), F.coalesce("next_break", F.lit(NEVER)))
    return until.where(F.col("low") < F.coalesce("side_end", F.lit(NEVER))).select(*keys, "verb", "alt", "cases", "low", high.alias("high"))


def fits(opened: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verb, alt, ix): the nominals that lie in an opening and have one of its cases."""
    spans = opened.withColumn("case", F.explode("cases")).drop("cases")
    points = tokens.where(F.col("pos").isin(*NOMINAL) & F.col("case").isNotNull()).select(*keys, "case", "ix")
    return within(points, spans, [*keys, "case"], "ix", "low", "high").select(*keys, "verb", "alt", "ix").distinct()


def objects(verbs: DataFrame, tokens: DataFrame, valences: DataFrame, keys: list[str], skip: int = SKIP) -> DataFrame:
    """(keys, verb, alt, ix): for each verb the nominals of its first alternative that has any."""
    found = saved(fits(openings(verbs, tokens, valences, keys, skip), tokens, keys), "fits")
    first = found.groupBy(*keys, "verb").agg(F.min("alt").alias("alt"))
    return found.join(first.hint("merge"), [*keys, "verb", "alt"]).select(*keys, "verb", "alt", "ix")


def additions(verbs: DataFrame, tokens: DataFrame, valences: DataFrame, keys: list[str], taken: DataFrame | None = None, skip: int = SKIP) -> DataFrame:
    """(keys, verb, alt, ix): each alternative, in order, takes the first nominal that fits it and that none before it has taken, nor `taken`
    (keys, verb, ix). One round per alternative of the dictionary."""
    found = fits(openings(verbs, tokens, valences, keys, skip), tokens, keys)
    found = saved(found if taken is None else found.join(taken.select(*keys, "verb", "ix").hint("merge"), [*keys, "verb", "ix"], "left_anti"), "fits")
    used = None
    for alt in sorted(r[0] for r in valences.select("alt").distinct().collect()):
        free = found.where(F.col("alt") == alt)
        if used is not None:
            free = free.join(used.select(*keys, "verb", "ix").hint("merge"), [*keys, "verb", "ix"], "left_anti")
        took = saved(free.groupBy(*keys, "verb", "alt").agg(F.min("ix").alias("ix")), "took")
        used = took if used is None else used.unionByName(took)
    return found.limit(0) if used is None else used


def fill_right(tokens: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """tokens with name: the label carried to the right over words of phrases (a number as mark), conjunctions and prepositions, up to a label, an adverb or
    anything else; conjunctions and prepositions at the end of what is filled stay without."""
    light = F.col("pos").isin("CCONJ", "ADP")
    inside = F.col(label).isNull() & (F.col("pos") != "ADV") & (F.col("mark").rlike("^[0-9]+$") | light)
    run = carried(tokens, keys, [F.col("ix")], F.col(label), "__fill", resets=~inside)
    # A light word is kept if a heavy one of the same run follows before the run ends.
    heavy = F.when(inside & ~light & F.col("__fill").isNotNull(), F.lit(True))
    ahead = carried(run, keys, [F.desc("ix")], heavy, "__heavy", resets=~inside)
    keep = inside & F.col("__fill").isNotNull() & (~light | F.coalesce("__heavy", F.lit(False)))
    return ahead.withColumn(name, F.coalesce(F.col(label), F.when(keep, F.col("__fill")))).drop("__fill", "__heavy")


def fill_left(tokens: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """tokens with name: the label carried to the left over the words of its phrase (equal mark), and over a conjunction that joins an adjective to it."""
    joins = lambda c: F.col(c).isin("ADJ", "NUM")
    near = carried(tokens, keys, [F.desc("ix")], F.struct("pos", "mark"), "__right", own=False)
    near = carried(near, keys, [F.col("ix")], F.struct("pos"), "__left", own=False)
    same = F.coalesce(F.col("mark") == F.col("__right.mark"), F.lit(False))
    conjunction = (F.col("pos") == "CCONJ") & F.coalesce(joins("__left.pos"), F.lit(False))
    joined = joins("pos") & F.coalesce(F.col("__right.pos") == "CCONJ", F.lit(False))
    ends = F.col(label).isNotNull() | ~(same | conjunction | joined)
    out = carried(near, keys, [F.desc("ix")], F.col(label), "__fill", resets=ends)
    return out.withColumn(name, F.coalesce(F.col(label), "__fill")).drop("__right", "__left", "__fill")
