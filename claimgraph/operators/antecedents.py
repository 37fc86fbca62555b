"""What a word of a clause belongs to in the clauses before it: nouns that agree with it, and verbs.

Tokens are rows (keys, seg_id, ix, id, pos, number, gender, case, verb_form, parent, deprel): a clause is a seg_id within the keys, ix orders the tokens
of a clause. All searches are as-of joins; words look at clauses before their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import ANY, Alternative, accepting, nearest_agreeing, with_any

#: Pairs of cases whose forms are easily mistaken for each other.
ALIKE = (("Acc", "Gen"), ("Acc", "Nom"), ("Loc", "Ins"))


def _pairs(case: Column) -> Column:
    """The pairs of ALIKE that a case is in."""
    return F.filter(F.array(*[F.when(case.isin(*p), "/".join(p)) for p in ALIKE]), lambda p: p.isNotNull())


def _genders(gender: Column, any_one: Column) -> Column:
    """What a word of a gender takes: its own, masculine for neuter, any where any_one holds."""
    return F.when(any_one, F.array(F.lit(ANY))).when(gender == "Neut", accepting(gender, F.lit("Masc"))).otherwise(accepting(gender))


def participle_tiers() -> list[list[Alternative]]:
    """Two tiers: number, gender and case as they are; then what forms that look alike allow."""
    number, gender, case = F.col("number"), F.col("gender"), F.col("case")
    plural, none = F.coalesce(number == "Plur", F.lit(False)), gender.isNull()
    text = lambda c: F.coalesce(c, F.lit(""))
    loose_number = F.when(plural, F.array(F.lit(ANY))).otherwise(accepting(number))
    exact = Alternative([text(number), _genders(gender, plural & none), text(case)], [text(number), with_any(gender), text(case)])
    alike = Alternative([loose_number, _genders(gender, none), _pairs(case)], [with_any(number), with_any(gender), _pairs(case)])
    short = Alternative([loose_number, _genders(gender, F.lit(False)), F.when(case.isNull(), "Nom")], [with_any(number), with_any(gender), case])
    same = Alternative([loose_number, text(case)], [with_any(number), text(case)])
    return [[exact], [alike, short, same]]


def noun_for_participle(words: DataFrame, tokens: DataFrame, keys: list[str], name: str = "noun") -> DataFrame:
    """words with name (seg_id, ix, id) of the nearest earlier noun or numeral that agrees, and name_tier: 0 for exact agreement, 1 for a loose one."""
    nouns = tokens.where(F.col("pos").isin("NOUN", "NUM"))
    return nearest_agreeing(words, nouns, keys, ["seg_id", "ix"], participle_tiers(), F.struct("seg_id", "ix", "id"), name, at=[F.col("seg_id"), F.lit(None).cast("int")])


def noun_for_which(words: DataFrame, tokens: DataFrame, keys: list[str], name: str = "noun") -> DataFrame:
    """words with name (seg_id, ix, id): of the agreeing nouns of the nearest earlier clause that has any, the last that hangs on no earlier of them,
    unless it is joined to one by a conjunction. Nouns agree in number, and in gender unless they are plural."""
    nouns = tokens.where("pos = 'NOUN'")
    agree = [Alternative([F.col("number"), F.col("gender")], [F.col("number"), F.col("gender")]), Alternative([F.when(F.col("number") == "Plur", "Plur")], [F.col("number")])]
    near = nearest_agreeing(words.withColumn("word", F.monotonically_increasing_id()), nouns, keys, ["seg_id", "ix"], [agree], F.col("seg_id"), "near", at=[F.col("seg_id"), F.lit(None).cast("int")]).drop("near_tier")
    near = near.withColumnsRenamed({c: f"w_{c}" for c in words.columns if c not in keys})
    # The agreeing nouns of one clause: equal keys, clause and features.
    met = near.join(nouns, [*[near[k] == nouns[k] for k in keys], near["near"] == nouns["seg_id"], near["w_number"] == nouns["number"]]).where((F.col("w_gender") == F.col("gender")) | (F.col("number") == "Plur"))
    met = met.select("word", nouns["seg_id"], nouns["ix"], nouns["id"], nouns["parent"], nouns["deprel"])
    above = met.select("word", F.col("id").alias("parent"), F.col("ix").alias("above"))
    hangs = met.join(above, ["word", "parent"], "left").withColumn("free", F.coalesce(F.col("deprel") == "conj", F.lit(False)) | F.coalesce(F.col("above") >= F.col("ix"), F.lit(True)))
    last = hangs.where("free").groupBy("word").agg(F.max_by(F.struct("seg_id", "ix", "id"), "ix").alias(name))
    joined = near.join(last, "word", "left").drop("word", "near")
    return joined.withColumnsRenamed({f"w_{c}": c for c in words.columns if c not in keys})


def finite_verb_before(words: DataFrame, tokens: DataFrame, keys: list[str], name: str = "verb") -> DataFrame:
    """words with name (seg_id, ix, id) of the nearest finite verb of an earlier clause."""
    verbs = tokens.where("pos = 'VERB' and verb_form = 'Fin'")
    return nearest_agreeing(words, verbs, keys, ["seg_id", "ix"], [[Alternative()]], F.struct("seg_id", "ix", "id"), name, at=[F.col("seg_id"), F.lit(None).cast("int")]).drop(f"{name}_tier")
