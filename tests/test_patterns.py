"""Row patterns, tails, valences against plain Python."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from claimgraph import storage
from claimgraph.operators import asof, matching, patterns, tails, valence
from claimgraph.operators.patterns import Step

rng = random.Random(6)


@pytest.mark.parametrize(
    ("steps", "regex"),
    [
        ([Step("a"), Step("b", 0, None), Step("a2", 0, 1)], "ab*a?"),
        ([Step("a", 1, 2), Step("b", 2, 3)], "a{1,2}b{2,3}"),
        ([Step("b", 0, None), Step("a", 0, None), Step("c")], "b*a*c"),
        ([Step("a", 2, None), Step("a2", 1, 1), Step("c", 0, 2)], "a{2,}ac{0,2}"),
    ],
)
def test_longest_is_what_a_greedy_expression_finds(steps, regex):
    takes = lambda c: sum(1 << i for i, s in enumerate(steps) if s.name[0] == c)
    for text in map("".join, itertools.product("abc", repeat=7)):
        kinds = [takes(c) for c in text]
        got = [(m[0][0], m[-1][1]) for m in patterns.matches(kinds, [{}] * len(kinds), steps)]
        assert got == [m.span() for m in re.finditer(regex, text) if m.group()], (regex, text)


def brute(kinds, features, steps, start):
    """The longest match from `start`, by trying every split of rows among steps."""
    def split(at, i, took):
        if at == len(steps):
            yield i
            return
        for n in range(steps[at].least, len(kinds) - i + 1 if steps[at].most is None else steps[at].most + 1):
            rows = range(i, i + n)
            if i + n > len(kinds):
                break
            last, good = dict(took), True
            for r in rows:
                good = good and kinds[r] >> at & 1 and all(o not in last or features[last[o]][f] == features[r][f] for o, f in steps[at].agrees)
                last[steps[at].name] = r
            if not good:
                break
            yield from split(at + 1, i + n, last)

    return max((e for e in split(0, start, {}) if e > start), default=None)


def test_agreement_equals_every_split():
    steps = [Step("x", 0, 2), Step("y", 1, None, (("x", "f"), ("y", "g"))), Step("z", 0, 1, (("y", "f"), ("x", "g")))]
    for _ in range(1500):
        n = rng.randint(1, 7)
        kinds = [rng.choice([1, 2, 3, 6, 7]) for _ in range(n)]
        features = [{"f": rng.choice([0, 1]), "g": rng.choice([0, 1, None])} for _ in range(n)]
        for start in range(n):
            found = patterns.longest(kinds, features, steps, start)
            assert (found and found[-1][1]) == brute(kinds, features, steps, start)


def test_matches_over_rows(spark):
    rows = [("k", i, c) for i, c in enumerate("abba.cbaab..abb")] + [(None, i, c) for i, c in enumerate("ab")] + [("z", 0, None)]
    df = spark.createDataFrame(rows, "k string, i int, c string").repartition(4)
    steps = [Step("a"), Step("b", 0, None)]
    got = sorted((r.k or "", r.first, r.last, r.n, [s["step"] for s in r.steps]) for r in patterns.match_rows(df, ["k"], "i", steps, {s.name: F.col("c") == s.name for s in steps}).collect())
    assert got == [("", 0, 1, 2, ["a", "b"]), ("k", 0, 2, 3, ["a", "b"]), ("k", 3, 3, 1, ["a"]), ("k", 7, 7, 1, ["a"]), ("k", 8, 9, 2, ["a", "b"]), ("k", 12, 14, 3, ["a", "b"])]
    assert patterns.match_rows(df.limit(0), ["k"], "i", steps, {s.name: F.col("c") == s.name for s in steps}).collect() == []


def test_tails_are_consumed(spark):
    forms = [(1, "клапана"), (2, "корпуса насоса"), (3, "насоса"), (4, None), (5, ""), (6, "вала"), (7, "большого вала двигателя")]
    tailed = [(4, "вала корпуса"), (8, "клапана и корпуса насоса"), (9, "большого вала"), (10, "вала и чего-то и насоса"), (11, None), (12, ""), (13, "и и"), (2, "клапана")]
    f = spark.createDataFrame([("d", *x) for x in forms] + [("e", 1, "вала")], "code string, ord int, form string")
    t = spark.createDataFrame([("d", *x) for x in tailed], "code string, ord int, tail string")
    chain, rest = tails.owners(t, f, ["code"], "ord", "tail", "form")
    assert sorted(tuple(r)[1:] for r in chain.collect()) == [(2, 1, 1), (8, 1, 3), (8, 2, 1), (9, 1, 7), (10, 1, 6), (10, 2, 3)]
    assert {r.ord: r.rest for r in rest.collect()} == {2: "", 4: "вала корпуса", 8: "корпуса", 9: "", 10: "чего-то", 11: "", 12: "", 13: "и и"}
    size = t.select(F.length(tails.prefix_sums(F.split(F.lit("a b c d"), " ")).cast("string")).alias("n")).first().n
    assert size > 0


def test_first_alternative_and_turns(spark):
    text = "имеет на валу клапан в корпусе быстро ось".split()
    pos = ["VERB", "ADP", "NOUN", "NOUN", "ADP", "NOUN", "ADV", "NOUN"]
    case = [None, None, "Loc", "Acc", None, "Loc", None, "Acc"]
    t = spark.createDataFrame([("s", i, w, p, c, "1") for i, (w, p, c) in enumerate(zip(text, pos, case, strict=True), 1)], "k string, ix int, text string, pos string, case string, mark string")
    verbs = t.where("pos = 'VERB'").select("k", F.col("ix").alias("verb"), F.lit("иметь").alias("lemma"))
    table = spark.createDataFrame([("иметь", 1, ["под"], ["Acc"]), ("иметь", 2, ["в"], ["Loc"]), ("иметь", 3, [], ["Acc"]), ("иметь", 4, [], ["Loc"])], "lemma string, alt int, anchors array<string>, cases array<string>")
    assert [tuple(r)[1:] for r in valence.objects(verbs, t, table, ["k"]).collect()] == [(1, 2, 6)]
    assert sorted(tuple(r)[1:] for r in valence.additions(verbs, t, table, ["k"]).collect()) == [(1, 2, 6), (1, 3, 4), (1, 4, 3)]
    assert valence.objects(verbs.limit(0), t, table, ["k"]).collect() == []


def test_tails_are_hashed_on_all_cores_and_once(spark, monkeypatch):
    """Tails and forms of one small file are hashed in many tasks; what a probe accepts is worked out once a row, not again for the ranges' sample."""
    rows = [("d", i, f"w{i % 7} w{i % 5} w{i % 3}", f"w{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "code string, ord int, tail string, form string").coalesce(1)
    tasks = {}
    for module in (tails, matching, asof):
        monkeypatch.setattr(module, "saved", lambda df, name: tasks.setdefault(name, df.rdd.getNumPartitions()) and storage.saved(df, name))
    assert tails.owners(df, df, ["code"], "ord", "tail", "form")[0].count() > 0
    assert min(tasks["tails"], tasks["forms"]) > 1
    tasks.clear()
    near = {r.ord: r.near for r in matching.nearest_form(df, df, ["code"], "ord", "tail", "form", "near").collect()}
    assert min(tasks["probes"], tasks["forms"]) > 1
    fits = lambda tail, form: f"{tail} ".startswith(f"{form} ") or f" {tail}".endswith(f" {form}")
    assert near == {i: max(j for j in range(i) if fits(t, rows[j][3])) for _, i, t, _ in rows if any(fits(t, rows[j][3]) for j in range(i))}
    made = spark.sparkContext.accumulator(0)

    def noted(form):
        made.add(1)
        return form

    ways = [[asof.Alternative([F.udf(noted)("form")], [F.col("form")])]]
    assert asof.nearest_agreeing(df, df, ["code"], ["ord"], ways, F.col("ord"), "near").count() == 60
    assert made.value == 60
