"""Joins on ranges, aliases, contained texts and cuts of texts against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimgraph.operators import containment, graph, intervals, matching

rng = random.Random(9)


def test_spans_of_any_length(spark):
    spans = [(k, low, low + length) for k in "ab" for low, length in [(-5, 3), (0, 1), (7, 10**9), (-(10**12), 2 * 10**12), (3, 0), (2, 17), (-(2**62), 2**63 - 1)]] + [("a", None, 3), (None, 0, 9)]
    points = [(k, p) for k in "ab" for p in [-(2**62), -6, -5, -3, -2, 0, 1, 2, 3, 18, 19, 10**9 + 6, 10**9 + 7, 2**62 - 1]] + [("a", None), (None, 1)]
    s = spark.createDataFrame(spans, "k string, low long, high long")
    p = spark.createDataFrame(points, "k string, at long")
    got = sorted(tuple(r) for r in intervals.within(p, s, ["k"], "at", "low", "high").select("k", "at", "low", "high").collect())
    want = sorted((k, a, low, high) for k, a in points for j, low, high in spans if k == j and k and None not in (a, low, high) and low <= a < high)
    assert got == want
    assert s.where("low < high").select(F.size(intervals.cover(F.col("low"), F.col("high"))).alias("n")).agg(F.max("n")).first()[0] <= 126
    assert intervals.within(p, s.limit(0), ["k"], "at", "low", "high").collect() == []


def test_ends_that_are_no_whole_numbers(spark):
    s = spark.createDataFrame([(0.5, 2.25), (-1.5, -1.25)], "low double, high double")
    p = spark.createDataFrame([(x / 4,) for x in range(-8, 12)], "at double")
    got = sorted(tuple(r) for r in intervals.within(p, s, [], "at", "low", "high").select("at", "low").collect())
    assert got == sorted((x / 4, low) for x in range(-8, 12) for low, high in ((0.5, 2.25), (-1.5, -1.25)) if low <= x / 4 < high)


@settings(max_examples=200, deadline=None)
@given(st.integers(-1000, 1000), st.integers(1, 3000))
def test_cover_of_a_span(low, length):
    """The rule of cover(), in Python: disjoint nodes that make up the span."""
    nodes, a, b, k = [], low, low + length, 0
    while a < b:
        left, right = a & 1, b & 1
        nodes += [(k, a)] * left + [(k, b - 1)] * (right and (not left or a + 1 < b))
        a, b, k = (a + left) >> 1, b >> 1, k + 1
    assert sorted(x for k, n in nodes for x in range(n << k, (n + 1) << k)) == list(range(low, low + length))


def test_chains_in_few_rounds(spark):
    chain = [("c", f"k{i:04}", f"k{i + 1:04}") for i in range(1000)]
    ring = [("r", f"x{i}", f"x{(i + 1) % 12}") for i in range(12)] + [("r", "tail", "x5"), ("r", "a", "tail")]
    more = [("c", "k0003", "k0001"), ("s", "me", "me"), ("s", None, "x"), ("s", "y", None), ("d", "k0001", "z"), ("p", "u", "v"), ("p", "v", "u"), ("m", "many", "o"), ("m", "many", "p")]
    refs = spark.createDataFrame(chain + ring + more, "code string, alias string, key string")
    got = {(r.code, r.alias): r.key for r in graph.resolved(refs, rounds=12).collect()}
    want = {("c", a): "k1000" for _, a, _ in chain} | {("r", f"x{i}"): "x0" for i in range(12)} | {("r", "tail"): "x0", ("r", "a"): "x0", ("d", "k0001"): "z", ("p", "u"): "u", ("p", "v"): "u", ("m", "many"): "p"}
    assert got == want
    assert graph.resolved(refs.limit(0)).collect() == []


def test_closure_squares(spark):
    """A chain of 40 with a ring and a shortcut: least depths, in rounds of the logarithm."""
    edges = [("c", f"n{i}", f"n{i + 1}") for i in range(40)] + [("c", "n40", "n38"), ("c", "n0", "n20"), ("d", "n1", "n0")]
    df = spark.createDataFrame([(*e, "have") for e in edges], "code string, sbj_key string, obj_key string, type string")
    want = {}
    for code in "cd":
        out = {}
        for k, a, b in edges:
            if k == code:
                out.setdefault(a, []).append(b)
        for start in out:
            near, depth = [start], 0
            while near:
                depth += 1
                near = list(dict.fromkeys(y for x in near for y in out.get(x, []) if (code, start, y) not in want))
                want |= {(code, start, y): depth for y in near}
    assert {(r.code, r.ancestor, r.descendant): r.depth for r in graph.closure(df).collect()} == want


@pytest.mark.parametrize("posting", [3, 20000])
@pytest.mark.parametrize("gram", [2, 4])
def test_contained_texts(spark, gram, posting):
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "", "abab" * 50, "abab" * 50]
    long = [(i % 3, i, t) for i, t in enumerate(texts)]
    short = [(i % 3, i, t and t[1:4] or t) for i, t in enumerate(texts)]
    a, b = spark.createDataFrame(short, "k int, i int, t string"), spark.createDataFrame(long, "k int, j int, u string")
    for keys in (["k"], []):
        got = sorted((r.i, r.j) for r in containment.containing(a, b if keys else b.drop("k"), keys, "t", "u", gram, posting).collect())
        assert got == sorted((i, j) for k, i, t in short for m, j, u in long if t is not None and u is not None and t in u and (not keys or k == m))
    assert containment.containing(a.limit(0), b, ["k"], "t", "u").collect() == []
    plan = containment.containing(a, b, ["k"], "t", "u")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_groups_of_two_cuts(spark):
    cuts = {1: (["ab", "c", "def"], ["a", "bc", "de", "f"]), 2: (["abc"], ["ab"]), 3: (["", "a"], ["a", ""]), 4: (["x"], []), 5: (["aé", "漢"], ["aé漢"])}
    rows = [[(d, i, t) for d, sides in cuts.items() for i, t in enumerate(sides[n], 1)] for n in (0, 1)]
    left, right = (spark.createDataFrame(r, "d int, i int, t string") for r in rows)
    got = sorted(tuple(r) for r in matching.align_groups(left, right, ["d"], "i", "t").fillna(-1).collect())
    assert got == [(1, 3, 1, 2, 2, 1, 2, 2), (1, 6, 3, 3, 1, 3, 4, 2), (2, -1, 1, 1, 1, 1, 1, 1), (3, 1, 1, 2, 2, 1, 2, 2), (4, -1, 1, 1, 1, -1, -1, 0), (5, 3, 1, 2, 2, 1, 1, 1)]
