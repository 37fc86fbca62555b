"""Scans over sorted ranges and as-of joins against plain Python, with a key that holds most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from claimgraph.operators import asof, ordered, scan

rng = random.Random(4)
KEYS = [("a", "b", None)[min(2, int(rng.expovariate(1.5)))] for _ in range(600)]
ROWS = [(k, i, rng.choice(["N", "V", "-", None, "?"]), rng.choice([None, f"v{i}"])) for i, k in enumerate(KEYS)]


@pytest.fixture(scope="module")
def rows(spark):
    changed = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield spark.createDataFrame(ROWS, "k string, at long, s string, v string").repartition(5)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_a_large_key_is_many_tasks(rows):
    ranged = scan._in_ranges(rows, [F.col("k"), F.col("at")]).select("k", F.shiftright("__at", 33).alias("part"))
    assert ranged.where("k = 'a'").select("part").distinct().count() >= 4


@pytest.mark.parametrize("back", [1, 2, 5])
def test_nearest_preceding(rows, back):
    want, seen = {}, {}
    for k, at, s, v in ROWS:
        before = seen.setdefault(k, [])
        found = [x for x in before[: len(before) - back + 1] if x is not None]
        want[at] = found[-1] if found else None
        before.append(v if s == "N" else None)
    got = ordered.nearest_preceding(rows, ["k"], ["at"], F.col("s") == "N", F.col("v"), "near", back)
    assert got.columns == ["k", "at", "s", "v", "near"]
    assert {r.at: r.near for r in got.collect()} == want


def test_carry_with_resets(rows):
    want, held = {}, {}
    for k, at, s, v in ROWS:
        if s == "-":
            held[k] = None
        held[k] = v if v is not None and s != "V" else held.get(k)
        want[at] = held[k]
    got = ordered.carry(rows, ["k"], ["at"], F.coalesce(F.col("s") != "V", F.lit(True)), F.col("v"), F.col("s") == "-", "held")
    assert {r.at: r.held for r in got.collect()} == want


def test_states_and_final_states(rows):
    transitions = {("0", "N"): "1", ("1", "V"): "2", ("2", "N"): "0", ("1", "-"): "0", ("2", "-"): "1", ("0", "-"): "2"}
    want, state = {}, {}
    for k, at, s, _ in ROWS:
        state[k] = transitions.get((state.get(k, "0"), s), state.get(k, "0"))
        want[at] = state[k]
    got = scan.states(rows, ["k"], ["at"], "s", transitions, "0", "state").collect()
    assert {r.at: r.state for r in got} == want and {r.at: r.v for r in got} == {r[1]: r[3] for r in ROWS}
    assert {r.k: r.state for r in scan.final_states(rows, ["k"], ["at"], "s", transitions, "0", "state").collect()} == state


def test_empty_tables(rows):
    none = rows.where("false")
    assert ordered.nearest_preceding(none, ["k"], ["at"], F.lit(True), F.col("v"), "x").collect() == []
    assert ordered.nearest_preceding(none, ["k"], ["at"], F.lit(True), F.col("v"), "x", 3).collect() == []
    assert scan.states(none, ["k"], ["at"], "s", {("0", "N"): "1"}, "0", "x").collect() == []


def test_nearest_agreeing(spark, rows):
    """Exact tier before a loose one of two alternatives, ties in order by value, nulls as values where the tier says so, repeated probes."""
    probes = rows.where("at % 3 = 0").unionByName(rows.where("at = 30"))
    found = rows.select("k", (F.col("at") - F.col("at") % 2).alias("at"), "s", "v")
    text, letter = F.coalesce("s", F.lit("")), F.substring("v", -1, 1)
    tiers = [[asof.Alternative([text, letter], [text, letter])], [asof.Alternative([letter], [letter]), asof.Alternative([asof.accepting(F.col("s"), F.lit("N"))], [asof.with_any(F.col("s"))])]]
    got = sorted(((r.at, r.near, r.near_tier) for r in asof.nearest_agreeing(probes, found, ["k"], ["at"], tiers, F.struct("v", "s"), "near").collect()), key=repr)
    want = []
    for k, at, s, v in [r for r in ROWS if r[1] % 3 == 0] + [r for r in ROWS if r[1] == 30]:
        earlier = [(a - a % 2, (w, t)) for j, a, t, w in ROWS if j == k and k is not None and a - a % 2 < at]
        exact = [(a, (w, t)) for a, (w, t) in earlier if (t or "") == (s or "") and v and w and w[-1] == v[-1]]
        loose = [(a, (w, t)) for a, (w, t) in earlier if (v and w and w[-1] == v[-1]) or (t or "") in (s or "", "N")]
        best = [(0, exact), (1, loose)]
        tier = next((n for n, x in best if x), None)
        last = max(best[tier][1], key=lambda x: (x[0], [(y is not None, y or "") for y in x[1]])) if tier is not None else None
        want.append((at, last and last[1], tier))
    assert [(a, n and tuple(n), t) for a, n, t in got] == sorted(want, key=repr)
