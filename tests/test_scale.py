"""Steps that grew faster than their input, or that gathered what only looked small."""

import random

from pyspark.sql import functions as F

from claimgraph.operators import asof, containment, intervals, matching
from claimgraph.plans import registry


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_are_filed_by_rows_and_merged(spark):
    """Long spans over few points: levels of the tree follow the points, and what is filed is not broadcast."""
    points = spark.range(40).select((F.col("id") % 2).alias("k"), (F.col("id") * 10**7).alias("at"))
    spans = spark.range(8).select((F.col("id") % 2).alias("k"), (F.col("id") * 10**6 - 5).alias("low"), (F.col("id") * 10**6 + 10**9).alias("high"))
    found = intervals.within(points, spans, ["k"], "at", "low", "high")
    plan = plan_of(found)
    assert "SortMergeJoin [__node" in plan and plan.count("shiftright(") < 20
    assert found.count() == sum(a % 2 == b % 2 and b * 10**6 - 5 <= a * 10**7 < b * 10**6 + 10**9 for a in range(40) for b in range(8))


def test_asof_results_are_merged(spark):
    rows = spark.range(20).select((F.col("id") % 3).alias("k"), "id")
    found = asof.nearest_agreeing(rows, rows, ["k"], ["id"], [[asof.Alternative()]], F.col("id"), "near")
    assert "SortMergeJoin [__id" in plan_of(found)
    assert {r.id: r.near for r in found.collect()} == {i: i - 3 if i > 2 else None for i in range(20)}


def test_copies_of_texts_are_counted_not_paired(spark):
    """As pairs one by one, with ids that repeat; and many copies of few texts, whose pairs would be 10^10."""
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("ab") for _ in range(draw.randint(0, n)))
    short = [(i % 2, draw.randint(0, 30), text(4)) for i in range(60)] + [(0, None, "a"), (1, 3, None)]
    long = [(i % 2, draw.randint(0, 30), text(9)) for i in range(60)] + [(0, None, "ab"), (1, 4, None)]
    a, b = spark.createDataFrame(short, "k int, i int, t string"), spark.createDataFrame(long, "k int, j int, u string")
    for keys in (["k"], []):
        want: dict = {}
        for k, i, t in short:
            for m, j, u in long:
                if None not in (i, j, t, u) and i != j and t in u and (not keys or k == m):
                    want.setdefault((k, i) if keys else (i,), []).append(j)
        got = containment.counted(a if keys else a.drop("k"), b if keys else b.drop("k"), keys, "i", "t", "j", "u").collect()
        assert {tuple(r[:-2]): tuple(r[-2:]) for r in got} == {w: (len(js), min(js)) for w, js in want.items()}
    many = spark.range(100_000).select("id", F.concat(F.lit("name "), F.col("id") % 3).alias("t"))
    found = containment.counted(many.select("id", F.lit("name").alias("t")), many.withColumnsRenamed({"id": "j", "t": "u"}), [], "id", "t", "j", "u")
    assert found.agg(F.min("n"), F.max("n"), F.max("first"), F.count("*")).first()[:] == (99_999, 99_999, 1, 100_000)


def test_cuts_in_a_row_align_without_a_shuffle(spark):
    """The same as by token tables, with empty tokens, nulls and rows of one side alone."""
    draw = random.Random(5)

    def cut(text):
        out = []
        while text:
            n = draw.randint(0, 3)
            out, text = [*out, text[:n]], text[n:]
        return out + [""] * draw.randint(0, 2)

    rows = [(i, cut("aé漢d" * draw.randint(0, 4)), cut("aé漢d" * draw.randint(0, 4))) for i in range(700)] + [(900, None, ["a"]), (901, ["a"], None), (902, None, None), (903, [None, "a"], ["a", None])]
    df = spark.createDataFrame(rows, "d int, l array<string>, r array<string>")
    table = lambda c: df.select("d", F.posexplode(c).alias("i", "t")).withColumn("i", F.col("i") + 1)
    pairs = matching.align_arrays(df, ["d"], F.col("l"), F.col("r"))
    groups = matching.align_group_arrays(df, ["d"], F.col("l"), F.col("r"))
    plain = lambda found: sorted((tuple(r) for r in found.collect()), key=repr)
    assert plain(pairs) == plain(matching.align_tokens(table("l"), table("r"), ["d"], "i", "t").select("d", "left_at", "right_at", "left_at_text"))
    assert plain(groups) == plain(matching.align_groups(table("l"), table("r"), ["d"], "i", "t"))
    assert "Exchange" not in plan_of(pairs) + plan_of(groups)
    for name in ("align_tokens", "aligned_groups"):
        assert "Exchange" not in plan_of(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_samples_are_dealt_out(spark):
    """A small file is read by one task; what every row of it makes is not made there."""
    folder = "/root/testdata/sf0.001"
    assert registry.read(spark, folder, "supplier").rdd.getNumPartitions() == 1
    assert registry._sample_claims(spark, folder).rdd.getNumPartitions() > 1
    assert registry._sample_files(spark, folder).rdd.getNumPartitions() > 1
