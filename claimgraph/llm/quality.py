"""Quality rules: robust multivariate outliers (DataFrame operations only).

Every document gets a vector of transformed statistics. For each language and source a minimum-covariance-determinant
estimate is made from several deterministic starts (medians and quartile ranges alone, with correlations of the squashed
values, and with those of the spatial signs). Concentration steps take mean and covariance of the h documents nearest
to the last estimate; after FIRST_STEPS of them the start with the least determinant stays, and goes on until its
determinant settles. One reweighting step follows. A document far from its group's estimate by Mahalanobis distance is rejected.

A group is never gathered: order statistics come from counts over a fixed grid of bins, means and covariances are sums,
and all of them are pre-aggregated before they are shuffled. The h-subset ends within a bin, whose
documents count by the share of it that is wanted, so every subset weighs h and determinants can be compared. The squares of
the least deviations in FEATURES are added to every covariance's diagonal, so a statistic that hardly varies in a group does not reject what differs a little. A group
below MIN_GROUP documents is judged by its language's estimate, or, where that has too few as well, by that of all documents.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, fresh, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP = 60
SUBSET = 0.75
#: Steps that every start takes, steps after which an estimate that has not settled is an error, and when it has settled.
FIRST_STEPS, MOST_STEPS, SETTLED = 3, 60, 1e-3
#: Bins of the distance per unit of its logarithm.
BINS = 32
REWEIGHT = 0.975
#: A document of n words is judged by its group's covariance times 1 + SHORT / n, as the statistics of short texts vary more: its squared
#: Mahalanobis distance is that by the group's covariance times n / (n + SHORT).
SHORT = 60
#: (name, least standard deviation): below it a statistic is taken to vary by that much.
FEATURES = (("f_length", 0.04), ("f_symbols", 0.05), ("f_lines", 0.15), ("f_repeats", 0.10), ("f_capitals", 0.05), ("f_marks", 0.05))
#: The share of clean documents that a normal law would let pass the cutoff, a chi-square quantile.
TAIL = 1e-3
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
P = len(FEATURES)


def chi2_cdf(x: float, k: int) -> float:
    """Chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < q and high < 1e4:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return high


def _consistency(share: float) -> float:
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def measured(df: DataFrame, text_col: str) -> DataFrame:
    """df with the base statistics, base_failed and the features. Null and blank texts have no words and all counts 0.

    Three-word windows that occur twice are found without an object per window: 32 bits of a window's hash and its place are
    one long, and a primitive sort brings equal hashes together. Only windows whose 32 bits meet another's are hashed in full.
    """
    w, packed, near, starts, lines, safe = fresh(df, "w", "packed", "near", "starts", "lines", "safe")
    columns = [F.col(f"`{c}`") for c in df.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = df.select(*columns, text.alias(safe), words(F.col(f"`{text_col}`")).alias(w), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias(lines))
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    high = lambda x: F.shiftrightunsigned(x, 32)
    df = df.select(
        *columns,
        w,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length(safe) - F.length(F.regexp_replace(safe, f"[{SYMBOLS}]", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).alias(lines),
        F.length(F.regexp_replace(safe, r"[^\p{Lu}]+", "")).alias("f_capitals"),
        F.length(F.regexp_replace(safe, r"[\p{L}\p{N}\s]+", "")).alias("f_marks"),
        F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.shiftleft(window(i), 32).bitwiseOR(i.cast("long"))))).alias(packed),
    )
    meets = F.filter(packed, lambda x, i: (high(x) == high(F.get(packed, i - 1))) | (high(x) == high(F.get(packed, i + 1))))
    at = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    df = df.withColumn(near, F.sort_array(F.transform(meets, lambda x: F.struct(window(at(x)).alias("h"), at(x).alias("at"))))).drop(w, packed)
    twice = F.transform(near, lambda x, i: F.when((x["h"] == F.get(near, i - 1)["h"]) | (x["h"] == F.get(near, i + 1)["h"]), x["at"]))
    df = df.withColumn(starts, F.sort_array(F.filter(twice, lambda x: x.isNotNull())))
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return df.select(
        *columns,
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.log(chars / n).alias("f_length"),
        F.sqrt(F.col("n_symbols") / chars).alias("f_symbols"),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col(lines), F.lit(1))).alias("f_lines"),
        F.sqrt(F.col("n_repeat_words") / n).alias("f_repeats"),
        F.sqrt(F.col("f_capitals") / chars).alias("f_capitals"),
        F.sqrt(F.col("f_marks") / chars).alias("f_marks"),
    )


def _key(c: Column) -> Column:
    """Group keys as text; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def _groups(stats: DataFrame, min_group: int) -> DataFrame:
    """(lang_key, source_key, group, feeds): the group whose estimate judges them, null where even all are too few, and the
    groups whose estimates their documents go into."""
    n = stats.where("not base_failed").groupBy("lang_key", "source_key").agg(F.count("*").alias("n"))
    every = stats.select("lang_key", "source_key").distinct().join(n, ["lang_key", "source_key"], "left").fillna(0, ["n"])
    by_lang = Window.partitionBy("lang_key")
    small = F.col("n") < min_group
    every = every.withColumn("in_lang", F.sum("n").over(by_lang)).withColumn("lang_small", F.max(small).over(by_lang))
    poor = F.col("lang_small") & (F.col("in_lang") < min_group)
    in_all, some_poor = every.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max(poor), F.lit(False))).first()
    own = F.concat("lang_key", F.lit("\x01"), "source_key")
    enough = F.lit(in_all >= min_group)
    group = F.when(~small, own).when(F.col("in_lang") >= min_group, F.col("lang_key")).when(enough, F.lit("all"))
    feeds = F.array(F.when(~small, own), F.when(F.col("lang_small") & ~poor, F.col("lang_key")), F.when(F.lit(some_poor) & enough, F.lit("all")))
    return every.select("lang_key", "source_key", group.alias("group"), F.array_compact(feeds).alias("feeds"))


# Expressions over the params as SQL text: hundreds of them are written at once, which one call each would make slow.
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_CENTRED = [f"({name} - mean_{i})" for i, (name, _) in enumerate(FEATURES)]


def _sum(terms: list[str]) -> str:
    return "(" + (" + ".join(terms) or "0D") + ")"


def _distance() -> str:
    """Squared Mahalanobis distance from the params columns mean_i and w_i_j (inverse of the covariance's Cholesky factor)."""
    return _sum([f"pow({_sum([f'w_{i}_{j} * {_CENTRED[j]}' for j in range(i + 1)])}, 2)" for i in range(P)])


def _middles(rows: DataFrame) -> DataFrame:
    """(group, mean_i, sd_i): medians and interquartile ranges, from counts over a grid of a quarter of the least deviation."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(name) / (least / 4)).cast("long").alias("bin")) for i, (name, least) in enumerate(FEATURES)])
    counts = rows.select("group", F.inline(cells)).groupBy("group", "i", "bin").agg(F.count("*").alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("group", "i").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("group", "i"))
    ranked = counts.withColumn("share", up_to / total)
    quartiles = ranked.groupBy("group", "i").agg(*[F.min(F.when(F.col("share") >= q, F.col("bin"))).alias(f"q{k}") for k, q in enumerate((0.25, 0.5, 0.75))])
    least = F.element_at(F.array(*[F.lit(f) for _, f in FEATURES]), F.col("i") + 1)
    quartiles = quartiles.select("group", "i", ((F.col("q1") + 0.5) * least / 4).alias("mean"), F.greatest(least, (F.col("q2") - F.col("q0")) * least / 4 / 1.349).alias("sd"))
    return quartiles.groupBy("group").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}_{i}") for c in ("mean", "sd") for i in range(P)])


def _starts(rows: DataFrame) -> DataFrame:
    """(group, start, mean_i, s_i_j): medians, with three covariances."""
    middles = written(_middles(rows), "middles")
    z = [F.col(name) / F.col(f"sd_{i}") - F.col(f"mean_{i}") / F.col(f"sd_{i}") for i, (name, _) in enumerate(FEATURES)]
    squashed = [F.tanh(x) for x in z]
    norm = F.sqrt(F.greatest(reduce(lambda a, b: a + b, [x * x for x in z]), F.lit(1e-12)))
    signs = [x / norm for x in z]
    kinds = {"t": squashed, "u": signs}
    made = rows.join(middles, "group").select("group", *[x.alias(f"{k}_{i}") for k, v in kinds.items() for i, x in enumerate(v)])
    sums = made.groupBy("group").agg(*[F.avg(F.col(f"{k}_{i}") * F.col(f"{k}_{j}")).alias(f"{k}_{i}_{j}") for k in kinds for i in range(P) for j in range(i + 1)])
    both = middles.join(sums, "group")

    def covariance(kind: str | None, i: int, j: int) -> Column:
        if i == j:
            return F.col(f"sd_{i}") * F.col(f"sd_{i}")
        if kind is None:
            return F.lit(0.0)
        scale = F.sqrt(F.col(f"{kind}_{i}_{i}") * F.col(f"{kind}_{j}_{j}"))
        return F.when(scale > 0, F.col(f"{kind}_{i}_{j}") / scale).otherwise(0.0) * F.col(f"sd_{i}") * F.col(f"sd_{j}")

    starts = F.array(*[F.struct(F.lit(k).alias("start"), *[covariance(kind, i, j).alias(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)]) for k, kind in enumerate((None, "t", "u"))])
    return both.select("group", *[f"mean_{i}" for i in range(P)], F.inline(starts))


def _solved(df: DataFrame) -> DataFrame:
    """(group, start, mean_i, s_i_j) to (group, start, mean_i, w_i_j, logdet): the inverse of the Cholesky factor, and the determinant."""
    steps = []  # each may use those before it
    for i, j in _PAIRS:  # Cholesky factor l, row by row
        rest = f"s_{i}_{j} - {_sum([f'l_{i}_{k} * l_{j}_{k}' for k in range(j)])}"
        steps.append(f"sqrt(greatest({rest}, 1e-12D)) AS l_{i}_{j}" if i == j else f"({rest}) / l_{j}_{j} AS l_{i}_{j}")
    for i, j in _PAIRS:  # its inverse w
        steps.append(f"1 / l_{i}_{i} AS w_{i}_{j}" if i == j else f"-{_sum([f'l_{i}_{k} * w_{k}_{j}' for k in range(j, i)])} / l_{i}_{i} AS w_{i}_{j}")
    steps.append(f"2 * {_sum([f'ln(l_{i}_{i})' for i in range(P)])} AS logdet")
    return df.selectExpr("*", *steps).selectExpr("group", "start", *[f"mean_{i}" for i in range(P)], *[f"w_{i}_{j}" for i, j in _PAIRS], "logdet")


def _concentrated(rows: DataFrame, params: DataFrame, share: float | None) -> DataFrame:
    """Params from the mean and the covariance (times a consistency factor, plus the least variances) of the share of each
    group's rows nearest to its params; without a share, of those nearer than the reweighting cutoff."""
    far = rows.join(params, "group").selectExpr("group", "start", *[f"mean_{i}" for i in range(P)], f"{_distance()} AS d2", *[f"{c} AS x_{i}" for i, c in enumerate(_CENTRED)])
    if share is None:
        chosen = far.where(F.col("d2") <= chi2_quantile(REWEIGHT, P)).withColumn("part", F.lit(1.0))
    else:
        # Counts per bin first, a few bytes each, then the sums of the chosen: a task hands on one row of sums for each group.
        binned = far.withColumn("bin", F.floor(BINS * F.log(F.col("d2") + 1e-3)).cast("long"))
        by = Window.partitionBy("group", "start")
        counts = binned.groupBy("group", "start", "bin").agg(F.count("*").alias("n"))
        counts = counts.withColumn("want", share * F.sum("n").over(by)).withColumn("before", F.sum("n").over(by.orderBy("bin")) - F.col("n")).where("before < want")
        last = F.max(F.struct("bin", F.least(F.lit(1.0), (F.col("want") - F.col("before")) / F.col("n")).alias("share")))
        cuts = counts.groupBy("group", "start").agg(last.alias("cut"))
        chosen = binned.join(cuts, ["group", "start"]).where(F.col("bin") <= F.col("cut.bin")).withColumn("part", F.when(F.col("bin") < F.col("cut.bin"), 1.0).otherwise(F.col("cut.share")))
    moments = [f"sum(x_{i} * part) AS x_{i}" for i in range(P)] + [f"sum(x_{i} * x_{j} * part) AS p_{i}_{j}" for i, j in _PAIRS]
    held = chosen.groupBy("group", "start").agg(*[F.expr(e) for e in ("sum(part) AS n", *[f"max(mean_{i}) AS mean_{i}" for i in range(P)], *moments)])
    factor = _consistency(REWEIGHT if share is None else share)
    cov = lambda i, j: f"(p_{i}_{j} - x_{i} * x_{j} / n) / n * {factor!r}D + {FEATURES[i][1] ** 2 if i == j else 0.0!r}D AS s_{i}_{j}"
    return _solved(held.selectExpr("group", "start", *[f"mean_{i} + x_{i} / n AS mean_{i}" for i in range(P)], *[cov(i, j) for i, j in _PAIRS]))


def fitted(rows: DataFrame) -> DataFrame:
    """(group, start, mean_i, w_i_j, logdet) from a written table of rows (group, features): the estimate of the start whose determinant is the least."""
    params = written(_solved(_starts(rows)).withColumn("change", F.lit(None).cast("double")), "params")
    for step in range(MOST_STEPS):
        new = _concentrated(rows, params.drop("change"), 0.5 if step == 0 else SUBSET)
        if step == FIRST_STEPS - 1:
            best = Window.partitionBy("group").orderBy("logdet", "start")
            new = new.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
        before = params.select("group", "start", F.col("logdet").alias("was"))
        params = written(new.join(before, ["group", "start"]).withColumn("change", F.abs(F.col("logdet") - F.col("was"))).drop("was"), "params")
        if step >= FIRST_STEPS:
            change = params.agg(F.max("change")).first()[0]
            if change is None or change < SETTLED:
                break
    else:
        raise RuntimeError(f"an estimate did not settle in {MOST_STEPS} steps")
    return written(_concentrated(rows, params.drop("change"), None), "params")


def estimates(stats: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang_key, source_key, group, mean_i, w_i_j) from a written table of statistics."""
    groups = written(_groups(stats, min_group), "groups")
    rows = stats.where("not base_failed").join(groups, ["lang_key", "source_key"]).select(F.explode("feeds").alias("group"), *[n for n, _ in FEATURES])
    rows = written(rows, "vectors")
    return written(groups.join(fitted(rows).drop("start", "logdet"), "group", "left"), "estimates")


def _judged(stats: DataFrame, params: DataFrame) -> DataFrame:
    joined = stats.join(params, ["lang_key", "source_key"], "left")
    d2 = F.expr(_distance()) * F.col("n_words") / (F.col("n_words") + SHORT)
    cutoff = chi2_quantile(1 - TAIL, P)
    # One sum, not a conjunction: the optimizer would push the base rule alone below the join and inline into its lambdas
    # the arrays that measured() computes once.
    verdict = F.coalesce(d2, F.lit(0.0)) + F.col("base_failed").cast("double") * 1e300 <= cutoff
    return joined.withColumn("distance", F.sqrt(d2)).withColumn("kept", verdict)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """id_col and OUTPUTS of every row.

    Null and blank texts fail the base rule (fewer than 50 words). Null languages and sources are values of their own. Repeated rows
    count each. Where even all documents are too few for an estimate, distance is null and the base rule alone decides.
    An empty table gives no rows.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), _key(F.col(f"`{lang_col}`")).alias("lang_key"), _key(F.col(f"`{source_col}`")).alias("source_key"))
    stats = written(measured(source, "__text").drop("__text"), "stats")
    return _judged(stats, estimates(stats, min_group)).select(F.col("__id").alias(id_col), *OUTPUTS)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """docs without those that assess() rejects, columns as they were, in a written table beside their statistics meanwhile.

    Null and blank texts are rejected (fewer than 50 words); null languages and sources are values of their own; each of
    repeated rows stays or goes by itself, with one verdict; an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    source = docs.select(row.alias("__row"), F.col(f"`{text_col}`").alias("__text"), _key(F.col(f"`{lang_col}`")).alias("lang_key"), _key(F.col(f"`{source_col}`")).alias("source_key"))
    stats = written(measured(source, "__text").drop("__text"), "stats")
    kept = _judged(stats, estimates(stats.drop("__row"), min_group)).where("kept")
    return kept.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
