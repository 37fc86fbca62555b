"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame operations only).

A source is a stream of words: its documents in a pseudo-random order, over again for each epoch. The stream is cut into
blocks. A source takes whole epochs while its target allows, and of the last epoch the blocks that a permutation puts
first, the last of them cut so that the words taken are the rounded target.

The exact block quotas of all sources are divided among output shards by a binary tree: a node with n blocks, of which
q_s from source s, gives its left child half of them, drawn without replacement. The draw is sequential over the
sources, each a hypergeometric draw by inversion around its mean. Each leaf then owns a run of every source's permuted
blocks, disjoint from the others', and orders its blocks by a hash. The permutation is a keyed Feistel network on the block
numbers, so no block is sorted or gathered; the number of shards goes with the words of the mix.

Orders come from two-level prefix sums: documents are dealt by hash into bins of about BIN documents, so a source with a
third of all rows is never gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, fresh, without, word_count, written

#: Words in a shard, about, and the least depth of the tree.
SHARD_WORDS, LEAST_LEVELS = 1 << 27, 3
BLOCK_WORDS = 1024
BIN = 4096
CAP = 3
WEIGHTS = (1, 2, 3)
OUTPUTS = ("size", "source_size", "target", "taken", "pieces")
PLACED = ("epoch", "shard", "place", "from_word")
PIECE = "array<struct<epoch:int,shard:int,place:bigint,from_word:bigint,n_words:bigint>>"
#: The Feistel network's left side has at most as many values, and it has as many rounds.
LEFT, ROUNDS = 32, 6


def targets(sizes: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size) with rank and target.

    Sources by code point, null last, weigh weights[0], weights[1], ... over and over and share the total; a target
    stops at cap times its source's size and what it leaves is shared by weight among the rest. With r = cap * size / weight
    ascending the capped sources are a prefix, so prefix sums give the answer at once. One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "rank").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    # Were the sources before this one capped and no other, a unit of weight would get this much.
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    s = s.withColumn("share", share).withColumn("level", F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("ratio", "rank", "share"))).over(whole)["share"])
    return s.select("source", "source_size", "rank", F.least(F.col("most"), F.col("weight") * F.coalesce("level", F.lit(0.0))).alias("target"))


def _log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series, exact to 1e-10 from 8 on; smaller ones by table."""
    small = F.element_at(F.array(*[F.lit(v) for v in _SMALL]), F.least(x, F.lit(8)).cast("int") + 1)
    z = F.greatest(x, F.lit(1)).cast("double") + 1
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    return F.when(x < 8, small).otherwise(series)


_SMALL = [0.0, 0.0, 0.6931471805599453, 1.791759469228055, 3.1780538303479458, 4.787491742782046, 6.579251212010101, 8.525161361065415, 10.60460290274525]


def _draw(total: Column, good: Column, n: Column, u: Column) -> Column:
    """Of n blocks drawn from total, how many are among the good ones: hypergeometric, by inversion of u in [0, 1).

    The probabilities are summed from twelve standard deviations below the mean to as many above, beyond which less than
    1e-30 lies, so the work grows with the square root of the quota.
    """
    t, g, m = total.cast("double"), good.cast("double"), n.cast("double")
    mean = F.when(t > 0, m * g / t).otherwise(0.0)
    sd = F.sqrt(F.when(t > 1, mean * (1 - g / t) * (t - m) / (t - 1)).otherwise(0.0))
    low = F.greatest(F.lit(0).cast("long"), n - (total - good), F.floor(mean - 12 * sd - 12).cast("long"))
    high = F.least(good, n, F.ceil(mean + 12 * sd + 12).cast("long"))
    lf = _log_factorial
    at_low = F.exp(lf(good) - lf(low) - lf(good - low) + lf(total - good) - lf(n - low) - lf(total - good - n + low) - lf(total) + lf(n) + lf(total - n))
    state = F.struct(at_low.alias("p"), u.cast("double").alias("left"), low.alias("k"), F.lit(False).alias("done"))

    def step(s: Column, k: Column) -> Column:
        done = s["done"] | (s["left"] < s["p"])
        ahead = s["p"] * (g - k) * (m - k) / ((k + 1.0) * (t - g - m + k + 1.0))
        return F.struct(F.when(done, s["p"]).otherwise(ahead).alias("p"), F.when(done, s["left"]).otherwise(s["left"] - s["p"]).alias("left"), F.when(done, s["k"]).otherwise(k + 1).alias("k"), done.alias("done"))

    walked = F.aggregate(F.sequence(low, F.greatest(low, high - 1)), state, step, lambda s: s["k"])
    return F.when(high <= low, low).otherwise(F.least(walked, high))


def _unit(*parts: Column) -> Column:
    """A pseudo-random number in [0, 1) fixed by its parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def split(quotas: DataFrame, levels: int = LEAST_LEVELS, seed: int = 0) -> DataFrame:
    """quotas (rank, quota) to (shard, rank, first, quota): the run of each source's blocks that each of 2**levels shards owns."""
    nodes = quotas.select(F.lit(0).alias("shard"), "rank", F.lit(0).cast("long").alias("first"), F.col("quota").cast("long").alias("quota"))
    for level in range(levels):
        node = Window.partitionBy("shard")
        to_come = node.orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
        held = nodes.withColumn("total", F.sum("quota").over(node)).withColumn("remain", F.sum("quota").over(to_come))
        # A node's sources as one array in rank order (a row per source of the whole input), folded in sequence.
        packed = held.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("rank", "first", "quota", "remain"))).alias("s"), F.max("total").alias("total"))
        tip = F.when(F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard")), F.lit(2)) == 0, 0).otherwise(1)
        half = F.floor((F.col("total") + tip) / 2).cast("long")
        kind = "array<struct<rank:int,first:bigint,quota:bigint,got:bigint>>"

        def one(state: Column, x: Column) -> Column:
            got = _draw(x["remain"], x["quota"], state["need"], _unit(F.lit(seed), F.lit(level), F.col("shard"), x["rank"]))  # noqa: B023
            return F.struct((state["need"] - got).alias("need"), F.concat(state["out"], F.array(F.struct(x["rank"].alias("rank"), x["first"].alias("first"), x["quota"].alias("quota"), got.alias("got")))).cast(kind).alias("out"))

        folded = F.aggregate("s", F.struct(half.alias("need"), F.array().cast(kind).alias("out")), one, lambda s: s["out"])
        drawn = packed.select("shard", F.inline(folded))
        sides = F.array(
            F.struct((F.col("shard") * 2).alias("child"), F.col("first").alias("begin"), F.col("got").alias("share")),
            F.struct((F.col("shard") * 2 + 1).alias("child"), (F.col("first") + F.col("got")).alias("begin"), (F.col("quota") - F.col("got")).alias("share")),
        )
        nodes = drawn.select("rank", F.inline(sides)).select(F.col("child").alias("shard"), "rank", F.col("begin").alias("first"), F.col("share").alias("quota"))
        nodes = written(nodes, "mix-nodes")  # a row per shard and source; else the plans of all levels nest
    return nodes


def permuted(block: Column, blocks: Column, *key: Column) -> Column:
    """Where a keyed permutation of [0, blocks) puts a block.

    A Feistel network permutes left * ceil(blocks / left) numbers, left being LEFT or, for few blocks, their root; from one of
    the fewer than left that are no block it goes on, so a block is reached within left steps.
    """
    left = F.least(F.ceil(F.sqrt(blocks)).cast("long"), F.lit(LEFT))
    right = F.ceil(blocks / left).cast("long")

    def stirred(x: Column) -> Column:
        def turn(s: Column, k: Column) -> Column:
            far = F.pmod(s["l"] + F.pmod(F.xxhash64(*key, k, F.lit(0), s["r"]), left), left)
            near = lambda one: F.pmod(s["r"] + F.pmod(F.xxhash64(*key, k, F.lit(1), one), right), right)
            return F.struct(far.cast("long").alias("l"), near(far.cast("long")).cast("long").alias("r"))

        state = F.struct(F.floor(x / right).cast("long").alias("l"), F.pmod(x, right).cast("long").alias("r"))
        return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), state, turn, lambda s: s["l"] * right + s["r"])

    steps = F.sequence(F.lit(0).cast("long"), left * right - blocks)
    return F.aggregate(steps, block.cast("long") - blocks, lambda x, _: F.when((x >= 0) & (x < blocks), x).otherwise(stirred(F.when(x < 0, x + blocks).otherwise(x))))


def planned(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """targets() with docs to the plan of each source: epochs (whole ones), rest (words of the last), blocks, quota (blocks taken) and last_at."""
    want, size = F.round(F.col("target")).cast("long"), F.col("source_size")
    plan = sources.select("*", F.when(size > 0, F.floor(want / size)).otherwise(0).cast("long").alias("epochs"), F.greatest(F.ceil(size / block_words).cast("long"), F.lit(1)).alias("blocks"), F.ceil(F.col("docs") / BIN).cast("long").alias("bins"), want.alias("want"))
    plan = plan.withColumn("rest", F.when(size > 0, F.col("want") - F.col("epochs") * size).otherwise(0).cast("long"))
    plan = plan.withColumn("last_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("rank")))
    # Blocks of the last epoch: one more may be needed where the short block is among them.
    full = F.ceil(F.col("rest") / block_words).cast("long")
    with_short = F.ceil((F.col("rest") + F.col("blocks") * block_words - size) / block_words).cast("long")
    return plan.withColumn("quota", F.col("epochs") * F.col("blocks") + F.when(F.col("last_at") < full, with_short).otherwise(full))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", levels: int | None = None, block_words: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """(id, source, size, source_size, target, taken, pieces, place) of every row of docs.

    pieces: array of (epoch, shard, place, from_word, n_words): which words of the document each shard holds, and the
    hash that orders the blocks within the shard. taken is their sum and at most 3 times the size. levels: depth of the tree, by
    default as the words of the mix ask. Null and blank texts have size 0 and are not taken. A null source is a source like
    others, last in order. Rows that repeat an id are mixed like any; equal rows may be taken differently but reruns give
    the same rows. Sources of size 0 have target 0. An empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("place"))
    rows = written(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    counts = totals.select(F.col("source").alias("s"), "docs")
    sources = targets(totals.select("source", "source_size")).join(counts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = written(planned(sources, block_words, seed), "mix-plan")
    if levels is None:
        words = plan.agg(F.coalesce(F.sum("want"), F.lit(0))).first()[0]
        levels = max(LEAST_LEVELS, (max(0, words - 1) // SHARD_WORDS).bit_length())
    leaves = written(split(plan.select("rank", "quota"), levels, seed), "mix-leaves").where("quota > 0")
    # Runs are found by buckets of about a leaf's length, a few in each, however many shards there are.
    plan = plan.withColumn("width", F.greatest(F.ceil(F.col("quota") / (1 << levels)).cast("long"), F.lit(1)))
    spans = leaves.withColumnRenamed("quota", "share").join(plan.select("rank", "width"), "rank")
    spans = spans.select("rank", F.struct("first", "shard").alias("run"), F.explode(F.sequence(F.floor(F.col("first") / F.col("width")), F.floor((F.col("first") + F.col("share") - 1) / F.col("width")))).alias("bucket"))
    runs = spans.groupBy("rank", "bucket").agg(F.sort_array(F.collect_list("run")).alias("runs"))

    dealt = rows.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    dealt = dealt.withColumn("bin", F.floor(F.col("bins") * (F.col("place") / float(1 << 64) + 0.5)).cast("long"))
    bins = dealt.groupBy("rank", "bin").agg(F.sum("size").alias("words"))
    starts = bins.select("rank", "bin", F.coalesce(F.sum("words").over(Window.partitionBy("rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("bin_start"))
    inner = Window.partitionBy("rank", "bin").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, ["rank", "bin"])
    laid = laid.withColumn("start", F.col("bin_start") + F.col("within"))
    begin, size = F.col("start"), F.col("size")
    first_block, last_block = F.floor(begin / block_words), F.floor((begin + size - 1) / block_words)
    short = F.col("blocks") * block_words - F.col("source_size")  # what the last block lacks

    def piece(epoch: Column, b: Column, at: Column) -> Column:
        block_len = F.when(b == F.col("blocks") - 1, block_words - short).otherwise(F.lit(block_words))
        before = at * block_words - F.when(at > F.col("last_at"), short).otherwise(0)
        take = F.when(epoch < F.col("epochs"), block_len).otherwise(F.least(F.greatest(F.col("rest") - before, F.lit(0)), block_len))
        a = F.greatest(begin, b * block_words)
        z = F.least(begin + size, b * block_words + take)
        return F.struct(epoch.cast("int").alias("epoch"), (epoch * F.col("blocks") + at).alias("stream"), (a - begin).cast("long").alias("from_word"), (z - a).cast("long").alias("n_words"))

    here = F.transform(F.sequence(first_block, last_block), lambda b: F.struct(b.alias("b"), permuted(b, F.col("blocks"), F.lit(seed), F.col("rank")).alias("at")))
    laid = laid.withColumn("here", F.when((size > 0) & (F.col("quota") > 0), here))
    laps = F.sequence(F.lit(0).cast("long"), F.col("epochs"))
    drawn = F.filter(F.flatten(F.transform(laps, lambda e: F.transform("here", lambda x: piece(e, x["b"], x["at"])))), lambda p: p["n_words"] > 0)
    laid = written(laid.select("row", "id", "source", "size", "source_size", "target", "place", "rank", "width", F.when(F.col("here").isNotNull(), drawn).alias("drawn")), "mix-laid")
    each = laid.select("row", "rank", "width", F.explode("drawn").alias("p")).withColumn("bucket", F.floor(F.col("p.stream") / F.col("width")))
    placed = each.join(runs, ["rank", "bucket"])
    shard = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("p.stream")), -1)["shard"]
    held = F.struct(F.col("p.epoch"), shard.alias("shard"), F.xxhash64(F.lit(seed), F.col("rank"), F.col("p.stream")).alias("place"), F.col("p.from_word"), F.col("p.n_words"))
    pieces = placed.groupBy("row").agg(F.sort_array(F.collect_list(held)).alias("pieces"))  # no more than the blocks of one document
    out = laid.drop("drawn", "rank", "width").join(pieces, "row", "left").withColumn("pieces", F.coalesce(F.col("pieces").cast(PIECE), F.array().cast(PIECE)))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + p["n_words"])
    return out.select("id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces", "place")


def shards_of(pieces: Column) -> Column:
    """(shard, words) of each shard that holds words of a document, by shard."""
    numbers = F.array_sort(F.array_distinct(F.transform(pieces, lambda p: p["shard"])))
    return F.transform(numbers, lambda n: F.struct(n.alias("shard"), F.aggregate(F.filter(pieces, lambda p: p["shard"] == n), F.lit(0).cast("long"), lambda a, p: a + p["n_words"]).alias("words")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target, taken and pieces; input columns of these names are
    replaced. A document of the mix keeps its whole text; pieces say which of its words which shard holds, and how often.
    Each of repeated rows is taken or not by itself. An empty table gives no rows."""
    place, nth, key, home, order = fresh(docs, "mix_place", "mix_nth", "mix_key", "mix_home", "mix_order")
    mixed = written(mix(docs, id_col, text_col, source_col, seed=seed, **options), "mixed")
    here = without(docs, *OUTPUTS).withColumn(place, F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    found = mixed.select(F.col("place").alias(key), F.col("source").alias(home), *OUTPUTS)
    on = (F.col(place) == F.col(key)) & F.col(f"`{source_col}`").eqNullSafe(F.col(home))
    if mixed.groupBy("place", "source").count().where("count > 1").limit(1).count():
        # Equal rows may be taken differently: the k-th of the one side goes with the k-th of the other.
        here = here.withColumn(nth, F.row_number().over(Window.partitionBy(place, f"`{source_col}`").orderBy(place)))
        found = found.withColumn(order, F.row_number().over(Window.partitionBy(key, home).orderBy(F.desc("taken"))))
        on = on & (F.col(nth) == F.col(order))
    kept = here.join(found.where("taken > 0"), on)
    return kept.select(*[F.col(f"`{c}`") for c in without(docs, *OUTPUTS).columns], *OUTPUTS)


def _spaced_words(text: Column) -> Column:
    """The words, each with the white space after it."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))


def _cut(words: Column, piece: Column) -> Column:
    return F.btrim(F.array_join(F.slice(words, (piece["from_word"] + 1).cast("int"), piece["n_words"].cast("int")), ""), F.lit(SPACES))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """mixed_documents() with the words taken alone as text_col, repeats included: the pieces in their order, a line break between."""
    kept = mixed_documents(docs, id_col, text_col, source_col, seed=seed, **options)
    word, = fresh(kept, "words")
    cut = kept.withColumn(word, _spaced_words(F.col(f"`{text_col}`")))
    return cut.withColumn(text_col, F.array_join(F.transform("pieces", lambda p: _cut(F.col(word), p)), "\n")).drop(word)


def mixed_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **options) -> DataFrame:
    """The mixed text: a row per piece, in shard and place order. text_col holds the piece's words alone, taken their number;
    epoch, shard, place and from_word say where it stands, size, source_size and target are those of its document."""
    kept = mixed_documents(docs, id_col, text_col, source_col, seed=seed, **options)
    names = [c for c in kept.columns if c not in ("taken", "pieces") and c.lower() not in PLACED]
    cut = kept.select(*[F.col(f"`{c}`") for c in names], F.explode("pieces").alias("__piece"))
    piece = F.col("__piece")
    text = _cut(_spaced_words(F.col(f"`{text_col}`")), piece)
    out = cut.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names], piece["n_words"].alias("taken"), *[piece[c].alias(c) for c in PLACED])
    return out.orderBy("shard", "place", "epoch", f"`{id_col}`", "from_word")
