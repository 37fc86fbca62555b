"""Matching operators: token alignment, nearest theta matches, ordered merges, label runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .asof import Alternative, nearest_agreeing
from .scan import carried, running_total
from .tails import cut, cuts, dealt, prefix_sums


def _ends(df: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, at, text, start, end): tokens with the characters they span in their text, white space aside."""
    total = running_total(df.select(*keys, F.col(order).alias("at"), F.col(text).alias("text")), keys, ["at"], F.length("text"), "end")
    return total.select(*keys, "at", "text", (F.col("end") - F.coalesce(F.length("text"), F.lit(0))).alias("start"), "end")


def align_tokens(left: DataFrame, right: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Pairs of tokens of two cuts of one text that begin and end at the same characters (white space aside).

    Token ends are running sums of lengths, so the alignment is an equi-join on (keys, start, end), not a two-pointer walk.
    """
    named = lambda df, name: _ends(df, keys, order, text).withColumnsRenamed({"at": name, "text": f"{name}_text"})
    return named(left, "left_at").join(named(right, "right_at"), [*keys, "start", "end"])


def align_groups(left: DataFrame, right: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """(keys, end, left_from, left_to, n_left, right_from, right_to, n_right): tokens of two cuts of one text in groups, m of the one for n of the other.

    A group ends where both cuts have a token's end (`end` counts characters, white space aside); what is behind the last common end is one group whose end is
    null, with the tokens of one side alone where the other has none. Every token of both sides is in one group. Each token takes the
    next common end, by a scan from the back, so a text of any length is many tasks.
    """
    sides = [_ends(df, keys, order, text).withColumn("side", F.lit(n)) for n, df in enumerate((left, right))]
    both = saved(sides[0].unionByName(sides[1]), "tokens")
    common = both.where("end is not null").groupBy(*keys, "end").agg(F.countDistinct("side").alias("n")).where("n = 2").select(*keys, "end", F.lit(-1).alias("side"))
    ahead = carried(both.unionByName(common, allowMissingColumns=True), keys, [F.desc("end"), F.asc("side")], F.when(F.col("side") < 0, F.col("end")), "group")
    side = lambda n, f: f(F.when(F.col("side") == n, F.col("at")))
    found = ahead.where("side >= 0").groupBy(*keys, "group").agg(*[f.alias(n) for k, name in ((0, "left"), (1, "right")) for f, n in ((side(k, F.min), f"{name}_from"), (side(k, F.max), f"{name}_to"), (side(k, F.count), f"n_{name}"))])
    return found.withColumnRenamed("group", "end")


#: Rows whose tokens are laid side by side at once.
AT_ONCE = 512


def _spread(tokens: pa.ListArray) -> tuple:
    """Of a column of token arrays, for all tokens: the tokens, their rows, places from 1, lengths and ends."""
    flat, counts = tokens.flatten(), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = np.cumsum(counts) - counts, np.concatenate([[0], np.cumsum(sizes)])
    return flat, np.repeat(np.arange(len(counts)), counts), np.arange(len(sizes)) - np.repeat(first, counts) + 1, sizes, total[1:] - np.repeat(total[first], counts)


def _side_by_side(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(key columns, left, right, bases) of some rows: bases[row] + end is a place of its own for every row and end, and bases[row + 1] - 1 one that is no end."""
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(k, AT_ONCE)
            sides = [_spread(part.column(keys + n)) for n in (0, 1)]
            longest = np.zeros(part.num_rows, np.int64)
            for _, row, _, _, end in sides:
                np.maximum.at(longest, row, end)
            yield part.columns[:keys], *sides, np.concatenate([[0], np.cumsum(longest + 2)])


def _shape(df: DataFrame, keys: list[str], rest: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), rest])


def align_arrays(df: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """(keys, left_at, right_at, left_text): align_tokens() of two arrays of tokens in one row, within the row: no shuffle, nothing on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (texts, row, at, size, end), (_, row_r, at_r, size_r, end_r), base in _side_by_side(batches, len(keys)):
            # Of one side's tokens that start at a place, empty ones come first and one other at most.
            code, code_r = (2 * (base[r] + e - n) + (n > 0) for r, e, n in ((row, end, size), (row_r, end_r, size_r)))
            low, high = np.searchsorted(code_r, code, "left"), np.searchsorted(code_r, code, "right")
            i = np.repeat(np.arange(len(code)), high - low)
            j = np.arange(len(i)) - np.repeat(np.cumsum(high - low) - high, high - low)
            same = end[i] == end_r[j]
            i, j = i[same], j[same]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row[i])) for c in key), pa.array(at[i], pa.int32()), pa.array(at_r[j], pa.int32()), texts.take(pa.array(i))], [*keys, "left_at", "right_at", "left_text"])

    return df.select(*[F.col(f"`{k}`") for k in keys], left.alias("__left"), right.alias("__right")).mapInArrow(run, _shape(df, keys, "left_at int, right_at int, left_text string"))


def align_group_arrays(df: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """align_groups() of two arrays of tokens in one row, within the row: no shuffle, nothing on disk."""
    names = [f"{side}_{x}" for side in ("left", "right") for x in ("from", "to")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, *sides, base in _side_by_side(batches, len(keys)):
            ends = [base[row] + end for _, row, _, _, end in sides]
            common = np.intersect1d(*ends)
            groups = []
            for (_, row, _, _, _), end in zip(sides, ends, strict=True):
                ahead = np.append(common, base[-1])[np.searchsorted(common, end)]
                groups.append(np.where(ahead < base[row + 1], ahead, base[row + 1] - 1))
            every = np.union1d(*groups)
            row = np.searchsorted(base, every, "right") - 1
            out = [*(c.take(pa.array(row)) for c in key), pa.array(every - base[row], pa.int64(), mask=every == base[row + 1] - 1)]
            for (_, _, at, _, _), group in zip(sides, groups, strict=True):
                low, high = np.searchsorted(group, every, "left"), np.searchsorted(group, every, "right")
                padded, none = np.append(at, 0), low == high
                out += [pa.array(padded[low], pa.int32(), mask=none), pa.array(padded[high - 1], pa.int32(), mask=none), pa.array(high - low, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*keys, "end", *names[:2], "n_left", *names[2:], "n_right"])

    shape = "`end` bigint, left_from int, left_to int, n_left bigint, right_from int, right_to int, n_right bigint"
    return df.select(*[F.col(f"`{k}`") for k in keys], left.alias("__left"), right.alias("__right")).mapInArrow(run, _shape(df, keys, shape))


def nearest_holder(df: DataFrame, other: DataFrame, keys: list[str], order: str, ids: str, name: str) -> DataFrame:
    """(keys, order, name): for each row the order of the nearest earlier row of `other` whose array `ids` holds the row's order value.

    The arrays are filed by what they hold, so a row meets its nearest holder alone; rows without a holder are left out.
    """
    rows = df.select(*keys, order).distinct()
    holds = [[Alternative([F.col(order)], [F.col(ids)])]]
    found = nearest_agreeing(rows, other.select(*keys, order, ids), keys, [order], holds, F.col(order), name)
    return found.where(F.col(name).isNotNull()).select(*keys, order, name)


def nearest_form(df: DataFrame, other: DataFrame, keys: list[str], order: str, tail: str, form: str, name: str) -> DataFrame:
    """(keys, order, name): for each row the order of the nearest earlier row of `other` whose form begins, ends or is the row's tail,
    word by word. A tail is filed under the hashes of its beginnings and ends (see tails), two numbers a word."""
    words = lambda c: F.split(F.col(c), " ")
    shaped = lambda rows, c: dealt(rows.select(*keys, order, c).where(F.col(c).isNotNull()), keys, order).select(*keys, order, prefix_sums(words(c)).alias("sums"), F.size(words(c)).alias("size"))
    zero, size = F.lit(0), F.col("size")
    tails = shaped(df, tail).select(*keys, order, cuts(F.col("sums"), zero, size).alias("cuts"))
    forms = saved(shaped(other, form).select(*keys, order, cut(F.col("sums"), zero, size).alias("whole")), "forms")
    found = nearest_agreeing(tails, forms, keys, [order], [[Alternative([F.col("cuts")], [F.col("whole")])]], F.col(order), name)
    best = found.where(F.col(name).isNotNull()).groupBy(*keys, order).agg(F.max(name).alias(name))
    return best


def merge_ordered(df: DataFrame, keys: list[str], order: str, values: str) -> DataFrame:
    """The array values of equal keys one after the other, in order."""
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, values))).alias("__s"), F.min(order).alias(order))
    return packed.select(*keys, order, F.flatten(F.transform("__s", lambda x: x[values])).alias(values))


def first_by_priority(df: DataFrame, keys: list[str], kind: str, priority: tuple[str, ...], order: str) -> DataFrame:
    """The first row, in order, of the kind that comes first in the priority list; other kinds are passed over."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind))
    first = df.withColumn("__rank", rank).where("__rank > 0").groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct("__rank", order)).alias("__first"))
    return first.select("__first.*")


def fill_labels(df: DataFrame, keys: list[str], order: str, label: str, breaks: Column, name: str) -> DataFrame:
    """Carry the last label over unlabelled rows until a row that breaks the run."""
    return carried(df, keys, [order], F.when(breaks, None).otherwise(F.col(label)), name, breaks)


def demoted_roots(tokens: Column, labels: Column, root: str) -> Column:
    """Labels with a root blanked where its head is another root and the relation is not coordination."""
    zipped = F.arrays_zip(tokens.alias("t"), labels.alias("l"))
    roots = F.transform(F.filter(zipped, lambda z: z["l"] == root), lambda z: z["t"]["id"])
    return F.transform(zipped, lambda z: F.when((z["l"] == root) & F.array_contains(roots, z["t"]["parent"]) & (z["t"]["deprel"] != "conj"), F.lit("")).otherwise(z["l"]))


def genitive_tail(tokens: Column, root_at: Column) -> Column:
    """The text after the root if all of it is genitive or accusative (prepositions and conjunctions aside), else null."""
    after = F.slice(tokens, root_at + 2, F.greatest(F.size(tokens) - root_at - 1, F.lit(0)))
    nominal = F.filter(after, lambda t: ~t["pos"].isin("ADP", "CCONJ"))
    fits = F.forall(nominal, lambda t: F.coalesce(F.try_element_at(t["grammar"], F.lit("Case")).isin("Gen", "Acc"), F.lit(False)))
    return F.when((F.size(nominal) > 0) & fits, F.lower(F.array_join(F.transform(after, lambda t: t["text"]), " ")))


def tag_features(tags: Column, table: dict[str, tuple[str, str]]) -> Column:
    """Comma-separated tags to a feature map by table; of two tags for one feature the later counts, unknown tags are left out."""
    names = F.create_map(*[F.lit(x) for tag, (name, _) in table.items() for x in (tag, name)])
    values = F.create_map(*[F.lit(x) for tag, (_, value) in table.items() for x in (tag, value)])
    known = F.filter(F.split(tags, "[,=]"), lambda t: F.try_element_at(names, t).isNotNull())
    pairs = F.transform(known, lambda t: F.struct(F.try_element_at(names, t).alias("key"), F.try_element_at(values, t).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


#: Grammatical tags of a dictionary analyser and what they are in universal features.
RUSSIAN_TAGS = {
    "муж": ("Gender", "Masc"), "жен": ("Gender", "Fem"), "сред": ("Gender", "Neut"), "ед": ("Number", "Sing"), "мн": ("Number", "Plur"), "им": ("Case", "Nom"), "род": ("Case", "Gen"), "дат": ("Case", "Dat"), "вин": ("Case", "Acc"), "местн": ("Case", "Loc"), "твор": ("Case", "Ins"), "пр": ("Case", "Loc"), "парт": ("Case", "Gen"),
    "инф": ("VerbForm", "Inf"), "прич": ("VerbForm", "Part"), "деепр": ("VerbForm", "Trans"), "изъяв": ("Mood", "Ind"), "пов": ("Mood", "Imp"), "прош": ("Tense", "Past"), "наст": ("Tense", "Pres"), "непрош": ("Tense", "Fut"), "несов": ("Aspect", "Imp"), "сов": ("Aspect", "Perf"), "действ": ("Voice", "Act"), "страд": ("Voice", "Pass"),
    "1-л": ("Person", "1"), "2-л": ("Person", "2"), "3-л": ("Person", "3"), "срав": ("Degree", "Cmp"), "прев": ("Degree", "Sup"), "од": ("Animacy", "Anim"), "неод": ("Animacy", "Inan"),
}


def segment_dot(segments: DataFrame, code: str = "code") -> DataFrame:
    """(code, dot): the segment tree of (code, seg_id, type, text, parent) in DOT; parent 0 is the root."""
    label = F.concat(F.lit("["), F.col("seg_id").cast("string"), F.lit(":"), F.coalesce("type", F.lit("")), F.lit("] "), F.replace("text", F.lit('"'), F.lit("'")))
    line = F.concat(F.lit('"'), F.col("seg_id").cast("string"), F.lit('" [label="'), label, F.lit('"];\n"'), F.col("parent").cast("string"), F.lit('" -> "'), F.col("seg_id").cast("string"), F.lit('";'))
    packed = segments.groupBy(code).agg(F.sort_array(F.collect_list(F.struct("seg_id", line.alias("line")))).alias("s"))
    return packed.select(code, F.concat(F.lit("digraph {\n"), F.array_join(F.transform("s", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("dot"))
