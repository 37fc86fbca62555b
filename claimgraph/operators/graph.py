"""Invention-graph tables: terms (code, key, term, ord), edges (code, sbj_key, obj_key, verb_key, type, ord), refs (code, key, alias)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved
from .containment import counted
from .ordered import last_wins

ROOT = "0.0"


def resolve_refs(df: DataFrame, refs: DataFrame, code: str, *keys: str) -> DataFrame:
    """Replace alias keys by the key they stand for."""
    for key in keys:
        names = refs.select(F.col("code").alias(code), F.col("alias").alias(key), F.col("key").alias("__canonical"))
        df = df.join(names, [code, key], "left").withColumn(key, F.coalesce("__canonical", key)).drop("__canonical")
    return df


def resolved(refs: DataFrame, rounds: int = 64) -> DataFrame:
    """(code, alias, key): refs with each alias's chain of keys followed to its end, by pointer jumping: each round doubles how far every alias
    sees, so a chain of n takes about log2 n rounds. Aliases that lead into a cycle stand for the cycle's smallest key. An alias with several keys
    takes the greatest; null aliases and keys are left out, and so is an alias of itself.
    """
    one = refs.where("alias is not null and key is not null").groupBy("code", "alias").agg(F.max("key").alias("key")).where("alias <> key")
    one = saved(one, "refs")
    more = one.select("code", F.col("alias").alias("key"), F.lit(True).alias("open"))
    state = saved(one.join(more, ["code", "key"], "left").select("code", "alias", "key", F.col("key").alias("least"), F.coalesce("open", F.lit(False)).alias("open")), "chains")
    for _ in range(rounds):
        ahead = state.select("code", F.col("alias").alias("key"), F.col("key").alias("far"), F.col("least").alias("far_least"), F.col("open").alias("far_open"))
        seen = state.where("open").join(ahead, ["code", "key"])
        seen = seen.select("code", "alias", F.col("far").alias("key"), F.least("least", "far_least").alias("least"), F.col("far_open").alias("open"), (~F.col("far_open") | (F.col("far_least") < F.col("least"))).alias("news"))
        seen = saved(seen, "chains")
        state = saved(state.where("not open").unionByName(seen.drop("news")), "chains")
        # Without a chain that ended or a smaller key seen, what is open are cycles, and every key on them sees all of its own.
        if not seen.where("news").limit(1).count():
            break
    else:
        raise RuntimeError(f"chains did not end in {rounds} rounds")
    cycles = state.where("open").select("code", F.col("alias").alias("key"), F.col("least").alias("cycle"))
    return state.join(cycles, ["code", "key"], "left").select("code", "alias", F.when(F.col("open"), F.col("cycle")).otherwise(F.col("key")).alias("key"))


def cross_points(df: DataFrame, left: str, right: str, keys: list[str]) -> DataFrame:
    """Each point of one side with each of the other, within a row."""
    return df.select(*keys, F.explode(left).alias("sbj_key"), F.col(right)).select(*keys, "sbj_key", F.explode(right).alias("obj_key"))


def merged_edges(edges: DataFrame) -> DataFrame:
    return last_wins(edges, ["code", "sbj_key", "obj_key"], ["ord"])


def floating(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """Terms that are neither the root nor the target of a have or comp edge."""
    held = edges.where(F.col("type").isin("have", "comp")).select("code", F.col("obj_key").alias("key"))
    return terms.where(F.col("key") != ROOT).join(held, ["code", "key"], "left_anti")


def similar_terms(loose: DataFrame, terms: DataFrame, keys: tuple[str, ...] = ("code",)) -> DataFrame:
    """(keys, key, into): floating terms whose text exactly one other term of equal keys contains."""
    other = terms.select(*keys, F.col("key").alias("into"), F.col("term").alias("longer"))
    found = counted(loose, other, list(keys), "key", "term", "into", "longer")
    return found.where("n = 1").select(*keys, "key", F.col("first").alias("into"))


def similar_in_order(loose: DataFrame, terms: DataFrame) -> DataFrame:
    """similar_terms() one after the other by ord: a term that is merged no longer counts for those after it.

    A document's terms, a row's worth, are folded in its own array; documents are independent.
    """
    marked = terms.join(loose.select("code", "key", F.lit(True).alias("loose")), ["code", "key"], "left")
    packed = marked.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("ord", "key", "term", F.coalesce("loose", F.lit(False)).alias("loose")))).alias("terms"))
    merged = "array<struct<key:string,into:string>>"
    state = F.struct(F.col("terms").alias("left"), F.array().cast(merged).alias("merged"))

    def one(s: Column, t: Column) -> Column:
        longer = F.filter(s["left"], lambda x: (x["key"] != t["key"]) & F.contains(x["term"], t["term"]))
        into = F.get(longer, F.lit(0))["key"]
        left = F.filter(s["left"], lambda x: x["key"] != t["key"])
        moved = F.transform(s["merged"], lambda m: F.struct(m["key"].alias("key"), F.when(m["into"] == t["key"], into).otherwise(m["into"]).alias("into")))
        done = F.concat(moved, F.array(F.struct(t["key"].alias("key"), into.alias("into"))))
        fits = F.size(longer) == 1
        return F.struct(F.when(fits, left).otherwise(s["left"]).alias("left"), F.when(fits, done).otherwise(s["merged"]).cast(merged).alias("merged"))

    folded = packed.select("code", F.filter("terms", lambda t: t["loose"]).alias("loose"), "terms")
    return folded.select("code", F.inline(F.aggregate("loose", state, one, lambda s: s["merged"])))


def synonyms(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, key, into): of equal terms under one parent by edges other than conn, the first stays."""
    children = edges.where("type <> 'conn'").select("code", F.col("sbj_key").alias("parent"), F.col("obj_key").alias("key")).distinct()
    named = children.join(terms, ["code", "key"])
    w = Window.partitionBy("code", "parent", "term").orderBy("ord", "key")
    first = named.withColumn("into", F.first("key").over(w)).where("key <> into")
    return first.groupBy("code", "key").agg(F.min("into").alias("into"))


def merge_keys(terms: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms without the merged ones, and edges with their ends replaced; of edges that coincide the last counts."""
    kept = terms.join(mapping.select("code", "key"), ["code", "key"], "left_anti")
    refs = mapping.select("code", F.col("into").alias("key"), F.col("key").alias("alias"))
    return kept, merged_edges(resolve_refs(edges, refs, "code", "sbj_key", "obj_key"))


def post_process(terms: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Similar terms merged, then synonyms. Each step reads its input several times, so inputs are written once."""
    terms, edges = saved(terms, "terms"), saved(edges, "edges")
    terms, edges = merge_keys(terms, edges, saved(similar_in_order(floating(terms, edges), terms), "similar"))
    terms, edges = saved(terms, "terms"), saved(edges, "edges")
    terms, edges = merge_keys(terms, edges, saved(synonyms(terms, edges), "synonyms"))
    return saved(terms, "terms"), saved(edges, "edges")


def closure(edges: DataFrame, types: tuple[str, ...] = ("comp", "have")) -> DataFrame:
    """(code, ancestor, descendant, depth) along containment edges; each pair at its least depth, to any depth.

    Each round joins what is known with itself, so paths double in length and rounds are the logarithm of the depth; a pair stays at its
    least depth, so cycles end.
    """
    pair = ["code", "ancestor", "descendant"]
    step = edges.where(F.col("type").isin(*types)).select("code", F.col("sbj_key").alias("ancestor"), F.col("obj_key").alias("descendant"), F.lit(1).alias("depth")).distinct()
    known = saved(step, "closure")
    reach = 1
    while True:
        # Paths longer than half of what is known so far go on; the shorter ones did so in an earlier round.
        ahead = known.where(F.col("depth") > reach // 2) if reach > 1 else known
        right = known.select("code", F.col("ancestor").alias("descendant"), F.col("descendant").alias("last"), F.col("depth").alias("more"))
        found = ahead.join(right, ["code", "descendant"]).select("code", "ancestor", F.col("last").alias("descendant"), (F.col("depth") + F.col("more")).alias("depth"))
        after = saved(known.unionByName(found).groupBy(*pair).agg(F.min("depth").alias("depth")), "closure")
        reach *= 2
        if not after.where(F.col("depth") > reach // 2).limit(1).count():
            return after
        known = after


def dot(terms: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, dot): the graph in DOT; root red, its children yellow, others lime; comp solid, conn dashed, have dotted."""
    from ..functions.clean import node_label

    children = edges.where(F.col("sbj_key") == ROOT).select("code", F.col("obj_key").alias("key"), F.lit("yellow").alias("near")).distinct()
    nodes = terms.join(children, ["code", "key"], "left").withColumn("color", F.when(F.col("key") == ROOT, "red").otherwise(F.coalesce("near", F.lit("lime"))))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    node_lines = nodes.select("code", F.concat(quoted(F.col("key")), F.lit(" [label="), quoted(node_label(F.col("term"))), F.lit(", color="), "color", F.lit("];")).alias("line"))
    style = F.when(F.col("type") == "comp", "solid").when(F.col("type") == "conn", "dashed").otherwise("dotted")
    edge_lines = edges.select("code", F.concat(quoted(F.col("sbj_key")), F.lit(" -> "), quoted(F.col("obj_key")), F.lit(" [style="), style, F.lit("];")).alias("line"))
    lines = node_lines.union(edge_lines).groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    return lines.select("code", F.concat(F.lit("digraph {\n"), "body", F.lit("\n}")).alias("dot"))
