"""Prefix tries of conversations.

1. A turn becomes a digest of its role and text; a conversation becomes one string of digests, 32 characters a turn, and the lengths of its
   texts. Equal conversations are one class, whose ids are hashed in order as a stream.
2. Subtries are dealt by the digest of their first turn. Where the turns of a subtrie's classes are more than `limit`, it is dealt again by
   its next turn, and so on: the chain of turns that all its classes share is its trunk, which is kept as a row, and what
   comes after the trunk makes new subtries. A round looks only at the subtries that are still too large, and there is a round
   for every branching that they go through.
3. Subtries within the limit go to applyInPandas in hash buckets. A bucket is held as nodes with pointer dictionaries; subtrees are summed by an
   iterative postorder, so depth costs no recursion.
4. Trunks are summed from the last round up: the tops of the subtries below give the leaves and the savings.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import written

#: Characters of a digest; turns in a subtrie that one task builds.
WIDTH, LIMIT = 32, 20_000
NO_IDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Rows of a trunk that are made at a time.
STEP = 65536


def _digest(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, WIDTH)


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of turns (conv_id, turn, role, text): the digests of its turns one after the other, and the bytes of their texts.

    Turns go by turn, null first, those of equal turn by digest. Null roles and texts are empty. Rows without conv_id are left out.
    A conversation is one row: 40 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = _digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("d"), F.octet_length(text).cast("long").alias("b")).alias("t"))
    packed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return packed.select("conv_id", F.array_join(F.transform("t", lambda x: x["d"]), "").alias("path"), F.transform("t", lambda x: x["b"]).alias("sizes"))


def rebuilt(own: DataFrame, family: int = 5, shared: int = 9) -> DataFrame:
    """(conv_id, path, sizes): the first h turns of conversation conv_id - conv_id % family, then the conversation's own from h + 1 on;
    h is crc32 of the id's digits modulo `shared`. A first conversation that does not exist gives no turns."""
    most = shared - 1
    first = own.select(F.col("conv_id").alias("first"), F.substring("path", 1, most * WIDTH).alias("first_path"), F.slice("sizes", 1, most).alias("first_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    joined = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(first, "first", "left").withColumn("h", h)
    path = F.concat(F.coalesce(F.col("first_path").substr(F.lit(1), F.col("h") * WIDTH), F.lit("")), F.col("path").substr(F.col("h") * WIDTH + 1, F.length("path")))
    sizes = F.concat(F.coalesce(F.slice("first_sizes", F.lit(1), F.col("h")), F.array().cast("array<bigint>")), F.slice("sizes", F.col("h") + 1, F.size("sizes")))
    return joined.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, conv_id) sorted by both to (key, ends): SHA-256 of a key's ids, comma-joined. No ids are held."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k == key:
                state.update(b",%d" % conv)
            else:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(b"%d" % conv)
        yield pa.RecordBatch.from_pylist([{"key": k, "ends": e} for k, e in done], _ENDS)
    if state:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends": state.hexdigest()}], _ENDS)


_ENDS = pa.schema([("key", pa.string()), ("ends", pa.string())])


def classes(conversations: DataFrame) -> DataFrame:
    """(path, sizes, n, least, ends): equal conversations (conv_id, path, sizes) as one row, with the hash of their ids.

    SHA-256 runs in order by its definition: the ids of one class pass through one task, as a stream.
    """
    keyed = written(conversations.withColumn("key", _digest(F.col("path"))), "rebuilt")
    grouped = keyed.groupBy("key").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    ends = keyed.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "key string, ends string")
    return grouped.join(ends, "key").drop("key")


class Trie:
    """Nodes as columns, children as a dictionary per node from digest to place. A node's parent always has a smaller place."""

    def __init__(self):
        self.tops: dict[str, int] = {}
        self.kids: list[dict[str, int]] = []
        self.up, self.depth, self.size, self.n, self.least, self.ends = [], [], [], [], [], []

    def _node(self, up: int, depth: int, size: int) -> int:
        for column, value in ((self.kids, {}), (self.up, up), (self.depth, depth), (self.size, size), (self.n, 0), (self.least, None), (self.ends, NO_IDS)):
            column.append(value)
        return len(self.kids) - 1

    def add(self, group: str, at: int, path: str, sizes: list[int], n: int, least: int, ends: str) -> None:
        """A class of n conversations, from depth `at` on, where its group's top is."""
        node = self.tops.get(group)
        if node is None:
            node = self.tops[group] = self._node(-1, at, sizes[at - 1])
        for depth in range(at, len(sizes) + 1):
            if depth > at:
                turn = path[(depth - 1) * WIDTH : depth * WIDTH]
                below = self.kids[node].get(turn)
                if below is None:
                    below = self.kids[node][turn] = self._node(node, depth, sizes[depth - 1])
                node = below
            self.n[node] += n
            self.least[node] = least if self.least[node] is None else min(self.least[node], least)
        self.ends[node] = ends

    def postorder(self) -> Iterator[int]:
        for top in self.tops.values():
            waiting = [(top, iter(self.kids[top].values()))]
            while waiting:
                node, rest = waiting[-1]
                below = next(rest, None)
                if below is None:
                    waiting.pop()
                    yield node
                else:
                    waiting.append((below, iter(self.kids[below].values())))

    def sums(self) -> tuple[list[int], list[int]]:
        """Leaves and savings of each node's subtree."""
        leaves, saved = [0] * len(self.kids), [(n - 1) * size for n, size in zip(self.n, self.size, strict=True)]
        for node in self.postorder():
            leaves[node] = leaves[node] or 1
            if (up := self.up[node]) >= 0:
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        return leaves, saved


def _build(bucket: pd.DataFrame) -> pd.DataFrame:
    """Classes (g, parent, at, up, path, sizes, n, least, ends) of some subtries to their nodes; a top has its g and parent, the others null."""
    trie, above = Trie(), {}
    for row in bucket.itertuples(index=False):
        trie.add(row.g, row.at, row.path, row.sizes, row.n, row.least, row.ends)
        above[row.g] = (row.parent, row.up)
    leaves, saved = trie.sums()
    columns = {"conv_id": trie.least, "depth": trie.depth, "parent_conv_id": [trie.least[u] if u >= 0 else None for u in trie.up], "n_convs": trie.n, "n_children": [len(k) for k in trie.kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": trie.ends, "g": [None] * len(leaves), "parent": [None] * len(leaves)}
    for g, top in trie.tops.items():
        columns["g"][top], (columns["parent"][top], columns["parent_conv_id"][top]) = g, above[g]
    made = pd.DataFrame(columns)
    return made.astype({"parent_conv_id": "Int64"})


@F.pandas_udf(IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """The number of first turns that two paths share."""
    return pd.Series([len(os.path.commonprefix([x, y])) // WIDTH for x, y in zip(a, b, strict=True)], dtype="int32")


def _trunk_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trunks (g, parent, up, at, low, least, n, ends, sizes, below, leaves, saved) to their nodes, from the top down."""
    for batch in batches:
        for r in batch.to_pylist():
            rest = np.cumsum(np.array(r["sizes"], dtype=np.int64)[::-1])[::-1] * (r["n"] - 1) + r["saved"]
            for begin in range(r["at"], r["low"] + 1, STEP):
                depths = range(begin, min(begin + STEP, r["low"] + 1))
                rows = [{"conv_id": r["least"], "depth": d, "parent_conv_id": r["up"] if d == r["at"] else r["least"], "n_convs": r["n"], "n_children": r["below"] if d == r["low"] else 1, "n_leaves": r["leaves"], "saved_tokens": int(rest[d - r["at"]]), "ends_sha256": r["ends"] if d == r["low"] else NO_IDS, "g": r["g"] if d == r["at"] else None, "parent": r["parent"] if d == r["at"] else None} for d in depths]
                yield pa.RecordBatch.from_pylist(rows, _NODES)


_NODES = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in f"{NODE}, g string, parent string".split(", ")])


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per node of the trie of conversations (conv_id, path, sizes), see NODE for its columns.

    The root has depth 0 and no parent. A conversation without turns is a member of the root alone. limit bounds the memory of a task, not the
    result. An empty table has no members, so no node either.
    """
    found = written(classes(conversations), "classes")
    whole = found.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum(F.size("sizes")).alias("turns"), F.max(F.when(F.col("path") == "", F.col("ends"))).alias("ends")).first()
    spark = conversations.sparkSession
    root = [] if whole["n"] is None else [("", None, None, 0, 0, whole["least"], whole["n"], whole["ends"] or NO_IDS, [0])]
    trunks = [spark.createDataFrame(root, "g string, parent string, up long, at int, low int, least long, n long, ends string, sizes array<bigint>")]
    state = found.where("path <> ''").select("*", F.substring("path", 1, WIDTH).alias("g"), F.lit("").alias("parent"), F.lit(1).alias("at"), F.lit(whole["least"]).cast("long").alias("up"))
    small = []
    while True:
        large = state.groupBy("g").agg(F.sum(F.size("sizes") - F.col("at") + 1).alias("turns"), F.min("path").alias("x"), F.max("path").alias("y"), F.sum("n").alias("n"), F.min("least").alias("least"), F.first("parent").alias("parent"), F.first("at").alias("at"), F.first("up").alias("up"))
        large = written(large.where(F.col("turns") > limit).withColumn("low", _shared("x", "y")).drop("x", "y", "turns"), "large")
        if not large.limit(1).count():
            small.append(state)
            break
        small.append(state.join(large.select("g"), "g", "left_anti"))
        inside = state.drop("parent", "at", "up", "n", "least").join(large, "g")
        # What ends with the trunk is one class; any class has the trunk's sizes.
        ended = inside.where(F.size("sizes") == F.col("low")).select("g", "ends")
        sample = inside.groupBy("g").agg(F.first(F.slice("sizes", F.col("at"), F.col("low") - F.col("at") + 1)).alias("sizes"))
        trunk = large.join(ended, "g", "left").join(sample, "g")
        trunks.append(written(trunk.select("g", "parent", "up", "at", "low", "least", "n", F.coalesce("ends", F.lit(NO_IDS)).alias("ends"), "sizes"), "trunks"))
        after = state.join(large.select("g", "low", F.col("least").alias("above")), "g").where(F.size("sizes") > F.col("low"))
        key = _digest(F.col("path").substr(F.lit(1), (F.col("low") + 1) * WIDTH))
        state = written(after.select("path", "sizes", "n", "least", "ends", key.alias("g"), F.col("g").alias("parent"), (F.col("low") + 1).alias("at"), F.col("above").alias("up")), "subtries")

    columns = ["g", "parent", "at", "up", "path", "sizes", "n", "least", "ends"]
    buckets = max(1, -(-(whole["turns"] or 0) // limit))
    members = small[0].select(*columns)
    for more in small[1:]:
        members = members.unionByName(more.select(*columns))
    dealt = members.groupBy(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("bucket"))
    nodes = written(dealt.applyInPandas(_build, f"{NODE}, g string, parent string"), "nodes")
    for trunk in reversed(trunks):
        tops = nodes.where("parent is not null").groupBy(F.col("parent").alias("g")).agg(F.count("*").alias("below"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        summed = trunk.join(tops, "g", "left").select("*").withColumns({"below": F.coalesce("below", F.lit(0).cast("long")), "leaves": F.coalesce("leaves", F.lit(1).cast("long")), "saved": F.coalesce("saved", F.lit(0).cast("long"))})
        nodes = nodes.unionByName(written(summed.mapInArrow(_trunk_nodes, f"{NODE}, g string, parent string"), "trunk-nodes"))
    return nodes.select(*[c.split()[0] for c in NODE.split(", ")])
