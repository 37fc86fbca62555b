"""MinHash near-dedup by an LSH forest.

1. Every document becomes its set of word shingles (64-bit hashes) and a MinHash signature. Documents with equal sets are
   one class, so exact copies cost a row each and are never paired.
2. Forest: each tree is an order of the classes by another slice of the signature. Classes whose labels agree to the least
   depth are a region. A region of at most look_back + 1 classes is looked at whole. Pairs whose sketches are far below
   the threshold are dropped (five standard deviations), the rest are candidate edges.
3. Classes of larger regions go through a prefix-filtered join on full sets: two sets at the threshold share one of their
   rarest shingles, so each class is filed under these, and under each shingle classes of different components so far are
   compared by size, place and sketch. A shingle with many classes is cut into blocks, and each pair of blocks is a task.
4. Connected components of the candidates bring together whatever may be linked. Inside each, links are confirmed on the
   full sets: every pair of different components-so-far is tested, so no link between gathered classes is lost,
   while pairs already connected are not tested. A component beyond block_bytes is split into blocks and
   each pair of blocks is a task, so memory stays bounded and the result exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, written
from .graph import components

TREES, DEPTH, LEAST_DEPTH, SKETCH = 24, 6, 3, 64
LOOK_BACK = 256
#: Shingles whose counts order the prefixes (any order is right, rare ones first makes it fast), and classes in a block.
FREQUENT, POSTINGS = 200_000, 4096
BLOCK_BYTES = 48 << 20
WORD_MEMORY = 400_000

_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORDS: dict[bytes, int] = {}


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter text is one shingle, a blank one has none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_TABLE).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    missing = [w for w in set(words) if w not in _WORDS]
    if missing:
        if len(_WORDS) > WORD_MEMORY:
            _WORDS.clear()
            missing = list(set(words))
        for w in missing:
            _WORDS[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    h = np.array([_WORDS[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), dtype=np.uint64)
    for j in range(min(k, len(h))):
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of 16 bits."""
    low = None
    for at in range(0, len(shingles), 2048):
        part = ((shingles[at : at + 2048, None] * _MULTIPLIERS) >> np.uint64(32)).min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return (low & np.uint64(0xFFFF)).astype(">u2")


def _features(k: int, with_set: bool):
    """(key, id, text) batches to (digest, set) or (key, id, n, digest, signature, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from made(batches)
        finally:  # the worker lives on for other stages
            _WORDS.clear()
            pa.default_memory_pool().release_unused()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for at in range(0, max(1, len(texts)), 1000):
                n, digest, extra, sketch = [], [], [], []
                for t in texts.slice(at, 1000):
                    s = shingle_set(t.as_py(), k)
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if with_set:
                        extra.append(s.tobytes())
                    else:
                        sig = signature(s) if len(s) else None
                        extra.append(None if sig is None else sig.tobytes())
                        sketch.append(None if sig is None else (sig[:: len(sig) // SKETCH][:SKETCH] & 0xFF).astype(np.uint8).tobytes())
                if with_set:
                    yield pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(extra, pa.binary())], ["digest", "shingles"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), batch.column(1).slice(at, 1000), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(extra, pa.binary()), pa.array(sketch, pa.binary())], ["key", "id", "n", "digest", "signature", "sketch"])

    return run


class Union:
    """Union-find over hashable nodes; the root is the smallest."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.up[b] = a


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Equally long byte strings as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _neighbours(least_agreement: float, look_back: int, stitch: bool):
    """Rows sorted by (tree, label) to candidate edges, contracted to stars (kind 0), the rows of the partition's outer
    regions (kind 1) and the classes of regions that look_back does not reach across (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, held, head, crowded = Union(), None, [], set()
        codes: dict[bytes, int] = {}

        def outer(rows: list[np.ndarray], last: bool) -> list[dict]:
            t, label, sketch, node = rows
            k = len(t) - 1 if last else 0
            same = np.flatnonzero((t == t[k]) & (label[:, :LEAST_DEPTH] == label[k, :LEAST_DEPTH]).all(axis=1))
            same = same[-look_back:] if last else same[:look_back]
            return [{"kind": 1, "a": None, "b": None, "tree": int(t[i]), "label": label[i].tobytes(), "digest": node[i], "sketch": sketch[i].tobytes()} for i in same.tolist()]

        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy()
            rows = [tree, _matrix(batch.column(1), ">u2", DEPTH), _matrix(batch.column(3), "u1", SKETCH), np.array(batch.column(2).to_pylist(), dtype=object)]
            old = 0 if held is None else len(held[0])
            if old:
                rows = [np.concatenate([a, b]) for a, b in zip(held, rows, strict=True)]
            t, label, sketch, node = rows
            if not stitch and len(head) < look_back and (held is None or len(head) == old):
                head = outer(rows, False)
            ids = np.array([codes.setdefault(x, len(codes)) for x in node], dtype=np.int64)
            root = np.array([union.find(x) for x in ids.tolist()], dtype=np.int64)
            first = np.ones(len(t), bool)
            first[1:] = (t[1:] != t[:-1]) | (label[1:, :LEAST_DEPTH] != label[:-1, :LEAST_DEPTH]).any(axis=1)
            start = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
            far = np.arange(len(t)) - start
            crowded.update(node[np.isin(start, start[far >= look_back])])
            at, joined = np.arange(old, len(t)), 0
            for j in range(1, look_back + 1):
                at = at[far[at] >= j]
                if not len(at):
                    break
                if joined and not j & (j - 1):
                    touched = np.flatnonzero(np.isin(start, start[at]))
                    root[touched] = [union.find(x) for x in ids[touched].tolist()]
                    joined = 0
                new = at[root[at] != root[at - j]]  # pairs already connected need no look
                new = new[(sketch[new] == sketch[new - j]).mean(axis=1) >= least_agreement]
                for i in new.tolist():
                    union.join(int(ids[i]), int(ids[i - j]))
                joined += len(new)
            held = [x[-look_back:] for x in rows]
        if held is None:
            return
        ends = [] if stitch else head + outer(held, True)
        names = list(codes)
        stars = [(names[x], names[union.find(x)]) for x in union.up]
        yield pa.RecordBatch.from_pylist([{"kind": 0, "a": x, "b": r} for x, r in stars if x != r] + ends + [{"kind": 2, "a": x} for x in crowded], _EDGES)

    return run


_EDGES = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("tree", pa.int32()), ("label", pa.binary()), ("digest", pa.binary()), ("sketch", pa.binary())])
_EDGES_SQL = "kind int, a binary, b binary, tree int, label binary, digest binary, sketch binary"


def _prefixes(tokens: np.ndarray, counts: np.ndarray, percent: int):
    """(digest, comp, sketch, shingles) to (digest, comp, n, sketch, tokens): the rarest shingles, of which two sets at the
    threshold share one; tokens (ascending) and counts order them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for packed in batch.column(3):
                s = np.frombuffer(packed.as_py(), dtype=np.uint64).view(np.int64)
                at = np.minimum(np.searchsorted(tokens, s), max(0, len(tokens) - 1))
                count = np.where(tokens[at] == s, counts[at], 0) if len(tokens) else np.zeros(len(s), np.int64)
                n.append(len(s))
                out.append(s[np.lexsort((s, count))][: len(s) - -(-percent * len(s) // 100) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(2), pa.array(out, pa.list_(pa.int64()))], ["digest", "comp", "n", "sketch", "tokens"])

    return run


def _pairs(least_agreement: float, percent: int):
    """Rows (token, i, j, n, pos, comp, digest, sketch) sorted by (token, i, j, n) to candidate edges between components, contracted to stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        union, key, group = Union(), None, []

        def done() -> None:
            n, pos = (np.array([r[c] for r in group], dtype=np.int64) for c in (0, 1))
            comp = np.unique(np.array([r[2] for r in group], dtype=object), return_inverse=True)[1]
            sketch = np.frombuffer(b"".join(r[4] for r in group), "u1").reshape(-1, SKETCH)
            ends = np.searchsorted(n * percent, 100 * n, side="right")
            for a in range(len(group) - 1):
                b = np.arange(a + 1, ends[a])
                # No shingle before this one is shared, if this pair is to be found here.
                b = b[(comp[b] != comp[a]) & ((100 + percent) * np.minimum(n[a] - pos[a], n[b] - pos[b]) >= percent * (n[a] + n[b]))]
                for x in b[(sketch[b] == sketch[a]).mean(axis=1) >= least_agreement].tolist():
                    union.join(group[a][3], group[x][3])

        for batch in batches:
            for token, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (token, i, j) != key:
                    if len(group) > 1:
                        done()
                    key, group = (token, i, j), []
                group.append(row)
        if len(group) > 1:
            done()
        stars = [(x, union.find(x)) for x in union.up]
        yield pa.RecordBatch.from_pylist([{"a": x, "b": r} for x, r in stars if x != r], pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    return run


def _crowded_edges(sets: DataFrame, percent: int, least_agreement: float, postings: int) -> DataFrame:
    """sets (digest, comp, sketch, shingles) to candidate edges (a, b) between classes of different comp."""
    unpacked = sets.mapInArrow(_tokens_of, "token long")
    frequent = unpacked.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow().sort_by("token")
    shape = "digest binary, comp binary, n long, sketch binary, tokens array<long>"
    prefixes = sets.mapInArrow(_prefixes(frequent["token"].to_numpy(), frequent["c"].to_numpy(), percent), shape)
    filed = written(prefixes.select("digest", "comp", "n", "sketch", F.posexplode("tokens").alias("pos", "token")), "prefixes")
    shared = filed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x <> y")
    shared = written(shared.select("token", F.ceil(F.col("c") / postings).cast("int").alias("blocks")), "postings")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    tasks = filed.join(shared, "token").select("token", F.explode(others).alias("p"), "n", F.col("pos").cast("long").alias("pos"), "comp", "digest", "sketch")
    tasks = tasks.select("token", "p.i", "p.j", "n", "pos", "comp", "digest", "sketch").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n")
    return written(tasks.mapInArrow(_pairs(least_agreement, percent), "a binary, b binary"), "crowded-edges")


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.int64))], ["token"])


def link_exactly(digests: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """(member, smallest member of its component) of the graph that links sets with 100 * |a & b| >= percent * |a | b|.

    A pivot is compared with all members outside its component. Members go on acting as pivots until those that
    have not all lie in one component, when every pair of different components has been tested.
    """
    g = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    labels = np.arange(g)
    if g == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * both >= percent * (sizes.sum() - both):
            labels[1] = 0
    else:
        owner = np.repeat(np.arange(g), sizes)
        _, rank = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(rank, kind="stable")
        postings, ends = owner[order], np.cumsum(np.bincount(rank))
        begins = np.concatenate([[0], ends[:-1]])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        popularity = np.add.reduceat((ends - begins)[rank].astype(float), offsets[:-1]) / sizes
        waiting = np.argsort(-popularity, kind="stable")
        while len(waiting):
            own = labels[waiting]
            main = np.bincount(own, minlength=g).argmax()
            outside = np.flatnonzero(own != main)
            if not len(outside) and len(waiting) > 0:
                break
            p = waiting[outside[0]] if np.bincount(own).max() > 1 else waiting[0]
            waiting = waiting[waiting != p]
            ids = rank[offsets[p] : offsets[p + 1]]
            inter = np.bincount(np.concatenate([postings[begins[i] : ends[i]] for i in ids]), minlength=g)
            hit = (100 * inter >= percent * (sizes[p] + sizes - inter)) & (labels != labels[p])
            if hit.any():
                merged = np.unique(np.append(labels[hit], labels[p]))
                labels[np.isin(labels, merged)] = merged[0]
    least: dict[int, bytes] = {}
    for d, c in zip(digests, labels.tolist(), strict=True):
        least[c] = min(d, least.get(c, d))
    return [(d, least[c]) for d, c in zip(digests, labels.tolist(), strict=True) if d != least[c]]


def _confirm(percent: int):
    """Rows (comp, i, j, digest, shingles) sorted by (comp, i, j) to confirmed stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digests, sets = None, [], []

        def done() -> pa.RecordBatch:
            stars = link_exactly(digests, sets, percent) if len(digests) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([s[0] for s in stars], pa.binary()), pa.array([s[1] for s in stars], pa.binary()), pa.array([key[3]] * len(stars), pa.bool_())], ["a", "b", "split"])

        for batch in batches:
            for comp, i, j, split, digest, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, i, j, split) != key:
                    if key is not None:
                        yield done()
                    key, digests, sets = (comp, i, j, split), [], []
                digests.append(digest)
                sets.append(np.frombuffer(shingles, dtype=np.uint64))
        if key is not None:
            yield done()

    return run


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, block_bytes: int = BLOCK_BYTES, look_back: int = LOOK_BACK, postings: int = POSTINGS) -> DataFrame:
    """(id, n, component) of every row of docs, id as given.

    component: the smallest id that is reachable over links, the row's own included. Blank and null texts have n = 0 and link
    with nothing: their component is their own id. Null ids are passed over by the minimum; a component of null ids alone
    has null. Repeated rows each get a row. An empty table gives none.

    A pair at the threshold whose sketches agree five standard deviations less than they should is not looked at (probability about 3e-7);
    it is then linked only where other links connect its documents.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    keyed = source.select(F.xxhash64("id", "text").alias("key"), "id", "text")
    kind = dict(keyed.dtypes)["id"]
    features = written(keyed.mapInArrow(_features(k, False), f"key long, id {kind}, n long, digest binary, signature binary, sketch binary"), "features")
    classes = features.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    width = 2 * DEPTH
    trees = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.col("signature").substr(t * width + 1, F.lit(width)).alias("label")))
    forest = classes.select(F.explode(trees).alias("t"), "digest", "sketch").select("t.tree", "t.label", "digest", "sketch")
    agreement = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / SKETCH) ** 0.5
    look = lambda df, stitch: df.mapInArrow(_neighbours(agreement, look_back, stitch), _EDGES_SQL)
    found = written(look(forest.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label"), False), "neighbours")
    ends = found.where("kind = 1").select("tree", "label", "digest", "sketch").distinct()  # two regions a partition
    region = F.substring("label", 1, 2 * LEAST_DEPTH)
    stitched = written(look(ends.repartition("tree", region).sortWithinPartitions("tree", "label"), True), "stitched")
    edges = found.where("kind = 0").select("a", "b").union(stitched.where("kind = 0").select("a", "b"))
    star = components(edges)
    crowded = written(found.where("kind = 2").union(stitched.where("kind = 2")).select(F.col("a").alias("digest")).distinct(), "crowded")
    if crowded.limit(1).count():
        roots = star.select(F.col("node").alias("digest"), F.col("root").alias("comp"))
        crowd = crowded.join(classes.select("digest", "key", "sketch"), "digest").join(roots, "digest", "left").select("digest", "key", "sketch", F.coalesce("comp", "digest").alias("comp"))
        crowd = written(crowd, "crowd")
        full = keyed.join(crowd.select("key"), "key", "left_semi").mapInArrow(_features(k, True), "digest binary, shingles binary").where("digest is not null")
        full = written(full.groupBy("digest").agg(F.first("shingles").alias("shingles")).join(crowd, "digest").select("digest", "comp", "sketch", "shingles"), "crowd-sets")
        more = _crowded_edges(full, percent, agreement, postings)
        if more.limit(1).count():
            star = components(edges.union(more))
    members = star.select("node", F.col("root").alias("comp")).union(star.select(F.col("root").alias("node"), F.col("root").alias("comp")).distinct())
    members = written(members.join(classes.select(F.col("digest").alias("node"), "key", "n"), "node"), "members")
    sizes = members.groupBy("comp").agg(F.ceil(F.sum("n") * 8 / block_bytes).cast("int").alias("blocks"))
    wanted = keyed.join(members.select("key"), "key", "left_semi")
    sets = wanted.mapInArrow(_features(k, True), "digest binary, shingles binary").where("digest is not null")
    sets = sets.groupBy("digest").agg(F.first("shingles").alias("shingles"))
    placed = sets.join(members.join(sizes, "comp").select(F.col("node").alias("digest"), "comp", "blocks"), "digest")
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, own).alias("i"), F.greatest(b, own).alias("j")))
    tasks = placed.select("comp", F.explode(others).alias("p"), (F.col("blocks") > 1).alias("split"), "digest", "shingles").select("comp", "p.i", "p.j", "split", "digest", "shingles")
    tasks = tasks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    links = written(tasks.mapInArrow(_confirm(percent), "a binary, b binary, split boolean"), "links")
    final = links.where("not split").select(F.col("a").alias("node"), F.col("b").alias("root"))
    if links.where("split").limit(1).count():
        final = final.union(components(links.where("split").select("a", "b")))
    nodes = final.union(final.select(F.col("root").alias("node"), "root").distinct())
    least = nodes.join(classes.select(F.col("digest").alias("node"), "least"), "node")
    roots = written(least.groupBy("root").agg(F.min("least").alias("component")), "roots")  # a large group of rows of one root can then be split
    reached = nodes.join(roots, "root").select(F.col("node").alias("digest"), "component")
    by_class = classes.select("digest", "least").join(reached, "digest", "left").select("digest", F.coalesce("component", "least").alias("component"))
    joined = features.select("id", "n", "digest").join(by_class, "digest", "left")
    return joined.select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, n_shingles, component_id and kept (the row's id is its component's) for every row; see cluster()."""
    found = cluster(docs, id_col=id_col, **options)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def dedupe(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs, one document of each group: that with the smallest id. An id is a document: rows that repeat one share its
    lot, and all rows of the id that is kept stay. Rows without an id, or without words, stay as they are."""
    found = cluster(docs, id_col=id_col, **options)
    gone = found.where("component is null or id <> component").select(F.col("id").alias(id_col)).where(F.col(f"`{id_col}`").isNotNull()).distinct()
    return docs.join(gone, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
