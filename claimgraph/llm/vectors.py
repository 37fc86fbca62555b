"""Near copies among embeddings by sorted projection passes.

1. Equal vectors are one class. A class is known by 128 bits of a digest.
2. A pass gives every class 64 random hyperplane signs, one after the other, as its key, and orders all classes by it. A class is compared with the
   `window` classes before it, on a copy with a byte for each component; the copy's rounding is bounded for each vector, so no pair at the
   threshold is passed over. What one partition's order cuts apart is compared in a second look at the partitions' ends. The number of passes follows
   from the number of classes: a pair just at the threshold is met in at least one pass but for `miss`.
3. Connected components of what was met bring together whatever may be linked, and within them every pair is settled in double precision, so a group
   denser than the window loses none of its links. Components larger than `block` are cut into blocks that lie close together; the blocks'
   centres and radii settle most pairs of blocks whole (all linked, or none), the others are a task each.
4. Links are counted and components are formed again from verified links alone.

A pair is missed only if no pass brings it, or a chain of other pairs, within the window. See README for the recall measured.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import written
from .graph import components

WINDOW, BLOCK, MISS, BITS = 512, 1024, 0.02, 64
#: Pairs whose cosine is this close to the threshold are computed again one by one.
NEAR = 1e-9


def direction(vector: list) -> np.ndarray | None:
    """The vector at length 1 in double precision; none where a component is missing or not finite, or all are zero."""
    if not vector:
        return None
    x = np.array([math.nan if c is None else c for c in vector], dtype=np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x /= top
    return x / np.sqrt(np.dot(x, x))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to (id, class, unit): class is null and unit empty where the vector links with nothing."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), 2000):
            own, units = [], []
            for v in batch.column(1).slice(at, 2000).to_pylist():
                x = direction(v)
                own.append(None if x is None else hashlib.sha256(np.array(v, dtype=np.float64).tobytes()).digest()[:16])
                units.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 2000), pa.array(own, pa.binary()), pa.array(units, pa.binary())], ["id", "class", "unit"])


def _projections(width: int, dealt: int) -> np.ndarray:
    """The hyperplanes of a pass, for vectors of a width."""
    return np.random.default_rng([20240611, width, dealt]).standard_normal((width, BITS))


def _keys(passes: int):
    """(class, unit) to (width, pass, key, class, small, scale, slack), a row per pass.

    unit = scale * small + rest; slack is the length of rest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            by_width: dict[int, list[int]] = {}
            units = batch.column(1).to_pylist()
            for i, u in enumerate(units):
                by_width.setdefault(len(u) // 8, []).append(i)
            for width, at in by_width.items():
                if width not in planes:
                    planes = {width: [_projections(width, p) for p in range(passes)]}  # one width at a time is held
                for begin in range(0, len(at), 2000):
                    some = at[begin : begin + 2000]
                    x = np.frombuffer(b"".join(units[i] for i in some)).reshape(-1, width)
                    scale = np.abs(x).max(axis=1) / 127
                    small = np.rint(x / scale[:, None]).astype(np.int8)
                    slack = np.sqrt(((x - small * scale[:, None]) ** 2).sum(axis=1))
                    own, packed = batch.column(0).take(pa.array(some)), pa.array([r.tobytes() for r in small], pa.binary())
                    for p in range(passes):
                        key = np.packbits(x @ planes[width][p] > 0, axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
                        n = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(key), own, packed, pa.array(scale), pa.array(slack)], ["width", "pass", "key", "class", "small", "scale", "slack"])

    return run


class Groups:
    """Union-find over places 0, 1, ...; a root is the smallest of its group."""

    def __init__(self):
        self.up: list[int] = []

    def grow(self, n: int) -> None:
        self.up.extend(range(len(self.up), n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs (a[i], b[i]); those already in one group cost no step of their own."""
        while len(a):
            places, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            roots = np.array([self.find(x) for x in places.tolist()], dtype=np.int64)[back]
            apart = roots[: len(a)] != roots[len(a) :]
            a, b = a[apart], b[apart]
            for i in np.unique(a, return_index=True)[1].tolist():
                x, y = self.find(int(a[i])), self.find(int(b[i]))
                self.up[max(x, y)] = min(x, y)


_EDGES = pa.schema([("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("width", pa.int32()), ("pass", pa.int32()), ("key", pa.int64()), ("class", pa.binary()), ("small", pa.binary()), ("scale", pa.float64()), ("slack", pa.float64())])
_EDGES_SQL = "kind int, a binary, b binary, width int, pass int, key long, class binary, small binary, scale double, slack double"


def _neighbours(cosine: float, window: int, ends: bool):
    """Rows of _keys() in order to pairs met, contracted to stars (kind 0), and the partition's first and last rows (kind 1, if `ends`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, places, held, first = Groups(), {}, None, None

        def met(rows: pa.Table, at: int) -> None:
            """Rows from `at` on with those up to window before them, all of one width and pass."""
            x = np.frombuffer(b"".join(rows["small"].to_pylist()), np.int8).reshape(len(rows), -1).astype(np.float32)
            x *= rows["scale"].to_numpy()[:, None].astype(np.float32)
            slack = rows["slack"].to_numpy()
            place = np.array([places.setdefault(c, len(places)) for c in rows["class"].to_pylist()], dtype=np.int64)
            groups.grow(len(places))
            for i in range(at, len(x), window):
                low, high = max(0, i - window), min(len(x), i + window)
                # (s + r)(t + q) for rests r, q as long as the slacks and s, t no longer than 1 + slack. 1e-5: single precision.
                p, q = slack[i:high, None], slack[None, low:high]
                fits = x[i:high] @ x[low:high].T + (p + q + 3 * p * q) + 1e-5 >= cosine
                a, b = np.nonzero(fits)
                a, b = a + i, b + low
                near = (b < a) & (a - b <= window)
                groups.join_all(place[a[near]], place[b[near]])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if ends and (first is None or len(first) < window):
                first = rows.slice(0, window) if first is None else pa.concat_tables([first, rows.slice(0, window - len(first))])
            old = 0 if held is None else len(held)
            rows = rows if held is None else pa.concat_tables([held, rows])
            width, dealt = rows["width"].to_numpy(), rows["pass"].to_numpy()
            cuts = np.flatnonzero((width[1:] != width[:-1]) | (dealt[1:] != dealt[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
                if end > old:
                    met(rows.slice(begin, end - begin), max(old - begin, 0))
            held = rows.slice(max(0, len(rows) - window)).combine_chunks()
        names = list(places)
        stars = [(names[i], names[r]) for i in range(len(names)) if (r := groups.find(i)) != i]
        for at in range(0, len(stars), 10000):
            yield pa.RecordBatch.from_pylist([{"kind": 0, "a": a, "b": b} for a, b in stars[at : at + 10000]], _EDGES)
        if ends and held is not None:
            yield pa.RecordBatch.from_pylist([{"kind": 1} | r for t in (first, held) for r in t.to_pylist()], _EDGES)

    return run


def linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of x, at length 1, are linked with which of y; pairs at the threshold are computed singly."""
    c = x @ y.T
    out = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) < NEAR), strict=True):
        out[i, j] = float(np.dot(x[i], y[j])) / math.sqrt(float(np.dot(x[i], x[i])) * float(np.dot(y[j], y[j]))) >= cosine
    return out


_SETTLED = pa.schema([("class", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _settle(cosine: float):
    """Rows (comp, i, j, side, class, n, unit) in order of (comp, i, j): a task holds the classes of block i and, where j is another, of block j.
    Gives for each class the vectors of other classes linked with it in the task, and a class of the task that links lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def done() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            own = [r[1] for r in rows]
            n = np.array([r[2] for r in rows], dtype=np.int64)
            by_width: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                by_width.setdefault(len(r[3]), []).append(i)
            count, groups = np.zeros(len(rows), np.int64), Groups()
            groups.grow(len(rows))
            for at in (np.array(v) for v in by_width.values()):
                x = np.frombuffer(b"".join(rows[i][3] for i in at)).reshape(len(at), -1)
                side = np.array([rows[i][0] for i in at])
                one, two = np.flatnonzero(side == 0), np.flatnonzero(side == (key[1] != key[2]))
                right, y = at[two], x[two]
                for begin in range(0, len(one), 512):
                    some = at[one[begin : begin + 512]]
                    fits = linked(x[one[begin : begin + 512]], y, cosine) & (some[:, None] != right[None, :])
                    count[some] += fits @ n[right]
                    if key[1] != key[2]:
                        count[right] += n[some] @ fits
                    a, b = np.nonzero(fits)
                    groups.join_all(some[a], right[b])
            return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(count), pa.array([own[groups.find(i)] for i in range(len(own))], pa.binary())], schema=_SETTLED)

        for batch in batches:
            for comp, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, i, j) != key:
                    if key is not None:
                        yield done()
                    key, rows = (comp, i, j), []
                rows.append(row)
        if key is not None:
            yield done()

    return run


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, block, class, n, unit) in order of (comp, block) to (comp, block, width, centre, radius, n, class): the mean direction of a
    block, the largest angle to it, its vectors and one of its classes. Width 0, which settles nothing, where widths differ."""
    key, rows = None, []

    def done() -> dict:
        widths = {len(u) for _, _, u in rows}
        out = {"comp": key[0], "block": key[1], "width": 0, "centre": [], "radius": 0.0, "n": sum(r[1] for r in rows), "class": min(r[0] for r in rows)}
        if len(widths) == 1:
            x = np.frombuffer(b"".join(r[2] for r in rows)).reshape(len(rows), -1)
            mean = x.sum(axis=0)
            length = np.sqrt(np.dot(mean, mean))
            if length > 1e-6:
                out |= {"width": x.shape[1], "centre": (mean / length).tolist(), "radius": float(np.arccos(np.clip((x @ mean).min() / length, -1, 1)))}
        return out

    made = []
    for batch in batches:
        for comp, block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (comp, block) != key:
                if key is not None:
                    made.append(done())
                key, rows = (comp, block), []
            rows.append(row)
        yield pa.RecordBatch.from_pylist(made, _OUTLINES)
        made = []
    if key is not None:
        yield pa.RecordBatch.from_pylist([done()], _OUTLINES)


_OUTLINES = pa.schema([("comp", pa.binary()), ("block", pa.int64()), ("width", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("n", pa.int64()), ("class", pa.binary())])
_OUTLINES_SQL = "comp binary, block long, width int, centre array<double>, radius double, n long, class binary"


def passes_for(classes: int, cosine: float, window: int, miss: float) -> int:
    """Passes in which a pair at the threshold stays apart with probability `miss` at most.

    Classes that share b key bits with a class are about classes / 2^b, so b = log2(classes / window) shared bits bring a pair within the window.
    """
    bits = max(1.0, math.log2(max(classes, 2) / window))
    once = (1 - math.acos(cosine) / math.pi) ** bits
    return max(2, math.ceil(math.log(miss) / math.log1p(-once)))


def near_copies(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, window: int = WINDOW, block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """(id, n_links, component) for every row: other vectors with a cosine of at least `cosine`, and the smallest id that links lead to.

    Vectors that are null, empty, zero, or have null or non-finite components link with nothing, and vectors of different widths do not link.
    Equal vectors are linked. Rows of one id are vectors of their own. Null ids are passed over by the minimum; a component of null ids alone has null. Other columns are
    not looked at; an empty table gives no rows.
    """
    source = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    kind = dict(source.dtypes)["id"]
    rows = written(source.mapInArrow(_classes, f"id {kind}, class binary, unit binary"), "vectors")
    groups = rows.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("unit").alias("unit"))
    groups = written(groups, "classes")
    passes = passes_for(groups.count(), cosine, window, miss)
    keyed = groups.select("class", "unit").mapInArrow(_keys(passes), "width int, pass int, key long, class binary, small binary, scale double, slack double")
    order = ["width", "pass", "key", "class"]
    in_order = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(in_order.mapInArrow(_neighbours(cosine, window, True), _EDGES_SQL), "neighbours")
    ends = found.where("kind = 1").drop("kind", "a", "b").distinct()  # two windows a partition
    stitched = ends.repartition("width", "pass").sortWithinPartitions(*order).mapInArrow(_neighbours(cosine, window, False), _EDGES_SQL)
    star = components(found.where("kind = 0").select("a", "b").union(stitched.where("kind = 0").select("a", "b")))
    members = star.select(F.col("node").alias("class"), F.col("root").alias("comp")).union(star.select(F.col("root").alias("class"), F.col("root").alias("comp")).distinct())
    members = written(members.join(groups.select("class", "n", "unit"), "class"), "members")
    sizes = written(members.groupBy("comp").agg(F.count("*").alias("size")), "sizes")
    placed = members.join(sizes, "comp")
    zero = F.lit(0).cast("long")
    tasks = placed.where(F.col("size") <= block).select("comp", zero.alias("i"), zero.alias("j"), F.lit(0).alias("side"), "class", "n", "unit")
    whole = None
    if sizes.where(F.col("size") > block).limit(1).count():
        more, whole = _blocks(placed.where(F.col("size") > block), cosine, block)
        tasks = tasks.unionByName(more)
    tasks = tasks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    settled = tasks.mapInArrow(_settle(cosine), "class binary, links long, root binary")
    if whole is not None:
        settled = settled.unionByName(whole)
    settled = written(settled, "settled")
    links = settled.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(settled.select(F.col("class").alias("a"), F.col("root").alias("b")))
    nodes = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    least = nodes.join(groups.select(F.col("class").alias("node"), "least"), "node")
    least = written(least.groupBy("root").agg(F.min("least").alias("component")), "roots")
    by_class = nodes.join(least, "root").select(F.col("node").alias("class"), "component")
    by_class = groups.select("class", "n", "least").join(links, "class", "left").join(by_class, "class", "left")
    by_class = by_class.select("class", (F.col("n") - 1 + F.coalesce("links", zero)).alias("n_links"), F.coalesce("component", "least").alias("component"))
    joined = rows.select("id", "class").join(by_class, "class", "left")
    return joined.select("id", F.coalesce("n_links", zero).alias("n_links"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def _blocks(placed: DataFrame, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Tasks of the components of (comp, class, n, unit, size) that are larger than a block, and what pairs of blocks settle whole.

    Blocks follow the order of a projection, so those of a long chain are mostly far apart.
    """
    keyed = placed.select("class", "unit").mapInArrow(_keys(1), "width int, pass int, key long, class binary, small binary, scale double, slack double")
    ordered = placed.join(keyed.select("class", "width", "key"), "class")
    ranked = written(numbered(ordered, ["comp", "width", "key", "class"], "rank"), "ranked")
    firsts = ranked.groupBy("comp").agg(F.min("rank").alias("first"))
    cut = written(ranked.join(firsts, "comp").select("comp", F.expr(f"(rank - first) div {block}").alias("block"), "class", "n", "unit"), "blocks")
    outlines = written(cut.repartition("comp", "block").sortWithinPartitions("comp", "block").mapInArrow(_outlines, _OUTLINES_SQL), "outlines")
    one = outlines.select("comp", F.col("block").alias("i"), F.col("width").alias("wi"), F.col("centre").alias("ci"), F.col("radius").alias("ri"), F.col("n").alias("ni"), F.col("class").alias("ki"))
    two = outlines.select("comp", F.col("block").alias("j"), F.col("width").alias("wj"), F.col("centre").alias("cj"), F.col("radius").alias("rj"), F.col("n").alias("nj"), F.col("class").alias("kj"))
    dot = F.aggregate(F.zip_with("ci", "cj", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    angle = F.when((F.col("wi") == F.col("wj")) & (F.col("wi") > 0), F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))))
    most = math.acos(cosine)
    pairs = one.join(two, "comp").where("i <= j").withColumn("angle", angle)
    # Angles near 0 come from cosines with half the digits; hence 1e-6.
    near = F.when(F.col("i") == F.col("j"), 2 * F.col("ri")).otherwise(F.col("angle") + F.col("ri") + F.col("rj")) <= most - 1e-6
    far = (F.col("wi") > 0) & (F.col("wj") > 0) & ((F.col("wi") != F.col("wj")) | ((F.col("i") < F.col("j")) & (F.col("angle") - F.col("ri") - F.col("rj") > most + 1e-6)))
    pairs = pairs.withColumn("near", F.coalesce(near & (F.col("wi") > 0) & (F.col("wi") == F.col("wj")), F.lit(False))).where(~F.coalesce(far, F.lit(False)))
    pairs = written(pairs.select("comp", "i", "j", "near", "ni", "nj", "ki", "kj"), "block-pairs")
    test = pairs.where("not near").select("comp", "i", "j")
    left = test.join(cut.withColumnRenamed("block", "i"), ["comp", "i"]).select("comp", "i", "j", F.lit(0).alias("side"), "class", "n", "unit")
    right = test.where("i < j").join(cut.withColumnRenamed("block", "j"), ["comp", "j"]).select("comp", "i", "j", F.lit(1).alias("side"), "class", "n", "unit")
    # All of i is linked with all of j: each class of i counts the vectors of j and leads to a class of j, and the other way round.
    sums = pairs.where("near").select("comp", F.col("i").alias("block"), F.col("nj").alias("others"), F.col("kj").alias("to")).union(pairs.where("near and i < j").select("comp", F.col("j").alias("block"), F.col("ni").alias("others"), F.col("ki").alias("to")))
    sums = sums.groupBy("comp", "block").agg(F.sum("others").alias("others"), F.collect_set("to").alias("to"))
    own = pairs.where("near and i = j").select("comp", F.col("i").alias("block"), F.lit(True).alias("own"))
    counted = cut.join(sums, ["comp", "block"]).join(own, ["comp", "block"], "left")
    less = F.when(F.col("own"), F.col("n")).otherwise(F.lit(0).cast("long"))  # a class of a near block was counted with the others of its block
    whole = counted.select("class", (F.col("others") - less).alias("links"), F.posexplode("to").alias("k", "root"))
    return left.unionByName(right), whole.select("class", F.when(F.col("k") == 0, F.col("links")).otherwise(F.lit(0).cast("long")).alias("links"), "root")
