"""Projection passes, prefix tries and source divergence against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import divergence, trie, vectors

rng = random.Random(11)


# --- 11 projection passes ----------------------------------------------------------------------------------------------


def brute_vectors(rows, cosine=0.9):
    """[(id, links, component)] in the order of rows."""
    units = []
    for _, v in rows:
        ok = bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)
        units.append(np.array(v, dtype=float) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    joined = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in joined[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(joined[i]), min(ids, default=None)))
    return out


def made_vectors(groups, copies, spread, width=16, chain=0, seed=3):
    g = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = g.standard_normal(width)
        centre /= np.linalg.norm(centre)
        out += [(centre + g.standard_normal(width) * spread / width**0.5).tolist() for _ in range(copies)]
    out += [[float(np.cos(a)), float(np.sin(a)), *[0.0] * (width - 2)] for a in np.linspace(0, 2.5, chain)]
    return list(enumerate(out))


def links_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(map(tuple, vectors.near_copies(df, **options).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.15, 0.45])
@pytest.mark.parametrize("options", [{}, {"window": 8, "block": 10}], ids=["whole", "blocks"])
def test_links_equal_all_pairs(spark, spread, options):
    """Groups of 60 are wider than the window and the block; a chain of 80 is longer than both and only its neighbours are linked."""
    rows = made_vectors(3, 60, spread, chain=80)
    rows = [(i, v) for i, v in rows] + [(1000 + i, v) for i, v in rows[:5]]
    assert links_of(spark, rows, **options) == sorted(brute_vectors(rows), key=repr)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (9, [-0.0, -3.0]), (10, [1.0, 0.0, 0.0]), (11, [1e300, 1e299]), (12, [1e-300, 1e-310])]
    assert links_of(spark, rows) == sorted(brute_vectors([(i, [c / 1e299 for c in v] if i == 11 else [c * 1e299 for c in v] if i == 12 else v) for i, v in rows]), key=repr)
    assert links_of(spark, []) == []
    clash = spark.createDataFrame([(1, [1.0, 0.1], "x", 1)], "vec_id long, embedding array<double>, class string, component long")
    assert [tuple(r) for r in vectors.near_copies(clash).collect()] == [(1, 0, 1)]


def test_pairs_at_the_threshold(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, (1 - 0.81) ** 0.5]), (2, [9.0, 19**0.5]), (3, [0.9, -((1 - 0.8099999) ** 0.5)])]
    want = [(i, sum(1 for j, w in rows if j != i and float(np.dot(v, w)) / float(np.linalg.norm(v) * np.linalg.norm(w)) >= 0.9)) for i, v in rows]
    assert [r[:2] for r in links_of(spark, rows)] == want


def test_recall_against_all_pairs(spark):
    """Pairs alone, all near the threshold and among many others, where each must be met by a pass of its own."""
    g = np.random.default_rng(8)
    out = []
    for _ in range(1500):
        x, y = g.standard_normal(24), g.standard_normal(24)
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        c = g.uniform(0.9, 0.93)
        out += [x.tolist(), (c * x + (1 - c * c) ** 0.5 * y / np.linalg.norm(y)).tolist()]
    rows = list(enumerate(out))
    found = sum(n for _, n, _ in links_of(spark, rows, window=16))
    x = np.array(out)
    x /= np.linalg.norm(x, axis=1)[:, None]
    there = int((x @ x.T >= 0.9).sum()) - len(x)
    assert 0.97 * there <= found <= there


# --- 12 prefix tries ---------------------------------------------------------------------------------------------------


def brute_trie(turns):
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = (*own.get(c - c % 5, [])[:h], *own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def saved(p):
        return (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(map(saved, kids[p]))

    def leaves(p):
        return sum(map(leaves, kids[p])) or 1

    return sorted([(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves(p), saved(p), hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()], key=repr)


def trie_of(spark, turns, **options):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    own = trie.paths(df)
    return sorted(map(tuple, trie.prefix_trie(trie.rebuilt(own), **options).collect()), key=repr)


@pytest.fixture(scope="module")
def turns():
    """A first turn with a third of all conversations, a chain shared by many, one long conversation, branches at every depth, null and empty turns."""
    out = []
    for c in range(120):
        head = ["common"] if c % 3 == 0 else [f"start {c % 7}"]
        if c % 4 == 0:
            head = ["common", "a", "b", "c", "d"]
        body = [rng.choice(["yes", "no", "é́", ""]) for _ in range(rng.randint(0, 6))]
        out += [(c, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(head + body)]
    out += [(500, t, "user", f"t{t // 3}") for t in range(90)]
    return [*out, (201, None, None, None), (201, 0, "user", None), (201, 0, None, "tie"), (201, 0, "user", "tie"), (202, 0, "user", ""), (None, 0, "user", "nobody"), (3, 2, "user", "again"), (3, 2, "user", "again")]


@pytest.mark.parametrize("limit", [1, 7, 60, 20000])
def test_nodes_equal_brute_force(spark, turns, limit):
    assert trie_of(spark, turns, limit=limit) == brute_trie(turns)


def test_few_conversations(spark):
    assert trie_of(spark, []) == []
    turnless = [(1, 0, "user", "x")]  # h = 7, and conversation 0 is not there
    assert trie_of(spark, turnless) == brute_trie(turnless) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    same = [(c, t, "user", f"{t}") for c in (10, 11, 12, 13, 14) for t in range(12)]
    for limit in (1, 1000):
        assert trie_of(spark, same, limit=limit) == brute_trie(same)
    clash = spark.createDataFrame([(1, 0, "user", "x", 1, "g")], "conv_id long, turn long, role string, text string, n long, g string")
    assert trie.prefix_trie(trie.rebuilt(trie.paths(clash))).count() == 1


def test_deep_conversation(spark):
    """Deeper than Python recurses, as one task and as trunks."""
    deep = [(5, t, "user", "x" * (t % 3)) for t in range(3000)] + [(10, t, "user", "x" * (t % 3)) for t in range(2999)]
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in (5, 10)}
    for limit in (100, 20000):
        got = trie_of(spark, deep, limit=limit)
        assert len(got) == 3001 and {r[:6] for r in got if r[1] in (0, 2999)} == {(5, 0, None, 2, 1, 1), (5, 2999, 5, 2, 1, 1)}, h
        assert max(r[6] for r in got) == sum(t % 3 for t in range(2999))


# --- 13 source divergence ----------------------------------------------------------------------------------------------


def brute_divergence(docs, least, top):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -f, rank) for rank, (f, _, item) in enumerate(rows, 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, monkeypatch):
    words = ["Ab", "cd", "éf", "漢字", "x1y", "z_w", "\U0001f600", "n\x00m"]
    docs = [(" ".join(rng.choice(words[: 3 + i % 6]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None, "\U0001f600"])) for i in range(300)]
    docs += [("ab " * 50000, "en", "a"), (None, "de", "only"), ("", "xx", "p"), ("!!", "xx", "q"), ("rare words", "xx", "r")]
    docs += [("tie tia tib", "ti", s) for s in ("k", "l", "k", "m")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, n long, term string")
    for least, top in ((3, 4), (30, 50)):
        assert sorted(map(tuple, divergence.audit(df, least, top).collect())) == brute_divergence(docs, least, top)
    assert divergence.audit(df.limit(0)).collect() == []


def test_counts_of_bounded_dictionaries(spark, monkeypatch):
    """Dictionaries passed on when full, and texts split in parts, give the same sums. Run in this process, where the bounds can be set."""
    import pyarrow as pa

    texts = ["aa bb cc " * 20, "bb dd", None, "ee" * 5, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 5), pa.array(list("xxyyx")), pa.array([t or "" for t in texts])], ["lang", "source", "text"])

    def total():
        out = Counter()
        for b in divergence._count(iter([batch, batch])):
            for r in b.to_pylist():
                out[r["source"], r["term"]] += r["n"] * 1000 + r["df"]
        return out

    whole = total()
    monkeypatch.setattr(divergence, "HELD", 2)
    monkeypatch.setattr(divergence, "CHUNK", 4)
    assert total() == whole
    assert whole["x", "bb"] == 2 * (20 + 1) * 1000 + 4


# --- 4 quality rules: the distance ----------------------------------------------------------------------------------------


def test_distances_are_mahalanobis_with_the_short_text_correction(spark):
    """Distances from the estimates and the statistics by numpy: the group's covariance times 1 + SHORT / n for a text of n words."""
    from claimgraph.llm import quality

    texts = [" ".join(rng.choice(["one", "Two", "three,", "fo#ur", "five."]) + str(rng.randrange(500)) for _ in range(rng.randint(50, 400))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    judged = {r.doc_id: r.distance for r in quality.assess(docs).collect()}
    source = docs.select("doc_id", "text", quality._key(F.col("lang")).alias("lang_key"), quality._key(F.col("source")).alias("source_key"))
    stats = quality.written(quality.measured(source, "text").drop("text"), "stats")
    params = quality.estimates(stats).first()
    p = quality.P
    mean = np.array([params[f"mean_{i}"] for i in range(p)])
    factor = np.array([[params[f"w_{i}_{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)])
    covariance = np.linalg.inv(factor.T @ factor)
    for r in stats.collect():
        x = np.array([r[n] for n, _ in quality.FEATURES]) - mean
        d2 = x @ np.linalg.inv(covariance * (1 + quality.SHORT / r.n_words)) @ x
        assert judged[r.doc_id] == pytest.approx(d2**0.5, rel=1e-6)
