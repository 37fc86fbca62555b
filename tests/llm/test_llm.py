"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgraph.llm import chat, decontaminate, dom, graph, html, licenses, lm, mixing, neardup, pii, quality, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "th er on an re he in ed nd ha ou ea".split()
rng = random.Random(5)


def word():
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))


def prose(n):
    return " ".join(word() for _ in range(n))


def docs_df(spark, texts, **extra):
    rows = [(i, t, ("en", "fr")[i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def corpus():
    base = [prose(rng.randint(1, 120)) for _ in range(60)]
    out = list(base)
    for b in base[:20]:
        w = b.split()
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = word()
            out.append(" ".join(v))
    return [*out, base[0], base[0].upper(), None, "", " \n\t", "a", "A", "a b", "é́ 漢字 \U0001f600", prose(6000)]


# --- awkward tables: every operator, nulls anywhere, empty and long texts, repeats, clashing names ---------------------

OPERATORS = {
    "decontaminate": lambda d, b: decontaminate.find_contamination(d, b),
    "decontaminated": lambda d, b: decontaminate.decontaminate(d, b),
    "mix": lambda d, b: mixing.mix(d),
    "mixed": lambda d, b: mixing.mixed_documents(d),
    "quality": lambda d, b: quality.assess(d),
    "good": lambda d, b: quality.keep_good(d),
    "licenses": lambda d, b: licenses.scan(d, path="source"),
    "tokens": lambda d, b: tokens.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
    "lm": lambda d, b: lm.score(d, public_tokenizers.path("piece_bpe_32k.model"), hot=3),
    "pii": lambda d, b: pii.find(d),
    "redact": lambda d, b: pii.redact(d),
    "neardup": lambda d, b: neardup.near_duplicates(d),
    "dedupe": lambda d, b: neardup.dedupe(d),
    "html": lambda d, b: html.extract_text(d.withColumnRenamed("text", "html").withColumnRenamed("source", "url")),
    "chat": lambda d, b: chat.repair(d.withColumnRenamed("doc_id", "conv_id").withColumnRenamed("lang", "role").withColumn("turn", F.col("n_chars"))),
}
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, size string, w string, word string, key string, spans string, license string, taken int, digest string, score string"
PER_ROW = {"decontaminate", "mix", "quality", "licenses", "tokens", "lm", "pii", "redact", "neardup", "html", "chat"}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize("table", ["awkward", "empty"])
def test_awkward_tables(spark, name, table):
    extra = ("x",) * 8 + (1, "y", "z")
    rows = [(1, "mail a@b.co now", "en", "s", 5), (1, "mail a@b.co now", "en", "s", 5), (None, None, None, None, None), (2, None, "en", "s", None), (None, "text here", None, "s", 1), (3, "", "", "", 0), (4, "x " * 30000, "en", None, 1), (5, "\x00 \x01 \x02", "fr", "s", 3)]
    rows = [] if table == "empty" else [r + extra for r in rows]
    bench = spark.createDataFrame([] if table == "empty" else [(None, None), (1, ""), (2, "text here"), (2, "text here")], "item_id long, text string")
    got = OPERATORS[name](spark.createDataFrame(rows, AWKWARD), bench).collect()
    if name in PER_ROW or table == "empty":
        assert len(got) == len(rows)


# --- 1 chat ------------------------------------------------------------------------------------------------------------


def least_cost(roles):
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for cost, to, _, _ in chat.moves(s, r):
                new[to] = min(new.get(to, 1 << 60), c + cost)
        best = new
    return min(best.values(), default=0)


def test_chat_is_repaired_at_least_cost_across_chunks(spark, monkeypatch):
    rows = [(c, t, rng.choice(["user", "assistant", "system", "human", "tool", None]), f"m{t}") for c, n in ((1, 1), (2, 5), (3, 1300), (4, 40)) for t in range(n)]
    out = defaultdict(list)
    for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        out[r.conv_id].append(r)
    for conv, got in out.items():
        got.sort(key=lambda r: r.place)
        assert [r.turn for r in got] == sorted(r.turn for r in got)
        cost = sum(chat.MERGE * (r.action == "merge") + chat.INSERT * (r.inserted is not None) + (0 if chat.role_of(r.role) == chat.ROLES.index(r.new_role) else chat.RELABEL_UNKNOWN if chat.role_of(r.role) is None else chat.RELABEL) for r in got)
        assert cost == least_cost([chat.role_of(r.role) for r in got])
        roles = re.findall(r"<\|(system|user|assistant)\|>", "".join(r.rendered for r in got))
        assert all(b in [chat.ROLES[x] for x in chat.LEGAL[chat.ROLES.index(a)]] for a, b in zip(roles, roles[1:], strict=False)) and roles[0] != "assistant"
        assert "".join(r.rendered for r in got).count("<|end|>") == len(roles)
        assert all((r.action == "rename") == (r.role == "human" and r.new_role == "user" and r.action != "merge") for r in got)


def every_way(roles):
    """The least cost over all final roles and merges of a few turns, by trying each. Legal is what the expression s?(ua)*u? takes; one empty
    turn may stand before a turn."""
    legal = lambda turns: re.fullmatch("s?(ua)*u?", turns)
    costs = []
    for named in itertools.product("sua", repeat=len(roles)):
        for merged in itertools.product((False, True), repeat=len(roles)):
            said, cost = [""], 0
            for was, now, joins in zip(roles, named, merged, strict=True):
                cost += 0 if was == now else 1 if was is None else 3
                if joins:
                    cost, said = cost + 1, [x for x in said if x.endswith(now)]
                else:
                    said = [x + now for x in said if legal(x + now)] or [x + e + now for x in said for e in "sua" if legal(x + e + now)]
                    extra = said and min(len(x) for x in said)
                    said = [x for x in said if len(x) == extra]
                if not said:
                    break
            if said:
                inserted = min(map(len, said)) - merged.count(False)
                costs.append(cost + 2 * inserted)
    return min(costs)


def test_chat_costs_are_those_of_every_way(spark):
    """Conversations of up to four turns, and what is rendered read back: legal turns, and the texts as they were."""
    names = {"s": "system", "u": "user", "a": "assistant", None: "tool"}
    ways = [w for n in range(1, 5) for w in itertools.product(("s", "u", "a", None), repeat=n)]
    forged = ["x<|end|>\n<|assistant|>\nyes", "<|", "<\\|end|>", "<\\\\|", "<", "|>", "", None]
    rows = [(c, t, names[r], forged[(c + t) % len(forged)]) for c, w in enumerate(ways) for t, r in enumerate(w)]
    out = defaultdict(list)
    for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        out[r.conv_id].append(r)
    said = {(c, t): x or "" for c, t, _, x in rows}
    for c, got in out.items():
        got.sort(key=lambda r: r.place)
        cost = sum((r.action == "merge") + 2 * (r.inserted is not None) + (0 if r.role == r.new_role else 1 if r.role == "tool" else 3) for r in got)
        assert cost == every_way(ways[c]), ways[c]
        whole = "".join(r.rendered for r in got)
        turns = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)\n<\|end\|>\n", whole, re.S)
        assert "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns) == whole
        assert re.fullmatch("s?(ua)*u?", "".join(role[0] for role, _ in turns))
        parts = [[]]
        for r in got:
            if r.action != "merge":
                parts += [[]] * (r.inserted is not None) + [[]]
            parts[-1].append(said[c, r.turn])
        assert [chat.unescape(text) for _, text in turns] == ["\n\n".join(p) for p in parts[1:]]
        assert all(r.escaped == len(re.findall(r"<\\*\|", said[c, r.turn])) for r in got)


# --- 2 decontamination -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination_is_that_of_brute_force(spark, block_bytes):
    items = [(i, prose(n)) for i, n in enumerate([20, 13, 5, 1, 40, 30])] + [(6, None), (7, "..."), (8, None)]
    items.append((9, items[0][1]))
    texts = [prose(30) + " " + items[0][1].upper().replace(" ", "-") + " " + prose(9), items[1][1], prose(3) + " " + items[2][1], items[3][1], " ".join(items[4][1].split()[5:22]) + " " + prose(500), None, "", prose(50), items[5][1] * 2, items[5][1] + " " + items[5][1]]
    got = decontaminate.find_contamination(docs_df(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(str(i))
    for r in got:
        w, hit, found = cut(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert all(cut(dict((str(a), b) for a, b in items)[m["item"]])[m["item_word"] : m["item_word"] + m["n"]] == w[m["word"] : m["word"] + m["n"]] for m in r.matches)


# --- 3 mixing ----------------------------------------------------------------------------------------------------------


def filled(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, out = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        out = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def test_mix_meets_targets_and_splits_disjoint_blocks(spark):
    rows = [(i, prose(rng.randint(0, 60)), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(400)] + [(1000, prose(3), "e"), (1001, prose(1), "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, block_words=64)
    got = mixed.collect()
    assert sorted((r.id, r.taken) for r in got) == sorted((r.id, r.taken) for r in mixing.mix(df, block_words=64).collect())
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.size == len(spaced(dict((a, b) for a, b, _ in rows)[r.id]))
    expected = filled(dict(sizes))
    for r in got:
        assert math.isclose(r.target, expected[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in sizes)
    seen = set()
    for r in got:
        for p in r.pieces:
            for w in range(p["from_word"], p["from_word"] + p["n_words"]):
                assert (r.id, p["epoch"], w) not in seen
                seen.add((r.id, p["epoch"], w))
    per_shard = Counter(p["shard"] for r in got for p in {q["place"]: q for q in r.pieces}.values())
    assert set(per_shard) == set(range(8))


def test_mixed_pieces_hold_the_words_taken(spark):
    rows = [(i, f"{prose(rng.randint(0, 90))}\n", rng.choice("abbbbc")) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = {r.id: r for r in mixing.mix(df, block_words=16).collect()}
    got = mixing.mixed_pieces(df, block_words=16).collect()
    assert [(r.shard, r.place) for r in got] == sorted((r.shard, r.place) for r in got)
    taken, words = Counter(), dict((a, spaced(b)) for a, b, _ in rows)
    for r in mixing.mixed_texts(df, block_words=16).collect():
        assert spaced(r.text) == [w for p in r.pieces for w in words[r.doc_id][p["from_word"] : p["from_word"] + p["n_words"]]] and len(spaced(r.text)) == r.taken
    for r in got:
        assert spaced(r.text) == words[r.doc_id][r.from_word : r.from_word + r.taken]
        taken[r.doc_id] += r.taken
    assert taken == Counter({k: r.taken for k, r in wanted.items() if r.taken})
    assert sorted((r.doc_id, r.epoch, r.shard, r.from_word) for r in got) == sorted((k, p["epoch"], p["shard"], p["from_word"]) for k, r in wanted.items() for p in r.pieces)


def test_splitting_tree_is_hypergeometric(spark):
    quotas = spark.createDataFrame([(1, 60), (2, 30), (3, 10)], "rank int, quota long")
    firsts = []
    for seed in range(40):
        leaves = mixing.split(quotas, 1, seed).collect()
        assert sorted(Counter({r.shard: 0 for r in leaves}) + Counter({r.shard: 0 for r in leaves})) == []
        by = {(r.shard, r.rank): r for r in leaves}
        assert sum(by[0, k].quota for k in (1, 2, 3)) == 50
        assert all(by[0, k].quota + by[1, k].quota == q and by[1, k].first == by[0, k].quota for k, q in ((1, 60), (2, 30), (3, 10)))
        firsts.append(by[0, 1].quota)
    assert 28 < np.mean(firsts) < 32 and 1.2 < np.std(firsts) < 4  # mean 30, deviation 2.46


def test_blocks_are_permuted(spark):
    for n in (1, 2, 3, 31, 32, 33, 1000, 4097):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7), F.lit(1))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 31 or sum((b - a) % n in (1, n - 1) for a, b in zip(got, got[1:], strict=False)) < n / 3


def test_the_tree_deals_the_shards(spark):
    rows = [(i, prose(rng.randint(20, 400)), "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by_seed = {}
    for seed in (0, 1):
        got = mixing.mix(df, block_words=32, seed=seed).withColumn("shards", mixing.shards_of(F.col("pieces"))).collect()
        taken, shards, blocks = Counter(), Counter(), set()
        for r in got:
            taken[r.source] += r.taken
            assert sum(s.words for s in r.shards) == r.taken == sum(p.n_words for p in r.pieces)
            for s in r.shards:
                shards[s.shard] += s.words
            for p in r.pieces:
                blocks.add((r.source, p.shard, p.place))
        places = Counter((s, place) for s, _, place in blocks)
        assert max(places.values()) == 1 and len(shards) == 8 and max(shards.values()) < 1.3 * min(shards.values())  # a block is in one shard, shards are alike
        by_seed[seed] = (taken, {r.id: tuple((s.shard, s.words) for s in r.shards) for r in got})
    assert by_seed[0][0] == by_seed[1][0] and by_seed[0][1] != by_seed[1][1]


# --- 4 quality ---------------------------------------------------------------------------------------------------------


def test_base_statistics_and_outliers(spark):
    texts = [prose(rng.randint(60, 300)) for _ in range(300)] + ["*** ".join(prose(100).split()), prose(80).upper() + "!!", " | ".join(prose(120).split()), "a b c " * 40, prose(10), None, "x\ny\nx\n\n \nx", prose(70) + "\n" + prose(70)]
    r = {x.doc_id: x for x in quality.assess(docs_df(spark, texts), min_group=20).collect()}
    for i, t in enumerate(texts):
        w = spaced(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        twice, covered = Counter(tri), set()
        for k, g in enumerate(tri):
            if twice[g] > 1:
                covered.update((k, k + 1, k + 2))
        lines = [x for x in (t or "").split("\n") if spaced(x)]
        assert (r[i].n_words, r[i].word_chars, r[i].n_symbols, r[i].n_dup_lines, r[i].n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert r[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert all(r[i].kept for i in range(300)) and r[307].kept
    assert not any(r[i].kept for i in (300, 301, 302, 303, 304, 305, 306))


def test_estimate_is_near_a_plain_one(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(4000, quality.P)) @ np.diag([0.3] * quality.P) + 1
    x[:400] += 5
    stats = spark.createDataFrame([("=a", "=b", False, *map(float, v)) for v in x], "lang_key string, source_key string, base_failed boolean, " + ", ".join(f"{n} double" for n, _ in quality.FEATURES))
    p = quality.estimates(stats.coalesce(1)).first()
    clean = x[400:]
    assert all(abs(p[f"mean_{i}"] - clean[:, i].mean()) < 0.03 for i in range(quality.P))
    w = np.array([[p[f"w_{i}_{j}"] if j <= i else 0 for j in range(quality.P)] for i in range(quality.P)])
    d2 = (((clean - clean.mean(0)) @ w.T) ** 2).sum(1)
    assert abs(np.median(d2) - quality.chi2_quantile(0.5, quality.P)) < 1


def plain_mcd(x, share, steps=60, starts=40):
    """Least determinant over random starts, each concentrated until it settles."""
    n, p = x.shape
    h, g, best = int(share * n), np.random.default_rng(1), None
    for _ in range(starts):
        rows = g.choice(n, p + 1, replace=False)
        before = None
        for _ in range(steps):
            mean, cov = x[rows].mean(0), np.cov(x[rows].T, bias=True) + np.eye(p) * 1e-9
            d2 = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            rows = np.argsort(d2)[:h]
            if before is not None and set(rows) == before:
                break
            before = set(rows)
        det = np.linalg.slogdet(np.cov(x[rows].T, bias=True))[1]
        if best is None or det < best[0]:
            best = (det, x[rows].mean(0), np.cov(x[rows].T, bias=True))
    return best


def test_estimate_is_that_of_least_determinant(spark):
    g = np.random.default_rng(8)
    mix = np.linalg.qr(g.normal(size=(quality.P, quality.P)))[0] @ np.diag(np.linspace(0.4, 1.5, quality.P))
    x = g.normal(size=(1500, quality.P)) @ mix.T + 2
    x[:300] = g.normal(size=(300, quality.P)) * 0.4 + np.linspace(6, 9, quality.P)
    rows = neardup.written(spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, " + ", ".join(f"{n} double" for n, _ in quality.FEATURES)), "test")
    found = quality.fitted(rows).first()
    _, mean, cov = plain_mcd(x, quality.SUBSET)
    cov = cov * quality._consistency(quality.SUBSET)
    w = np.array([[found[f"w_{i}_{j}"] if j <= i else 0 for j in range(quality.P)] for i in range(quality.P)])
    ours = (((x - [found[f"mean_{i}"] for i in range(quality.P)]) @ w.T) ** 2).sum(1)
    plain = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
    cut = quality.chi2_quantile(1 - quality.TAIL, quality.P)
    assert (ours[:300] > cut).all() and ((ours > cut) != (plain > cut)).mean() < 0.01


# --- 5 licences --------------------------------------------------------------------------------------------------------


def test_licences_are_found_and_inherited(spark):
    rows = [("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software to deal in the Software without restriction."), ("a/x/y/f.txt", "nothing"), ("a/b/LICENSE", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."), ("a/b/c/g.txt", None), ("a/b/h.txt", "text\n# Licensed under the Apache License, Version 2.0.\nmore"), ("z/f.txt", "no copyright text that is alike to any"), ("top.txt", "x"), (None, "x")]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [(got[p].license, got[p].origin, got[p].from_path) for p in ("a/LICENSE", "a/x/y/f.txt", "a/b/c/g.txt", "a/b/h.txt")] == [("MIT", "file", "a/LICENSE"), ("MIT", "inherited", "a/LICENSE"), ("GPL-3.0", "inherited", "a/b/LICENSE"), ("Apache-2.0", "header", "a/b/h.txt")]
    assert all(got[p].license is None for p in ("z/f.txt", "top.txt", None))


def test_wrapped_headers_are_scored_whole(spark):
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    rows = [("a.py", "".join(f"# {x}\n" for x in gpl.split("\n")) + "import os\nprint(os.name)\n" * 30), ("c.js", "/* " + mpl.replace("\n", "\n * ") + " */\n\nlet x = 1;\n"), ("d.txt", mpl)]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a.py": "GPL-2.0-or-later", "c.js": "MPL-2.0", "d.txt": "MPL-2.0"}


def test_whole_notices_and_or_later_forms(spark):
    """The third BSD clause tells the two notices apart, also with a copyright line, wrapped, numbered otherwise and without the disclaimer."""
    two, three = (max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("BSD-2-Clause", "BSD-3-Clause"))
    wrapped = lambda t: "\n".join(" * " + t[i : i + 70] for i in range(0, len(t), 70)).replace("1. ", "(a) ")
    gpl = "is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
    rows = [("three", f"/*\n * Copyright (c) 2011, Somebody. All rights reserved.\n *\n{wrapped(three)}\n */\nint x;"), ("two", f"Copyright (c) 2011, Somebody\n\n{two}"), ("three/LICENSE-BSD", three.partition(" This software is provided")[0]), ("x/COPYING.LESSER", "GNU LESSER GENERAL PUBLIC LICENSE. " + next(t for n, t in licenses.TEMPLATES if n == "LGPL-3.0")), ("x/a.c", "int y;"), ("g2", f"Tool {gpl}version 2 of the License."), ("g3", f"# Tool {gpl}either version 3 of the License, or (at your option) any later version.")]
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"three": ("BSD-3-Clause", "header"), "two": ("BSD-2-Clause", "header"), "three/LICENSE-BSD": ("BSD-3-Clause", "file"), "x/COPYING.LESSER": ("LGPL-3.0", "file"), "x/a.c": ("LGPL-3.0", "inherited"), "g2": ("GPL-2.0", "header"), "g3": ("GPL-3.0-or-later", "header")}


def test_a_header_scores_alike_in_any_corpus(spark):
    header = ("h", "Released under the MIT License, see the file LICENSE.")
    more = [(str(i), f"mit license file number {i} copyright") for i in range(60)]
    scores = [next(r.score for r in licenses.similar(spark.createDataFrame([header, *x], "key string, statement string")).collect() if r.key == "h") for x in ([], more)]
    assert scores[0] == scores[1]


def test_every_template_is_nearest_to_itself(spark):
    rows = [(str(i), t) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r.key: r for r in licenses.similar(spark.createDataFrame(rows, "key string, statement string")).collect()}
    assert all(got[str(i)].license == name and got[str(i)].score > 0.999 for i, (name, _) in enumerate(licenses.TEMPLATES))


def test_cosines_are_plain_ones(spark):
    rows = [(str(i), t) for i, t in enumerate(["Released under the MIT License, see LICENSE.", "Licensed under the Apache License", "public domain work, the author has waived all rights", "copyright of nobody in particular", "GNU General Public License version 2 license license"])]
    got = {r.key: (r.license, r.score) for r in licenses.similar(spark.createDataFrame(rows, "key string, statement string"), least=0.0).collect()}
    cut = lambda t: Counter(re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)?", t.lower()))
    texts = [cut(t) for _, t in licenses.TEMPLATES]
    df = Counter(w for t in texts for w in t)
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1 if df[w] else 1.0

    def vector(t):
        v = {w: (1 + math.log(c)) * idf(w) for w, c in t.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    known = [(name, vector(cut(t))) for name, t in licenses.TEMPLATES]
    for key, t in rows:
        v = vector(cut(t))
        scores = [(round(sum(x * k.get(w, 0) for w, x in v.items()), 9), name) for name, k in known]
        best = max(s for s, _ in scores)
        assert math.isclose(got[key][1], best, abs_tol=1e-8) and got[key][0] == min(n for s, n in scores if abs(s - best) < 1e-8)


# --- 6 token counts ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, corpus, name, tmp_path):
    path = public_tokenizers.path(name)
    texts = [*corpus, "x<|endoftext|>y <|EndOfText|> <|startoftext|>", "don't  stop now é   z\x1cq", "a\x85b \x0bc", "'s 'll 12345"]
    got = {r.doc_id: r for r in tokens.count_tokens(docs_df(spark, texts), path, cache=str(tmp_path / "cache"), limit=100).collect()}
    if name.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(m.encode(t))
    else:
        from tokenizers import Tokenizer

        m = Tokenizer.from_file(path)
        count = lambda t: len(m.encode(t, add_special_tokens=False).ids)
    for i, t in enumerate(texts):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (count(t or ""), len((t or "").encode()), count(t or "") > 100)


def test_cache_is_used_and_appended(spark, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    tokens.count_tokens(docs_df(spark, ["a b", "a  b ", "c"]), path, cache=cache).collect()
    assert spark.read.parquet(cache).count() == 2
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long")).write.parquet(cache + "2")
    got = tokens.count_tokens(docs_df(spark, ["a b", "d e f"]), path, cache=cache + "2").orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [77, 3] and spark.read.parquet(cache + "2").count() == 3


def test_words_forgotten_are_counted_again(corpus, monkeypatch):
    monkeypatch.setattr(tokens, "WORD_MEMORY", 40)
    counter = tokens.WordCounter(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t or "" for t in corpus] * 2
    got = [n for k in range(0, len(texts), 3) for n in counter.count(texts[k : k + 3])]
    assert got == counter.encode(texts) and counter.by_word


# --- 7 language model --------------------------------------------------------------------------------------------------


def test_forward_recursion_sums_all_segmentations():
    lattice = lm.Lattice({p: w for p, w in [("▁", 1.0), ("a", 2.0), ("b", 1.0), ("ab", 3.0), ("▁a", 1.5), ("aba", 0.5), *((f"<0x{b:02X}>", 0.1) for b in range(256))]})

    def total(s):
        out = 0.0 if s else 1.0
        for k in range(1, len(s) + 1):
            w = lattice.logs.get(s[:k])
            if w is None and k == 1:
                w = sum(lattice.bytes[b] for b in s[0].encode())
            if w is not None:
                out += math.exp(w) * total(s[k:])
        return out

    for s in ("▁", "▁aba", "▁abab", "▁éab"):
        assert math.isclose(lattice.score(s), math.log(total(s)), rel_tol=1e-9)
    uses = {}
    lattice.expect("▁abab", 2.0, uses)
    assert math.isclose(sum(u * len(p) for p, u in uses.items()), 2.0 * 5)


@pytest.mark.parametrize("hot", [0, 5, 50_000])
def test_base_scores(spark, corpus, hot):
    got = {r.doc_id: r for r in lm.score(docs_df(spark, corpus), public_tokenizers.path("piece_bpe_32k.model"), hot=hot).collect()}
    cut = {i: [*spaced((t or "").translate(LOWER)), None] for i, t in enumerate(corpus)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in cut}
    c = Counter(w for i in cut if not held[i] for w in cut[i])
    n, v = sum(c.values()), len(c)
    for i, w in cut.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 1) / (n + (v + 1))) for x in w), rel_tol=1e-9)
        assert got[i].score < 0


def test_scores_are_sums_over_words(spark, corpus):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in lm.score(docs_df(spark, corpus), path, hot=7).collect()}
    cut = {i: (t or "").translate(LOWER).encode().split() for i, t in enumerate(corpus)}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in cut}
    count = Counter(w for i in cut if not held[i] for w in cut[i])
    words = neardup.written(spark.createDataFrame([(bytearray(w), c) for w, c in count.items()], "word binary, c long"), "test")
    lattice, end = lm.fit(words, sum(not h for h in held.values()), path)
    for i, ws in cut.items():
        assert math.isclose(got[i].score, sum(lattice.score("▁" + w.decode()) for w in ws) / math.log(10) + end, rel_tol=1e-6)


def test_long_words_in_windows(monkeypatch):
    weights = {p: rng.random() + 0.1 for p in ["▁", "a", "b", "ab", "aba", "bb", "▁ab"]} | {f"<0x{b:02X}>": 0.1 for b in range(256)}
    word_ = "▁" + "".join(rng.choice("abé") for _ in range(60))
    found = []
    for window in (4096, 7, 1):
        monkeypatch.setattr(lm.Lattice, "WINDOW", window)
        lattice, uses = lm.Lattice(weights), {}
        lattice.expect(word_, 3.0, uses)
        found.append((lattice.score(word_), uses))
    for score, uses in found[1:]:
        assert math.isclose(score, found[0][0], rel_tol=1e-9) and all(math.isclose(uses[p], u, rel_tol=1e-9) for p, u in found[0][1].items())


# --- 8 personal data ---------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_spans_are_those_of_plain_patterns(spark):
    texts = [None, "", "a@b.com_x@y.z.w 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.0255", "+1 (555) 555-0100 +49-30-123456 4111 1111 1111 1111", "é\U0001f600 x@y.co \x01\x02", "1" * 3000 + " " + "2 " * 2000 + "@" * 100 + "a." * 2000, "a@b.c " * 200]
    texts += ["".join(rng.choice("ab@.+-_% 0123456789()é\n") for _ in range(300)) for _ in range(200)]
    for r in pii.find(docs_df(spark, texts)).collect():
        found = {k: [(m.start(), m.end()) for m in re.finditer(p, r.text or "") if ok(m.group())] for k, p, ok in KINDS}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, found.values()))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, v in found.items() for a, z in v).encode()).hexdigest()


def test_checksums_context_and_redaction(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765431", "my ssn: 123-45-6789", "code 123-45-6789", "write a@b.co or +1 (555) 555-0100!"]
    found = pii.find(docs_df(spark, texts)).orderBy("doc_id").collect()
    assert [r.spans for r in found] == ["iban:5:32", "ssn:8:19", "", "email:6:12,phone:16:33"]
    out = pii.redact(docs_df(spark, texts)).orderBy("doc_id").collect()
    assert out[3].text == "write [EMAIL] or [PHONE]!" and out[3].n_chars == len(out[3].text) and out[2].text == texts[2]


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def added_spans(t):
    near = lambda a, z, words: re.search(rf"(?:^|[^a-z])(?:{words})", (t[max(0, a - 40) : a] + " " + t[z : z + 20]).translate(LOWER))
    found = []
    for m in re.finditer(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", t):
        s = m.group().replace(" ", "")
        if 15 <= len(s) <= 34 and mod97(s):
            found.append(("iban", *m.span()))
    found += [("ssn", *m.span()) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", t) if near(*m.span(), "ssn|social security|taxpayer")]
    return found + [("secret", *m.span()) for m in re.finditer(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,256}(?![A-Za-z0-9_-])", t) if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()) and near(*m.span(), "token|secret|api|key|password|passwd|credential|bearer")]


def test_added_spans_are_those_of_plain_patterns(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "FR1420041010050500013M02606"]
    secrets = ["a1" * 14, "A" * 30, "0" * 30, "x9_-" * 8, "ab12" * 70]
    texts = [prose(rng.randint(0, 12)) + rng.choice([" token = ", " iban ", " ssn ", " my key: ", " "]) + rng.choice([*ibans, *secrets, "123-45-6789", "123-45-67890"]) + rng.choice([" ", ".", "x", ""]) + prose(rng.randint(0, 9)) for _ in range(250)]
    for r in pii.find(docs_df(spark, texts)).collect():
        assert [(x.kind, x.start, x.end) for x in r.found if x.kind not in pii.BASE] == added_spans(r.text)


def test_a_text_with_very_many_matches(spark):
    parts = [rng.choice(["4111111111111111", "1.2.3.4", "12", "word", "a@b.co", "+1 (212) 555 0100", "漢"]) for _ in range(60000)]
    r = pii.find(docs_df(spark, ["\n".join(parts)])).first()
    c = Counter(parts)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (c["a@b.co"], c["1.2.3.4"], c["4111111111111111"], c["+1 (212) 555 0100"])
    marks = {"4111111111111111": "[CARD]", "1.2.3.4": "[IP]", "a@b.co": "[EMAIL]", "+1 (212) 555 0100": "[PHONE]"}
    assert pii.redact(docs_df(spark, ["\n".join(parts)])).first().text == "\n".join(marks.get(x, x) for x in parts)


# --- 9 html ------------------------------------------------------------------------------------------------------------


def test_article_text(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>Home</ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; tail</h1><p><b>One\n two<br><p>Three&nbsp;<i>four</i> five<!-- no --><div class="share">Share</div><section id="comments"><p>Reader says</p></section></article><aside>side</aside><footer>&copy; x</footer></body></html>'
    rows = [(1, "http://a.x/1", page), (2, None, None), (3, "http://a.x/3", ""), (4, "http://b.x/", "<p>only"), (5, "nohost", "plain < text")]
    got = {r.page_id: r for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & tail\nOne two\nThree four five" and got[1].n_chars == len(got[1].text)
    assert [got[i].text for i in (2, 3, 4, 5)] == ["", "", "only", "plain < text"]


def test_wrapper_drops_what_is_constant_and_keeps_copies(spark):
    page = lambda i: f"<html><body><div class=x><p>Read our terms</p></div><div class=y><p>{prose(20)}</p><p>{i} {prose(9)}</p></div></body></html>"
    copies = "<html><body><p>Same</p><p>page</p></body></html>"
    rows = [(i, "http://w.x/", page(i)) for i in range(12)] + [(100 + i, "http://c.x/", copies) for i in range(9)]
    got = {r.page_id: r for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i, _, p in rows[:12]:
        assert got[i].text == "\n".join(re.findall(r"<p>([^<]*)</p>", p)[1:])
    assert all(got[100 + i].text == "Same\npage" for i in range(9))


def test_deep_nesting_keeps_its_text():
    root = dom.parse("<article>" + "<div>a" * 5000 + "</div>" * 5000 + "<p>end</article>")
    assert html.extract(root, None).split("\n") == ["a"] * 5000 + ["end"]
    assert len(dom.Slot("#root", [root]).walk()) == 5003


def test_deep_nesting_closes_nothing_else():
    root = dom.parse("<div class=page><article><p>A</p>" + "<div>" * 250 + "<nav><div>menu</div></nav>b" + "</div>" * 250 + "<p>end</p></article></div>")
    assert html.extract(root, None) == "A\nb\nend"


def test_simple_tree_matching():
    a, b = (dom.Slot("#root", [dom.parse(x)]) for x in ("<div><p>1</p><ul><li>2</ul></div>", "<div><h1>0</h1><p>1</p><table></table><ul><li>3</ul></div>"))
    size, _ = dom.match(a, b, {})
    assert size == 5  # root, div, p, ul, li
    t = dom.Template.unpack(json.loads(json.dumps(dom.Template("#root").pack())))
    dom.align(t, a, True)
    dom.align(t, b, True)
    assert [c.label for c in t.children[0].children] == ["h1", "p", "table", "ul"]


def plain_matching(a, b):
    """Simple tree matching, as it is written down: the size of the largest top-down matching that keeps order."""
    m, n = len(a.children), len(b.children)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            x, y = a.children[i - 1], b.children[j - 1]
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (plain_matching(x, y) if x.label == y.label else 0))
    return best[m][n] + 1


def test_matching_is_that_of_the_plain_recursion():
    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "ul", "p"], k=rng.randint(0, 5)))

    for _ in range(150):
        a, b = (dom.Slot("#root", [dom.parse(tree(2))]) for _ in range(2))
        size, pairs = dom.match(a, b, {})
        assert size == plain_matching(a, b)
        assert all(x < y and v < w for (x, v), (y, w) in zip(pairs, pairs[1:], strict=False))


def test_wrapper_finds_the_content_where_no_element_says_it(spark):
    page = lambda i: f"<html><body><div><a href=/>{word()}</a> <a href=/a>{word()}</a></div><div>Ad {i}</div><div><h2>{word()}</h2><p>{prose(30)}</p><p>{prose(9)}</p></div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://w.x/{i}", page(i)) for i in range(9)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)).collect()}
    for i, _, h in rows:
        assert got[i] == "\n".join(re.findall(r"<(?:h2|p)>([^<]*)</", h))
        assert html.by_elements(dom.parse(h), set()) != got[i]


def test_headings_beside_the_content_stay():
    page = lambda i: f"<body><div class=page><h1>{word()} {i}</h1><div class=text><p>{prose(60)}</p><p>{prose(40)}</p></div></div><div class=foot>same</div></body>"
    inside = lambda i: f"<body><main><div class=more>{word()} {i}</div><article><p>{prose(60)}</p></article></main></body>"
    for make, tag in ((page, "h1|p"), (inside, "p")):
        pages = [make(i) for i in range(5)]
        wrapper = html.wrapper_of(pages)
        for p in pages:
            assert html.extract(dom.parse(p), wrapper).split("\n") == re.findall(rf"<(?:{tag})>([^<]*)", p)


def test_constant_text_of_an_article_stays():
    pages = [f"<body><nav>Menu</nav><article><h2>Summary</h2><p>{prose(9)}</p><p class='share-price ad-hoc'>Price</p><div class='share-buttons'>Tweet</div></article></body>" for _ in range(6)]
    wrapper = html.wrapper_of(pages)
    for p in pages:
        assert html.extract(dom.parse(p), wrapper) == "Summary\n" + re.search(r"<p>([^<]*)", p)[1] + "\nPrice"


def test_quotes_in_tags_are_read_as_browsers_do():
    page = """<p>x <img alt="5" tall" src=a>y</p><p><a title='it's'>z</a> <a href="a>b">q</a> <b title = 'c>d'>r</b><i a= >s</i><img alt="open>t</p>"""
    assert html.extract(dom.parse(page), None) == "x y\nz q rst"
    deep = "<p>" + "<a " + "b=" * 50000
    assert html.extract(dom.parse(deep), None).startswith("<a b=")


def test_content_is_not_lost_to_longer_blocks():
    """A short article beside long comments that no class tells apart: both are blocks of paragraphs, so both stay."""
    says = lambda i: "".join(f"<p>{word()} {i} {prose(30)}</p>" for _ in range(12))
    pages = [f"<body><div>menu</div><div class=mid><h1>{word()} {i}</h1><p>{i} {prose(5)}</p></div><div class=xx>{says(i)}</div><div>end</div></body>" for i in range(6)]
    wrapper = html.wrapper_of(pages)
    for p in pages:
        assert html.extract(dom.parse(p), wrapper).split("\n") == re.findall(r"<(?:h1|p)>([^<]*)", p)


def test_template_within_articles_goes():
    pages = [f"<body><article><h1>{word()} {i}</h1><div class=club><b>Join</b> our club</div><h2>Summary</h2><p>{i} {prose(9)}</p><p>Always so</p><section>Written by us</section></article></body>" for i in range(6)]
    wrapper = html.wrapper_of(pages)
    for p in pages:
        assert html.extract(dom.parse(p), wrapper).split("\n") == re.findall(r"<(?:h1|h2|p)>([^<]*)", p)


def test_bodies_that_are_all_the_same_stay():
    pages = [f"<body><div class=a><h1>{word()} {i}</h1><div class=b><p>The same.</p></div></div></body>" for i in range(6)]
    wrapper = html.wrapper_of(pages)
    assert [html.extract(dom.parse(p), wrapper) for p in pages] == [re.search("<h1>([^<]*)", p)[1] + "\nThe same." for p in pages]


def test_texts_do_not_depend_on_order_or_partitions(spark):
    odd = lambda i: "".join(f"<div class={'xyz'[rng.randrange(3)]}>{prose(2)}</div>" for _ in range(i % 5))
    rows = [(i, "http://h.x/", f"<body><div class=top>T</div>{odd(i)}<div class=mid><h2>{word()} {i}</h2><p>{i} {prose(9)}</p>{'<div class=ad2>Buy</div>' * (i % 3 > 0)}</div><div class=end>E</div></body>") for i in range(40)]
    texts = []
    for n in (1, 4, 9):
        mixed = rng.sample(rows, len(rows))
        got = html.extract_text(spark.createDataFrame(mixed, "page_id long, url string, html string").repartition(n)).collect()
        texts.append({r.page_id: r.text for r in got})
    assert texts[0] == texts[1] == texts[2]
    wrapper = html.wrapper_of([h for _, _, h in rows])
    assert texts[0] == {i: html.extract(dom.parse(h), wrapper) for i, _, h in rows}
    assert all(texts[0][i].split("\n") == re.findall("<(?:h2|p)>([^<]*)", h) for i, _, h in rows)


def test_wrappers_know_the_template_of_made_hosts():
    """Hosts made of parts of which it is known what is template: every word of the varying parts is in the texts and none of the others."""
    for _ in range(60):
        parts = [(f"<{t} class=p{chr(97 + k)}>", f"</{t}>", rng.random() < 0.5, rng.choice([1, 0.7])) for k, t in enumerate(rng.choices(["div", "section"], k=rng.randint(1, 4)))]
        pages, want = [], []
        for i in range(12):
            page, text = "", []
            for k, (start, end, constant, share) in enumerate(parts):
                if rng.random() < share:
                    said = f"fixed {'abcd'[k]} words" if constant else f"{i}x{k} {prose(6)}"
                    page += f"{start}<p>{said}</p>{end}"
                    text += [] if constant else [said]
            pages.append(f"<body>{page}<div class=text><p>{i} {prose(5)}</p></div></body>")
            want.append([*text, re.search(r"<div class=text><p>([^<]*)", pages[-1])[1]])
        wrapper = html.wrapper_of(pages)
        assert [html.extract(dom.parse(p), wrapper).split("\n") for p in pages] == want


# --- 10 near duplicates ------------------------------------------------------------------------------------------------


def components_of(sets, percent=80):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("k", "block_bytes"), [(2, 48 << 20), (5, 48 << 20), (2, 1500)])
def test_components_are_those_of_all_pairs(spark, corpus, k, block_bytes):
    sets = {}
    for i, t in enumerate(corpus):
        w = spaced((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    expected = components_of(sets)
    got = neardup.near_duplicates(docs_df(spark, corpus), k=k, block_bytes=block_bytes).collect()
    assert {r.doc_id: r.component_id for r in got} == expected
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in got)


def test_exact_linking_agrees_with_all_pairs():
    base = [rng.getrandbits(60) for _ in range(60)]
    sets = []
    for _ in range(80):
        s = set(base)
        for _ in range(rng.randint(0, 12)):
            s.discard(rng.choice(base))
            s.add(rng.getrandbits(60))
        sets.append(np.array(sorted(s), dtype=np.uint64))
    digests = [i.to_bytes(2, "big") for i in range(80)]
    got = dict(neardup.link_exactly(digests, sets, 80))
    expected = components_of({i: set(s.tolist()) for i, s in enumerate(sets)})
    assert {i: int.from_bytes(got.get(d, d), "big") for i, d in enumerate(digests)} == expected


@pytest.mark.parametrize("postings", [4096, 50])
def test_links_within_a_crowd_are_found(spark, postings):
    shared, own = prose(60), lambda n: " ".join(f"w{rng.getrandbits(40)}" for _ in range(n))
    texts = [f"{shared} {own(60)}" for _ in range(400)] + [f"{shared} {own(6)}" for _ in range(12)]
    sets = {i: set(t.split()) for i, t in enumerate(texts)}
    got = neardup.near_duplicates(docs_df(spark, texts), k=1, look_back=1, postings=postings).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(sets)


def test_crowded_edges_need_no_forest(spark):
    """Every link is among the edges, whatever neighbours the orders give."""
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 2) for _ in range(rng.randint(10, 40))) for _ in range(150)]
    sets = {i: neardup.shingle_set(t, 1) for i, t in enumerate(texts)}
    rows = [(i.to_bytes(2, "big"), i.to_bytes(2, "big"), (neardup.signature(s)[::2][:64] & 0xFF).astype(np.uint8).tobytes(), s.tobytes()) for i, s in sets.items()]
    df = spark.createDataFrame(rows, "digest binary, comp binary, sketch binary, shingles binary")
    edges = neardup._crowded_edges(df, 80, 0.0, 20)
    star = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in graph.components(edges).collect()}
    for i, a in sets.items():
        for j, b in sets.items():
            both = len(np.intersect1d(a, b))
            if i < j and 100 * both >= 80 * (len(a) + len(b) - both):
                assert star.get(i, i) == star.get(j, j)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


# --- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = neardup.written(stage(spark, docs, FOLDER), "test")
        assert docs.count() <= before
        before = docs.count()
        if k < 4:
            assert docs.columns == columns, name
    assert docs.where("taken < 1 or taken > 3 * size").count() == 0
    assert pii.find(docs.select("doc_id", "text")).where("n_email + n_ip + n_card + n_phone > 0").count() == 0


def test_pipeline_stages_are_those_of_brute_force(spark):
    import corpus_pipeline

    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = neardup.written(stages[0](spark, docs, FOLDER), "test")
    # The base rule in plain Python, and the distances by numpy from each group's estimate; 22.457744 is the 0.999 quantile of chi-square with 6 degrees.
    failed = set()
    for r in docs.collect():
        w = spaced(r.text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
        if len(w) < 50 or 2 * len(covered) > len(w):
            failed.add(r.doc_id)
    keyed = docs.select("doc_id", "text", quality._key(F.col("lang")).alias("lang_key"), quality._key(F.col("source")).alias("source_key"))
    stats = neardup.written(quality.measured(keyed, "text").drop("text"), "test")
    groups = {(g.lang_key, g.source_key): g for g in quality.estimates(stats).collect()}
    outliers, p = set(), quality.P
    for r in stats.collect():
        g = groups.get((r.lang_key, r.source_key))
        if g is not None and g.mean_0 is not None:
            z = np.array([[g[f"w_{i}_{j}"] if j <= i else 0.0 for j in range(p)] for i in range(p)]) @ np.array([r[n] - g[f"mean_{i}"] for i, (n, _) in enumerate(quality.FEATURES)])
            if z @ z / (1 + 60 / max(1, r.n_words)) > 22.457744:
                outliers.add(r.doc_id)
    assert outliers - failed
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in failed | outliers)

    texts = {r.doc_id: r.text for r in kept.collect()}
    sets = {}
    for i, t in texts.items():
        w = spaced(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    one = neardup.written(stages[1](spark, kept, FOLDER), "test")
    assert {r.doc_id for r in one.collect()} == {i for i, c in components_of(sets).items() if i == c}

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    windows = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() for w in [cut(r.text)] for k in range(max(1, len(w) - 12) if w else 0)}
    clean = neardup.written(stages[2](spark, one, FOLDER), "test")
    left = set()
    for r in one.collect():
        w, hit = cut(r.text), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not (hit and 20 * len(hit) >= len(w)):
            left.add(r.doc_id)
    assert {r.doc_id for r in clean.collect()} == left

    redacted = neardup.written(stages[3](spark, clean, FOLDER), "test")
    changed = 0
    for r in redacted.collect():
        t, at, out = texts[r.doc_id], 0, ""
        spans = [(k, *m.span()) for k, p, ok in KINDS for m in re.finditer(p, t) if ok(m.group())] + added_spans(t)
        for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
            if start >= at:
                out += t[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert r.text == out + t[at:]
        changed += bool(spans)
    assert changed

    said = {r.doc_id: spaced(r.text) for r in redacted.collect()}
    source = {r.doc_id: r.source for r in redacted.collect()}
    sizes, taken, seen = Counter(), Counter(), set()
    for i, w in said.items():
        sizes[source[i]] += len(w)
    for r in stages[4](spark, redacted, FOLDER).collect():
        assert spaced(r.text) == [w for p in r.pieces for w in said[r.doc_id][p.from_word : p.from_word + p.n_words]] and len(spaced(r.text)) == r.taken <= 3 * len(said[r.doc_id])
        taken[source[r.doc_id]] += r.taken
        for p in r.pieces:
            words = {(r.doc_id, p.epoch, w) for w in range(p.from_word, p.from_word + p.n_words)}
            assert not words & seen
            seen |= words
    assert all(abs(taken[x] - target) <= 1 for x, target in filled(dict(sizes)).items())
