"""The opN_ queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, html, licenses, lm, mixing, neardup, pii, quality, tokens, trie, vectors
from .common import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    """Looked up when a query runs, so that the others do without the vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per turn; the rendered parts of a conversation follow each other by place."""
    fixed = chat.repair(table(spark, sf_dir, "conversations"))
    return fixed.select("conv_id", "turn", "place", "role", "new_role", "action", "inserted", "escaped", "rendered")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs).withColumn("shards", mixing.shards_of(F.col("pieces")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files source/lang/doc_id; those that end in a licence statement stand for their directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    last_line = F.element_at(F.split(F.btrim(F.coalesce("text", F.lit(""))), "\n"), -1)
    files = docs.select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, license_file=last_line.rlike(r"(?i)licen[sc]e"), keep=["doc_id", "path"])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, vocabulary_file("word_bpe_49k.json"), keep=["doc_id"])


def op7_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score(docs, vocabulary_file("piece_bpe_32k.model"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")


def op9_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, k=2)


def op11_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_copies(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(trie.paths(table(spark, sf_dir, "conversations")), "conversations")
    return trie.prefix_trie(trie.rebuilt(own))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_decontaminate, op3_mix, op4_quality, op5_licenses, op6_token_counts, op7_lattice_score, op8_pii, op9_extract_text, op10_near_duplicates, op11_projection_passes, op12_prefix_trie, op13_source_divergence)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES: dict[str, str] = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS x FROM bw),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hit AS (SELECT doc_id, item, i, win.n FROM dw JOIN win ON win.n = dw.n AND win.x = list_slice(dw.w, dw.i, dw.i + dw.n - 1)),
at AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN "at" USING (doc_id) LEFT JOIN it USING (doc_id)""".replace("\nat AS", '\n"at" AS'),
    "op10_near_duplicates": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS x FROM d),
c AS (SELECT min(doc_id) AS rep, x, len(x) AS n FROM (SELECT doc_id, list_sort(x) AS x FROM s WHERE len(x) > 0) GROUP BY x),
e AS (SELECT rep, n, unnest(x) AS g FROM c),
f AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
o AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS n_both FROM (e SEMI JOIN f USING (g)) a JOIN e b ON a.g = b.g AND a.rep <> b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM o WHERE 100 * n_both >= 80 * (na + nb - n_both)),
r AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.x) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.x = list_sort(s.x) LEFT JOIN m ON m.rep = c.rep""",
    "op11_projection_passes": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)""",
    "op12_prefix_trie": r"""
WITH r AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({d: d, b: b} ORDER BY turn NULLS FIRST, d[1:32]) AS own FROM r GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 9 AS h FROM o),
p AS (SELECT h.conv_id, list_concat(coalesce(f.own[1:h.h], []), h.own[h.h + 1:]) AS p FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 5),
x AS (SELECT conv_id, len(p) AS turns, p, unnest(range(0, len(p) + 1)) AS depth FROM p),
k AS (SELECT conv_id, turns, depth, coalesce(p[depth].b, 0) AS b, md5(array_to_string(list_transform(p[1:depth], lambda t: t.d), '')) AS k, CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(p[1:depth - 1], lambda t: t.d), '')) END AS up FROM x),
n AS (SELECT k, depth, any_value(up) AS up, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (turns = depth), '')) AS ends_sha256 FROM k GROUP BY k, depth),
c AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT a.k, count(*) FILTER (c.n_children IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.b) AS BIGINT) AS saved_tokens FROM n JOIN k a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN c ON c.up = n.k GROUP BY a.k)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN s USING (k) LEFT JOIN c ON c.up = n.k LEFT JOIN n u ON u.k = n.up""",
    "op13_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 30),
k AS (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM k GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(k.c, 0) AS c, 1 + CAST((1000000000::HUGEINT * (coalesce(k.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS BIGINT) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN k USING (lang, source, term)),
q AS (SELECT lang, term, 1 + CAST((1000000000::HUGEINT * (sum(c) + 5)) // (any_value(total) + 5 * any_value(v)) AS BIGINT) AS q
  FROM k JOIN (SELECT lang, sum(c) AS total FROM k GROUP BY ALL) USING (lang) JOIN v USING (lang) GROUP BY ALL),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
}
