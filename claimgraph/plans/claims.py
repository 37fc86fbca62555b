"""The claim pipeline: patents to records with facts and an invention graph, then to relational tables and RDF.

Cleaning and filters are column expressions; annotation and the folds run in one mapInArrow over the documents that are
left, without a shuffle. A document that fails keeps its row with an error.
"""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import clean_claim, split_parts
from ..operators import graph, numbering, rdf
from ..operators.segments import SURROGATES
from ..sources import owl, patents
from ..storage import saved

GRAPH = (
    "struct<terms:array<struct<key:string,term:string,ord:int>>,verbs:array<struct<key:string,text:string,type:string,prepositions:array<struct<number:int,text:string>>>>,"
    "edges:array<struct<sbj_key:string,obj_key:string,verb_key:string,prep_key:int,type:string,ord:int>>,refs:array<struct<key:string,alias:string>>>"
)
SEGMENTS = "array<struct<id:int,part:int,text:string,type:string,template:string,link:struct<type:string,parent:int,point:string,child:string>>>"
FACTS = "array<struct<action:string,object:string,condit:string>>"
RESULT = f"code string, segments {SEGMENTS}, graph {GRAPH}, facts {FACTS}, fold_error string"


def symbol_of(t: dict, k: int, tokens: list[dict], text: str) -> str | None:
    """What a token is in its segment's template; as operators.classify.template, on tokens in Python."""
    g, kinds = t["grammar"] or {}, {x["pos"] for x in tokens}
    if t["mark"] == "S":
        return None
    if t["pos"] == "NOUN":
        return {None: None, "Nom": "N0", "Acc": "N0"}.get(g.get("Case"), "N")
    if t["pos"] == "PRON":
        return "который" if t["lemma"] == "который" else "PR0" if g.get("Case") == "Nom" else "PR"
    if t["pos"] == "VERB":
        return f"V<{g.get('VerbForm', 'U')[0]}>"
    if t["lemma"] == "-":
        return "-"
    if t["pos"] in ("CCONJ", "SCONJ") and t["mark"] == "O":
        return t["pos"][:2]
    if t["pos"] in ("ADV", "NUM") and not kinds & {"VERB", "NOUN"}:
        return "AV"
    if t["pos"] == "X" and text.find("-") > 0:
        return "X"
    final = int(tokens[-1]["id"])
    if t["pos"] == "ADJ" and "VERB" not in kinds and ((k == 0 and int(t["id"]) > int(t["parent"])) or (t is tokens[-1] and int(t["parent"]) >= final)):
        return "A0"
    return None


def template_of(tokens: list[dict], text: str) -> str:
    out: list[str] = [""]
    for k, t in enumerate(tokens):
        s = symbol_of(t, k, tokens, text)
        said = out[-1] == s and s in ("N", "N0", "PR", "PR0", "который", "CC", "SC")
        covered = (s in ("N", "N0") and out[-1] in ("PR", "PR0")) or (s in ("PR", "PR0") and out[-1] in ("N", "N0")) or (s == "N" and out[-1] == "N0")
        if s is None or said or covered:
            continue
        if s == "N0" and out[-1] == "N":
            out.pop()
        out.append(s)
    if out[1:] in ([], ["CC"]):
        kinds = {t["pos"] for t in tokens}
        return next((s for p, s in (("ADJ", "A"), ("SCONJ", "SC"), ("X", "X")) if p in kinds), "UNKNOWN")
    return "_".join(out[1:])


def classify_segment(tokens: list[dict], text: str) -> tuple[str | None, str]:
    """(type, template)."""
    from ..operators.classify import FINAL, TRANSITIONS
    from ..operators.lexicon import SEPARATORS

    lemmas = [t["lemma"] for t in tokens]
    if text.lower() in SEPARATORS:
        return "SEPARATOR", "DROPPED"
    target = any(t["pos"] == "VERB" and t["lemma"] not in ("предназначать", "называть") for t in tokens)
    if "цель" in lemmas or lemmas[:1] == ["предназначать"] or (lemmas[:1] == ["для"] and not target):
        return "PURPOSE", "DROPPED"
    if "называть" in lemmas:
        return "NAMED", "DROPPED"
    template = template_of(tokens, text)
    if template == "UNKNOWN":
        return "UNKNOWN", template
    state = "P0"
    for symbol in template.split("_"):
        state = TRANSITIONS.get((state, symbol), state)
    return FINAL[state], template


def set_aside(text: str, originals: list[str]) -> str:
    """As operators.segments.with_surrogates, numbered on from the originals of the parts before."""
    for pattern in SURROGATES:
        for found in re.findall(pattern, text):
            hit = found[0] if isinstance(found, tuple) else found
            if not hit.isdigit():
                originals.append(hit)
                text = text.replace(hit, f"REP{len(originals)} ", 1)
    return text


def put_back(text: str, originals: list[str]) -> str:
    """A label's original may hold a label itself, so the last go first."""
    for k in range(len(originals), 0, -1):
        text = re.sub(rf"REP{k}(?![0-9]) ?", lambda _: originals[k - 1], text)  # noqa: B023
    return text


def fold_document(parts: list[str], candidates: list[str], annotator, deprecated=None) -> dict:
    """Segments, graph (None with fewer than two terms) and facts of one document."""
    from ..extraction import Extraction
    from ..fold import fold_graph
    from ..linking import link_segments
    from ..operators.facts import match_facts

    segments, n, originals = [], 0, []
    for p, part in enumerate(parts):
        for text in re.split(r"[,;]", set_aside(part, originals)):
            n += 1
            text = text.strip(" ,")
            if text:
                tokens = annotator.annotate(text)
                kind, template = classify_segment(tokens, text)
                for t in tokens:
                    t["text"] = put_back(t["text"], originals)
                segments.append({"id": n, "part": 0 if len(parts) == 1 else p + 1, "text": put_back(text, originals), "tokens": tokens, "type": kind, "template": template})
    link_segments(segments)
    found = Extraction(segments)
    folded = fold_graph(found.root, found.triplets, deprecated, segments) if found.triplets else None
    facts, seen = [], set()
    for text in candidates:
        for f in match_facts(annotator.annotate(text)):
            if tuple(f.values()) not in seen:
                seen.add(tuple(f.values()))
                facts.append(f)
    shown = [{k: s[k] for k in ("id", "part", "text", "type", "template", "link")} for s in segments]
    return {"segments": shown, "graph": folded if folded and len(folded["terms"]) > 1 else None, "facts": facts}


def _fold(annotator_name: str, plugin: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .. import annotate

        annotator, deprecated = annotate.get(annotator_name), load_plugin(plugin)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    rows.append({"code": row["code"], **fold_document(row["parts"] or [], row["candidates"] or [], annotator, deprecated), "fold_error": None})
                except Exception as problem:  # one bad document must not end the job
                    rows.append({"code": row["code"], "segments": [], "graph": None, "facts": [], "fold_error": f"{type(problem).__name__}: {problem}"})
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return run


_S = pa.string()
ARROW = pa.schema(
    [
        ("code", _S),
        ("segments", pa.list_(pa.struct([("id", pa.int32()), ("part", pa.int32()), ("text", _S), ("type", _S), ("template", _S), ("link", pa.struct([("type", _S), ("parent", pa.int32()), ("point", _S), ("child", _S)]))]))),
        (
            "graph",
            pa.struct(
                [
                    ("terms", pa.list_(pa.struct([("key", _S), ("term", _S), ("ord", pa.int32())]))),
                    ("verbs", pa.list_(pa.struct([("key", _S), ("text", _S), ("type", _S), ("prepositions", pa.list_(pa.struct([("number", pa.int32()), ("text", _S)])))]))),
                    ("edges", pa.list_(pa.struct([("sbj_key", _S), ("obj_key", _S), ("verb_key", _S), ("prep_key", pa.int32()), ("type", _S), ("ord", pa.int32())]))),
                    ("refs", pa.list_(pa.struct([("key", _S), ("alias", _S)]))),
                ]
            ),
        ),
        ("facts", pa.list_(pa.struct([("action", _S), ("object", _S), ("condit", _S)]))),
        ("fold_error", _S),
    ]
)


def phrases(df: DataFrame, key: str, text: str, annotator: str = "rules") -> DataFrame:
    """(key, text with its noun phrases in brackets) of any texts; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .. import annotate

        tool = annotate.get(annotator)
        for batch in batches:
            found = [None if t is None else annotate.bracketed(t, tool) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["key", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)


def load_plugin(spec: str | None):
    """'module:function' to a test of lemmas that are no concepts; None where it cannot be had."""
    import importlib

    if not spec:
        return None
    module, _, name = spec.partition(":")
    try:
        return getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError):
        return None


def folded(found: DataFrame, annotator: str = "rules", plugin: str | None = None) -> DataFrame:
    """read_patents() rows that could be read and are device claims, through the fold; a document that fails keeps its row, with fold_error."""
    good = found.where("error is null").where(F.coalesce(patents.is_device_claim(F.col("main_claim")), F.lit(False)))
    text = F.regexp_replace(clean_claim(F.col("main_claim")), r"\.\s*$", "")
    base = good.select("path", "code", "name", "org", "ipc", split_parts(text).alias("parts"), patents.fact_candidates(F.col("abstract"), F.col("description")).alias("candidates"))
    # The record travels through the fold, so nothing is joined back by a code that may repeat.
    done = base.select(F.to_json(F.struct("path", "code", "name", "org", "ipc")).alias("code"), "parts", "candidates").mapInArrow(_fold(annotator, plugin), RESULT)
    meta = F.from_json("code", "path string, code string, name string, org string, ipc array<string>")
    return done.withColumn("meta", meta).select("meta.path", "meta.code", "meta.name", "meta.org", "meta.ipc", "segments", "graph", "facts", "fold_error")


def has_result(graph: Column, facts: Column) -> Column:
    return graph.isNotNull() | F.coalesce(F.size(facts) > 0, F.lit(False))


def with_results(done: DataFrame) -> DataFrame:
    """folded() rows that have a graph or facts."""
    return done.where(has_result(F.col("graph"), F.col("facts"))).drop("path")


def records(found: DataFrame, annotator: str = "rules", plugin: str | None = None) -> DataFrame:
    """read_patents() rows to (code, name, org, ipc, segments, graph, facts, fold_error) of those with a graph or facts."""
    return with_results(folded(found, annotator, plugin))


def failures(found: DataFrame, done: DataFrame) -> DataFrame:
    """(path, code, error) of the files that could not be read and of the documents that could not be folded."""
    read = found.where("error is not null").select("path", "code", "error")
    return read.unionByName(done.where("fold_error is not null").select("path", "code", F.col("fold_error").alias("error")))


def tables(found: DataFrame) -> dict[str, DataFrame]:
    """records() to terms, verbs, verb_preps, edges, refs and facts, similar and synonymous terms merged."""
    found = saved(found, "records")
    part = lambda name: found.where("graph is not null").select("code", F.inline(f"graph.{name}"))
    terms, edges = graph.post_process(part("terms"), part("edges"))
    verbs = part("verbs")
    return {
        "terms": terms,
        "edges": edges,
        "verbs": verbs.drop("prepositions"),
        "verb_preps": verbs.select("code", F.col("key").alias("verb_key"), F.inline("prepositions")).withColumnRenamed("number", "prep_key").withColumnRenamed("text", "prep"),
        "refs": part("refs"),
        "facts": found.select("code", F.posexplode("facts").alias("n", "f")).select("code", (F.col("n") + 1).alias("n"), "f.*"),
    }


def ontology(found: DataFrame, folder: str, limit: int = 1000, chunk: int = 500) -> DataFrame:
    """Write records() as RDF/XML, the first `limit` by code, `chunk` documents a file patents_<time>_<n>.owl; returns the RDF rows."""
    found = saved(found, "records")
    chunks = saved(numbering.limited_chunks(found.select("code").where("code is not null").distinct(), ["code"], limit, chunk), "chunks")
    kept = found.join(F.broadcast(chunks.select("code")), "code", "left_semi")
    t = tables(kept)
    rows = saved(rdf.emit(kept.select("code", "name", "org", "ipc", "facts"), t["terms"], t["edges"], t["refs"]), "rdf")
    owl.write_files(rdf.chunk_files(rows, chunks), folder, time.strftime("%Y%m%d%H%M%S"))
    return rows


def batch(spark: SparkSession, source: str, target: str, limit: int = 1000, chunk: int = 500, annotator: str = "rules") -> DataFrame:
    """The ontology of all XML files below a folder; what failed goes to <target>-errors as JSON lines."""
    found = saved(patents.read_patents(patents.find_files(spark, source)), "patents")
    done = saved(folded(found, annotator), "folded")
    failures(found, done).write.mode("overwrite").json(f"{target.rstrip('/')}-errors")
    return ontology(with_results(done), target, limit, chunk)
