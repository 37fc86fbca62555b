"""Ontology emission: RDF rows, chunk numbers, RDF/XML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import ROOT

NAMESPACE = "http://example.org/claimgraph#"
LINKS = {"comp": "contains", "conn": "connected_to", "have": "parent_for"}
CLASSES = ("Component", "Concept", "Device", "IPC", "Problem", "TechnicalFunction")
OBJECT_PROPERTIES = ("connected_to", "contains", "has_function", "has_ipc", "link", "parent_for", "part_of", "solution_for")
DATA_PROPERTIES = ("concept_name", "doc_name", "doc_num", "doc_org", "ipc_code", "problem_name", "sao_action", "sao_object", "sao_subject")


def row(code: Column, s: Column, p: str | Column, o: Column, kind: str) -> Column:
    return F.struct(code.alias("code"), s.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"))


def emit(records: DataFrame, terms: DataFrame, edges: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """(code, s, p, o, o_kind) of records (code, name, org, ipc, facts), their terms and edges."""
    code = F.col("code")
    device = F.concat("code", F.lit("_dev_0"))
    root = terms.where(F.col("key") == ROOT).select("code", F.col("term").alias("root_term"))
    recs = records.join(root, "code", "left")
    ipc = F.concat("code", F.lit("_ipc_0"))
    problem = lambda i: F.concat(code, F.lit("_pbl_"), (i + 1).cast("string"))
    of_record = F.flatten(
        F.array(
            F.array(row(code, device, "rdf:type", F.lit("Device"), "iri"), row(code, device, "concept_name", F.coalesce("root_term", F.lower("name")), "literal"), row(code, device, "doc_name", F.col("name"), "literal"), row(code, device, "doc_num", code, "literal"), row(code, device, "doc_org", F.col("org"), "literal")),
            F.when(F.size("ipc") > 0, F.concat(F.array(row(code, ipc, "rdf:type", F.lit("IPC"), "iri"), row(code, device, "has_ipc", ipc, "iri")), F.transform("ipc", lambda x: row(code, ipc, "ipc_code", x, "literal")))).otherwise(F.array().cast(ROWS)),
            F.flatten(F.transform("facts", lambda f, i: F.array(row(code, problem(i), "rdf:type", F.lit("Problem"), "iri"), row(code, problem(i), "problem_name", F.concat_ws(" ", f["action"], f["object"], f["condit"]), "literal"), row(code, device, "solution_for", problem(i), "iri")))),
        )
    )
    out = recs.select(F.inline(of_record)).where("o is not null")
    from pyspark.sql import Window

    named = terms.where(F.col("key") != ROOT).withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("ord", "key")) - 1)
    iri = F.concat("code", F.lit("_com_"), F.col("n").cast("string"))
    components = named.select(F.inline(F.array(row(code, iri, "rdf:type", F.lit("Component"), "iri"), row(code, iri, "concept_name", F.col("term"), "literal"), row(code, iri, "part_of", device, "iri"))))
    ids = named.select("code", "key", iri.alias("iri")).union(records.select("code", F.lit(ROOT).alias("key"), device.alias("iri")))
    e = edges
    if refs is not None:
        from .graph import resolve_refs

        known = ids.select("code", F.col("key").alias("k"))
        for end in ("sbj_key", "obj_key"):  # only keys that no term has are looked up
            missing = e.join(known.withColumnRenamed("k", end), ["code", end], "left_anti")
            e = e.join(known.withColumnRenamed("k", end), ["code", end], "left_semi").unionByName(resolve_refs(missing, refs, "code", end))
    link = F.create_map(*[F.lit(x) for pair in LINKS.items() for x in pair])
    ends = e.join(ids.select("code", F.col("key").alias("sbj_key"), F.col("iri").alias("s")), ["code", "sbj_key"]).join(ids.select("code", F.col("key").alias("obj_key"), F.col("iri").alias("o")), ["code", "obj_key"])
    links = ends.select("code", "s", F.try_element_at(link, F.col("type")).alias("p"), "o", F.lit("iri").alias("o_kind")).where("p is not null")
    return out.unionByName(components).unionByName(links)


ROWS = "array<struct<code:string,s:string,p:string,o:string,o_kind:string>>"


def xml_text(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def documents_xml(rdf: DataFrame) -> DataFrame:
    """(code, xml): the individuals of each document as RDF/XML."""
    about = lambda c: F.concat(F.lit(NAMESPACE), xml_text(c))
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit("    <cg:"), "p", F.lit(">"), xml_text(F.col("o")), F.lit("</cg:"), "p", F.lit(">"))).when(F.col("p") == "rdf:type", F.concat(F.lit('    <rdf:type rdf:resource="'), about(F.col("o")), F.lit('"/>'))).otherwise(F.concat(F.lit("    <cg:"), "p", F.lit(' rdf:resource="'), about(F.col("o")), F.lit('"/>')))
    of_subject = rdf.select("code", "s", value.alias("line")).groupBy("code", "s").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    node = F.concat(F.lit('  <owl:NamedIndividual rdf:about="'), about(F.col("s")), F.lit('">\n'), "lines", F.lit("\n  </owl:NamedIndividual>"))
    return of_subject.select("code", "s", node.alias("node")).groupBy("code").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "node"))), lambda x: x["node"]), "\n").alias("xml"))


def header() -> str:
    declared = [f'  <owl:Class rdf:about="{NAMESPACE}{c}"/>' for c in CLASSES]
    declared += [f'  <owl:ObjectProperty rdf:about="{NAMESPACE}{p}"/>' for p in OBJECT_PROPERTIES] + [f'  <owl:SymmetricProperty rdf:about="{NAMESPACE}connected_to"/>']
    declared += [f'  <owl:DatatypeProperty rdf:about="{NAMESPACE}{p}"/>' for p in DATA_PROPERTIES]
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:cg="{NAMESPACE}">\n' + "\n".join(declared)


def file_name(started: Column, n: Column) -> Column:
    """The name of a chunk's file: patents_<time of the run>_<n>.owl."""
    return F.concat(F.lit("patents_"), F.date_format(started, "yyyyMMddHHmmss"), F.lit("_"), n.cast("string"), F.lit(".owl"))


def chunk_files(rdf: DataFrame, chunks: DataFrame) -> DataFrame:
    """(n, text): a file per chunk; at most a chunk's documents meet in one row. chunks: (code, chunk)."""
    docs = documents_xml(rdf).join(chunks, "code")
    files = docs.groupBy(F.col("chunk").alias("n")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("code", "xml"))), lambda x: x["xml"]), "\n").alias("body"))
    return files.select("n", F.concat(F.lit(header() + "\n"), "body", F.lit("\n</rdf:RDF>\n")).alias("text"))
