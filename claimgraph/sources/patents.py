"""Patent XML as a table: one row per file, fields by XPath; a file that cannot be read keeps its row with an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import all_or_null

ROOT_TAG = "ru-patent-document"
FILES = "*.[xX][mM][lL]"


def find_files(spark: SparkSession, folder: str, glob: str = FILES) -> DataFrame:
    """(path, value) of every XML file below a folder."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def plain_xml(value: Column) -> Column:
    """Without DOCTYPE, which the XPath functions refuse, and without a byte-order mark."""
    return F.regexp_replace(F.regexp_replace(value, "^﻿", ""), r"<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "")


def is_patent(value: Column) -> Column:
    """The first element is a patent document's."""
    return F.regexp_extract(plain_xml(value), r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<([A-Za-z][\w.:-]*)", 1) == ROOT_TAG


def is_closed(value: Column) -> Column:
    """A cheap test of well-formedness: the root element is closed at the end."""
    return value.rlike(rf"(?s)</{ROOT_TAG}\s*>\s*(?:<!--.*?-->\s*)*$") & (F.size(F.split(value, f"<{ROOT_TAG}")) == 2)


def _texts(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def _first(xml: Column, path: str) -> Column:
    return F.get(_texts(xml, path), F.lit(0))


def _section(xml: Column, name: str) -> Column:
    """The elements of a name as a document of their own, so that a path is evaluated over them alone and not over the whole file."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)<{name}(?=[\s/>])(?:[^>]*/>|.*?</{name}\s*>)"), F.lit(0))
    return F.when(xml.isNotNull(), F.concat(F.lit("<r>"), F.array_join(found, ""), F.lit("</r>")))


SECTIONS = ("SDOBI", "claims", "abstract", "description")


def _sections(xml: Column) -> dict[str, Column]:
    """The root's start tag alone, and the sections that fields are read from."""
    head = F.concat(F.regexp_replace(F.regexp_extract(xml, rf"(?s)<{ROOT_TAG}(?=[\s>])[^>]*", 0), "/$", ""), F.lit("/>"))
    return {"head": F.when(xml.isNotNull(), head)} | {n: _section(xml, n) for n in SECTIONS}


def _fields(part: dict[str, Column]) -> dict[str, Column]:
    """The fields from _sections()."""
    attribute = {n: _first(part["head"], f"/{ROOT_TAG}/@{n}") for n in ("country", "doc-number", "kind", "date-publ")}
    first_ipc = F.get(F.regexp_extract_all(part["SDOBI"], F.lit(r"(?s)<B510EP(?=[\s>]).*?</B510EP\s*>"), F.lit(0)), F.lit(0))
    entries = F.regexp_extract_all(first_ipc, F.lit(r"(?s)<classification-ipcr(?=[\s>]).*?</classification-ipcr\s*>"), F.lit(0))
    # An entry is small, and its blank parts are empty text rather than no node.
    of = lambda e, n: F.trim(F.xpath_string(e, F.lit(f"/classification-ipcr/{n}")))
    codes = F.transform(entries, lambda e: F.concat(of(e, "section"), of(e, "class"), of(e, "subclass"), of(e, "main-group"), F.lit("/"), of(e, "subgroup")))
    return {
        "code": all_or_null(*attribute.values()),
        "country": attribute["country"],
        "doc_number": attribute["doc-number"],
        "kind": attribute["kind"],
        "date_publ": attribute["date-publ"],
        "name": _first(part["SDOBI"], "//ru-b542/text()"),
        "org": _first(part["SDOBI"], "//SDOBI[@lang='ru']//B731/*[1]/text()"),
        "ipc": F.coalesce(codes, F.array().cast("array<string>")),
        "main_claim": _first(part["claims"], "//claims[@lang='ru']/claim[@num='1']/*[1]/text()[1]"),
        "claims": _texts(part["claims"], "//claims[@lang='ru']/claim/*[1]/text()[1]"),
        "abstract": _texts(part["abstract"], "//abstract[@lang='ru']/*/text()[1]"),
        "description": _texts(part["description"], "//description[@lang='ru']/*/text()[1]"),
    }


def read_patents(files: DataFrame) -> DataFrame:
    """files (path, value) to (path, the fields, error).

    error is 'not a patent' for another root element, 'broken XML' for a root that is not closed once, 'no code' where an
    attribute of the code is missing, else null; the fields of rows with either of the first two are null.
    """
    xml = plain_xml(F.col("value"))
    patent, closed = F.coalesce(is_patent(F.col("value")), F.lit(False)), F.coalesce(is_closed(F.col("value")), F.lit(False))
    safe = F.when(patent & closed, xml)
    df = files.select("path", safe.alias("__xml"), F.when(~patent, "not a patent").when(~closed, "broken XML").alias("__error"))
    names = {n: f"__{n}" for n in ("head", *SECTIONS)}
    df = df.select("path", *[c.alias(names[n]) for n, c in _sections(F.col("__xml")).items()], "__error")
    df = df.select("path", *[c.alias(n) for n, c in _fields({n: F.col(c) for n, c in names.items()}).items()], "__error")
    return df.withColumn("error", F.coalesce("__error", F.when(F.col("code").isNull(), "no code"))).drop("__error")


def simple_claims(value: Column, pattern: str = r"<claim-text>(.*)</claim-text>") -> Column:
    """Everything between claim-text tags, by pattern alone."""
    return F.regexp_extract_all(value, F.lit(pattern), F.lit(1))


def is_device_claim(claim: Column, method: str = "Способ", colon: str = ":") -> Column:
    """Method claims, and claims with a colon past the first character, are left out."""
    return ~F.contains(claim, F.lit(method)) & F.instr(claim, colon).isin(0, 1)


CANDIDATE = r"(?iu)техническ[а-я]+ результа[а-я:]+"


def fact_candidates(abstract: Column, description: Column, pattern: str = CANDIDATE) -> Column:
    """The first matching paragraph of each of the two, in this order."""
    first = lambda lines: F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))
    return F.array_compact(F.array(first(abstract), first(description)))
