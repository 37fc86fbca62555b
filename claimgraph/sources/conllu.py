"""CoNLL-U text as token rows, for annotations made elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_conllu(files: DataFrame) -> DataFrame:
    """files (path, value) to (path, sent_id, pos_idx, id, text, lemma, pos, grammar, parent, deprel); ranges and empty nodes are left out."""
    sentences = files.select("path", F.posexplode(F.split(F.trim("value"), r"\r?\n\s*\r?\n")).alias("sent_id", "block"))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: x.rlike(r"^[0-9]+\t"))
    rows = sentences.select("path", "sent_id", F.posexplode(lines).alias("pos_idx", "line")).withColumn("f", F.split("line", "\t"))
    field = lambda i: F.get("f", F.lit(i))
    grammar = F.when(field(5) != "_", F.str_to_map(field(5), F.lit(r"\|"), F.lit("=")))
    return rows.select("path", "sent_id", "pos_idx", field(0).alias("id"), field(1).alias("text"), field(2).alias("lemma"), field(3).alias("pos"), grammar.alias("grammar"), field(6).alias("parent"), field(7).alias("deprel"))
