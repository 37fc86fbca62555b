"""The writer of ontology files: names, lost attempts, failed jobs."""

import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimgraph.sources import owl


def test_files_have_their_names(spark, tmp_path):
    folder = str(tmp_path / "owl")
    df = spark.createDataFrame([(n, f"<é {n}>\n") for n in range(1, 8)], "n long, text string").repartition(3)
    owl.write_files(df, folder, "20240102030405")
    assert sorted(os.listdir(folder)) == [f"patents_20240102030405_{n}.owl" for n in range(1, 8)]
    assert {(r.name, r.text) for r in owl.read_names(spark, folder).collect()} == {(f"patents_20240102030405_{n}.owl", f"<é {n}>\n") for n in range(1, 8)}
    owl.write_files(df.limit(0), folder, "20250102030405")
    assert os.listdir(folder) == []


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    folder = str(tmp_path / "owl")
    owl.write_files(spark.createDataFrame([(1, "old")], "n long, text string"), folder, "20240102030405")
    text = F.when(F.col("n") == 5, F.raise_error(F.lit("lost"))).otherwise("x")
    df = spark.range(8).repartition(4).select(F.col("id").alias("n"), text.alias("text"))
    with pytest.raises(Exception, match="lost"):
        owl.write_files(df, folder, "20240102030406")
    assert os.listdir(folder) == ["patents_20240102030405_1.owl"]
    with pytest.raises(Exception, match="several files"):
        owl.write_files(spark.createDataFrame([(2, "a"), (2, "b")], "n long, text string"), folder, "20240102030407")
    assert os.listdir(folder) == ["patents_20240102030405_1.owl"]


def test_only_the_attempts_that_count_are_kept(tmp_path):
    """A task killed half way, and one that ran twice: the commit knows of one attempt each."""
    writer = owl.OwlWriter(str(tmp_path), "20240102030405", False)

    def dies():
        yield Row(n=1, text="half")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    first, again = writer.write(iter([Row(n=1, text="one")])), writer.write(iter([Row(n=2, text="two")]))
    writer.write(iter([Row(n=2, text="two, speculative")]))
    writer.commit([first, again, None])
    assert {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)} == {"patents_20240102030405_1.owl": "one", "patents_20240102030405_2.owl": "two"}


def test_columns_are_checked():
    with pytest.raises(ValueError, match="n and text"):
        owl.OwlFiles({"path": "x", "started": "y"}).writer(StructType.fromDDL("a int"), True)
