"""The claim pipeline over a stream of XML files (stateless, so late files need no watermark)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import claims
from ..sources import patents


def file_stream(spark: SparkSession, folder: str, glob: str = patents.FILES) -> DataFrame:
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("seen_at"), "value")


def record_stream(spark: SparkSession, folder: str, annotator: str = "rules") -> DataFrame:
    return claims.records(patents.read_patents(file_stream(spark, folder)), annotator)


def new_patents(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """Patents as they arrive, each code once within the delay."""
    files = file_stream(spark, folder)
    xml = patents.plain_xml(F.col("value"))
    fields = patents._fields(patents._sections(xml))
    coded = files.where(patents.is_patent(F.col("value")) & patents.is_closed(F.col("value"))).select("path", "seen_at", fields["code"].alias("code"), fields["name"].alias("name"))
    return coded.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["code"])


def write_records(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append records as Parquet, each batch once."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
