"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, in local mode alone, a temporary one: a machine's own folder is of no
    use to the others of a cluster, so there it is an error."""
    conf = spark.sparkContext.getConf()
    top = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master", "") != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="claimgraph-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/claimgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
