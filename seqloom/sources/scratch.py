"""Tables written for the time of an application, in a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a local master gets a folder of its own, and a cluster an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="seqloom-")
    return _own[context.applicationId]


def fresh(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; it goes with the application."""
    folder = f"{shared_folder(spark)}/seqloom-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return f"{folder}/{name}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as it is read back from the shared folder: made once, whoever reads it how often."""
    path = fresh(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
