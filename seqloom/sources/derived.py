"""Letter sequences derived from text columns: q, x and z are invalid, other letters go round a, c, g, t."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FROM = string.ascii_lowercase + string.ascii_uppercase
TO = "".join("n" if c in "qxz" else "acgt"[i % 4] for i, c in enumerate(string.ascii_lowercase)) * 2


def sequences(df: DataFrame, text: str, *keys) -> DataFrame:
    """The key columns and ``seq``."""
    return df.select(*keys, F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), FROM, TO).alias("seq"))


def document_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sequences(docs, "text", F.col("doc_id").alias("read_id"), "lang")


def benchmark_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text", F.col("item_id").cast("long").alias("read_id"))
