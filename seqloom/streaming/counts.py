"""Running word counts over a stream of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.letters import MOST
from ..operators.words import partial_counts, readable


def running_counts(reads: DataFrame, k: int, cutoff: int = 1) -> DataFrame:
    """(kmer, count) of all sequences so far, for the complete or update output mode; the state is one row a word."""
    counted = partial_counts(reads, k).groupBy("kmer").agg(F.sum("n").alias("n")).where(F.col("n") >= cutoff)
    return readable(counted, k).select("kmer", F.least("n", F.lit(MOST)).cast("int").alias("count"))
