"""A corpus from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns
of ``documents``; the last returns the pieces of the packed sequences. Near-duplicates are five-word shingle
sets of similarity 0.8 or more. SQL cannot express the trained, sketching and packing stages, so ORACLE_SQL
is None and the tests hold the stages against brute force.

Defined results of every stage: an empty table gives an empty one; columns may have any names and stay as they are, for each stage picks
rows of its input (the mixing stage some of them several times) and nothing of what its operator adds, and operators see all columns but their own inputs
under other names. Documents without words go
with the classifier; of rows with equal texts, repeated rows and rows without an identifier included, one stays; of near-duplicates
also; a null source is a source; null identifiers reach the packed pieces as nulls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import exact_dedup, minhash, mixing, packing, quality_classifier, token_counts
from seqloom.llm.common import column, persisted

ORACLE_SQL = None
USED = ("doc_id", "text", "source")


def among(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` picks of ``docs``; it sees columns that no operator reads under names that no operator gives."""
    names = [c if c in USED else f"column {i} of documents" for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*names)).select(*(column(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return among(docs, lambda own: quality_classifier.classified(own).where("kept"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, one with the smallest number."""
    return among(docs, exact_dedup.one_of_each)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the first as they are numbered here."""

    def first_of_each(own: DataFrame) -> DataFrame:
        rows = persisted(own.withColumn("_row", F.monotonically_increasing_id()))
        kept = minhash.near_duplicates(rows.select("_row", "text"), k=5, percent=80, key="_row").where("kept").select("_row")
        return rows.join(kept, "_row", "left_semi")

    return among(docs, first_of_each)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources come nearer to equal weights of tokens: every source once at least, small ones up to twice, the last
    pass of each cut where its budget ends."""
    import public_tokenizers

    counts = token_counts.token_counter(public_tokenizers.path("piece_bpe_32k.model"))
    return among(docs, lambda own: mixing.drawn(own, tokens=counts(F.col("text")), least_repeats=1.0, most_repeats=2.0))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each is written and read again before the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = persisted(docs)
    return docs
