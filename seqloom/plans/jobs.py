"""Whole jobs: counting a read set, evaluating expressions, mapping words to sequences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import letters
from ..operators import histograms, profiles, tables, words


@dataclass(frozen=True)
class Counted:
    table: DataFrame
    histogram: histograms.Histogram
    profile: DataFrame | None


def prepared(reads: DataFrame, compress: bool = False, barcode: int = 0) -> DataFrame:
    """Homopolymer compression first, then the bar code is cut off."""
    seq = letters.compressed(F.col("seq")) if compress else F.col("seq")
    return reads.withColumn("seq", letters.without_barcode(seq, barcode) if barcode else seq)


def count(reads: DataFrame, k: int = 40, cutoff: int = 1, compress: bool = False, barcode: int = 0, profile: bool = False, against: DataFrame | None = None) -> Counted:
    """Table above the cutoff, histogram of all words, and profiles (of the words themselves, or ``against`` a table)."""
    reads = prepared(reads, compress, barcode)
    raw = words.raw_counts(reads, k)
    made = profiles.relative(reads, against, k) if against is not None else profiles.absolute(reads, k) if profile else None
    table = words.readable(raw.where(F.col("n") >= cutoff).select("kmer", F.least("n", F.lit(letters.MOST)).cast("int").alias("count")), k)
    return Counted(table, histograms.of_counts(raw, k), made)


def mapped(table: DataFrame, sequences: DataFrame, k: int, merge: bool = False) -> DataFrame:
    """Half-open intervals of the sequences that words of the table cover."""
    return profiles.intervals(profiles.relative(sequences, table, k), k, merge)


def summary(reads: DataFrame, k: int) -> DataFrame:
    """(reads, bases, short_reads, windows) of a read set."""
    n = F.length("seq").cast("long")
    return reads.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(n), F.lit(0)).alias("bases"), F.count_if(n < k).alias("short_reads"), F.coalesce(F.sum(F.greatest(n - (k - 1), F.lit(0))), F.lit(0)).alias("windows"))


def expressed(given: list[DataFrame], expressions: dict[str, str], low: int = 1, high: int = letters.MOST) -> dict[str, tuple[DataFrame, histograms.Histogram]]:
    """Each named expression's table and histogram."""
    return expressed_on(tables.aligned(given), len(given), expressions, low, high)


def expressed_on(wide: DataFrame, number: int, expressions: dict[str, str], low: int = 1, high: int = letters.MOST, k: int | None = None) -> dict[str, tuple[DataFrame, histograms.Histogram]]:
    """The same on aligned tables."""
    made = {name: tables.evaluated_on(wide, number, text, k) for name, text in expressions.items()}
    return {name: (t, histograms.of_counts(t.select(F.col("count").cast("long").alias("n")), 0, low, high)) for name, t in made.items()}
