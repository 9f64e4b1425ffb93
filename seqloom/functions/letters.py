"""Columns over DNA letters, all built from Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest count a table or profile holds.
MOST = 32767


def lowered(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "acgt")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "acgtACGT", "tgcaTGCA"))


def canonical(word: Column) -> Column:
    """The smaller of a word and its reverse complement."""
    return F.least(word, reverse_complement(word))


def canonical_word(word: str) -> str:
    """The same for a word at hand, in lower case."""
    word = word.lower()
    return min(word, word[::-1].translate(str.maketrans("acgt", "tgca")))


def is_palindrome(word: Column) -> Column:
    return word == reverse_complement(word)


def is_valid(word: Column) -> Column:
    return ~word.rlike("[^acgtACGT]")


def compressed(seq: Column) -> Column:
    """Runs of one and the same character shrink to one; ``aA`` is no run."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def without_barcode(seq: Column, length: int) -> Column:
    return F.substring(seq, length + 1, 1 << 30)


def gc_percent(word: Column) -> Column:
    """Whole per cent of letters g and c."""
    return F.floor(100 * F.length(F.regexp_replace(word, "[^gcGC]", "")) / F.length(word)).cast("int")


def packed(word: Column) -> Column:
    """Two bits a letter, first letter highest, as LONG; for words of at most 31 letters."""
    return F.conv(F.translate(word, "acgtACGT", "01230123"), 4, 10).cast("long")


def unpacked(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "acgt")


def modulated(x: Column, y: Column, mode: str | None) -> Column:
    """Combine two present counts: mean, sum, floored difference, smaller, larger, left; no mode gives 1."""
    return {
        "*": F.floor((x + y) / 2).cast("long"),
        "+": x + y,
        "-": F.greatest(x - y, F.lit(0).cast("long")),
        "<": F.least(x, y),
        ">": F.greatest(x, y),
        ".": F.when(x == 0, y).otherwise(x),
        None: F.lit(1).cast("long"),
    }[mode]


def minimizer(word: Column, length: int) -> Column:
    """The smallest canonical subword of a length."""
    starts = F.sequence(F.lit(1), F.length(word) - length + 1)
    return F.array_min(F.transform(starts, lambda i: canonical(F.substring(word, i, length))))
