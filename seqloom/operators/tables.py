"""Count tables: access by ordinal, prefix and word; set algebra; merging; symmetry.

A table is a DataFrame (kmer STRING, count INT), one row a word. Letters sort a < c < g < t, so the order
of strings is the order of words. Ordinals are places in the files of the stored table, shifted by an index of prefixes (at most 4^6 rows
and one a file), so no window spans the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import letters
from ..functions.letters import MOST
from ..functions.ranges import address
from ..plans import expressions as E
from ..sources import artifacts
from ..sources.scratch import fresh, written
from . import superwords, words

#: Letters of the prefixes that haplotype sites are counted by.
PLACED_BY = 6
#: Ordinals below this are found as the least words of a table.
NEAR = 1 << 16


def ordered(table: DataFrame, partitions: int | None = None) -> DataFrame:
    by = ["kmer"] if partitions is None else [partitions, "kmer"]
    return table.repartitionByRange(*by).sortWithinPartitions("kmer")


def _kept(table: DataFrame) -> str:
    """Where ``table`` is stored in order for the time of the application: it is made once, and ordinals are places in files."""
    path = fresh(table.sparkSession, "x.ktab")
    artifacts.write_table(table.select("kmer", "count"), path)
    return path


def ordinals(table: DataFrame) -> DataFrame:
    """``table`` plus ``ord``, the 0-based place of each word in order."""
    return artifacts.numbered(table.sparkSession, _kept(table))


def at(table: DataFrame, where: str) -> DataFrame:
    """Rows of an address: ordinals ``5`` and ``5-9``, prefixes ``acg`` and ``ac-cg``. The first NEAR ordinals need no stored table."""
    kind, first, last = address(where)
    if kind == "ordinal" and last < NEAR:
        return table.orderBy("kmer").offset(first).limit(last - first + 1)
    if kind == "ordinal":
        return artifacts.numbered(table.sparkSession, _kept(table), first, last).drop("ord")
    found = table.where(F.col("kmer") >= first)
    return found if last is None else found.where(F.col("kmer") < last)


def lookup(table: DataFrame, sought: DataFrame) -> DataFrame:
    """(word, count) for the column ``word``; -1 where the word or its complement is not in the table."""
    asked = sought.select("word", letters.canonical(letters.lowered(F.col("word"))).alias("_kmer"))
    return asked.join(table.withColumnRenamed("kmer", "_kmer"), "_kmer", "left").select("word", F.coalesce("count", F.lit(-1)).alias("count"))


def seek(table: DataFrame, word: str) -> DataFrame:
    """The first row at or after a word's canonical form in order; the word is whole."""
    return seek_entry(table, letters.canonical_word(word))


def seek_entry(table: DataFrame, word: str) -> DataFrame:
    """The first row at or after a word, or the beginning of one, as it is written."""
    return table.where(F.col("kmer") >= word.lower()).orderBy("kmer").limit(1)


def seek_ordinal(table: DataFrame, place: int) -> DataFrame:
    """The row at a 0-based place in order."""
    return artifacts.numbered(table.sparkSession, _kept(table), place, place).drop("ord")


def disordered(table: DataFrame, place: str) -> DataFrame:
    """Rows that do not strictly follow the row before them by ``place``; none in a proper table."""
    after = table.groupBy(F.col("kmer")).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = table.join(after.where("_n > 1"), "kmer").where(F.col(place) > F.col("_first")).select(table.columns)
    pairs = table.select("kmer", place).withColumn(place, F.col(place) + 1).withColumnRenamed("kmer", "_before")
    return table.join(pairs, place).where("_before >= kmer").select(table.columns).unionByName(repeated).distinct()


def disordered_stored(placed: DataFrame, run: int = 1 << 16) -> DataFrame:
    """Rows of a stored table (file, row, kmer, count) that do not strictly follow the row stored before them, in file order.

    Rows are checked as they are read, each against the one read before it if that stands before it in its file; nothing is shuffled. Where the
    stream breaks, and every ``run`` rows, the last word of a stretch is then held against the first row of the next one of its file (one row a
    stretch), and the last one of each file against the next file's first.
    """
    by_file = placed.select(F.xxhash64("file").alias("file"), "row", "kmer", "count")  # a number is passed on sooner than a name
    wrong = by_file.mapInArrow(lambda batches: _disordered_rows(batches, run), "kmer string, count int")
    ends = placed.select("file", "row", "kmer", "count").mapInArrow(lambda batches: _stretch_ends(batches, run), f"file string, {_ENDS}")
    return _with_joints(wrong, ends)


def disordered_files(spark: SparkSession, names: list[str], run: int = 1 << 16) -> DataFrame:
    """The same of stored files in a given order, which tasks read straight into Arrow, where their store is one that pyarrow knows."""
    wrong = artifacts.over_files(spark, names, lambda batches: _disordered_rows(batches, run), "kmer string, count int", ["kmer", "count"])
    return _with_joints(wrong, artifacts.over_files(spark, names, lambda batches: _stretch_ends(batches, run), f"file long, {_ENDS}", ["kmer", "count"]))


_ENDS = "run long, kmer string, count int, last string"


def _with_joints(wrong: DataFrame, ends: DataFrame) -> DataFrame:
    ends = ends.select("file", "run", F.struct("kmer", "count").alias("first"), "last")
    joints = ends.withColumn("before", F.lag("last").over(Window.partitionBy("file").orderBy("run")))
    files = ends.groupBy("file").agg(F.min_by("first", "run").alias("first"), F.max_by("last", "run").alias("last"))  # one row a file
    between = files.withColumn("before", F.lag("last").over(Window.orderBy("file")))
    joined = joints.select("first", "before").unionByName(between.select("first", "before")).where("before >= first.kmer")
    return wrong.unionByName(joined.select("first.kmer", "first.count"))


def _linked(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(batch, words before, linked): which rows follow the row read before them in one file; ``run`` cuts stretches at its multiples."""
    last: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        both = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        row = both.column("row").to_numpy()
        file = both.column("file")
        linked = pc.equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False) & (row[1:] == row[:-1] + 1) & (row[1:] % run != 0)
        before = both.column("kmer")[:-1]
        if last is None:
            linked, before = np.concatenate(([False], linked)), pa.concat_arrays([pa.nulls(1, pa.string()), before])
        yield batch, before, linked
        last = batch.slice(batch.num_rows - 1)


def _disordered_rows(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    for batch, before, linked in _linked(batches, run):
        wrong = pc.fill_null(pc.and_(pa.array(linked), pc.greater_equal(before, batch.column("kmer"))), False)
        yield batch.select(["kmer", "count"]).filter(wrong)


def _stretch_ends(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """(file, run, kmer, count, last): where each stretch begins, its first row and its last word."""
    opened, word = None, None
    for batch, before, linked in _linked(batches, run):
        starts = pa.array(np.flatnonzero(~linked))
        firsts = batch.select(["file", "row", "kmer", "count"]).take(starts)
        if firsts.num_rows:
            begun = firsts if opened is None else pa.Table.from_batches([opened, firsts]).combine_chunks().to_batches()[0]
            lasts = before.take(starts) if opened is not None else before.take(starts)[1:]
            done = begun.slice(0, begun.num_rows - 1)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([*done.columns, lasts], names=["file", "run", "kmer", "count", "last"])
            opened = begun.slice(begun.num_rows - 1)
        word = batch.column("kmer").slice(batch.num_rows - 1)
    if opened is not None:
        yield pa.RecordBatch.from_arrays([*opened.columns, word], names=["file", "run", "kmer", "count", "last"])


def prefix_index(table: DataFrame, length: int) -> DataFrame:
    """(prefix, n, upto): words of each prefix, and of all prefixes up to it. At most 4^length rows."""
    counted = table.groupBy(F.substring("kmer", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("upto", F.sum("n").over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def largest_bucket(table: DataFrame, length: int) -> DataFrame:
    return table.groupBy(F.substring("kmer", 1, length).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("largest"))


def sliced(table: DataFrame, part: int, parts: int) -> DataFrame:
    """The part-th of ``parts`` disjoint key ranges (1-based) of about equal size."""
    if not 1 <= part <= parts:
        raise ValueError(f"part {part} of {parts}")
    return sliced_stored(table.sparkSession, _kept(table), part, parts)


def sliced_stored(spark: SparkSession, path: str, part: int, parts: int) -> DataFrame:
    """The same of a stored table; only the files of the range are read."""
    total = artifacts.words_of(spark, path)
    return artifacts.numbered(spark, path, total * (part - 1) // parts, total * part // parts - 1).drop("ord")


def aligned(tables: list[DataFrame], k: int | None = None) -> DataFrame:
    """kmer, c0, c1, ...: counts of each word in each table, 0 where absent; one shuffle for all tables, of packed words if ``k`` is given."""
    own = [words.keyed(t, k) for t in tables] if k else tables
    tagged = reduce(DataFrame.unionByName, (t.select("kmer", F.col("count").cast("long").alias("_n"), F.lit(i).alias("_t")) for i, t in enumerate(own)))
    return tagged.groupBy("kmer").agg(*(F.coalesce(F.max(F.when(F.col("_t") == i, F.col("_n"))), F.lit(0).cast("long")).alias(f"c{i}") for i in range(len(tables))))


def counted_apart(reads: DataFrame, k: int, group: str, names: list[str], spelled: bool = False) -> DataFrame:
    """:func:`aligned` for the tables of each group of sequences, without making them: one pass over the sequences, one shuffle. Packed words, or
    letters if ``spelled``, for what keeps most of them."""
    columns = [F.least(f"c{i}", F.lit(MOST).cast("long")).alias(f"c{i}") for i in range(len(names))]
    return superwords.aligned(reads, k, group, names, spelled=spelled).select("kmer", *columns)


def evaluated(tables: list[DataFrame], expressions: dict[str, str], k: int | None = None) -> dict[str, DataFrame]:
    """Each named expression as a table. All share one alignment, which callers may cache through :func:`aligned`."""
    wide = aligned(tables, k)
    return {name: evaluated_on(wide, len(tables), text, k) for name, text in expressions.items()}


def evaluated_on(wide: DataFrame, tables: int, text: str, k: int | None = None) -> DataFrame:
    """An expression on aligned tables; their words are letters, or packed ones of ``k`` letters, which become letters last."""
    tree = E.parsed(text)
    if max(E.tables_of(tree)) >= tables:
        raise ValueError("the expression names a table that is not given")
    counts = [F.col(f"c{i}") for i in range(tables)]
    packed = not isinstance(wide.schema["kmer"].dataType, StringType)
    if packed and not k:
        raise ValueError("packed words need their length")
    share = words.gc_percent(F.col("kmer"), k) if packed else letters.gc_percent(F.col("kmer"))
    result = wide.where(E.presence(tree, counts)).select("kmer", E.value(tree, counts, share).alias("_v")).where("_v > 0")
    found = result.select("kmer", F.least("_v", F.lit(MOST)).cast("int").alias("count"))
    return words.readable(found, k) if packed else found


def merged_raw(tables: list[DataFrame]) -> DataFrame:
    """kmer, n: unclipped sums of counts over tables."""
    return reduce(DataFrame.unionByName, tables).groupBy("kmer").agg(F.sum(F.col("count").cast("long")).alias("n"))


def merged(tables: list[DataFrame]) -> DataFrame:
    return merged_raw(tables).select("kmer", F.least("n", F.lit(MOST)).cast("int").alias("count"))


def merged_on(wide: DataFrame, tables: int) -> DataFrame:
    """kmer, n of aligned tables."""
    return wide.select("kmer", reduce(Column.__add__, (F.col(f"c{i}") for i in range(tables))).alias("n"))


def concatenated(slices: list[DataFrame]) -> DataFrame:
    """Tables over disjoint key ranges as one; nothing is shuffled."""
    return reduce(DataFrame.unionByName, slices)


def symmetric(table: DataFrame) -> DataFrame:
    """Every word and its reverse complement, palindromes once."""
    turned = table.select(letters.reverse_complement(F.col("kmer")).alias("kmer"), "count")
    return table.unionByName(turned.where(~letters.is_palindrome(F.col("kmer"))))


def venn(tables: list[DataFrame], low: int = 1, high: int = 100, k: int | None = None) -> DataFrame:
    return venn_on(aligned(tables, k), len(tables), low, high)


def venn_on(wide: DataFrame, tables: int, low: int = 1, high: int = 100) -> DataFrame:
    """(mask, freq, n): for each set of tables a word is in, the histogram of its smallest count there."""
    counts = [F.col(f"c{i}") for i in range(tables)]
    mask = reduce(Column.__add__, (F.when(c > 0, 1 << i).otherwise(0) for i, c in enumerate(counts)))
    present = F.array_min(F.filter(F.array(*counts), lambda c: c > 0))
    freq = F.least(F.greatest(present, F.lit(low)), F.lit(high)).cast("int")
    return wide.groupBy(mask.cast("int").alias("mask"), freq.alias("freq")).agg(F.count(F.lit(1)).alias("n"))


def haplotype_sites(table: DataFrame, k: int, low: int = 1, high: int = MOST) -> DataFrame:
    """:func:`haplotypes` plus ``site``, the 0-based number of each group in the order of left and right parts."""
    return _numbered_sites(_haplotypes(table, k, low, high), k)


def haplotypes(table: DataFrame, k: int, low: int = 1, high: int = MOST) -> DataFrame:
    """(left, centre, right, count): words in range that differ from another one in the middle letter alone."""
    return _sites(_haplotypes(table, k, low, high), k)


def haplotype_sites_of(reads: DataFrame, k: int, low: int = 1, high: int = MOST) -> DataFrame:
    """:func:`haplotype_sites` of the words of sequences, whose table is not made: words that differ in the middle meet where they are counted."""
    return _numbered_sites(_haplotypes_of(reads, k, low, high), k)


def haplotypes_of(reads: DataFrame, k: int, low: int = 1, high: int = MOST) -> DataFrame:
    """:func:`haplotypes` in the same way."""
    return _sites(_haplotypes_of(reads, k, low, high), k)


def _numbered_sites(groups: DataFrame, k: int) -> DataFrame:
    """Groups are numbered inside short prefixes and shifted by the groups of the prefixes before (at most 4^PLACED_BY rows). They are written
    once to the shared folder, few as they are, so the table is made once.
    """
    found = written(groups)
    found = found.withColumn("left", F.substring("_letters", 1, k // 2)).withColumn("right", F.substring("_letters", k // 2 + 2, k)).withColumn("_prefix", F.substring("_letters", 1, PLACED_BY))
    counts = found.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    shifts = F.broadcast(counts.select("_prefix", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    inside = F.row_number().over(Window.partitionBy("_prefix").orderBy("left", "right"))
    sites = found.withColumn("_inside", inside).join(shifts, "_prefix").select((F.col("_shift") + F.col("_inside") - 1).cast("long").alias("site"), "left", "right", F.explode("_g").alias("_x"))
    return sites.select("site", "left", _centre().alias("centre"), "right", F.col("_x.count").alias("count"))


def _sites(groups: DataFrame, k: int) -> DataFrame:
    half = k // 2
    found = groups.select("_letters", F.explode("_g").alias("_x"))
    return found.select(F.substring("_letters", 1, half).alias("left"), _centre().alias("centre"), F.substring("_letters", half + 2, k).alias("right"), F.col("_x.count").alias("count"))


def _centre() -> Column:
    return F.element_at(F.array(*map(F.lit, "ACGT")), F.col("_x.centre") + 1)


def _haplotypes_of(reads: DataFrame, k: int, low: int, high: int) -> DataFrame:
    return words.readable(superwords.paired(reads, k, low, high), k).withColumnRenamed("kmer", "_letters")


def _haplotypes(table: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(_letters, _g): groups of two or more words as the letters of one with its centre masked, and (centre, count) of each.

    Packed words are grouped on their LONGs without the two bits of the centre; only what is found becomes letters.
    """
    own = words.keyed(table.where(F.col("count").between(low, high)), k)
    limb, shift = words.centre_of(k)
    part = F.col("kmer") if k <= words.PACKED_UP_TO else F.col(f"kmer.w{limb}")
    centre, masked = F.shiftright(part, shift).bitwiseAND(3).cast("int"), part.bitwiseAND(F.lit(~(3 << shift)).cast("long"))
    kept = masked if k <= words.PACKED_UP_TO else F.struct(*(masked.alias(f"w{i}") if i == limb else F.col(f"kmer.w{i}").alias(f"w{i}") for i in range(len(words.limbs(k)))))
    groups = own.select(kept.alias("kmer"), F.struct(centre.alias("centre"), "count").alias("_x")).groupBy("kmer").agg(F.collect_list("_x").alias("_g"))  # at most four letters
    return words.readable(groups.where(F.size("_g") > 1), k).withColumnRenamed("kmer", "_letters")


def lines(table: DataFrame) -> DataFrame:
    """Text lines of a table in tab-separated form."""
    return table.select("kmer", F.concat_ws("\t", "kmer", "count").alias("line"))


def tagged_lines(table: DataFrame, k: int) -> DataFrame:
    """Rows of the one-letter tagged text form: k, the prefix letter, words and counts."""
    return table.select("kmer", F.concat(F.lit(f"S {k} "), F.col("kmer"), F.lit("\nC "), F.col("count")).alias("line"))


def tagged_buckets_of(reads: DataFrame, k: int, prefix: int) -> tuple[DataFrame, Callable[[], list[str]]]:
    """:func:`tagged_buckets` of the words of sequences, in order, without the first line; that is known once the others are written."""
    facts = Observation()
    made = superwords.tagged_buckets(reads, k, prefix).observe(facts, F.min("least").alias("least"), F.min("kmer").alias("kmer"))

    def first() -> list[str]:
        found = facts.get
        return [] if found["kmer"] is None else [f"K {k} {prefix} {found['least']} {found['kmer'] >> 2 * (k - prefix)}"]

    return made.select("line"), first


def tagged_buckets(table: DataFrame, k: int, prefix: int) -> DataFrame:
    """(ord, line): the tagged form by prefix: k, prefix length, least count and first prefix; then the suffixes and counts of each prefix.

    A bucket has the words of one prefix, so the prefix bounds its size.
    """
    split = table.select(F.substring("kmer", 1, prefix).alias("prefix"), F.struct(F.substring("kmer", prefix + 1, k).alias("suffix"), F.col("count").cast("string").alias("count")).alias("x"))
    buckets = split.groupBy("prefix").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.concat(
        F.concat_ws(" ", F.lit("S"), F.size("xs") * (k - prefix), F.array_join(F.transform("xs", lambda x: x["suffix"]), "")), F.lit("\n"),
        F.concat_ws(" ", F.lit("C"), F.size("xs"), F.array_join(F.transform("xs", lambda x: x["count"]), " ")),
    )
    place = F.conv(F.translate(F.min("prefix"), "acgt", "0123"), 4, 10)
    head = split.agg(F.count(F.lit(1)).alias("n"), F.concat_ws(" ", F.lit("K"), F.lit(k), F.lit(prefix), F.min(F.col("x.count").cast("int")), place).alias("line")).where("n > 0")
    return head.select(F.lit("").alias("ord"), "line").unionByName(buckets.select(F.col("prefix").alias("ord"), body.alias("line")))
