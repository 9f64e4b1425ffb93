"""Sequences in overlapping fragments, so that no record is ever one string.

Fragment b of a record has its letters from b * size on, size + overlap of them at most; with an overlap of k - 1 every window of k letters
begins in the first ``size`` letters of exactly one fragment. Lines of letters are read split by split; one row for each
split tells how the record that runs over its edge goes on: the letters it has so far, and the last of them where runs shrink to one letter.
Records without letters have no fragment. Letters before the first head of a file belong to no record and are left out; letters
outside ASCII become n. Only single lines must be below 2 GB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import letters
from .files import kind_of, read_sequences

SIZE = 1 << 20  #: letters that begin in a fragment
SENT = 16 << 20  #: letters that a task holds before it sends them
_SPACE, _OTHER = b" \t\n\x0b\f\r", re.compile(r"[^\x00-\x7F]")
_SPLIT = ("path", "file", "start")


def read_fragments(spark: SparkSession, paths: str | list[str], overlap: int, size: int = SIZE, compress: bool = False, barcode: int = 0) -> DataFrame:
    """(read_id, offset, seq) of files of one kind; offsets are those after compression and without the bar code."""
    if overlap < 0 or size < 1 or barcode < 0:
        raise ValueError("fragments have at least one letter, and overlap and bar code none or more")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if {kind_of(path) for path in paths} == {"fasta"}:
        return fragments(_pieces(spark, paths, compress), overlap, size, barcode)
    reads = read_sequences(spark, paths)
    seq = letters.compressed(F.col("seq")) if compress else F.col("seq")
    return fragments(reads.select("read_id", F.lit(0).cast("long").alias("at"), F.regexp_replace(seq, r"[^\x00-\x7F]", "n").alias("seq")), overlap, size, barcode)


def fragments(pieces: DataFrame, overlap: int, size: int = SIZE, barcode: int = 0) -> DataFrame:
    """The same from (read_id, at, seq): pieces of records with their places, gapless and apart, in any order. One shuffle of the letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = ([], [], [], []), 0
        for batch in batches:
            for read, at, seq in zip(*(batch.column(c) for c in ("read_id", "at", "seq")), strict=True):
                read, at, seq = read.as_py(), at.as_py() - barcode, seq.as_py()
                if at < 0:
                    at, seq = 0, seq[-at:]
                end = at + len(seq)
                for block in range(max(at - overlap, 0) // size, -(-end // size) if seq else 0):
                    low, high = max(block * size, at), min(block * size + size + overlap, end)
                    for column, value in zip(rows, (read, block, low, seq[low - at : high - at]), strict=True):
                        column.append(value)
                    held += high - low
                    if held > SENT:
                        yield _parts(rows)
                        rows, held = ([], [], [], []), 0
        yield _parts(rows)

    parts = pieces.where("seq IS NOT NULL").select("read_id", "at", "seq").mapInArrow(run, "read_id long, block long, low long, part string")
    joined = parts.groupBy("read_id", "block").agg(F.sort_array(F.collect_list(F.struct("low", "part"))).alias("parts"))  # size + overlap letters at most
    return joined.select("read_id", (F.col("block") * size).alias("offset"), F.array_join("parts.part", "").alias("seq"))


def _parts(rows: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(rows, kinds, strict=True)], names=["read_id", "block", "low", "part"])


def _stretches(compress: bool):
    """Rows of lines, a split in order, to (split, record, at, seq): records are counted inside the split, 0 goes on from the split before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, record, at, last = None, 0, 0, b""
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value = batch.column("value").cast(pa.large_string())
            places = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + n + 1]
            data = memoryview(value.buffers()[2] or b"")
            heads, turns = pc.starts_with(value, ">").to_numpy(zero_copy_only=False), np.zeros(n, bool)
            for name in _SPLIT:
                column = batch.column(name)
                turns[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            turns[0] = tuple(batch.column(name)[0].as_py() for name in _SPLIT) != now
            now = tuple(batch.column(name)[n - 1].as_py() for name in _SPLIT)
            starts = np.union1d(np.flatnonzero(heads | turns), [0]).tolist()
            rows = []
            for i, j in zip(starts, [*starts[1:], n], strict=True):
                if turns[i]:
                    record, at, last = 0, 0, b""
                if heads[i]:
                    record, at, last = record + 1, 0, b""
                seq = bytes(data[places[i + int(heads[i])] : places[j]]).translate(None, _SPACE)
                if not seq.isascii():
                    seq = _OTHER.sub("n", seq.decode()).encode()
                if compress and seq:
                    codes = np.frombuffer(last + seq, np.uint8)
                    seq = codes[np.append(not last, codes[1:] != codes[:-1])].tobytes()
                if seq or heads[i]:
                    rows.append((i, record, at, seq.decode()))
                at, last = at + len(seq), seq[-1:] or last
            if rows:
                where, *found = zip(*rows, strict=True)
                split = [batch.column(name).take(pa.array(where)) for name in _SPLIT]
                made = [pa.array(values, kind) for values, kind in zip(found, (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*split, *made], names=[*_SPLIT, "record", "at", "seq"])

    return run


def _pieces(spark: SparkSession, paths: list[str], compress: bool) -> DataFrame:
    """(read_id, at, seq) of FASTA files: identifiers as whole records have them."""
    read = spark.read.option("lineSep", "\n").text
    where = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    lines = reduce(DataFrame.unionAll, (read(path).select(F.lit(i).alias("path"), *where, "value") for i, path in enumerate(paths)))
    found = lines.mapInArrow(_stretches(compress), "path int, file string, start long, record long, at long, seq string")
    return found.join(_edges(found, compress), list(_SPLIT)).where(F.col("heads_in_file") + F.col("record") > 0).select(
        (F.col("heads_before") + F.col("record") - 1).alias("read_id"),
        (F.col("at") + F.when(F.col("record") > 0, 0).when(F.col("at") > 0, F.col("carry") - F.col("cut")).otherwise(F.col("carry"))).alias("at"),
        F.when((F.col("record") == 0) & (F.col("at") == 0) & (F.col("cut") == 1), F.expr("substring(seq, 2)")).otherwise(F.col("seq")).alias("seq"),
    )


def _edges(found: DataFrame, compress: bool) -> DataFrame:
    """One row a split: heads before it (in all files, and in its own), letters its first record has before it, and 1 in ``cut`` where its
    first letter goes on with the run before."""
    end = F.struct("record", (F.col("at") + F.length("seq")).alias("end"), F.expr("right(seq, 1)").alias("last"))
    first = F.when(F.col("record") == 0, F.struct("at", F.expr("left(seq, 1)").alias("first")))
    splits = found.groupBy(*_SPLIT).agg(F.max(end).alias("end"), F.min(first)["first"].alias("first"))
    splits = splits.select(*_SPLIT, F.col("end.record").alias("heads"), F.col("end.end").alias("tail"), F.col("end.last").alias("last"), "first")
    in_file = Window.partitionBy("path", "file").orderBy("start")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.col("first") == F.lag("last").over(in_file), 1).otherwise(0) if compress else F.lit(0)
    splits = splits.withColumn("cut", cut).withColumn("tail", F.col("tail") - F.when(F.col("heads") == 0, F.col("cut")).otherwise(0))
    splits = splits.withColumn("run", F.count_if(F.col("heads") > 0).over(in_file.rowsBetween(Window.unboundedPreceding, 0)))
    splits = splits.withColumn("sum", F.sum("tail").over(Window.partitionBy("path", "file", "run").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    return splits.select(
        *_SPLIT, "cut", F.coalesce(F.lag("sum").over(in_file), F.lit(0)).alias("carry"),
        *(F.coalesce(F.sum("heads").over(rows), F.lit(0)).alias(name) for rows, name in zip(before, ("heads_in_file", "heads_before"), strict=True)),
    )
