"""Stored artifacts: Parquet tables of this package, and the native binary histogram, table and profile files.

Binary layouts (fixed values, native byte order). Histogram: int k, low, high; long instances of the lowest
and highest bin; long for each bin. Table stub: int k, parts, minval, prefix bytes; long cumulative counts for each
prefix; part: int k, long n, n times suffix bytes and a 16-bit count. Profile stub: int k, parts; index part: int k, long
first, n, and n end offsets; data part: the profiles' bytes.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.codec import decode_all
from ..operators import profiles
from ..operators.histograms import Histogram
from .scratch import written

KINDS = ("hist", "ktab", "prof")
_TWO_BIT = np.frombuffer(b"acgt", np.uint8)


#: Letters of the prefixes in a stored table's index.
INDEXED_BY = 6


#: Sorted words share their beginnings, and Parquet's second version stores what differs.
STORED = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}


def write_table(table: DataFrame, path: str, in_order: bool = False) -> None:
    """Sorted ranges of words, so that prefix addresses prune by file and row-group statistics, and an index of them. A table whose partitions are
    such ranges already (``in_order``) is written as it is; any other one is sorted by Spark, which makes it twice.

    The index, in a folder that Spark's readers skip, has a row for each prefix in each file: its first row there, its words (number,
    first and last), and how many words of the table come before. It has at most 4^INDEXED_BY rows and one more for each file.
    """
    spark = table.sparkSession
    own = table if in_order else table.repartitionByRange("kmer").sortWithinPartitions("kmer")
    own.write.mode("overwrite").options(**STORED).parquet(path)
    names, schema = stored_files(spark, path), "file string, prefix string, row long, n long, first string, last string"
    if all(map(known, names)):
        short = [os.path.basename(name) for name in names]
        runs = over_files(spark, names, lambda own: _prefix_runs(x.set_column(0, "file", pa.array([short[x.column("file")[0].as_py()]] * x.num_rows)) for x in own), schema, ["kmer"])
    else:
        runs = placed_rows(spark, path).select("file", "row", "kmer").mapInArrow(_prefix_runs, schema)
    found = runs.groupBy("file", "prefix").agg(F.min("row").alias("row"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    before = Window.orderBy("file", "row").rowsBetween(Window.unboundedPreceding, -1)
    found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{path}/_index")


def _prefix_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix in each batch of sorted words."""
    for batch in batches:
        if batch.num_rows:
            file, row, kmer = (batch.column(c) for c in ("file", "row", "kmer"))
            prefix = pc.utf8_slice_codeunits(kmer, 0, INDEXED_BY)
            new = pc.or_(pc.not_equal(prefix[1:], prefix[:-1]), pc.not_equal(file[1:], file[:-1])).to_numpy(zero_copy_only=False)
            first = np.concatenate(([0], np.flatnonzero(new) + 1))
            n = np.diff(np.append(first, batch.num_rows))
            at, last = pa.array(first), pa.array(first + n - 1)
            yield pa.RecordBatch.from_arrays([file.take(at), prefix.take(at), row.take(at), pa.array(n), kmer.take(at), kmer.take(last)], names=["file", "prefix", "row", "n", "first", "last"])


def stored_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a stored table in the order of their names."""
    return sorted(unquote(name) for name in spark.read.parquet(path).inputFiles())


def known(path: str) -> bool:
    """Whether a path is in a store that pyarrow knows."""
    try:
        located(path)
    except (pa.ArrowException, ImportError, OSError):
        return False
    return True


def over_files(spark: SparkSession, names: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, columns: list[str]) -> DataFrame:
    """What ``run`` makes of the rows of each file: batches of (file, row, *columns), the place of the file in ``names`` and of the row in the file.
    One task reads a file, in order, straight into Arrow."""

    def batches(at: int) -> Iterator[pa.RecordBatch]:
        with opened(names[at]) as file:
            row = 0
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1 << 16, columns=columns):
                if batch.num_rows:
                    own = [pa.array(np.full(batch.num_rows, at)), pa.array(np.arange(row, row + batch.num_rows))]
                    yield pa.RecordBatch.from_arrays([*own, *(batch.column(c) for c in columns)], names=["file", "row", *columns])
                    row += batch.num_rows

    def each(ids: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in (i for batch in ids for i in batch.column("id").to_pylist()):
            yield from run(batches(at))

    return spark.range(0, len(names), 1, max(len(names), 1)).mapInArrow(each, schema)


def read_table(spark: SparkSession, path: str, cutoff: int = 1) -> DataFrame:
    """(kmer, count) of a stored table, words counted ``cutoff`` times or more; the cut-off reaches the scan."""
    return spark.read.parquet(path).where(F.col("count") >= cutoff)


def placed_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, kmer, count) of a stored table: where each row stands, files in the order of their names."""
    return spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "kmer", "count")


def table_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/_index")


def numbered(spark: SparkSession, path: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(kmer, count, ord) of a stored table's rows at ordinals first to last; only the files that hold them are read, and nothing is sorted."""
    wanted = table_index(spark, path).where((F.col("before") + F.col("n") > first) & (F.lit(last is None) | (F.col("before") <= (last or 0))))
    bases = {r["file"]: r["base"] for r in wanted.groupBy("file").agg(F.min(F.col("before") - F.col("row")).alias("base")).collect()}  # one row a file
    if not bases:
        return spark.read.parquet(path).select("kmer", "count", F.lit(0).cast("long").alias("ord")).where("false")
    rows = spark.read.parquet(*(f"{path}/{name}" for name in sorted(bases))).select("kmer", "count", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    shifts = F.broadcast(spark.createDataFrame(sorted(bases.items()), "_file string, _base long"))  # one row a file
    made = rows.join(shifts, "_file").select("kmer", "count", (F.col("_base") + F.col("_row")).alias("ord"))
    return made.where((F.col("ord") >= first) & (F.lit(last is None) | (F.col("ord") <= (last or 0))))


def words_of(spark: SparkSession, path: str) -> int:
    return table_index(spark, path).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def seek_stored(spark: SparkSession, path: str, word: str) -> DataFrame:
    """The first row of a stored table at or after a word as it is written; one file is read."""
    at = table_index(spark, path).where(F.col("last") >= word.lower()).orderBy("before").select("file").first()
    rows = spark.read.parquet(f"{path}/{at['file']}" if at else path)
    return rows.where(F.col("kmer") >= word.lower()).orderBy("kmer").limit(1)


class _Rows:
    """The rows of a stored table inside a range of words, as a stream of sorted batches."""

    def __init__(self, files: list[str], low: str, high: str | None):
        self.batches, self.now = self.read(files, low, high), None
        self.more()

    @staticmethod
    def read(files: list[str], low: str, high: str | None) -> Iterator[tuple[pa.Array, pa.Array]]:
        for name in files:
            with opened(name) as file:
                stored = pq.ParquetFile(file)
                at = stored.schema_arrow.get_field_index("kmer")
                groups = [stored.metadata.row_group(i).column(at).statistics for i in range(stored.num_row_groups)]
                some = [i for i, x in enumerate(groups) if x is None or not x.has_min_max or (x.max >= low and (high is None or x.min < high))]
                for batch in stored.iter_batches(row_groups=some, columns=["kmer", "count"]):
                    kept = pc.greater_equal(batch.column("kmer"), low)
                    batch = batch.filter(kept if high is None else pc.and_(kept, pc.less(batch.column("kmer"), high)))
                    if batch.num_rows:
                        yield batch.column("kmer"), batch.column("count").cast(pa.int64())

    def more(self) -> None:
        self.now = next(self.batches, None)

    @property
    def last(self) -> str:
        return self.now[0][-1].as_py()

    def upto(self, limit: str) -> tuple[pa.Array, pa.Array]:
        words, counts = self.now
        n = pc.sum(pc.less_equal(words, limit)).as_py()
        taken, self.now = (words[:n], counts[:n]), (words[n:], counts[n:])
        if n == len(words):
            self.more()
        return taken


def aligned_stored(spark: SparkSession, paths: list[str], rows: int = 1 << 20) -> DataFrame:
    """kmer, c0, c1, ...: :func:`..operators.tables.aligned` for stored tables, in order and without a shuffle.

    The index of the largest table gives the splitters of ranges of about ``rows`` of its words; one task merges one range of all tables as
    sorted streams, and holds a batch of each.
    """
    indexes = [[tuple(r) for r in table_index(spark, p).orderBy("before").select("file", "prefix", "n", "first", "last", "before").collect()] for p in paths]  # bounded, see write_table
    pivot = max(indexes, key=lambda index: sum(r[2] for r in index))
    cuts, held = [""], 0
    for _, prefix, n, *_ in pivot:
        if held >= rows and prefix > cuts[-1]:
            cuts, held = [*cuts, prefix], 0
        held += n
    ranges = list(zip(cuts, [*cuts[1:], None], strict=True))
    files = [[list(dict.fromkeys(f"{path}/{r[0]}" for r in index if r[4] >= low and (high is None or r[3] < high))) for path, index in zip(paths, indexes, strict=True)] for low, high in ranges]
    names = [f"c{i}" for i in range(len(paths))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in (i for batch in batches for i in batch.column("id").to_pylist()):
            streams = [_Rows(own, *ranges[at]) for own in files[at]]
            while alive := [i for i, x in enumerate(streams) if x.now is not None]:
                limit = min(streams[i].last for i in alive)
                parts = []
                for i in alive:
                    words, counts = streams[i].upto(limit)
                    parts.append(pa.table([words, *(counts if j == i else pa.array(np.zeros(len(words), np.int64)) for j in range(len(streams)))], names=["kmer", *names]))
                made = pa.concat_tables(parts).group_by("kmer", use_threads=False).aggregate([(c, "sum") for c in names]).sort_by("kmer")
                yield from made.select(["kmer", *(f"{c}_sum" for c in names)]).rename_columns(["kmer", *names]).combine_chunks().to_batches()

    return spark.range(0, len(ranges), 1, len(ranges)).mapInArrow(run, "kmer string, " + ", ".join(f"{c} long" for c in names))


def write_profiles(profile: DataFrame, path: str, pieces: bool = False) -> None:
    """(read_id, first, code) of a profile's ``pieces``, fragments or rows, in ranges of reads, so that a read is found by file and row-group statistics. A long
    profile is several rows; sequences without a window have none. Byte forms are written once before they are sorted, so the profile is made once."""
    made = profile if pieces else profiles.pieces(profile if "counts" in profile.columns else profiles.fragments_of(profile))
    coded = written(made.select("read_id", "first", codec.encoded(F.col("counts")).alias("code")))
    coded.repartitionByRange("read_id", "first").sortWithinPartitions("read_id", "first").write.mode("overwrite").parquet(path)


def read_profiles(spark: SparkSession, path: str, wanted: list[tuple[int, int]] | None = None) -> DataFrame:
    """(read_id, pos, count) of stored profiles; ``wanted`` are inclusive ranges of 0-based reads, which reach the scan."""
    stored = spark.read.parquet(path)
    if wanted is not None:
        stored = stored.where(reduce(Column.__or__, (F.col("read_id").between(a, b) for a, b in wanted), F.lit(False)))
    return profiles.from_compact(stored)


def _one_file(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def read_histogram_file(spark: SparkSession, path: str) -> Histogram:
    raw = _one_file(spark, path)
    k, low, high, i_low, i_high = struct.unpack_from("=iiiqq", raw)
    bins = np.frombuffer(raw, np.int64, high - low + 1, 28)
    rows = [(low + int(i), int(bins[i])) for i in np.flatnonzero(bins)]
    return Histogram(k, low, high, spark.createDataFrame(rows, "freq int, n long"), spark.createDataFrame([(i_low, i_high)], "i_low long, i_high long"))


def histogram_bytes(h: Histogram) -> bytes:
    """At most 32767 bins, so the driver may hold them."""
    own = h.as_words()
    ends = own.ends.first()
    bins = np.zeros(h.high - h.low + 1, np.int64)
    for row in own.bins.collect():
        bins[row["freq"] - h.low] = row["n"]
    return struct.pack("=iiiqq", h.k, h.low, h.high, ends["i_low"], ends["i_high"]) + bins.tobytes()


def write_histogram_file(h: Histogram, path: str) -> None:
    spark = h.bins.sparkSession
    hadoop, store = _filesystem(spark, path)
    out = store.create(hadoop.Path(path), True)
    out.write(bytearray(histogram_bytes(h)))
    out.close()


def unpacked_word(code: bytes, k: int) -> str:
    return "".join("acgt"[b >> s & 3] for b in code for s in (6, 4, 2, 0))[:k]


def packed_word(word: str) -> bytes:
    """Two bits a letter, first letter in the high bits, padded with zeros."""
    codes = ["acgt".index(c) for c in word.lower()] + [0] * (-len(word) % 4)
    return bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, len(codes), 4))


def located(path: str):
    """The store, of those that pyarrow knows, and the place in it."""
    path = re.sub(r"^file:/(?=[^/])", "file:///", path)
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def opened(path: str):
    """A file of any such store; Spark's own reader skips names with a leading dot."""
    store, inside = located(path)
    return store.open_input_file(inside)


def read_table_files(spark: SparkSession, stub: str, cutoff: int = 1) -> DataFrame:
    """(kmer, count) of a binary table, words counted ``cutoff`` times or more; every part file is one task."""
    with opened(stub) as file:
        raw = file.read()
    k, parts, _, width = struct.unpack_from("=iiii", raw)
    folder, name = os.path.split(stub)
    root = name.removesuffix(".ktab")
    suffix = (k + 3) // 4 - width
    files, first = [], 0
    for part in range(1, parts + 1):
        with opened(path := f"{folder}/.{root}.ktab.{part}") as file:
            n = struct.unpack("=iq", file.read(12))[1]
        files.append((path, first, n))
        first += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n")), strict=True):
                with opened(stub) as file:
                    index = np.frombuffer(file.read()[16:], np.int64)
                with opened(path) as file:
                    file.seek(12)
                    for start in range(first, first + n, 1 << 18):
                        some = min(1 << 18, first + n - start)
                        rows = np.frombuffer(file.read(some * (suffix + 2)), np.uint8).reshape(some, suffix + 2)
                        counts = np.ascontiguousarray(rows[:, suffix:]).view(np.uint16).ravel().astype(np.int32)
                        prefixes = np.searchsorted(index, np.arange(start, start + some), side="right").astype(">u4").view(np.uint8).reshape(some, 4)[:, 4 - width :]
                        kept = counts >= cutoff
                        yield pa.RecordBatch.from_arrays([unpacked_words(np.concatenate([prefixes, rows[:, :suffix]], axis=1)[kept], k), pa.array(counts[kept])], names=["kmer", "count"])

    return spark.createDataFrame(files, "path string, first long, n long").repartition(max(len(files), 1)).mapInArrow(run, "kmer string, count int")


def unpacked_words(codes: np.ndarray, k: int) -> pa.Array:
    """Rows of packed bytes as words of k letters."""
    letters = np.ascontiguousarray(_TWO_BIT[(codes[:, :, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].reshape(len(codes), 4 * codes.shape[1])[:, :k])
    return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(np.arange(0, len(codes) * k + 1, k, dtype=np.int32)), pa.py_buffer(letters.tobytes())])


def table_file_facts(stub: str) -> dict[str, int]:
    """k, parts, minval (what the table was cut off at) and words of a binary table."""
    with opened(stub) as file:
        raw = file.read()
    k, parts, minval, _ = struct.unpack_from("=iiii", raw)
    return {"k": k, "parts": parts, "minval": minval, "words": int(np.frombuffer(raw, np.int64, -1, 16)[-1])}


def read_profile_files(spark: SparkSession, stub: str, wanted: list[tuple[int, int]] | None = None) -> DataFrame:
    """(read_id, counts) of binary profiles, or of inclusive ranges of 0-based reads; every part is one task."""
    folder, name = os.path.split(stub)
    root = name.removesuffix(".prof")
    with opened(stub) as file:
        _, parts = struct.unpack("=ii", file.read(8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column("part").to_pylist():
                with opened(f"{folder}/.{root}.pidx.{part}") as index:
                    _, first, n = struct.unpack("=iqq", index.read(20))
                    ends = np.concatenate(([0], np.frombuffer(index.read(8 * n), np.int64)))
                ids = np.arange(first, first + n)
                kept = np.ones(n, bool) if wanted is None else np.any([(ids >= a) & (ids <= b) for a, b in wanted] or [np.zeros(n, bool)], axis=0)
                with opened(f"{folder}/.{root}.prof.{part}") as data:
                    for some in np.array_split(np.flatnonzero(kept), max(1, n // 1000)):
                        codes = []
                        for i in some.tolist():
                            data.seek(int(ends[i]))
                            codes.append(data.read(int(ends[i + 1] - ends[i])))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), decode_all(pa.array(codes, pa.binary()))], names=["read_id", "counts"])

    found = spark.createDataFrame([(part,) for part in range(1, parts + 1)], "part int").repartition(max(parts, 1))
    return found.mapInArrow(run, "read_id long, counts array<int>")


# --- tagged text ---------------------------------------------------------------------------------


def write_tagged(lines: DataFrame, path: str, kind: str, schema: list[str], command: str, order: list[str]) -> None:
    """Tagged text: a head (file type, schema and provenance), then the column ``line`` in the given order.

    The head is a part file of its own, whose name sorts before the others, so the parts in the order of their names are the whole file.
    """
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
    _write_head(lines.sparkSession, path, tagged_head(kind, schema, command))


def write_tagged_in_order(lines: DataFrame, path: str, kind: str, schema: list[str], command: str, first: Callable[[], list[str]]) -> None:
    """The same for lines whose partitions follow each other; the ``first`` data lines are known when the others are written. Parts are compressed (gzip)."""
    lines.select("line").write.mode("overwrite").option("compression", "gzip").text(path)
    _write_head(lines.sparkSession, path, tagged_head(kind, schema, command) + first())


def _write_head(spark: SparkSession, path: str, head: list[str]) -> None:
    hadoop, store = _filesystem(spark, path)
    out = store.create(hadoop.Path(f"{path}/part-00000-0-head.txt"), True)
    out.write(bytearray(("\n".join(head) + "\n").encode()))
    out.close()


def tagged_head(kind: str, schema: list[str], command: str) -> list[str]:
    """The lines before the data: type and version, one line for each line type, and who made the file."""
    when = datetime.now(UTC).strftime("%Y-%m-%d_%H:%M:%S")
    return [f"1 {len(kind)} {kind} 2 0", *(f"~ {x}" for x in schema), f"! 4 {len('seqloom')} seqloom 3 1.0 {len(command)} {command} {len(when)} {when}"]


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """(tag, fields) of the data lines of tagged text."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(1 |[!~#<>.])") & (F.col("value") != ""))
    return rows.select(F.substring("value", 1, 1).alias("tag"), F.split(F.expr("substring(value, 3)"), " ").alias("fields"))


def write_intervals(intervals: DataFrame, path: str) -> None:
    """Tab-separated lines seq_idx, beg, end, name, in the order of sequences and places."""
    order = ["seq_idx", "beg"]
    intervals.select("seq_idx", "beg", "end", "name").repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("sep", "\t").csv(path)


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return hadoop, at.getFileSystem(spark._jsc.hadoopConfiguration())


def of_root(spark: SparkSession, root: str) -> list[str]:
    """The artifacts that exist under a root name."""
    hadoop, store = _filesystem(spark, root)
    return [f"{root}.{kind}" for kind in KINDS if store.exists(hadoop.Path(f"{root}.{kind}"))]


def remove(spark: SparkSession, root: str) -> int:
    """Delete all artifacts of a root as a unit."""
    hadoop, store = _filesystem(spark, root)
    found = of_root(spark, root)
    for path in found:
        store.delete(hadoop.Path(path), True)
    return len(found)


def copy(spark: SparkSession, root: str, to: str, move: bool = False, overwrite: bool = True) -> int:
    """Copy or move all artifacts of a root as a unit; existing ones are kept if ``overwrite`` is off."""
    hadoop, store = _filesystem(spark, root)
    done = 0
    for path in of_root(spark, root):
        target = hadoop.Path(to + path[len(root) :])
        if store.exists(target):
            if not overwrite:
                continue
            store.delete(target, True)
        if move:
            store.rename(hadoop.Path(path), target)
        else:
            hadoop.FileUtil.copy(store, hadoop.Path(path), store, target, False, spark._jsc.hadoopConfiguration())
        done += 1
    return done
