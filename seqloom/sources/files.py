"""Sequence files as (read_id LONG, seq STRING), identifiers 0-based in file order.

Text formats go through Spark's own reader, which splits and decompresses them and reaches any store it
knows; a path may be a file or a folder of part files. A line's place is its number inside its split plus the lines of the splits
before it: one row per split, in a table that is joined and never passes through the driver. Lines are not shuffled for that.
CRAM has no decoder here and is refused. Binary alignments are read in byte ranges: a task finds the first block in its range and in it the
first record, and ends with the last record that begins in its range.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .artifacts import located, opened

#: File kinds by name ending, the letters of binary alignments, and the flag bits of secondary records.
KINDS = {
    ".cram": "cram", ".bam": "bam", ".sam": "sam", ".db": "two-bit", ".dam": "two-bit",
    ".fastq": "fastq", ".fq": "fastq", ".fasta": "fasta", ".fa": "fasta", ".fna": "fasta",
}
BAM_LETTERS = "=acmgrsvtwyhkdbn"
SECONDARY = 0x900
CHUNK, RECORDS = 1 << 16, 10_000
BLOCK, HEAD, CHAIN, RANGE = b"\x1f\x8b\x08\x04", 512, 5, 64 << 20  #: a block's first bytes, what is read to learn its size, records that prove a place, bytes of a task
_NIBBLES, _TWO_BIT = np.frombuffer(BAM_LETTERS.encode(), np.uint8), np.frombuffer(b"acgt", np.uint8)
#: Fixed values of two-bit databases: the size of the index's head, a read's record in it, the flag of the best read of a well, and the
#: line of the stub with the trimming.
INDEX_HEAD, BEST = 112, 0x800
READ = np.dtype({"names": ["length", "offset", "flags"], "formats": ["=i4", "=i8", "=i4"], "offsets": [4, 16, 32], "itemsize": 40})
TRIMMING = re.compile(r"size =\s*\d+ cutoff =\s*(\d+) all =\s*(\d)")


def kind_of(path: str) -> str:
    name = path.lower().removesuffix(".gz")
    for ending, kind in KINDS.items():
        if name.endswith(ending):
            return kind
    raise ValueError(f"cannot tell what kind of file {path} is")


def kind_column(path: Column) -> Column:
    """The same for a column of paths; null where no ending is known."""
    name = F.regexp_replace(F.lower(path), r"\.gz$", "")
    return F.coalesce(*(F.when(name.endswith(ending), kind) for ending, kind in KINDS.items()))


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All sequences of files of one kind, in the order of the paths."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {kind_of(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError("all files must be of one kind")
    reader = {"fasta": _fasta, "fastq": _fastq, "sam": _sam, "bam": _bam, "two-bit": _database}.get(kind := kinds.pop())
    if reader is None:
        raise NotImplementedError(f"{kind} files are not supported")
    parts = [reader(spark, path) for path in paths]
    if len(parts) == 1:
        return parts[0]
    tagged = reduce(DataFrame.unionByName, (part.withColumn("_file", F.lit(i)) for i, part in enumerate(parts)))
    counts = tagged.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    shifts = F.broadcast(counts.select("_file", _before("_n", "_file").alias("_shift")))  # one row a path
    return tagged.join(shifts, "_file").select((F.col("read_id") + F.col("_shift")).alias("read_id"), "seq")


def _before(count: str, order: str) -> Column:
    """The sum of the counts of all rows before; the table has one row a file, split or run."""
    return F.coalesce(F.sum(count).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _numbered(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(nr, value): the lines of a file with their 0-based numbers.

    Spark numbers a task's rows one after the other, and a split is read by one task in order, so a line's number in its split is the
    distance to the split's least number.
    """
    reader = spark.read.option("lineSep", separator) if separator else spark.read
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = reader.text(path).select("value", split.alias("_split"), F.monotonically_increasing_id().alias("_in"))
    sizes = rows.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_least"))
    shifts = sizes.select("_split", "_least", _before("_n", "_split").alias("_shift"))
    return rows.join(shifts, "_split").select((F.col("_shift") + F.col("_in") - F.col("_least")).cast("long").alias("nr"), "value")


def _dense(rows: DataFrame) -> DataFrame:
    """Rank rows by ``nr``, a run of a million numbers at a time; (read_id, seq)."""
    run = F.expr("nr div 1048576")
    counts = rows.groupBy(run.alias("_run")).agg(F.count(F.lit(1)).alias("_n"))
    shifts = counts.select("_run", _before("_n", "_run").alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy("nr"))
    return rows.withColumn("_run", run).withColumn("_inside", inside).join(shifts, "_run").select((F.col("_shift") + F.col("_inside") - 1).cast("long").alias("read_id"), "seq")


def _fasta(spark: SparkSession, path: str) -> DataFrame:
    """A record starts at a line that begins with >; its sequence may span lines."""
    rows = _numbered(spark, path, "\n>").where("trim(value) <> ''")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    return rows.select(F.col("nr").alias("read_id"), F.regexp_replace(body, r"\s", "").alias("seq"))


def _fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of four lines; the second is the sequence."""
    return _numbered(spark, path).where("nr % 4 = 1").select(F.expr("nr div 4").alias("read_id"), F.rtrim("value", F.lit("\r")).alias("seq"))


def _sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines but secondary and supplementary ones; letters other than a, c, g, t stay invalid."""
    fields = F.split("value", "\t")
    rows = _numbered(spark, path).where("value NOT LIKE '@%' AND value <> ''").select("nr", fields.alias("f"))
    kept = rows.where(F.col("f")[1].cast("int").bitwiseAND(SECONDARY) == 0)
    return _dense(kept.select("nr", F.when(F.col("f")[9] == "*", "").otherwise(F.col("f")[9]).alias("seq")))


def gzip_members(data: bytes) -> Iterator[bytes]:
    """The contents of gzip members in a row, a piece at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            piece = view[at : at + CHUNK]
            yield member.decompress(piece)
            at += len(piece) - len(member.unused_data)


class _Bytes:
    """Reads a stream of pieces a given number of bytes at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, b"", 0

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            more = next(self.pieces, None)
            if more is None:
                raise ValueError("the file ends within a record")
            self.held, self.at = self.held[self.at :] + more, 0
        self.at += n
        return self.held[self.at - n : self.at]

    def ended(self) -> bool:
        while self.at >= len(self.held):
            more = next(self.pieces, None)
            if more is None:
                return True
            self.held, self.at = more, 0
        return False

    def integer(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def block_size(head: bytes) -> int:
    """Bytes of the block that begins with these 18 or more bytes, or 0: blocks name their size in an extra field."""
    if len(head) < 18 or not head.startswith(BLOCK):
        return 0
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        name, n = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + n
    return 0


class _Content:
    """What the blocks of a file hold from the first block at or after a byte on; places count from there. ``fetch(at, n)`` reads the file."""

    def __init__(self, fetch, total: int, at: int, stop: int, aligned: bool):
        self.fetch, self.total, self.bytes, self.first = fetch, total, b"", 0
        self.next = at if aligned else self.found(at, stop)  # where the next block begins, None if none does before ``stop``
        self.data, self.base, self.blocks = bytearray(), 0, []

    def peek(self, at: int, n: int) -> bytes:
        n = min(n, self.total - at)
        if not self.first <= at <= at + n <= self.first + len(self.bytes):
            self.bytes, self.first = self.fetch(at, min(max(n, 16 * CHUNK), self.total - at)), at
        return self.bytes[at - self.first : at - self.first + n]

    def found(self, at: int, stop: int) -> int | None:
        """The first block that begins at ``at`` or later but before ``stop``: the end of the file or another block follows it."""
        while at < min(stop, self.total):
            some = self.peek(at, CHUNK)
            place = some.find(BLOCK)
            if place < 0:
                at += max(len(some) - len(BLOCK) + 1, 1)
                continue
            at += place
            size = block_size(self.peek(at, HEAD))
            if at < stop and size and (at + size == self.total or at + size < self.total and block_size(self.peek(at + size, HEAD))):
                return at
            at += 1
        return None

    def load(self) -> bool:
        if self.next is None or self.next >= self.total:
            return False
        size = block_size(self.peek(self.next, HEAD))
        whole = self.peek(self.next, size)
        if not size or len(whole) < size:
            raise ValueError("the file ends within a block" if size else "no block where one should be")
        self.blocks.append((self.base + len(self.data), self.next))
        self.data += zlib.decompress(whole, 31)
        self.next += size
        return True

    def at(self, place: int, n: int) -> bytes:
        """``n`` bytes from a place on, fewer at the end of the file."""
        while self.base + len(self.data) < place + n and self.load():
            pass
        return bytes(self.data[place - self.base : place - self.base + n])

    def block_of(self, place: int) -> int | None:
        """Where the block begins that holds a place; None behind the last one. Places before it are forgotten."""
        if not self.at(place, 1):
            return None
        while len(self.blocks) > 1 and self.blocks[1][0] <= place:
            self.blocks.pop(0)
        if place - self.base > 16 * CHUNK:
            del self.data[: place - self.base]
            self.base = place
        return self.blocks[0][1]


def record_after(content: _Content, place: int, references: int) -> int:
    """Where the next record begins if one may begin here, else 0."""
    head = content.at(place, 36)
    if len(head) < 36:
        return 0
    size, reference, at, name, _, _, cigar, _, length, mate, mate_at, _ = struct.unpack("<iiiBBHHHiiii", head)
    if not (-1 <= reference < max(references, 1) and -1 <= mate < max(references, 1) and at >= -1 and mate_at >= -1 and name >= 1 and length >= 0):
        return 0
    if size < 32 + name + 4 * cigar + (length + 1) // 2 + length:
        return 0
    text = content.at(place + 36, name)
    return place + 4 + size if len(text) == name and text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else 0


def bam_range(fetch, total: int, start: int, stop: int, skip: int | None, references: int = 0) -> Iterator[str]:
    """Sequences of the records that begin in blocks which begin in bytes start to stop.

    The first range skips the file's head (``skip`` bytes of content). Another one (None) takes the first place from which a chain of
    CHAIN records fits, or one to the end of the file; the record that runs into it belongs to the range before.
    """
    content, place = _Content(fetch, total, start, stop, skip is not None), skip or 0

    def fits(at: int) -> bool:
        for _ in range(CHAIN):
            at = record_after(content, at, references)
            if not at:
                return False
            if not content.at(at, 1):
                return len(content.at(at - 1, 1)) == 1
        return True

    owned = lambda: (block := content.block_of(place)) is not None and block < stop
    while skip is None and owned() and not fits(place):
        place += 1
    while owned():
        size = content.at(place, 4)
        record = content.at(place + 4, struct.unpack("<i", size)[0]) if len(size) == 4 else b""
        if len(size) < 4 or len(record) < struct.unpack("<i", size)[0]:
            raise ValueError("the file ends within a record")
        yield from sequence_of(record)
        place += 4 + len(record)


def sequence_of(record: bytes) -> Iterator[str]:
    """The letters of a record that is not secondary."""
    name, cigar, flag, length = record[8], *struct.unpack_from("<HHi", record, 12)
    if not flag & SECONDARY:
        packed = np.frombuffer(record, np.uint8, (length + 1) // 2, 32 + name + 4 * cigar)
        yield _NIBBLES[np.stack([packed >> 4, packed & 15], axis=1).ravel()[:length]].tobytes().decode()


def bam_head(raw: _Bytes) -> tuple[int, int]:
    """Bytes of content before the first record, and the number of references."""
    if raw.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = raw.integer()
    raw.take(text)
    number, size = raw.integer(), 12 + text
    for _ in range(number):
        name = raw.integer()
        raw.take(name + 4)
        size += name + 8
    return size, number


def bam_sequences(data: bytes) -> Iterator[str]:
    """Those of a whole file, whose blocks need not name their sizes."""
    raw = _Bytes(gzip_members(data))
    bam_head(raw)
    while not raw.ended():
        yield from sequence_of(raw.take(raw.integer()))


def _bam(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Every ``size`` bytes of a file are a task, which finds the records that begin there. Files whose blocks do not name their sizes, and
    folders, are one task a file."""
    store, inside = located(path)
    about = store.get_file_info(inside)
    if not about.is_file:
        return _whole_bam(spark, path)
    total = about.size

    def fetch(at: int, n: int) -> bytes:
        with opened(path) as file:
            file.seek(at)
            return file.read(n)

    if not block_size(fetch(0, min(HEAD, total))):
        return _whole_bam(spark, path)
    skip, references = bam_head(_Bytes(_contents(fetch, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (i for batch in batches for i in batch.column("id").to_pylist()):
            place, found = 0, bam_range(fetch, total, part * size, min(part * size + size, total), None if part else skip, references)
            while some := list(islice(found, RECORDS)):
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(some)), pa.array(range(place, place + len(some)), pa.int64()), pa.array(some, pa.string())], names=["_part", "_at", "seq"])
                place += len(some)

    parts = max(-(-total // size), 1)
    rows = spark.range(0, parts, 1, min(parts, 100_000)).mapInArrow(run, "_part long, _at long, seq string")
    shifts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", _before("_n", "_part").alias("_shift"))  # one row a range
    return rows.join(shifts, "_part").select((F.col("_shift") + F.col("_at")).cast("long").alias("read_id"), "seq")


def _contents(fetch, total: int) -> Iterator[bytes]:
    content, place = _Content(fetch, total, 0, total, True), 0
    while content.block_of(place) is not None:
        piece = content.at(place, len(content.data) - (place - content.base))
        yield piece
        place += len(piece)


def _whole_bam(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                first, found = 0, bam_sequences(content.as_py())
                while some := list(islice(found, RECORDS)):
                    yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(some)), pa.int64()), pa.array(some, pa.string())], names=["read_id", "seq"])
                    first += len(some)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "read_id long, seq string")


# --- two-bit databases ---------------------------------------------------------------------------


def _database(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a two-bit database that its trimming keeps; every range of reads is one task.

    The stub names the trimming; beside it, hidden files hold the index of the reads and their letters, four to a byte.
    """
    with opened(path) as file:
        trimming = TRIMMING.search(file.read().decode())
    if trimming is None:
        raise ValueError(f"{path} has no trimming; split the database first")
    cutoff, best = int(trimming[1]), 0 if int(trimming[2]) else BEST
    folder, name = os.path.split(path)
    root = f"{folder}/.{os.path.splitext(name)[0]}"
    with opened(f"{root}.idx") as file:
        (total,) = struct.unpack("=i", file.read(4))

    def kept(index: bytes) -> tuple[np.ndarray, np.ndarray]:
        reads = np.frombuffer(index, READ)
        return reads, (reads["length"] >= cutoff) & (reads["flags"] & BEST >= best)

    def index_of(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        with opened(f"{root}.idx") as file:
            file.seek(INDEX_HEAD + first * READ.itemsize)
            return kept(file.read(n * READ.itemsize))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in zip(*(batch.column(c).to_pylist() for c in ("first", "n")), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([n]), pa.array([int(index_of(first, n)[1].sum())])], names=["first", "n", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, shift in zip(*(batch.column(c).to_pylist() for c in ("first", "n", "_shift")), strict=True):
                reads, keep = index_of(first, n)
                with opened(f"{root}.bps") as file:
                    for i, read in enumerate(reads[keep]):
                        file.seek(int(read["offset"]))
                        codes = np.frombuffer(file.read((int(read["length"]) + 3) // 4), np.uint8)
                        letters = _TWO_BIT[(codes[:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].ravel()[: read["length"]]
                        yield pa.RecordBatch.from_arrays([pa.array([shift + i]), pa.array([letters.tobytes().decode()])], names=["read_id", "seq"])

    ranges = [(first, min(RECORDS, total - first)) for first in range(0, total, RECORDS)]
    if not ranges:
        return spark.createDataFrame([], "read_id long, seq string")
    tasks = spark.createDataFrame(ranges, "first long, n long").repartition(min(len(ranges), 1000))
    shifts = tasks.mapInArrow(counted, "first long, n long, _n long").select("first", "n", _before("_n", "first").alias("_shift"))  # one row a range
    return shifts.repartition(min(len(ranges), 1000), "first").mapInArrow(run, "read_id long, seq string")
