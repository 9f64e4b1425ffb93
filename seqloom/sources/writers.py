"""Binary alignment files and two-bit databases of sequences, one for each range of reads.

Tasks write their own files into a folder that all machines share; a task that runs again writes the same files anew. Reading the files
in the order of their names gives the reads in the order of their identifiers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .artifacts import located
from .files import BAM_LETTERS, BEST, INDEX_HEAD, READ

BLOCK_BYTES = 60_000
_NIBBLE = np.full(256, BAM_LETTERS.index("n"), np.uint8)
for _i, _c in enumerate(BAM_LETTERS):
    _NIBBLE[ord(_c)] = _NIBBLE[ord(_c.upper())] = _i
_CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate("acgt"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i


def block(content: bytes) -> bytes:
    """A compressed block that names its size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(content), len(content))


def bam_record(name: str, flag: int, seq: str) -> bytes:
    codes = _NIBBLE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    codes = np.append(codes, np.uint8(0)) if len(codes) % 2 else codes
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += (codes[::2] << 4 | codes[1::2]).tobytes() + b"\xff" * len(seq)
    return struct.pack("<i", len(body)) + body


def _written(rows: DataFrame, path: str, files: Callable[[Iterator[tuple], Callable], None]) -> list[str]:
    """The names of what ``files`` writes of each range of rows (read_id, flag, seq); it gets the rows and a function that opens a file."""
    store, inside = located(path)
    store.create_dir(inside, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = f"part{TaskContext.get().partitionId():06d}"
        found = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("read_id", "flag", "seq")), strict=True))
        store, inside = located(path)
        name = files(found, lambda begin, end: store.open_output_stream(f"{inside}/{begin}{part}{end}"))
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{part}{name}"])], names=["name"])

    own = rows.select("read_id", "flag", "seq").repartitionByRange("read_id").sortWithinPartitions("read_id")
    return sorted(r["name"] for r in own.mapInArrow(run, "name string").collect())  # one row a range


def write_bam(reads: DataFrame, path: str, flag=None) -> list[str]:
    """Binary alignment files of reads (read_id, seq) that are aligned to nothing; ``flag`` is a column of their flags."""

    def files(rows: Iterator[tuple], create: Callable) -> str:
        with create("", ".bam") as out:
            held = [b"BAM\1", struct.pack("<ii", 0, 0)]
            size = 0
            for key, own, seq in rows:
                held.append(record := bam_record(f"r{key}", own, seq))
                size += len(record)
                if size >= BLOCK_BYTES:
                    content = b"".join(held)
                    full = len(content) - len(content) % BLOCK_BYTES
                    for at in range(0, full, BLOCK_BYTES):
                        out.write(block(content[at : at + BLOCK_BYTES]))
                    held, size = [content[full:]], len(content) - full
            out.write(block(b"".join(held)))
            out.write(block(b""))
        return ".bam"

    return _written(reads.withColumn("flag", (F.lit(4) if flag is None else flag).cast("int")), path, files)


def write_two_bit(reads: DataFrame, path: str, cutoff: int = 0) -> list[str]:
    """Two-bit databases of reads (read_id, seq), all of them the best of their wells; letters but c, g and t become a."""

    def files(rows: Iterator[tuple], create: Callable) -> str:
        records, offset, longest, total = [], 0, 0, 0
        with create(".", ".bps") as out:
            for _, _, seq in rows:
                codes = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
                codes = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)])
                out.write((codes[::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]).tobytes())
                records.append((len(seq), offset, BEST))
                offset, longest, total = offset + len(codes) // 4, max(longest, len(seq)), total + len(seq)
        with create(".", ".idx") as out:
            out.write(struct.pack("=i", len(records)).ljust(INDEX_HEAD, b"\0"))
            out.write(np.array(records, READ).tobytes() if records else b"")
        with create("", ".db") as out:
            out.write(f"files = {1:9d}\n  {len(records)} reads reads\nblocks = {1:9d}\nsize = {total:10d} cutoff = {cutoff:9d} all = 1\n".encode())
        return ".db"

    return _written(reads.withColumn("flag", F.lit(0)), path, files)
