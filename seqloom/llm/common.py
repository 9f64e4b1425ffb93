"""Shared pieces of the training-data operators: text expressions, file locations, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a regular expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def column(name: str) -> Column:
    """A column of any name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def apart(df: DataFrame) -> str:
    """A prefix of underscores that begins no column of ``df``: names for intermediate columns."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def others(df: DataFrame, *results: str) -> list[str]:
    """The columns of ``df`` but those that a result of the same name, in any case, replaces."""
    replaced = {r.lower() for r in results}
    return [c for c in df.columns if c.lower() not in replaced]


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(value: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(value, UPPER, UPPER.lower())


_own_dirs: dict[str, str] = {}
_process = ctypes.CDLL(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local master gets one of its own."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where and not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        where = _own_dirs.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="seqloom-checkpoints-")
        _own_dirs[context.applicationId] = where
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def persisted(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors.

    The folder goes when the application ends, or before that by :func:`discarded`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discarded(df: DataFrame) -> None:
    """Delete what :func:`persisted` wrote for ``df``; nothing may read it or what derives from it afterwards."""
    where, files = _files(df.sparkSession, df.written_to)
    files.delete(where, True)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` text bytes each (single longer rows stay whole)."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    ends = np.cumsum(string_lengths(values), dtype=np.int64)
    start = done = 0
    while start < batch.num_rows:
        stop = max(int(np.searchsorted(ends, done + limit, side="right")), start + 1)
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])
    released()


def released() -> None:
    """Give freed memory back to the machine: workers live on between stages, and what they hold counts against their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_process, "malloc_trim", None)
    if trim is not None:
        trim(0)


def string_lengths(values: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``flat[s:s+n]`` for each (s, n)."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - np.concatenate(([0], np.cumsum(lengths)[:-1]))).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


def list_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the lists that ``offsets`` describes, empty lists included."""
    running = np.concatenate(([0], np.cumsum(values)))
    return running[offsets[1:]] - running[offsets[:-1]]
