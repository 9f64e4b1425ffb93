"""Token counts per document by Arrow batches.

Texts reach the worker as Arrow batches, which are cut into runs of about equal bytes. Each text is cut
at every safe boundary -- a single space between two characters that are neither a space nor the
tokenizer's own space mark -- where no vocabulary entry can reach across, so the pieces of the parts add
up to the pieces of the whole. Each distinct part of a run is encoded once and its length remembered in a
bounded table; only lengths leave the worker. There is no shuffle, and long texts cost memory in
proportion to one run.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives an empty result;
input columns other than the kept ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, column, list_sums

MARK = "▁"
SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
RUN, REMEMBERED = 8 << 20, 400_000  #: text bytes and parts that a worker holds at a time


@lru_cache(maxsize=2)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def crosses_spaces(path: str) -> bool:
    """Whether some vocabulary entry has a space mark after another character."""
    model = piece_model(path)
    return any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))


def lengths_of(values: pa.Array, model, known: dict[str, int]) -> np.ndarray:
    """Token counts of an array of texts."""
    values = pc.fill_null(values, "")
    odd = pc.or_(pc.or_(pc.match_substring(values, "  "), pc.match_substring(values, MARK)), pc.or_(pc.starts_with(values, " "), pc.ends_with(values, " ")))
    even = pc.if_else(odd, "", values)
    parts = pc.split_pattern(even, " ")
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    out = list_sums(_known(words, model, known)[coded.indices.to_numpy()], offsets)
    for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
        out[i] = int(_known(SAFE.split(values[int(i)].as_py()), model, known).sum())
    return out


def _known(words: list[str], model, known: dict[str, int]) -> np.ndarray:
    fresh = [w for w in dict.fromkeys(words) if w not in known]
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
        fresh = list(dict.fromkeys(words))
    for i in range(0, len(fresh), 20_000):
        some = fresh[i : i + 20_000]
        known.update(zip(some, map(len, model.encode(some, num_threads=1)), strict=True))
    return np.fromiter((known[w] for w in words), np.int64, len(words))


def token_counter(model_path: str):
    """A function that makes a column of token counts of a column of texts; null counts as empty."""
    if crosses_spaces(model_path):
        raise ValueError("this vocabulary has entries across spaces; its texts have no safe boundaries")

    def count(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, known = piece_model(model_path), {}
        for texts in arrays:
            batch = pa.RecordBatch.from_arrays([texts], names=["_text"])
            parts = [lengths_of(run.column("_text"), model, known) for run in byte_slices(batch, "_text", RUN)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return F.arrow_udf(count, "long").asNondeterministic()  # so that no filter above repeats it


def token_counts(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns plus ``n_bytes`` and ``n_tokens``; of two of a name the result counts."""
    kept = [column(c) for c in keep if c.lower() not in ("n_bytes", "n_tokens")]
    n_bytes = F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long")
    return docs.select(*kept, n_bytes.alias("n_bytes"), token_counter(model_path)(column(text)).alias("n_tokens"))


def op8_token_counts(spark, sf_dir, limit: int = 4096):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumn("over_limit", F.col("n_tokens") > limit)
