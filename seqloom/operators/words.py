"""Words of k letters in sequences.

A word is a LONG of two bits a letter, or for k above 31 a struct of several of 31 letters each (the last one has the rest), built in
numpy over whole Arrow batches; tuples of LONGs sort as their letters do. Sequences of any length are walked in slices that overlap by k - 1 letters,
so memory follows the slice and not the sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StringType

from ..functions.letters import MOST

PACKED_UP_TO = 31
SLICE = 4 << 20

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("acgt"):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i
#: The letters of each byte of four packed ones, and such bytes with their letters turned round.
_FOUR = np.array([["acgt"[b >> s & 3].encode() for s in (6, 4, 2, 0)] for b in range(256)]).view(np.uint32).ravel()
_ROUND = np.array([sum((b >> s & 3) << (6 - s) for s in (6, 4, 2, 0)) for b in range(256)], np.uint8)


def check_k(k: int) -> None:
    if k < 5:
        raise ValueError("words have at least 5 letters")


def limbs(k: int) -> list[int]:
    """Letters of each LONG of a word."""
    return [min(PACKED_UP_TO, k - at) for at in range(0, k, PACKED_UP_TO)]


def centre_of(k: int) -> tuple[int, int]:
    """The LONG of a word that has its centre, letter k // 2, and by how many bits the centre stands to the left in it."""
    limb, inside = divmod(k // 2, PACKED_UP_TO)
    return limb, 2 * (limbs(k)[limb] - 1 - inside)


def word_type(k: int) -> str:
    return "long" if k <= PACKED_UP_TO else f"struct<{', '.join(f'w{i}: long' for i in range(len(limbs(k))))}>"


def rolled(codes: np.ndarray, size: int, turned: bool = False) -> np.ndarray:
    """Every window of ``size`` letters as a LONG, its reverse complement if ``turned``; blocks of doubled length make it in few steps."""
    n = len(codes) - size + 1
    block = (3 - codes if turned else codes).astype(np.int64)
    out, done, length = np.zeros(max(n, 0), np.int64), 0, 1
    while n > 0:
        if size & length:
            part = block[done : done + n]
            out = out | part << 2 * done if turned else out << 2 * length | part
            done += length
        if 2 * length > size:
            break
        left, right = block[:-length], block[length:]
        block = right << 2 * length | left if turned else left << 2 * length | right
        length *= 2
    return out


def canonical_words(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of letter codes its canonical word (one row of LONGs if k is above 31), and whether it is free of invalid letters."""
    n, sizes = len(codes) - k + 1, limbs(k)
    if n <= 0:
        return np.zeros(0 if len(sizes) == 1 else (0, len(sizes)), np.int64), np.zeros(0, bool)
    bad = np.concatenate(([0], np.cumsum(codes == 4)))
    letters = np.minimum(codes, 3)
    made = {(size, turned): rolled(letters, size, turned) for size in set(sizes) for turned in (False, True)}
    starts = range(0, k, PACKED_UP_TO)
    forward = [made[size, False][at : at + n] for at, size in zip(starts, sizes, strict=True)]
    backward = [made[size, True][k - at - size : k - at - size + n] for at, size in zip(starts, sizes, strict=True)]
    less, equal = np.zeros(n, bool), np.ones(n, bool)
    for f, b in zip(forward, backward, strict=True):
        less |= equal & (f < b)
        equal &= f == b
    chosen = [np.where(less, f, b) for f, b in zip(forward, backward, strict=True)]
    return chosen[0] if len(sizes) == 1 else np.stack(chosen, axis=1), bad[k:] == bad[:-k]


def without_centre(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with the bits of their centre cleared, and these bits."""
    limb, shift = centre_of(k)
    part = words if words.ndim == 1 else words[:, limb]
    cleared = part & ~(np.int64(3) << shift)
    if words.ndim > 1:
        cleared = np.concatenate([words[:, :limb], cleared[:, None], words[:, limb + 1 :]], axis=1)
    return cleared, part >> shift & 3


def centre_last(words: np.ndarray, k: int) -> np.ndarray:
    """Words with their centre moved behind all other letters, so that those which differ in it alone follow each other in order."""
    limb, shift = centre_of(k)
    turned = words.copy() if words.ndim > 1 else words[:, None].copy()
    part, last = turned[:, limb].copy(), turned.shape[1] - 1
    centre, below = part >> shift & 3, part & (np.int64(1) << shift) - 1
    turned[:, limb] = (part >> (shift + 2)) << shift | below
    turned[:, last] = turned[:, last] << 2 | centre  # 64 bits at most: the sign may change, which keeps such words together
    return turned.reshape(words.shape)


def centre_split(turned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The reverse: words with the bits of their centre cleared, and these bits."""
    limb, shift = centre_of(k)
    words = turned.copy() if turned.ndim > 1 else turned[:, None].copy()
    centre = words[:, -1] & 3
    words[:, -1] = (words[:, -1].view(np.uint64) >> np.uint64(2)).view(np.int64)
    part = words[:, limb].copy()
    words[:, limb] = (part >> shift) << (shift + 2) | part & (np.int64(1) << shift) - 1
    return words.reshape(turned.shape), centre


def ranked(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of words, and in it the place of the first of each distinct one."""
    order = np.argsort(words) if words.ndim == 1 else np.lexsort(words.T[::-1])
    some = words[order]
    new = np.ones(len(some), bool)
    new[1:] = some[1:] != some[:-1] if words.ndim == 1 else (some[1:] != some[:-1]).any(axis=1)
    return order, np.flatnonzero(new)


def distinct(words: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words in order, and their numbers or the sums of their weights (rows of weights add up by column)."""
    if not len(words):
        return words, np.zeros((0, *weights.shape[1:]) if weights is not None else 0, np.int64)
    if words.ndim == 1 and weights is None:
        return np.unique(words, return_counts=True)
    order, first = ranked(words)
    return words[order[first]], np.diff(np.append(first, len(order))) if weights is None else np.add.reduceat(weights[order], first)


def letter_codes(words: pa.Array, k: int) -> np.ndarray:
    """Codes of valid words of k letters, one row a word."""
    return _CODE[np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)].reshape(-1, k)


def unpacked_codes(words: np.ndarray, k: int) -> np.ndarray:
    """Codes of packed words, one row a word."""
    return ((words[:, None] >> (2 * np.arange(k - 1, -1, -1, dtype=np.int64))) & 3).astype(np.uint8)


def packed_codes(codes: np.ndarray, long: bool) -> pa.Array:
    """Rows of codes as LONGs, or as bytes, in their order."""
    k = codes.shape[1]
    if long:
        return pa.array((codes.astype(np.int64) << (2 * np.arange(k - 1, -1, -1, dtype=np.int64))).sum(axis=1))
    return pa.array(np.ascontiguousarray(codes).view(f"V{k}").ravel().tolist(), pa.binary())


def slices(seq: str | None, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, letter codes) of overlapping slices of a sequence."""
    if seq is None or len(seq) < k:
        return
    codes = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    size = slice_size(k)
    for start in range(0, len(codes) - k + 1, size):
        yield start, codes[start : start + size + k - 1]


def slice_size(k: int) -> int:
    """Windows that are worked on at a time."""
    return max(SLICE // len(limbs(k)), 1)


def word_array(words: np.ndarray, k: int) -> pa.Array:
    if k <= PACKED_UP_TO:
        return pa.array(words)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(words.shape[1])], names=[f"w{i}" for i in range(words.shape[1])])


def word_numbers(words: pa.Array, k: int) -> np.ndarray:
    """The reverse of :func:`word_array`."""
    return words.to_numpy(zero_copy_only=False) if k <= PACKED_UP_TO else np.stack([x.to_numpy(zero_copy_only=False) for x in words.flatten()], axis=1)


def spelled(numbers: np.ndarray, k: int) -> pa.Array:
    """Packed words as letters."""
    own = numbers if numbers.ndim > 1 else numbers[:, None]
    parts = [_FOUR[_bytes(own[:, i], size)].view(np.uint8).reshape(len(own), 4 * -(-size // 4))[:, :size] for i, size in enumerate(limbs(k))]
    # all words are k bytes, so their bytes in a row are the values buffer of one string array
    ends = np.arange(0, len(own) * k + 1, k, dtype=np.int32)
    return pa.Array.from_buffers(pa.string(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(parts, axis=1).tobytes())])


def _bytes(words: np.ndarray, k: int) -> np.ndarray:
    """Packed words as rows of bytes, their first letter at the top of the first byte."""
    return (words.astype(np.uint64) << np.uint64(64 - 2 * k)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, : -(-k // 4)]


def backward(words: np.ndarray, k: int) -> np.ndarray:
    """Packed words of one LONG with their letters turned round (not complemented)."""
    turned = np.zeros((len(words), 8), np.uint8)
    turned[:, 8 - -(-k // 4) :] = _ROUND[_bytes(words, k)][:, ::-1]
    return turned.view(">u8").ravel().astype(np.int64)


def complement(words: np.ndarray, k: int) -> np.ndarray:
    """Reverse complements of packed words of one LONG."""
    return backward(words ^ np.int64((1 << 2 * k) - 1), k)


def letters_of(word: Column, k: int) -> Column:
    """A packed word as letters."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from (spelled(word_numbers(x, k), k) for x in parts)

    return F.arrow_udf(run, "string")(word)


def gc_percent(word: Column, k: int) -> Column:
    """Whole per cent of letters g and c of a packed word: those whose two bits differ."""
    parts = [word] if k <= PACKED_UP_TO else [word.getField(f"w{i}") for i in range(len(limbs(k)))]
    odd = F.lit(0x1555555555555555)
    number = reduce(Column.__add__, (F.bit_count(x.bitwiseXOR(F.shiftright(x, 1)).bitwiseAND(odd)) for x in parts))
    return F.floor(100 * number / k).cast("int")


def readable(df: DataFrame, k: int, word: str = "kmer") -> DataFrame:
    """Words as letters."""
    return df.withColumn(word, letters_of(F.col(word), k))


def keyed(df: DataFrame, k: int, word: str = "kmer") -> DataFrame:
    """Words of letters as :func:`word_type`; others stay."""
    if not isinstance(df.schema[word].dataType, StringType):
        return df

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in parts:
            codes = letter_codes(x, k)
            cut = [codes[:, at : at + size].astype(np.int64) for at, size in zip(range(0, k, PACKED_UP_TO), limbs(k), strict=True)]
            made = [(c << (2 * np.arange(c.shape[1] - 1, -1, -1, dtype=np.int64))).sum(axis=1) for c in cut]
            yield word_array(made[0] if len(made) == 1 else np.stack(made, axis=1), k)

    return df.withColumn(word, F.arrow_udf(run, word_type(k))(F.col(word)))


def partial_counts(reads: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(group,) kmer, n: counts within each Arrow batch, words as :func:`word_type`."""
    check_k(k)

    most = slice_size(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("_group").to_pylist() if group else [None] * batch.num_rows
            gathered: dict = {}
            held: dict = {}
            for name, seq in zip(names, batch.column("seq"), strict=True):
                for _, codes in slices(seq.as_py(), k):
                    words, valid = canonical_words(codes, k)
                    gathered.setdefault(name, []).append(words[valid])
                    held[name] = held.get(name, 0) + len(words)
                    if held[name] > most:
                        held[name] = 0
                        yield from _counted({name: gathered.pop(name)}, k, group)
            yield from _counted(gathered, k, group)

    columns = [F.col(group).alias("_group")] if group else []
    schema = f"{'_group string, ' if group else ''}kmer {word_type(k)}, n long"
    return reads.select(*columns, "seq").mapInArrow(run, schema).withColumnRenamed("_group", group or "_group")


def _counted(gathered: dict, k: int, group: str | None) -> Iterator[pa.RecordBatch]:
    for name, parts in gathered.items():
        words, counts = distinct(np.concatenate(parts))
        if len(words):
            columns = [word_array(words, k), pa.array(counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), *columns] if group else columns, names=["_group", "kmer", "n"] if group else ["kmer", "n"])


def raw_counts(reads: DataFrame, k: int, group: str | None = None) -> DataFrame:
    """(group,) kmer, n: unclipped counts of canonical words, words as :func:`word_type`."""
    from .superwords import counted

    return counted(reads, k, group)


def count_table(reads: DataFrame, k: int, cutoff: int = 1, most: int | None = MOST) -> DataFrame:
    """kmer (letters), count: words seen at least ``cutoff`` times, counts clipped at ``most`` (None: not)."""
    from .superwords import spelled_counts

    n = F.col("n") if most is None else F.least("n", F.lit(most))
    return spelled_counts(reads, k, cutoff).select("kmer", n.cast("int").alias("count"))


def ordered_table(reads: DataFrame, k: int, cutoff: int = 1, turned: bool = False) -> DataFrame:
    """:func:`count_table` in order: sorted partitions that follow each other. ``turned`` is the order of words read backward."""
    from .superwords import ordered

    return ordered(reads, k, cutoff, turned=turned)
