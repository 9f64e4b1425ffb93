"""Packing token sequences by Karmarkar-Karp multiway differencing.

A partition is read once, with no shuffle: texts are tokenised in Arrow runs, whole windows of a long
document leave at once, and the remainders gather into blocks of ``block`` windows. Inside a block the
differencing keeps one tuple of window sums per partial partition and always merges the two tuples of
largest imbalance, the heavy windows of one against the light windows of the other, until one near-equal
partition is left. Near-equal windows of a block that is filled to its capacity exceed theirs by a little here and there. Without
``cuts`` the window count rises until all fit, at the price of padding. With ``cuts`` only what exceeds a window is cut off; full windows
leave, and differencing deals the light windows and the cuttings anew, to the fewest windows that hold them, until nothing exceeds:
then every window of a whole block is full. A partition's last tokens that fill no window go to sequences whose
lengths are powers of two, which need no padding.

A worker holds one run of texts with its ids, and one block of at most ``block`` x capacity ids. Blocks depend on nothing but their partition, so a lost executor's task repeats
them alike. Sequence numbers are unique: partition number x 2^32 plus a running number.

Defined results: null text counts as empty and gives the end id alone; repeated rows are packed each; keys are of any type, null keys
are keys; an empty table gives an empty result; columns other than key and text are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_slices, column, list_sums, ragged_take

END_ID = 0
#: A space next to other white space may join its token; elsewhere a token never reaches back over it.
ODD = r"[\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}] | [\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]"
SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Pieces that may stand in lines of one text: a token never crosses a newline between such pieces.
PLAIN = r"\A ?[^\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]+\z"
RUN, LINE = 16 << 20, 2000  #: text bytes that a worker holds at a time, and pieces in a line


@lru_cache(maxsize=2)
def byte_model(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts, run by run; each distinct piece of a run is encoded once, in long lines of pieces."""

    def __init__(self, path: str):
        self.model = byte_model(path)
        self.newline = self.model.encode("\n", add_special_tokens=False).ids[0]

    def pieces(self, words: pa.Array, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all distinct words, each behind ``lead``, in a row, and the number of ids of each."""
        plain = pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)
        ids, lengths = [np.zeros(0, np.uint32)], np.zeros(len(words), np.int64)
        order = np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))
        own = words.take(pa.array(order[: int(plain.sum())]))
        ends = np.append(np.arange(0, len(own), LINE), len(own)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), own), "\n" + lead).to_pylist() if len(own) else []
        for start, stop, line in zip(ends[:-1].tolist(), ends[1:].tolist(), lines, strict=False):
            line_ids = np.array(self.model.encode_batch_fast([lead + line], add_special_tokens=False)[0].ids, np.uint32)
            breaks = np.flatnonzero(line_ids == self.newline)
            if len(breaks) == stop - start - 1:
                ids.append(np.delete(line_ids, breaks))
                lengths[order[start:stop]] = np.diff(np.concatenate(([-1], breaks, [len(line_ids)]))) - 1
            else:
                self.one_by_one(words, lead, order[start:stop], ids, lengths)
        self.one_by_one(words, lead, order[len(own) :], ids, lengths)
        # from the order of encoding to that of the words
        ordered = lengths[order]
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(ordered) - ordered
        return ragged_take(np.concatenate(ids), starts, lengths), lengths

    def one_by_one(self, words: pa.Array, lead: str, places: np.ndarray, ids: list[np.ndarray], lengths: np.ndarray) -> None:
        for i in range(0, len(places), LINE):
            some = [lead + w for w in words.take(pa.array(places[i : i + LINE])).to_pylist()]
            coded = [x.ids for x in self.model.encode_batch_fast(some, add_special_tokens=False)]
            lengths[places[i : i + LINE]] = list(map(len, coded))
            ids.append(np.fromiter((x for own in coded for x in own), np.uint32))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and each text's number of ids."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        split = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        flat = split.flatten()
        heads = flat.take(pa.array(offsets[:-1])).dictionary_encode()
        coded = flat.dictionary_encode()
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        own = [SAFE.split(texts[i].as_py()) for i in rows]
        odd_ones = pa.array([p for pieces in own for p in pieces], pa.string()).dictionary_encode()

        sets = [self.pieces(coded.dictionary, " "), self.pieces(heads.dictionary, ""), self.pieces(odd_ones.dictionary, "")]
        ids, lengths = (np.concatenate(x) for x in zip(*sets, strict=True))
        starts = np.cumsum(lengths) - lengths
        shift = np.cumsum([0, *(len(n) for _, n in sets)])
        places = coded.indices.to_numpy().astype(np.int64)
        places[offsets[:-1]] = heads.indices.to_numpy() + shift[1]
        if not rows:
            return ragged_take(ids, starts[places], lengths[places]), list_sums(lengths[places], offsets)
        # an odd text has one empty piece so far, and gets its own ones instead
        sizes = np.diff(offsets)
        sizes[rows] = [len(pieces) for pieces in own]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        all_places = np.empty(ends[-1], np.int64)
        is_odd = np.repeat(np.isin(np.arange(len(sizes)), rows), sizes)
        all_places[is_odd] = odd_ones.indices.to_numpy() + shift[2]
        keep = np.ones(len(places), bool)
        keep[offsets[:-1][rows]] = False
        all_places[~is_odd] = places[keep]
        return ragged_take(ids, starts[all_places], lengths[all_places]), list_sums(lengths[all_places], ends)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal items into ``windows`` sets of near-equal sums; returns the items of each set."""
    if windows == 1:
        return [list(range(len(sizes)))]
    heap, parts = [], {}
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        parts[i] = [[i]] + [None] * (windows - 1)
        heap.append((-size, i, sums))
    heapq.heapify(heap)
    new = len(sizes)
    while len(heap) > 1:
        _, a, one = heapq.heappop(heap)
        _, b, two = heapq.heappop(heap)
        sums = one + two[::-1]
        order = np.argsort(-sums, kind="stable")
        both = [x if y is None else y if x is None else x + y for x, y in zip(parts.pop(a), reversed(parts.pop(b)), strict=True)]
        sums, parts[new] = sums[order], [both[i] for i in order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), new, sums))
        new += 1
    return [x or [] for x in parts[heap[0][1]]] if heap else [[] for _ in range(windows)]


Part = tuple[int, int, int]  #: item, start, length


def windows_of(sizes: list[int], capacity: int, cuts: bool) -> list[list[Part]]:
    """The parts in each window; items are at most ``capacity`` long.

    Without ``cuts`` the window count rises until differencing fits all. With ``cuts``, what exceeds the capacity of a window is
    cut off and that window is done; the rest is dealt anew by differencing to as many windows as it needs, until nothing exceeds.
    """
    count = max(1, -(-sum(sizes) // capacity))
    if not cuts:
        dealt = differencing(sizes, count)
        while any(sum(sizes[i] for i in items) > capacity for items in dealt):
            count += 1
            dealt = differencing(sizes, count)
        return [[(i, 0, sizes[i]) for i in items] for items in dealt if items]
    out: list[list[Part]] = []
    bundles: list[list[Part]] = [[(i, 0, size)] for i, size in enumerate(sizes) if size]
    while bundles:
        weights = [sum(n for _, _, n in parts) for parts in bundles]
        rest: list[list[Part]] = []
        done = len(out)
        for items in differencing(weights, -(-sum(weights) // capacity)):
            window, excess, room = [], [], capacity
            for item, start, length in (part for i in items for part in bundles[i]):
                fits = min(room, length)
                if fits:
                    window.append((item, start, fits))
                if fits < length:
                    excess.append((item, start + fits, length - fits))
                room -= fits
            if excess:
                out.append(window)
                rest.append(excess)
            elif window:
                rest.append(window)
        if len(out) == done:
            return out + rest
        bundles = rest
    return out


PIECE_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Packer:
    """Collects documents and yields rows of PIECE_COLUMNS."""

    def __init__(self, partition: int, capacity: int, block: int, cuts: bool):
        self.next, self.capacity, self.block, self.cuts = partition << 32, capacity, block, cuts
        self.rest, self.gathered = [], 0

    def row(self, doc, ids: np.ndarray, start: int, offset: int, total: int) -> tuple:
        return doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            yield self.row(doc, ids[start : start + self.capacity], start, 0, total)
            self.next += 1
        if whole < total:
            yield from self.gather(doc, ids[whole:], whole, total)

    def gather(self, doc, ids: np.ndarray, start: int, total: int) -> Iterator[tuple]:
        room = self.block * self.capacity - self.gathered
        first = ids if not self.cuts else ids[:room]
        self.rest.append((doc, first, start, total))
        self.gathered += len(first)
        if self.gathered >= self.block * self.capacity:
            yield from self.flush()
            if len(first) < len(ids):
                yield from self.gather(doc, ids[len(first) :], start + len(first), total)

    def flush(self) -> Iterator[tuple]:
        items, self.rest, self.gathered = self.rest, [], 0
        for window in windows_of([len(x[1]) for x in items], self.capacity, self.cuts):
            offset = 0
            for item, start, length in window:
                doc, ids, at, total = items[item]
                yield self.row(doc, ids[start : start + length], at + start, offset, total)
                offset += length
            self.next += 1

    def close(self) -> Iterator[tuple]:
        """The last block; with cuts, what fills no window goes to sequences of power-of-two length."""
        tail, spare = [], self.gathered % self.capacity if self.cuts else 0
        self.gathered -= spare
        while spare:
            doc, ids, start, total = self.rest.pop()
            taken = min(spare, len(ids))
            if taken < len(ids):
                self.rest.append((doc, ids[:-taken], start, total))
            tail.append((doc, ids[len(ids) - taken :], start + len(ids) - taken, total))
            spare -= taken
        if self.rest:
            yield from self.flush()
        left = sum(len(x[1]) for x in tail)
        while left:
            room = 1 << (left.bit_length() - 1)
            left, offset = left - room, 0
            while room:
                doc, ids, start, total = tail.pop()
                taken = min(room, len(ids))
                yield self.row(doc, ids[:taken], start, offset, total)
                offset, room = offset + taken, room - taken
                if taken < len(ids):
                    tail.append((doc, ids[taken:], start + taken, total))
            self.next += 1


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], key), *(pa.array(c, pa.int64()) for c in columns[1:])], names=list(PIECE_COLUMNS))


def packed(docs: DataFrame, model_path: str, capacity: int = 1024, block: int = 64, cuts: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: PIECE_COLUMNS, with the ids' CRC-32 as unsigned little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, packer, rows = Encoder(model_path), Packer(TaskContext.get().partitionId(), capacity, block, cuts), []
        kind = pa.null()
        for batch in batches:
            kind = batch.schema.field("_key").type
            for part in byte_slices(batch, "_text", RUN):
                ids, counts = pieces.encode(part.column("_text"))
                ends = np.cumsum(counts)
                for doc, end, count in zip(part.column("_key").to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                    rows.extend(packer.add(doc, np.append(ids[end - count : end], np.uint32(END_ID))))
                if rows:
                    yield _batch(rows, kind)
                    rows = []
        rows.extend(packer.close())
        if rows:
            yield _batch(rows, kind)

    source = docs.select(column(key).alias("_key"), column(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return source.mapInArrow(run, ", ".join(f"{c} {kind if c == PIECE_COLUMNS[0] else 'long'}" for c in PIECE_COLUMNS))


def op2_packing(spark, sf_dir):
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
