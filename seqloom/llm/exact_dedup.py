"""Exact duplicates by Patricia-trie owners.

Texts are equal when identical after lower-casing A-Z. Each input partition first inserts its texts into a trie of its own and passes on
one row per distinct text, so a text that fills a third of the table costs one row per input partition; a trie that
outgrows its budget is passed on and begun anew.
Those rows are dealt by length and content hash; each dealt partition inserts the full byte strings into a
compressed radix trie whose terminal nodes hold the owner and the number of copies. When a trie's labels
outgrow the budget, its largest subtree is spilled to the task's scratch file and finished after the
others. Only groups of two or more leave the tries; documents join them by digest (a left outer join
that adaptive execution may broadcast when small, and split when skewed).

Defined results: null text counts as empty text; a null identifier never owns a text that a real one
has; a repeated row (same identifier, same text) counts as a copy, and every repeat of the owner's
identifier is marked kept (:func:`one_of_each` leaves one row all the same); identifiers are of any type that has an order; an empty
table gives an empty result; input columns that bear a result's name are replaced by the result, others may have any name.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, ascii_lower, column, others, persisted, released

TRIE_BYTES, NODE_BYTES = 256 << 20, 300  #: a trie's size, its nodes' own included


class Node:
    __slots__ = ("label", "children", "entry")

    def __init__(self, label: bytes, entry: list | None = None):
        self.label, self.children, self.entry = label, {}, entry


class PatriciaTrie:
    """Byte strings to [owner, number, tag]; ``largest`` chooses which identifier owns a string."""

    def __init__(self, largest: bool = False, budget: int = TRIE_BYTES, scratch: str | None = None):
        self.root, self.bytes, self.largest, self.budget, self.scratch = Node(b""), 0, largest, budget, scratch
        self.spilled: dict[bytes, str] = {}

    def merge(self, entry: list, owner: int | None, number: int) -> None:
        if entry[0] is None or owner is not None and (owner > entry[0] if self.largest else owner < entry[0]):
            entry[0] = owner
        entry[1] += number

    def insert(self, key: bytes, owner: int | None, number: int, tag: bytes) -> None:
        for prefix, path in self.spilled.items():
            if key.startswith(prefix):
                with open(path, "ab") as out:
                    pickle.dump((key, owner, number, tag), out)
                return
        node, at = self.root, 0
        while True:
            if at == len(key):
                if node.entry is None:
                    node.entry = [owner, number, tag]
                else:
                    self.merge(node.entry, owner, number)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = Node(key[at:], [owner, number, tag])
                self.bytes += len(key) - at + NODE_BYTES
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            rest = key[at : at + len(label)]
            same = len(os.path.commonprefix((label, rest)))
            fork = node.children[key[at]] = Node(label[:same])
            child.label = label[same:]
            self.bytes += NODE_BYTES
            fork.children[child.label[0]] = child
            node, at = fork, at + same
        if self.bytes > self.budget:
            self.spill()

    def entries(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.entry is not None:
                yield key, node.entry
            stack.extend((child, key) for child in node.children.values())

    @staticmethod
    def weight(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE_BYTES
            stack.extend(node.children.values())
        return total

    def spill(self) -> None:
        """Write the heaviest subtree below the first fork to a file; later keys of it go there too."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.entry is None:
            node = next(iter(node.children.values()))
            prefix += node.label
        if len(node.children) < 2 or self.scratch is None:
            return
        weights = {byte: self.weight(child) for byte, child in node.children.items()}
        byte = max(weights, key=weights.get)
        child, name = node.children.pop(byte), prefix + bytes([byte])
        self.bytes -= weights[byte]
        handle, path = tempfile.mkstemp(dir=self.scratch)
        with os.fdopen(handle, "wb") as out:
            for key, (owner, number, tag) in self.entries(child, prefix):
                pickle.dump((key, owner, number, tag), out)
        self.spilled[name] = path

    def owners(self) -> Iterator[list]:
        """The terminal entries, those of spilled subtrees last."""
        for _, entry in self.entries():
            yield entry
        self.root = Node(b"")
        for path in self.spilled.values():
            trie = PatriciaTrie(self.largest, self.budget, self.scratch)
            with open(path, "rb") as rows:
                while True:
                    try:
                        trie.insert(*pickle.load(rows))
                    except EOFError:
                        break
            os.remove(path)
            yield from trie.owners()


PARTIAL = "n_bytes long, content long, digest binary, body binary, owner {kind}, number long"
GROUPS = "digest binary, keep_id {kind}, group_size long"
BATCH_BYTES = 16 << 20


def _partials(largest: bool, budget: int):
    """One row for each distinct text of a partition, or of as much of it as fits one trie."""

    def passed_on(trie: PatriciaTrie, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for body, (owner, number, (content, digest)) in trie.entries():
            rows.append((len(body), content, digest, body, owner, number))
            held += len(body) + 100
            if held > BATCH_BYTES:
                yield _partial_rows(rows, kind)
                rows, held = [], 0
        if rows:
            yield _partial_rows(rows, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kind = PatriciaTrie(largest), pa.null()
        for batch in batches:
            kind = batch.schema.field("owner").type
            for body, owner, content, digest in zip(*(batch.column(c).to_pylist() for c in ("body", "owner", "content", "digest")), strict=True):
                trie.insert(body, owner, 1, (content, digest))
                if trie.bytes > budget:
                    yield from passed_on(trie, kind)
                    trie = PatriciaTrie(largest)
        yield from passed_on(trie, kind)
        released()

    return run


def _partial_rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), kind, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["n_bytes", "content", "digest", "body", "owner", "number"])


def _tries(largest: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as scratch:
            trie, kind, rows = PatriciaTrie(largest, budget, scratch), pa.null(), []
            for batch in batches:
                kind = batch.schema.field("owner").type
                for row in zip(*(batch.column(c).to_pylist() for c in ("body", "owner", "number", "digest")), strict=True):
                    trie.insert(*row)
            for owner, number, digest in trie.owners():
                if number > 1:
                    rows.append((digest, owner, number))
                if len(rows) >= 50_000:
                    yield _groups(rows, kind)
                    rows = []
            if rows:
                yield _groups(rows, kind)
        released()

    return run


def _groups(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    digests, owners, numbers = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(owners, kind), pa.array(numbers, pa.int64())], names=["digest", "keep_id", "group_size"])


def exact_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", budget: int = TRIE_BYTES) -> DataFrame:
    """``docs`` plus ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    largest, own = {"smallest": False, "largest": True}[keep], apart(docs)
    kind = docs.schema[key].dataType.simpleString()
    digest_name, keep_name, size_name = own + "digest", own + "keep", own + "size"
    body = ascii_lower(F.coalesce(column(text), F.lit("")))
    digest = F.unhex(F.sha2(F.encode(body, "UTF-8"), 256))
    texts = docs.select(F.octet_length(body).cast("long").alias("n_bytes"), F.xxhash64(body).alias("content"), digest.alias("digest"), F.encode(body, "UTF-8").alias("body"), column(key).alias("owner"))
    partials = texts.mapInArrow(_partials(largest, budget), PARTIAL.format(kind=kind))
    groups = partials.repartition("n_bytes", "content").mapInArrow(_tries(largest, budget), GROUPS.format(kind=kind)).toDF(digest_name, keep_name, size_name)
    names = [column(c) for c in others(docs, "keep_id", "group_size", "kept", "text_sha256")]
    joined = docs.withColumn(digest_name, digest).join(groups, digest_name, "left")
    owner = F.when(F.col(size_name).isNull(), column(key)).otherwise(F.col(keep_name))
    return joined.select(*names, owner.alias("keep_id"), F.coalesce(size_name, F.lit(1)).cast("long").alias("group_size"), column(key).eqNullSafe(owner).alias("kept"), F.lower(F.hex(digest_name)).alias("text_sha256"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest") -> DataFrame:
    """One row of ``docs`` for each text: of the rows that bear the owner's identifier, or of those without any, one."""
    found = persisted(exact_duplicates(docs, text, key, keep).where("kept"))
    repeated = found.where("group_size > 1").dropDuplicates(["text_sha256"])  # one row a group, but for repeats of the owner's
    return found.where("group_size = 1").unionByName(repeated).select(*map(column, docs.columns))


def op1_exact_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)"""
