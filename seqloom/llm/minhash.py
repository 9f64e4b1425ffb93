"""Near-duplicates by SetSketch registers.

1. Sketch: each text becomes its set of word-shingle hashes. A register holds the minimum over the set of
   one hash function, read as an exponential variable and truncated on the scale of powers of ``BASE``;
   registers of a union are the maxima of registers, and two of them agree about as often as the sets'
   Jaccard similarity. Equal sets (by fingerprint) become one class, named by its smallest identifier.
2. Bands: runs of registers are hashed to bucket names. Buckets of one class vanish, and buckets
   with the same members count once, so a small family travels once and not once per band.
3. Verify: the texts of classes in shared buckets are read again and their full sets sent to the
   buckets. In a task, members already connected need no comparison; others must share a rare
   shingle of their prefix (exact filter), pass the registers' joint likelihood (a pair is left out only when
   the threshold is e^-25 as likely as the best estimate), and then have their full sets intersected.
   A task returns a star per connected part: at most one edge per member, never all pairs.
   A bucket above ``PART`` members or ``PART_SHINGLES`` shingles is dealt into parts of about that size, and a few leaders of it go to every part, so that the parts of a
   family meet. Pairs of members that are connected then need no more. Only where a bucket has members outside its largest component,
   these (again in parts) meet the members of all other parts: no pair of a bucket is left out, and no set is sent again for a family
   that the leaders connect.
4. Connect: stars of all buckets become components by contraction in DataFrames.

With r registers in each of n bands, a pair at similarity s meets nowhere with probability (1 - s^r)^n: for the
defaults 8e-6 exactly at 0.85, 2e-8 at 0.9.

Defined results: null, empty and blank texts have no shingles, link with nothing and stay alone; texts
of fewer words than a shingle are one shingle; a repeated row belongs to its text's class; rows with a null
identifier are compared like others, under numbers above all identifiers, so they never name a component that has
one (a component of such rows alone is null, and one of its rows is kept); keys that are no integers are taken in their own order, over
numbered rows; an empty table gives an empty result; columns other than key and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import byte_slices, column, persisted
from .components import components

ROWS = 1 << 52  #: above any row number that Spark gives to fewer than 2^19 partitions

BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
PART, PART_SHINGLES, LEADERS = 3000, 4 << 20, 16  #: members and shingles of a task's part, leaders of a bucket of several parts
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    by %= 64
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def word_codes(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words of all texts in a row, dictionary-coded, and the texts' offsets among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    filled = pc.not_equal(flat, "")
    before = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))
    return flat.filter(filled).dictionary_encode(), before[offsets]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles."""
    coded, offsets = word_codes(texts)
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = _mixed(names)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    n = len(words)
    windows = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        windows ^= _rotated(words[j : j + len(windows)] * (MIX[0] + np.uint64(2 * j)), 17 * j)
    windows = _mixed(windows)
    out = []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if stop - start >= k:
            out.append(np.unique(windows[start : stop - k + 1]))
        elif stop > start:
            short = np.uint64(stop - start)
            for j in range(start, stop):
                short = short ^ _rotated(words[j : j + 1] * (MIX[1] + np.uint64(2 * (j - start))), 17 * (j - start) + 5)
            out.append(_mixed(np.atleast_1d(short)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class SetSketch:
    """Registers of sets of 64-bit hashes."""

    def __init__(self, registers: int):
        random = np.random.default_rng(20240607)
        self.flip = random.integers(0, 1 << 32, (registers, 1), np.uint32)
        self.factor = random.integers(0, 1 << 31, (registers, 1), np.uint32) * np.uint32(2) + np.uint32(1)

    def registers(self, members: np.ndarray) -> np.ndarray:
        short = (members >> np.uint64(32)).astype(np.uint32) ^ members.astype(np.uint32)
        least = np.full(len(self.flip), np.uint32(0xFFFFFFFF))
        for i in range(0, len(short), 2048):
            least = np.minimum(least, ((short[None, i : i + 2048] ^ self.flip) * self.factor).min(axis=1))
        exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
        return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, TOP).astype(np.uint16)

    @staticmethod
    def merged(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Registers of the union."""
        return np.maximum(one, two)


class JointLikelihood:
    """Log-likelihood of a Jaccard similarity, given how two sketches' registers compare and the set sizes."""

    def __init__(self, threshold: float, margin: float = 25.0):
        self.threshold, self.margin = threshold, margin

    def plausible(self, above: np.ndarray, below: np.ndarray, equal: np.ndarray, n: float, others: np.ndarray) -> np.ndarray:
        """Whether a similarity of at least the threshold is not e^-margin less likely than the best one."""
        grid = np.linspace(0.0, 1.0, 101)
        u, v = (n / (n + others))[:, None], (others / (n + others))[:, None]
        j = np.minimum(grid[None, :], np.minimum(u / v, v / u) - 1e-9)
        share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
        up, down = share(u - v * j), share(v - u * j)
        logs = lambda x: np.log(np.maximum(x, 1e-12))
        fit = above[:, None] * logs(up) + below[:, None] * logs(down) + equal[:, None] * logs(1 - up - down)
        return fit[:, grid >= self.threshold - 1e-9].max(axis=1) >= fit.max(axis=1) - self.margin


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(bands * rows)
        salts = np.arange(1, bands + 1, dtype=np.uint64) * MIX[1]
        for batch in batches:
            for part in byte_slices(batch, "_text", 8 << 20):
                sets = shingle_sets(part.column("_text"), k)
                prints, keys = [], np.zeros((len(sets), bands), np.uint64)
                for i, members in enumerate(sets):
                    prints.append(blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None)
                    if len(members):
                        values = sketch.registers(members).reshape(bands, rows).astype(np.uint64)
                        name = salts.copy()
                        for r in range(rows):
                            name = _mixed(name ^ (values[:, r] + np.uint64(0x9E3779B97F4A7C15)))
                        keys[i] = name
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), lists], names=["id", "n_shingles", "print", "bands"]
                )

    return run


def _full_sets(k: int, registers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SetSketch(registers)
        for batch in batches:
            for part in byte_slices(batch, "_text", 8 << 20):
                sets = shingle_sets(part.column("_text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary()), pa.array([sketch.registers(s).tobytes() for s in sets], pa.binary()), part.column("places")],
                    names=["id", "members", "registers", "places"],
                )

    return run


class Family:
    """The members of a bucket (or of two of its parts), and the links among them; members of one label are connected already."""

    def __init__(self, ids: list[int], sides: list[int], labels: list[int], members: list[np.ndarray], registers: np.ndarray, percent: int):
        order = sorted(range(len(ids)), key=lambda i: (len(members[i]), ids[i]))
        self.ids, self.sides = [ids[i] for i in order], [sides[i] for i in order]
        self.members, self.registers, self.percent = [members[i] for i in order], registers[order], percent
        self.parent = list(range(len(ids)))
        known: dict[int, int] = {}
        for i, label in enumerate(labels[j] for j in order):
            self.link(i, known.setdefault(label, i))
        self.likely = JointLikelihood(percent / 100)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def stars(self) -> list[tuple[int, int]]:
        """(member, centre) edges of the connected parts of two or more."""
        sizes = [len(m) for m in self.members]
        vocabulary, codes = np.unique(np.concatenate(self.members), return_inverse=True)
        counts = np.bincount(codes)
        ranks = np.empty(len(vocabulary), np.int64)
        ranks[np.argsort(counts, kind="stable")] = np.arange(len(vocabulary))
        coded = [np.sort(x) for x in np.split(ranks[codes], np.cumsum(sizes)[:-1])]
        del codes
        shared = counts[np.argsort(counts, kind="stable")] > 1
        posted: dict[int, list[int]] = {}
        marks = np.zeros(len(vocabulary), bool)
        two_sided = len(set(self.sides)) > 1
        for i, own in enumerate(coded):
            least = -(-self.percent * sizes[i] // 100)
            prefix = own[: sizes[i] - least + 1]
            prefix = prefix[shared[prefix]].tolist()
            found: set[int] = set()
            for token in prefix:
                found.update(posted.setdefault(token, []))
            mine = self.find(i)
            others = np.array([j for j in found if sizes[j] >= least and self.find(j) != mine and not (two_sided and self.sides[i] == self.sides[j])], np.int64)
            if len(others):
                self.compare(i, others, coded, sizes, marks)
            for token in prefix:
                posted[token].append(i)
        centre: dict[int, int] = {}
        for i in range(len(self.ids)):
            root = self.find(i)
            centre[root] = min(centre.get(root, self.ids[i]), self.ids[i])
        return [(self.ids[i], centre[self.find(i)]) for i in range(len(self.ids)) if self.ids[i] != centre[self.find(i)]]

    def compare(self, i: int, others: np.ndarray, coded: list[np.ndarray], sizes: list[int], marks: np.ndarray) -> None:
        mine, theirs = self.registers[i], self.registers[others]
        equal, above = (theirs == mine).sum(axis=1), (theirs < mine).sum(axis=1)
        below = theirs.shape[1] - equal - above
        likely = self.likely.plausible(above, below, equal, sizes[i], np.array([sizes[j] for j in others], float))
        others = others[likely][np.argsort(-equal[likely], kind="stable")]
        marks[coded[i]] = True
        for j in others.tolist():
            if self.find(i) != self.find(j):
                both = int(marks[coded[j]].sum())
                if 100 * both >= self.percent * (sizes[i] + sizes[j] - both):
                    self.link(i, j)
        marks[coded[i]] = False


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []
        for batch in batches:
            out = []
            buckets, ones, twos = (batch.column(c).to_pylist() for c in ("bucket", "one", "two"))
            ids, sides, labels, members, registers = (batch.column(c) for c in ("id", "side", "label", "members", "registers"))
            for i, now in enumerate(zip(buckets, ones, twos, strict=True)):
                if now != name:
                    out += _stars(rows, percent)
                    name, rows = now, []
                rows.append((ids[i].as_py(), sides[i].as_py(), labels[i].as_py(), np.frombuffer(members[i].as_py(), np.uint64), np.frombuffer(registers[i].as_py(), np.uint16)))
            if out:
                yield _edges(out)
        if out := _stars(rows, percent):
            yield _edges(out)

    return run


def _stars(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    if len(rows) < 2:
        return []
    ids, sides, labels, members, registers = zip(*rows, strict=True)
    return Family(list(ids), list(sides), list(labels), list(members), np.stack(registers), percent).stars()


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _numbered(source: DataFrame) -> tuple[DataFrame, int | None]:
    """``source`` with a number for every null identifier, and the largest real one (None where none is null)."""
    nulls = persisted(source.where("_key IS NULL").withColumn("_key", F.monotonically_increasing_id()))
    if nulls.isEmpty():
        return source, None
    top = source.agg(F.max("_key")).first()[0]
    top = -1 if top is None else top
    if top + ROWS >= 1 << 63:
        raise ValueError("no numbers are left above the identifiers for the rows without one")
    return source.where("_key IS NOT NULL").unionByName(nulls.withColumn("_key", F.col("_key") + F.lit(top + 1))), top


PLACE = "struct<bucket: long, one: int, two: int, side: int, label: long>"


def _verified(source: DataFrame, placed: DataFrame, k: int, registers: int, percent: int) -> DataFrame:
    """Stars of the links in each place (bucket, one, two); ``placed`` has a row for each member (rep) of each."""
    places = placed.groupBy("rep").agg(F.collect_list(F.struct("bucket", "one", "two", "side", "label")).alias("places"))
    sets = source.join(places, source["_key"] == places["rep"]).select("_key", "_text", "places").mapInArrow(_full_sets(k, registers), f"id long, members binary, registers binary, places array<{PLACE}>")
    # a repeated row of a representative sends its set again, which links nothing new
    sent = sets.select("id", "members", "registers", F.explode("places").alias("place")).select("id", "members", "registers", "place.*")
    sent = sent.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return sent.mapInArrow(_verify(percent), "a long, b long")


def _first_places(banded: DataFrame, part: int, leaders: int, shingles: int) -> DataFrame:
    """Members of shared buckets, dealt into parts; some leaders of a bucket of several parts go to all of them."""
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("rep")).alias("mark"), F.sum(F.hash("rep").cast("long")).alias("total"), F.sum("weight").alias("load")).where("size > 1")
    chosen = buckets.groupBy("size", "mark", "total", "load").agg(F.min("bucket").alias("bucket"))
    placed = banded.join(chosen, "bucket").withColumn("parts", F.greatest(F.ceil(F.col("size") / part), F.ceil(F.col("load") / shingles)).cast("int")).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    leads = (F.col("parts") > 1) & (F.pmod(F.xxhash64(F.lit("lead"), "rep", "bucket"), F.ceil(F.col("size") / leaders)) == 0)
    return placed.withColumn("one", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))))


def _second_places(first: DataFrame, linked: DataFrame, part: int, shingles: int) -> DataFrame:
    """In buckets of several parts that are not connected yet: all members, against those outside the largest component."""
    big = first.where("parts > 1 AND one = mine").select("rep", "bucket", "parts", "mine", "weight")
    labelled = big.join(linked, big["rep"] == linked["node"], "left").select("rep", "bucket", "parts", "mine", "weight", F.coalesce("component", "rep").alias("label"))
    counts = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))
    open_ones = counts.groupBy("bucket").agg(F.max(F.struct("n", "label", "w")).alias("top"), F.sum("n").alias("size"), F.sum("w").alias("load"))
    groups = F.greatest(F.ceil((F.col("size") - F.col("top.n")) / part), F.ceil((F.col("load") - F.col("top.w")) / shingles))
    open_ones = open_ones.select("bucket", F.col("top.label").alias("largest"), groups.cast("int").alias("groups"))
    waiting = labelled.join(open_ones.where("groups > 0"), "bucket")
    own = F.pmod(F.xxhash64(F.lit("rest"), "rep"), F.col("groups")).cast("int")
    member = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda j: F.struct(F.col("mine").alias("one"), j.alias("two"), F.lit(0).alias("side")))
    against = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: i != F.col("mine")), lambda i: F.struct(i.alias("one"), own.alias("two"), F.lit(1).alias("side")))
    everywhere = F.when(F.col("label") != F.col("largest"), F.concat(member, against)).otherwise(member)
    return waiting.select("rep", "bucket", "label", F.explode(everywhere).alias("place")).select("rep", "bucket", "label", "place.*")


def _named(sketches: DataFrame, names: DataFrame) -> DataFrame:
    """``sketches`` with the component of their print. Prints of a thousandth of the rows or more are joined by broadcast: there are
    a thousand at most."""
    rows = max(sketches.count(), 1)
    hot = F.broadcast(names.where(F.col("copies") * 1000 >= F.lit(rows)).drop("copies"))
    cold = names.where(F.col("copies") * 1000 < F.lit(rows)).drop("copies")
    return sketches.join(hot, "print").unionByName(sketches.join(hot, "print", "left_anti").join(cold, "print", "left"))


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 20, rows: int | None = None, text: str = "text", key: str = "doc_id", part: int = PART, leaders: int = LEADERS, shingles: int = PART_SHINGLES
) -> DataFrame:
    """One row per document: the key, n_shingles, component_id and kept."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        return _by_row(docs, text, key, lambda numbered: near_duplicates(numbered, k, percent, bands, rows, text, "_row", part, leaders, shingles))
    rows = rows or (5 if percent >= 84 else 4)
    source = docs.select(column(key).cast("long").alias("_key"), column(text).alias("_text"))
    source, top = _numbered(source)
    sketches = persisted(source.mapInArrow(_sketch(k, bands, rows), "id long, n_shingles long, print binary, bands array<long>"))
    classes = sketches.where("print IS NOT NULL").groupBy("print").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n_shingles").alias("weight"))
    banded = persisted(classes.select("rep", "weight", F.explode("bands").alias("bucket")))

    first = _first_places(banded, part, leaders, shingles)
    edges = _verified(source, first.select("rep", "bucket", "one", F.lit(0).alias("two"), F.lit(0).alias("side"), F.col("rep").alias("label")), k, bands * rows, percent)
    linked = persisted(components(edges))
    if not first.where("parts > 1").isEmpty():
        more = persisted(_second_places(first, linked, part, shingles))
        if not more.isEmpty():
            stars = linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
            linked = persisted(components(stars.unionByName(_verified(source, more, k, bands * rows, percent))))

    names = classes.join(linked, classes["rep"] == linked["node"], "left").where("copies > 1 OR component IS NOT NULL").select("print", "copies", F.coalesce("component", "rep").alias("component"))
    own, component = F.col("id"), F.coalesce("component", "id")
    real = (lambda x: x) if top is None else (lambda x: F.when(x <= top, x))
    return _named(sketches.select("id", "n_shingles", "print"), names).select(real(own).alias(key), "n_shingles", real(component).alias("component_id"), own.eqNullSafe(component).alias("kept"))


def _by_row(docs: DataFrame, text: str, key: str, found_in) -> DataFrame:
    """For keys that are no integers: rows are numbered, and a component gets the smallest key of its rows."""
    numbered = persisted(docs.select(column(key).alias("_name"), column(text).alias(text)).withColumn("_row", F.monotonically_increasing_id()))
    found = numbered.select("_row", "_name").join(found_in(numbered), "_row")
    names = found.groupBy("component_id").agg(F.min("_name").alias("_least"))
    kept = F.when(F.col("_least").isNull(), F.col("kept")).otherwise(F.col("_name").eqNullSafe(F.col("_least")))
    return found.join(names, "component_id").select(F.col("_name").alias(key), "n_shingles", F.col("_least").alias("component_id"), kept.alias("kept"))


def op3_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)
