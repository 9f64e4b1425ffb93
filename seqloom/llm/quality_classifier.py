"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document, as built-in expressions over the
rule metrics. One pass over the texts, which splits each into words once for both, writes every document's votes and hashed word
features to the shared folder. Only the table of vote patterns (at most 3^labellers rows) leaves the cluster; on it, expectation-maximisation estimates the class balance and each
labeller's accuracies, assuming votes are independent given the class. The posteriors of all documents are the soft labels of a linear
scorer: limited-memory BFGS, whose losses and slopes are added up over all stored features by treeAggregate, one array a partition. The
cut of the scores is the one of least expected cost over all documents' vote posteriors, from running sums inside ranges of scores. No table
of labels is read, and nothing is estimated from a part of the rows.

Losses, slopes and costs are sums of whole multiples of 2^-30, so they do not depend on how rows are partitioned.

Defined results: null, empty and blank texts score 0 and are rejected; if all documents vote alike, the
scorer keeps what the posterior keeps; repeated rows score alike and train once (each by its share); null keys are keys; an empty table gives an
empty result; input columns named score or kept are replaced, others stay untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, column, list_sums, others, persisted
from .quality_rules import METRICS, STOP_WORDS

DIMENSIONS = 1 << 14
REPEATED, COPIED, BIAS, STUTTER = 0, 1, 2, 3  # features outside the hashed range
RESERVED = 4
SHARE = {"repeats": ("n_repeat_words / n_words", 0.05, 0.35), "symbols": ("n_symbols / n_words", 0.02, 0.15), "lines": ("n_dup_lines / greatest(n_lines, 1)", 0.01, 0.3), "shouts": ("n_shouts / n_words", 0.02, 0.2)}
RUN = 2 << 20  #: text bytes of which words are held at a time
UNIT = 1 << 30  #: sums are of whole parts of this size
HELD = 1 << 18  #: feature values of which slopes are made at a time


def labellers() -> dict[str, Column]:
    """Votes of each labeller over the measured columns: 1 good, -1 bad, 0 none."""
    votes = {name: F.when(F.expr(f"{share} <= {low}"), 1).when(F.expr(f"{share} >= {high}"), -1).otherwise(0) for name, (share, low, high) in SHARE.items()}
    words = F.expr("word_chars / n_words")
    votes["stop words"] = F.when(F.expr("n_stop_words / n_words >= 0.08"), 1).when(F.expr("n_stop_words / n_words < 0.02"), -1).otherwise(0)
    votes["variety"] = F.when(F.expr("n_words < 20"), 0).when(F.expr("n_distinct_words / n_words < 0.2"), -1).when(F.expr("n_distinct_words / n_words >= 0.3"), 1).otherwise(0)
    votes["word length"] = F.when(words.between(3, 9), 1).when((words < 2) | (words > 14), -1).otherwise(0)
    return votes


def voted(known: DataFrame) -> DataFrame:
    """``known``, which has COUNTS, plus ``_votes``: the labellers' votes as digits of base 3, the first one lowest; null without words."""
    safe = known.withColumn("_wordless", F.col("n_words") == 0).withColumn("n_words", F.greatest("n_words", F.lit(1)))
    digits = [(v.cast("int") + 1) * 3**i for i, v in enumerate(labellers().values())]
    return safe.withColumn("_votes", F.when(~F.col("_wordless"), sum(digits[1:], digits[0])))


def pattern_of(votes: int) -> list[int]:
    return [votes // 3**i % 3 - 1 for i in range(len(labellers()))]


class LabelModel:
    """Class balance and labeller accuracies by expectation-maximisation over vote patterns."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200):
        self.patterns, self.counts = patterns, counts
        bad, good = (patterns < 0).sum(axis=1), (patterns > 0).sum(axis=1)
        posterior = np.clip((good + 0.5) / (good + bad + 1) - 0.3 * (bad > 0), 0.05, 0.95)
        for _ in range(rounds):
            self.maximise(posterior)
            new = self.posterior(patterns)
            if np.abs(new - posterior).max() < 1e-9:
                break
            posterior = new

    def maximise(self, posterior: np.ndarray) -> None:
        weight = {1: posterior * self.counts, 0: (1 - posterior) * self.counts}
        self.balance = min(max(weight[1].sum() / self.counts.sum(), 0.5), 0.99)
        self.chances = {}
        for c, w in weight.items():
            votes = np.stack([((self.patterns == v) * w[:, None]).sum(axis=0) for v in (-1, 0, 1)])
            self.chances[c] = (votes + 1.0) / (w.sum() + 3.0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good."""
        at = np.arange(patterns.shape[1])
        logs = {c: np.log(self.chances[c][patterns + 1, at]).sum(axis=1) for c in (0, 1)}
        odds = math.log(self.balance / (1 - self.balance)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller when it votes."""
        right = self.balance * self.chances[1][2] + (1 - self.balance) * self.chances[0][0]
        wrong = self.balance * self.chances[1][0] + (1 - self.balance) * self.chances[0][2]
        return right / (right + wrong)


class Words:
    """Words of a batch of texts as numbers of a dictionary, text after text, and where each text's begin, and end."""

    def __init__(self, texts: pa.Array):
        self.texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(self.texts)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten()
        filled = pc.not_equal(flat, "")
        self.offsets = np.concatenate(([0], np.cumsum(filled.to_numpy(zero_copy_only=False))))[offsets]
        coded = flat.filter(filled).dictionary_encode()
        self.dictionary, self.codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.sizes = np.diff(self.offsets)
        self.rows = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.distinct = _distinct(self.rows, self.codes, len(self.sizes))

    def summed(self, values: pa.Array | np.ndarray) -> np.ndarray:
        """Sums over each text's words of what each word of the dictionary has."""
        return list_sums(np.asarray(values).astype(np.int64)[self.codes], self.offsets)


def _begins(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    return np.concatenate((np.ones(len(values[:1]), bool), values[1:] != values[:-1]))


def _distinct(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """How many different codes each of ``n`` rows has."""
    span = int(codes.max(initial=0)) + 1
    keys = np.sort(rows * span + codes)
    return np.bincount(keys[_begins(keys)] // span, minlength=n)


def _repeats(words: Words) -> np.ndarray:
    """How many words of each text lie in a three-word window found at least twice in it."""
    starts = np.flatnonzero(words.rows[2:] == words.rows[:-2])
    keys, span = words.rows[starts], len(words.dictionary)
    for i in range(3):
        if (int(keys.max(initial=0)) + 1) * span >= 1 << 63:
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * span + words.codes[starts + i]
    order = np.argsort(keys)
    again = np.flatnonzero(~_begins(keys[order]))
    held = np.zeros(len(words.codes), bool)
    for first in (starts[order[again]], starts[order[again - 1]]):
        for i in range(3):
            held[first + i] = True
    return list_sums(held.astype(np.int64), words.offsets)


#: What labellers read: the rule metrics, as :func:`quality_rules.measured` defines them, and words that end in two exclamation marks.
COUNTS = (*METRICS, "n_shouts")
SYMBOL, LOWER = (np.isin(np.arange(256), list(signs)) for signs in (b"#*$%&|<>", b"abcdefghijklmnopqrstuvwxyz"))


def counted(words: Words) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n = len(words.sizes)
    split = pc.split_pattern(words.texts, "\n")
    lines, rows = split.flatten(), pc.list_parent_indices(split).to_numpy().astype(np.int64)
    filled = pc.not_equal(pc.ascii_trim_whitespace(lines), "")
    rows = rows[filled.to_numpy(zero_copy_only=False)]
    n_lines = np.bincount(rows, minlength=n)
    data, ends = _bytes_of(words.dictionary, np.uint8)
    shouts = words.summed(pc.ends_with(words.dictionary, "!!"))
    for end in "\u0085\u2028\u2029":  # a line's end that is no white space of words
        shouts = shouts + pc.ends_with(words.texts, "!!" + end).to_numpy(zero_copy_only=False)
    return {
        "n_words": words.sizes,
        "word_chars": words.summed(pc.utf8_length(words.dictionary)),
        "n_symbols": words.summed(list_sums(SYMBOL[data], ends)),
        "n_dup_lines": n_lines - _distinct(rows, lines.filter(filled).dictionary_encode().indices.to_numpy().astype(np.int64), n),
        "n_lines": n_lines,
        "n_repeat_words": _repeats(words),
        "n_stop_words": words.summed(pc.is_in(words.dictionary, pa.array(STOP_WORDS))),
        "n_distinct_words": words.distinct,
        "n_shouts": shouts,
    }


#: What makes the shape of a word: letter classes and digits, runs collapsed; signs stay.
SHAPE = ((r"\p{N}+", "0"), (r"\p{Lu}+", "\x01"), (r"\p{L}+", "a"), ("\x01", "A"))


def _shortened(words: pa.Array) -> pa.Array:
    """``words`` with one letter a for each run of a-z."""
    data, offsets = _bytes_of(words, np.uint8)
    lower, begins = LOWER[data], np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    left = ~lower
    left[:1] = True
    left[1:] |= ~lower[:-1]
    left |= begins[:-1]
    ends = np.concatenate(([0], np.cumsum(left)))[offsets]
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.where(lower, ord("a"), data)[left].astype(np.uint8)))


def word_features(words: pa.Array) -> np.ndarray:
    """Three hashed features of each word: its shape, its last two letters, its letters in lower case."""
    # runs of a-z first: few forms are left for the classes of all letters, and their shapes stay the same
    forms = _shortened(words).dictionary_encode()
    shapes = forms.dictionary
    for pattern, sign in SHAPE:
        shapes = pc.replace_substring_regex(shapes, pattern, sign)
    lowered = pc.utf8_lower(words)
    signed = pc.invert(pc.ascii_is_alnum(lowered))
    letters = pc.replace_with_mask(lowered, signed, pc.replace_substring_regex(lowered.filter(signed), r"[^\p{L}\p{N}_]+", ""))
    out = np.empty((len(words), 3), np.int64)
    for i, (kind, part) in enumerate({"s": shapes, "e": pc.utf8_slice_codeunits(lowered, -2), "w": letters}.items()):
        coded = part.dictionary_encode()
        named = pc.binary_join_element_wise(kind, coded.dictionary, "").cast(pa.binary()).to_numpy(zero_copy_only=False)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, named), np.uint64, len(named)) % (DIMENSIONS - RESERVED)
        found = hashed.astype(np.int64)[coded.indices.to_numpy()]
        out[:, i] = RESERVED + (found[forms.indices.to_numpy()] if kind == "s" else found)
    return out


def sparse(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and values of all texts, and where each text's begin, and end: square roots of shares, so that frequent words do not drown
    the others."""
    n, sizes = len(words.sizes), np.maximum(words.sizes, 1)
    keys = np.sort((words.rows[:, None] * DIMENSIONS + word_features(words.dictionary)[words.codes]).ravel())
    at = np.flatnonzero(_begins(keys))
    times, (rows, found) = np.diff(at, append=len(keys)), np.divmod(keys[at], DIMENSIONS)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n) + RESERVED)))
    columns, values = np.empty(offsets[-1], np.int32), np.empty(offsets[-1])
    places = np.arange(len(at)) + RESERVED * (rows + 1)
    columns[places], values[places] = found, times / sizes[rows]
    same = (words.codes[1:] == words.codes[:-1]) & (words.rows[1:] == words.rows[:-1])
    repeated = np.bincount(words.rows[1:][same], minlength=n) / sizes
    for feature, value in ((REPEATED, repeated), (COPIED, (words.sizes - words.distinct) / sizes), (BIAS, 1.0), (STUTTER, repeated >= 0.15)):
        columns[offsets[:-1] + feature], values[offsets[:-1] + feature] = feature, value
    return columns, np.sqrt(values).astype(np.float32), offsets


def vectors(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and values of each text."""
    columns, values, offsets = sparse(Words(texts))
    for a, b in pairwise(offsets.tolist()):
        yield columns[a:b], values[a:b]


class LinearScorer:
    """Logistic regression on hashed features."""

    def __init__(self, weights: np.ndarray, cut: float = 0.5):
        self.weights, self.cut = weights, cut

    def of(self, found: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of feature vectors; those without words get 0."""
        odds = np.array([self.weights[c] @ v if len(c) > RESERVED else -50.0 for c, v in found], float)
        return np.where(odds <= -50, 0.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))


STUDIED = "struct<columns:binary,weights:binary," + ",".join(f"{name}:long" for name in COUNTS) + ">"


def _studied(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Features and COUNTS of each text."""
    for texts in arrays:
        parts: list[list[pa.Array]] = [[pa.array([], pa.binary())] * 2 + [pa.array([], pa.int64())] * len(COUNTS)]
        for part in byte_slices(pa.RecordBatch.from_arrays([texts], names=["_text"]), "_text", RUN):
            words = Words(part.column("_text"))
            columns, values, offsets = sparse(words)
            found = counted(words)
            parts.append([_as_bytes(columns.astype(np.uint16), offsets), _as_bytes(values, offsets), *(pa.array(found[name], pa.int64()) for name in COUNTS)])
        yield pa.StructArray.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], ["columns", "weights", *COUNTS])


def _as_bytes(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of each row's numbers."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def _bytes_of(values: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary array and where each row's begin, and end."""
    values = values.cast(pa.binary())
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(values.buffers()[2] or b"", kind, (offsets[-1] - offsets[0]) // size, offsets[0]), (offsets - offsets[0]) // size


def _stored_vectors(features: pa.StructArray) -> list[tuple[np.ndarray, np.ndarray]]:
    (columns, offsets), (values, _) = _bytes_of(features.field("columns"), np.uint16), _bytes_of(features.field("weights"), np.float32)
    return [(columns[a:b], values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


class Slopes:
    """Loss and its slope over batches of stored rows: whole parts of UNIT, as Python tasks and the driver add them up."""

    def __init__(self, weights: np.ndarray, targets: np.ndarray, squares: bool = False):
        self.weights, self.targets, self.squares = weights, targets, squares

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            columns, offsets = _bytes_of(batch.column("columns"), np.uint16)
            values, _ = _bytes_of(batch.column("weights"), np.float32)
            good, share = self.targets[batch.column("_votes").to_numpy()], 1 / batch.column("_times").to_numpy()
            start = 0
            while start < batch.num_rows:
                stop = max(int(np.searchsorted(offsets, offsets[start] + HELD, side="right")) - 1, start + 1)
                a, b = offsets[start], offsets[stop]
                part = self.of(columns[a:b].astype(np.int64), values[a:b].astype(float), offsets[start : stop + 1] - a, good[start:stop], share[start:stop])
                total = part if total is None else total + part
                start = stop
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["data"])

    def of(self, columns: np.ndarray, values: np.ndarray, offsets: np.ndarray, good: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Sums of rows, of losses, of slopes and (where wanted) of squares."""
        odds = np.clip(np.add.reduceat(self.weights[columns] * values, offsets[:-1]), -50, 50)
        losses = share * (np.logaddexp(0, odds) - good * odds)
        sizes = np.diff(offsets)
        slopes = np.rint(UNIT * values * np.repeat(share * (1 / (1 + np.exp(-odds)) - good), sizes))
        sums = [[np.rint(UNIT * share).sum(), np.rint(UNIT * losses).sum()], np.bincount(columns, slopes, DIMENSIONS)]
        if self.squares:
            sums.append(np.bincount(columns, np.rint(UNIT * values**2 * np.repeat(share, sizes)), DIMENSIONS))
        return np.concatenate(sums).astype(np.int64)


def trained(rows: DataFrame, targets: np.ndarray, rounds: int = 25, decay: float = 1e-4, least: float = 1e-4) -> LinearScorer:
    """Logistic regression on all ``rows`` by limited-memory BFGS, until a round betters the loss by less than its ``least`` part.

    ``targets`` has the chance to be good of each value of ``_votes``. A round reads all stored features once, or more often where its step is
    too long; the driver gets three arrays of DIMENSIONS numbers at most from each of a few tasks.
    """

    def at(weights: np.ndarray, squares: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        parts = rows.mapInArrow(Slopes(weights, targets, squares), "data binary").rdd
        size = 2 + (1 + squares) * DIMENSIONS
        add = lambda total, more: total + (np.frombuffer(more["data"], np.int64) if isinstance(more, tuple) else more)
        total = parts.treeAggregate(np.zeros(size, np.int64), add, add, depth=2)
        mean = total[1:] / total[0]
        return mean[0] + decay / 2 * weights @ weights, mean[1 : 1 + DIMENSIONS] + decay * weights, mean[1 + DIMENSIONS :]

    weights = np.zeros(DIMENSIONS)
    loss, slope, squares = at(weights, squares=True)
    inner = 1 / (squares / 4 + decay)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, used = -slope, []
        for s, y in reversed(past):
            used.append(s @ way / (s @ y))
            way = way - used[-1] * y
        scale = past[-1][0] @ past[-1][1] / (past[-1][1] @ (inner * past[-1][1])) if past else 0.25
        way = scale * inner * way
        for (s, y), x in zip(past, reversed(used), strict=True):
            way = way + (x - y @ way / (s @ y)) * s
        fall, step = slope @ way, 1.0
        while step > 1e-6:
            new = weights + step * way
            new_loss, new_slope, _ = at(new)
            if new_loss <= loss + 1e-4 * step * fall:
                break
            step *= min(max(-fall * step / (2 * (new_loss - loss - step * fall)), 0.1), 0.5)
        else:
            break
        if (new - weights) @ (new_slope - slope) > 0:
            past = [*past[-9:], (new - weights, new_slope - slope)]
        done = loss - new_loss < least * loss
        weights, loss, slope = new, new_loss, new_slope
        if done:
            break
    return LinearScorer(weights)


def cheapest_cut(scored: DataFrame) -> float:
    """The cut of least expected cost of rows (score, lost, wrong): rows below it are lost and cost ``lost``, rows above are kept and
    cost ``wrong``, both whole numbers. Of several cuts the one in the widest gap between scores; it lies above 0."""
    levels = scored.groupBy("score").agg(F.sum("lost").alias("lost"), F.sum("wrong").alias("wrong"))
    levels = persisted(levels.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    parts = levels.groupBy("part").agg(F.min("score").alias("least"), F.sum("lost").alias("lost"), F.sum("wrong").alias("wrong")).orderBy("least").collect()
    if not parts:
        return 0.5
    cost = sum(p["wrong"] for p in parts)
    best = [(cost, -parts[0]["least"], 0.0)] if parts[0]["least"] > 0 else []
    starts = []
    for p, after in zip(parts, [*(p["least"] for p in parts[1:]), 1.0], strict=True):
        starts.append((p["part"], cost, after))
        cost += p["lost"] - p["wrong"]
    w = Window.partitionBy("part").orderBy("score")
    edges = levels.join(F.broadcast(scored.sparkSession.createDataFrame(starts, "part int, cost long, after double")), "part")
    edges = edges.select("score", (F.col("cost") + F.sum(F.col("lost") - F.col("wrong")).over(w)).alias("cost"), (F.coalesce(F.lead("score").over(w), "after") - F.col("score")).alias("gap"))
    found = edges.where("gap > 0").agg(F.min(F.struct("cost", -F.col("gap"), "score"))).first()[0]
    _, gap, edge = min([*best, *([tuple(found)] if found else [])])
    return edge - gap / 2


def prepared(docs: DataFrame, columns: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``columns`` of ``docs`` plus ``_order``, ``_votes`` and ``_features`` of every row, written once."""
    names = [f"_{i}" for i in range(len(columns))]
    own = docs.select(*(column(c).alias(n) for c, n in zip(columns, names, strict=True)), column(text).alias("_text"), F.xxhash64(column(key), column(text)).alias("_order"))
    # not deterministic in name, so that the many uses of its counts do not repeat it
    made = own.select(*names, "_order", F.arrow_udf(_studied, STUDIED).asNondeterministic()("_text").alias("_made"))
    known = made.select(*names, "_order", F.struct("_made.columns", "_made.weights").alias("_features"), *(f"_made.{name}" for name in COUNTS))
    return persisted(voted(known).select(*names, "_order", "_votes", "_features"))


def fitted(stored: DataFrame, lost_cost: float = 1.0) -> LinearScorer:
    """The scorer of all :func:`prepared` rows, with its cut. A row that occurs n times trains n times with an nth of its weight."""
    usable = stored.where("_votes IS NOT NULL")
    counted = usable.groupBy("_votes").agg(F.count(F.lit(1)).alias("n")).orderBy("_votes").collect()
    if not counted:
        return LinearScorer(np.zeros(DIMENSIONS))
    patterns = np.array([pattern_of(r["_votes"]) for r in counted])
    posterior = LabelModel(patterns, np.array([r["n"] for r in counted], float)).posterior(patterns)
    targets = np.zeros(3 ** patterns.shape[1])
    targets[[r["_votes"] for r in counted]] = posterior

    rows = usable.select("_order", "_votes", "_features.columns", "_features.weights")
    again = persisted(rows.groupBy("_order").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"))
    if again.isEmpty():
        rows = rows.withColumn("_times", F.lit(1).cast("long"))
    else:
        rows = persisted(rows.join(again, "_order", "left").withColumn("_times", F.coalesce("_times", F.lit(1).cast("long"))))
    scorer = trained(rows.drop("_order"), targets)

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, share = targets[batch.column("_votes").to_numpy()], 1 / batch.column("_times").to_numpy()
            scores = scorer.of(_stored_vectors(pa.StructArray.from_arrays([batch.column("columns"), batch.column("weights")], ["columns", "weights"])))
            lost, wrong = (np.rint(UNIT * share * x).astype(np.int64) for x in (lost_cost * good, 1 - good))
            yield pa.RecordBatch.from_arrays([pa.array(scores), pa.array(lost), pa.array(wrong)], names=["score", "lost", "wrong"])

    scorer.cut = cheapest_cut(rows.drop("_order").mapInArrow(costs, "score double, lost long, wrong long"))
    return scorer


def classified(docs: DataFrame, text: str = "text", key: str = "doc_id", lost_cost: float = 1.0, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (all by default) of ``docs`` plus ``score`` (chance of good quality) and ``kept``: whether keeping costs less, when to lose a
    good document costs ``lost_cost`` times as much as to keep a bad one.

    Where ``columns`` are named they are written beside the features, and scores come from these; else texts are read anew, so that
    no second copy of them is written.
    """
    names = others(docs, "score", "kept") if columns is None else columns
    stored = prepared(docs, columns or [], text, key)
    scorer = fitted(stored, lost_cost)

    def of_texts(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in arrays:
            batch = pa.RecordBatch.from_arrays([texts], names=["_text"])
            parts = [scorer.of(vectors(part.column("_text"))) for part in byte_slices(batch, "_text", RUN)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    def of_features(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for features in arrays:
            yield pa.array(scorer.of(_stored_vectors(features)), pa.float64())

    # not deterministic in name, so that no filter above repeats it
    if columns is None:
        scored = docs.select(*(column(c) for c in names), F.arrow_udf(of_texts, "double").asNondeterministic()(column(text)).alias("score"))
    else:
        score = F.arrow_udf(of_features, "double").asNondeterministic()
        scored = stored.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)), score("_features").alias("score"))
    return scored.withColumn("kept", F.col("score") >= scorer.cut)


def op7_quality_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classified(docs, columns=["doc_id"])
