"""Toxicity behind a noisy channel: deobfuscate, then score.

A character trigram model is counted over the words of all documents (its table is bounded by the
alphabet: 64^3 cells). A word that may be disguised -- digits or signs among letters or instead of them, a letter
repeated, letters that look like others, or parts set apart -- becomes a lattice (:mod:`.channel`), and Viterbi decoding finds its
likeliest reading, whatever its length; a word with inner marks is also read part by part, and one with masked letters (``*#%?``) that reads as nothing
listed is held against the listed words of its length. Words written in several parts are found
by the joined skeletons of neighbouring words and read with the spaces in the lattice, so they count only where one word is likelier
than several.

Evidence is learnt from a bounded sample of labelled training rows, as written and as decoded: words and word beginnings whose
share of toxic documents is significant (binomial tail, Bonferroni-corrected). The level of significance is the one of the least
log loss when each third of these training rows is scored with evidence of the other two; no other label is read. A document's score is
the posterior of a naive Bayes model over the distinct features found in it (each word giving its most significant one).

Every distinct word of a run is decoded and weighed once. The pass over the documents is scan -> map;
only feature counts of the sample are shuffled.

Defined results: null and empty texts get the bare prior (half the base rate, as they show no listed word); without
usable labels every score is 0.01; rows with a null identifier are not held out; repeated rows are scored each; a labelled
row counts once for each time it occurs; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .channel import LEADING, MASKS, READINGS, SIZE, TRAILING, CharacterModel, Filter, Skeletons, decode, disguised, normal, spans, stripped, trigram_counts
from .common import byte_slices, column, persisted, ragged_take

MARKS = "\"'.,;:()[]{}"
#: What joins the parts of a word.
PARTS = re.compile(r"[-_/.,:;~=&\\\"'()\[\]{}\u2010-\u2015]+")
JOINED = r"[-_/.,:;~=&\\\"'()\[\]{}\x{2010}-\x{2015}]"
BEGINNINGS = (4, 5, 6, 7)
RUN, REMEMBERED = 8 << 20, 100_000  #: text bytes and words that a worker holds at a time
LEVELS = (0.01, 0.05, 0.25, 1.0)
FOLDS = 3
#: Share of the sample's documents from which on a word is too frequent to be a part of another.
COMMON = 0.005
ALL = "\t"  #: the feature that every document has
AGAIN = "\t2"  #: ends the name of a feature that two or more distinct words of a document have
PART = "\tp"  #: ends the name of a word as written


def _words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    return lists.flatten().dictionary_encode(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def alone(word: str) -> str:
    """The character of a word that is one character, marks at its edges aside; else the empty string."""
    if len(word) == 1:
        return word
    return next((form for form in (stripped(word), word.strip(MARKS)) if len(form) == 1), "")


# --- evidence ----------------------------------------------------------------------------------


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) > n)] if word else []


def readings(word: str, model: CharacterModel) -> Iterator[str]:
    """A word as written, as decoded, and its parts as written and as decoded."""
    bare = stripped(word)
    plain = normal(bare)
    yield bare
    if plain != bare:
        yield plain
    for form in sorted({plain, word.strip(MARKS)}):
        if disguised(form):
            yield decode(form, model)
    parts = [x for x in PARTS.split(plain) if len(x) > 2]
    if len(parts) > 1 or parts and parts[0] != plain:
        for part in parts:
            yield part
            if disguised(part):
                yield decode(part, model)


@dataclass
class Evidence:
    """Listed features with their significance and log-likelihood ratio, the channel's character model, and frequent words."""

    listed: dict[str, tuple[float, float]]
    base: float
    model: CharacterModel
    common: frozenset[str] = frozenset()
    known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        exact = [f[1:].removesuffix(AGAIN) for f in self.listed if f[0] == "="]
        self.longest = max(map(len, exact), default=0)
        self.by_size: dict[int, list[str]] = {}
        for word in sorted(set(exact)):
            self.by_size.setdefault(len(word), []).append(word)
        self.may_be = Filter(exact, sorted({f.removesuffix(AGAIN) for f in self.listed if f[0] != "="}))

    def candidates(self, words: pa.Array, bare: pa.Array, skeletons: Skeletons) -> np.ndarray:
        """Which words may have a listed feature, as written or decoded, whole or in a part; ``bare`` are the words without marks."""
        out = self.may_be(skeletons)
        marked = pc.utf8_trim(words, MARKS)
        forms, owners = [], []
        for i in np.flatnonzero(pc.and_(pc.not_equal(marked, bare), pc.invert(pa.array(out))).to_numpy(zero_copy_only=False)).tolist():
            forms.append(marked[i].as_py())
            owners.append(i)
        for i in np.flatnonzero(pc.match_substring_regex(bare, JOINED).to_numpy(zero_copy_only=False) & ~out).tolist():
            parts = PARTS.split(normal(bare[i].as_py()))
            forms += parts
            owners += [i] * len(parts)
        out[np.array(owners, np.int64)[self.may_be(Skeletons(forms))]] = True
        return out

    def looked_up(self, word: str) -> tuple[str, ...]:
        return tuple(f for f in features(word) if f in self.listed or f + AGAIN in self.listed)

    def remembered(self, key: str, made) -> tuple[str, ...]:
        out = self.known.get(key)
        if out is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            out = self.known[key] = made()
        return out

    def of_word(self, word: str) -> tuple[str, ...]:
        """The listed features of the first reading of a word that has any, or else those of the word behind its masks."""
        return self.remembered(word, lambda: next(filter(None, map(self.looked_up, readings(word, self.model))), ()) or self.unmasked(word))

    def unmasked(self, word: str) -> tuple[str, ...]:
        """The most significant listed word that a word with masks (one a letter, at most half of them) may be.

        Letters are masked so that the word is recognised all the same, so a listed word is preferred to a likelier one that is not.
        """
        form = normal(word).strip(MARKS + "!?")
        masks = sum(c in MASKS for c in form)
        if not masks or 2 * masks > len(form) or len(form) - masks < 2:
            return ()
        fits = [x for x in self.by_size.get(len(form), ()) if all(a in MASKS or a == b or b in READINGS.get(a, "") for a, b in zip(form, x, strict=True))]
        found = [names for x in fits if (names := self.looked_up(x))]
        return max(found, key=lambda names: max(self.listed.get(f, self.listed.get(f + AGAIN)) for f in names), default=())

    def of_span(self, words: list[str]) -> tuple[str, ...]:
        """The listed word that neighbouring words are likelier to be than several words; frequent words stay what they are."""
        parts = [stripped(w) for w in words]
        if len(parts) > 1 and all(len(x) > 1 and x in self.common for x in parts):
            return ()

        def made() -> tuple[str, ...]:
            reading = "=" + decode(" ".join(parts), self.model)
            return (reading,) if reading in self.listed or reading + AGAIN in self.listed else ()

        return self.remembered(" ".join(parts), made) if len(parts) > 1 else made()

    def of_run(self, letters: str) -> set[tuple[str, ...]]:
        """Letters that stood apart: the listed words among them, as written or decoded."""
        out = set()
        for form in {letters, decode(letters, self.model)}:
            for start in range(len(form)):
                for stop in range(start + 3, min(start + self.longest, len(form)) + 1):
                    if "=" + form[start:stop] in self.listed:
                        out.add(("=" + form[start:stop],))
        return out

    def ratio(self, items: list[tuple[str, ...]], least: float = 0.0) -> float:
        """Sum of the ratios of the distinct features that are the most significant of some word, and more so than ``least``."""
        times: dict[str, int] = {}
        for names in items:
            for f in names:
                times[f] = times.get(f, 0) + 1
        chosen = {}
        for names in items:
            forms = [x for f in names for x in ([f + AGAIN] if times[f] > 1 else [f]) if self.listed.get(x, (0.0,))[0] > least]
            if forms:
                best = max(forms, key=self.listed.get)
                chosen[best] = self.listed[best][1]
        return sum(chosen.values())

    def found(self, texts: pa.Array) -> dict[int, list[tuple[str, ...]]]:
        """For each text with any, the listed features of each of its distinct words, runs of letters, and words in parts."""
        coded, offsets = _words(texts)
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy()
        evidence: dict[int, dict] = {}
        if not len(codes) or not self.listed:
            return {}
        bare = pc.utf8_ltrim(pc.utf8_rtrim(coded.dictionary, TRAILING), LEADING)
        skeletons = Skeletons(bare.to_pylist())
        own = {i: names for i in np.flatnonzero(self.candidates(coded.dictionary, bare, skeletons)).tolist() if (names := self.of_word(words[i]))}
        marked = np.zeros(len(words), bool)
        marked[list(own)] = True
        owner = lambda at: int(np.searchsorted(offsets, at, side="right")) - 1
        for at in np.flatnonzero(marked[codes]):
            evidence.setdefault(owner(at), {})[stripped(words[codes[at]])] = own[codes[at]]
        for i, start, stop in spans(codes, offsets, skeletons, self.may_be.exact, self.may_be.reach):
            if not marked[codes[start:stop]].any() and (names := self.of_span([words[c] for c in codes[start:stop]])):
                evidence.setdefault(i, {})[names] = names
        short = pc.or_(pc.less_equal(pc.utf8_length(bare), 1), pc.equal(pc.utf8_length(pc.utf8_trim(coded.dictionary, MARKS)), 1))
        letters = {i: c for i in np.flatnonzero(short.to_numpy(zero_copy_only=False)).tolist() if (c := alone(words[i]))}
        single = np.zeros(len(words), bool)
        single[list(letters)] = True
        apart = single[codes]
        begins, ends = apart.copy(), apart.copy()
        begins[1:] &= ~apart[:-1]
        ends[:-1] &= ~apart[1:]
        breaks = offsets[1:-1]
        breaks = breaks[(breaks > 0) & (breaks < len(codes))]
        begins[breaks], ends[breaks - 1] = apart[breaks], apart[breaks - 1]
        for start, stop in zip(np.flatnonzero(begins).tolist(), (np.flatnonzero(ends) + 1).tolist(), strict=True):
            if stop - start >= 3:
                evidence.setdefault(owner(start), {}).update({names: names for names in self.of_run("".join(letters[c] for c in codes[start:stop].tolist()))})
        return {i: list(items.values()) for i, items in evidence.items()}

    def chance(self, ratio: float) -> float:
        return 1 / (1 + math.exp(-min(math.log(self.base / (1 - self.base)) + ratio, 50.0)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.base)
        for i, items in self.found(texts).items():
            out[i] = self.chance(self.ratio(items))
        return out


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SIZE**3)
    for batch in batches:
        for part in byte_slices(batch, "_text"):
            coded, _ = _words(part.column("_text"))
            if len(coded):
                counts += trigram_counts([w.strip(TRAILING) for w in coded.dictionary.to_pylist()], np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(float))
    cells = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts[cells].astype(np.int64))], names=["cell", "n"])


def _count_features(model: CharacterModel):
    """(feature, fold, toxic documents, clean documents) of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "_text", RUN):
                coded, offsets = _words(part.column("_text"))
                kinds = part.column("fold").to_numpy().astype(np.int64) * 2 + part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
                forms: dict[str, int] = {}
                bare = np.fromiter((forms.setdefault(stripped(w), len(forms)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
                names: dict[str, int] = {}
                listed = [np.unique([names.setdefault(f, len(names)) for x in readings(w, model) for f in features(x)] + [names.setdefault(w + PART, len(names))]) for w in forms]
                flat = np.concatenate([np.zeros(0, np.int64), *listed]).astype(np.int64)
                sizes = np.array([len(x) for x in listed], np.int64)
                starts = np.cumsum(sizes) - sizes
                codes = coded.indices.to_numpy()
                counts = np.zeros((2 * FOLDS, 2 * len(names) + 1), np.int64)
                for i, (start, stop) in enumerate(pairwise(offsets.tolist())):
                    own = np.unique(bare[codes[start:stop]])
                    found, times = np.unique(ragged_take(flat, starts[own], sizes[own]), return_counts=True)
                    counts[kinds[i], found + len(names) * (times > 1)] += 1
                    counts[kinds[i], -1] += 1
                every = pa.array([*names, *(f + AGAIN for f in names), ALL])
                for fold in range(FOLDS):
                    some = np.flatnonzero(counts[2 * fold] + counts[2 * fold + 1])
                    yield pa.RecordBatch.from_arrays(
                        [every.take(pa.array(some)), pa.array(np.full(len(some), fold)), pa.array(counts[2 * fold + 1, some]), pa.array(counts[2 * fold, some])], names=["feature", "fold", "toxic", "clean"]
                    )

    return run


@dataclass(frozen=True)
class Side:
    """Training rows but those of one fold (None: all rows): how to read a feature's counts, and the totals."""

    fold: int | None
    toxic: int = 0
    clean: int = 0
    tested: int = 1

    def counts(self) -> tuple[Column, Column]:
        less = lambda c: F.col(c) - F.col(f"{c}{self.fold}") if self.fold is not None else F.col(c)
        return less("toxic"), less("clean")

    def least(self, level: float) -> float:
        return math.log(max(self.tested, 1) / level)

    def evidence(self, found: DataFrame, model: CharacterModel, trigrams: np.ndarray, level: float, common: frozenset[str]) -> Evidence:
        """Features more toxic than chance explains (Chernoff bound of the binomial tail), with smoothed log ratios.

        The test runs where the counts are; only features that pass it come to the driver, as many as a bounded sample can prove.
        """
        if not self.toxic or not self.clean:
            return Evidence({}, 0.01, model)
        bad, good = self.counts()
        base = self.toxic / (self.toxic + self.clean)
        share = bad / (bad + good)
        strength = (bad + good) * (share * F.log(share / base) + F.when(share >= 1, 0.0).otherwise((1 - share) * F.log((1 - share) / (1 - base))))
        rows = found.where(~F.col("feature").endswith(PART)).where(~F.col("feature").endswith(PART + AGAIN)).select("feature", bad.alias("bad"), good.alias("good"), share.alias("share"), strength.alias("strength"))
        rows = rows.where((F.col("bad") > 0) & (F.col("share") >= max(0.5, base)) & (F.col("strength") > self.least(level)) & (F.col("feature") != ALL)).orderBy("feature").collect()
        listed = {r["feature"]: (r["strength"], math.log((r["bad"] + 0.5) / (self.toxic + 1)) - math.log((r["good"] + 0.5) / (self.clean + 1))) for r in rows}
        weights = np.full(len(listed), trigrams.sum() / 200 / max(len(listed), 1))
        likelier = CharacterModel(trigrams + trigram_counts([f.removesuffix(AGAIN).removeprefix("=") for f in listed], weights))
        return Evidence(listed, base / 2, likelier, common)


def _losses(sides: list[Side], evidence: list[Evidence]):
    """(level, loss): the log losses of training rows, each scored with evidence of the other folds, summed over a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "_text", RUN):
                sums, folds = np.zeros(len(LEVELS)), part.column("fold").to_numpy()
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
                for fold, (side, own) in enumerate(zip(sides, evidence, strict=True)):
                    rows = np.flatnonzero(folds == fold)
                    found = own.found(part.column("_text").take(pa.array(rows)))
                    for j, row in enumerate(rows.tolist()):
                        for k, level in enumerate(LEVELS):
                            chance = own.chance(own.ratio(found[j], side.least(level))) if j in found else own.base
                            sums[k] -= math.log(max(chance if toxic[row] else 1 - chance, 1e-6))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(LEVELS))), pa.array(sums)], names=["level", "loss"])

    return run


def learnt(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 20_000) -> Evidence:
    """Evidence from at most ``sample`` labelled training rows; the character model from all documents."""
    source = docs.select(column(key).alias("_key"), column(text).alias("_text"))
    cells = source.select("_text").mapInArrow(_count_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    trigrams = np.zeros(SIZE**3)
    for row in cells:
        trigrams[row["cell"]] = row["n"]
    model = CharacterModel(trigrams)
    chosen = labels.where(F.col("toxic").isNotNull() & ~held_out(key)).select(column(key).alias("_key"), (F.col("toxic") == 1).alias("toxic")).orderBy(F.xxhash64("_key"), "_key", "toxic").limit(sample)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_key"), F.lit(FOLDS)).cast("int").alias("fold")
    rows = source.join(F.broadcast(chosen), "_key").select("_text", "toxic", fold)  # at most ``sample`` labels
    each = lambda c, i: F.sum(F.when(F.col("fold") == i, F.col(c)).otherwise(0)).alias(f"{c}{i}")
    counted = rows.mapInArrow(_count_features(model), "feature string, fold long, toxic long, clean long").groupBy("feature")
    found = persisted(counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *(each(c, i) for c in ("toxic", "clean") for i in range(FOLDS))))
    sides = [Side(fold) for fold in (*range(FOLDS), None)]
    is_all, is_part = F.col("feature") == ALL, F.col("feature").contains(PART)
    totals = found.agg(*(F.coalesce(F.sum(F.when(is_all, c)), F.lit(0)) for side in sides for c in side.counts()), *(F.count(F.when(~is_all & ~is_part & (side.counts()[0] >= 3), 1)) for side in sides)).first()
    n = len(sides)
    sides = [Side(side.fold, totals[2 * i], totals[2 * i + 1], totals[2 * n + i]) for i, side in enumerate(sides)]
    every = sides[-1]
    if not every.toxic or not every.clean:
        return Evidence({}, 0.01, model)
    least = max(COMMON * (every.toxic + every.clean), 3)
    frequent = found.where(F.col("feature").endswith(PART) & (F.col("toxic") + F.col("clean") >= least)).select("feature").collect()  # at most the sample's words / COMMON of its rows
    common = frozenset(r["feature"].removesuffix(PART) for r in frequent)
    trials = [side.evidence(found, model, trigrams, LEVELS[-1], common) for side in sides[:-1]]
    losses = {r["level"]: r["loss"] for r in rows.mapInArrow(_losses(sides[:-1], trials), "level long, loss double").groupBy("level").agg(F.sum("loss").alias("loss")).collect()}
    level = LEVELS[min(losses, key=lambda i: (losses[i], i))]
    return every.evidence(found, model, trigrams, level, common)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(column(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", limit: float = 0.7, sample: int = 20_000) -> DataFrame:
    """One row per document: the key, held_out, score and predicted."""
    evidence = learnt(docs, labels, text, key, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "_text", RUN):
                yield pa.RecordBatch.from_arrays([part.column("_key"), pa.array(evidence.scores(part.column("_text")), pa.float64())], names=["_key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    scored = docs.select(column(key).alias("_key"), column(text).alias("_text")).mapInArrow(run, f"_key {kind}, score double")
    return scored.select(F.col("_key").alias(key), held_out("_key").alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir):
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
