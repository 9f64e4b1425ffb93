import math
import re
import zlib
from collections import Counter
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import functions as F

from seqloom.llm import channel, quality_classifier, quality_rules, toxicity


def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


SF = "/root/testdata/sf0.01"


def test_quality_agrees_with_labels(spark):
    docs, labels = tables(spark, SF)
    got = quality_classifier.classified(docs.select("doc_id", "text")).select("doc_id", "score", "kept").toPandas().merge(labels.toPandas(), on="doc_id")
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.kept.mean() > 0.98 and bad.kept.mean() < 0.05


def test_quality_odd_rows(docs):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "the cat and the dog of that town"), (4, "the cat and the dog of that town"), (None, "x"), (5, "the of and " * 9000)]
    got = quality_classifier.classified(docs(rows)).select("doc_id", "score", "kept", "shard").collect()
    assert len(got) == 7 and all(not r["kept"] and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert len({r["score"] for r in got if r["doc_id"] == 4}) == 1 and got[0]["shard"] == 9
    assert quality_classifier.classified(docs(rows).limit(0)).count() == 0


def features_by_hand(text):
    """Every feature's value of one text, word by word."""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]
    out = Counter()
    for w in words:
        shape = re.sub("\x01", "A", re.sub(r"[^\W\d_]+", lambda m: re.sub(r"[^\x01]+", "a", re.sub(r"(?:(?=[^\W\d_])(?-i:[A-Z\u00c0-\u00d6\u00d8-\u00de]))+", "\x01", m[0])), re.sub(r"\d+", "0", w)))
        for kind, part in (("s", shape), ("e", w.lower()[-2:]), ("w", re.sub(r"[^\w]+", "", w.lower()))):
            out[4 + xxhash.xxh3_64_intdigest(kind + part) % (quality_classifier.DIMENSIONS - 4)] += 1
    n = max(len(words), 1)
    found = {column: math.sqrt(v / n) for column, v in out.items()}
    again = sum(a == b for a, b in pairwise(words)) / n
    return found | {0: math.sqrt(again), 1: math.sqrt((len(words) - len(set(words))) / n), 2: 1.0, 3: math.sqrt(again >= 0.15)}


def test_scores_equal_a_straight_computation():
    r = np.random.default_rng(2)
    parts = ["the", "The", "WORD", "12", "a1b", "\u00c9t\u00e9", "!!", "x-y", "don't", "7%", "iPhone", "\u00fcber"]
    texts = [" ".join(r.choice(parts, r.integers(1, 40))) for _ in range(200)] + [None, "", " \n", "one", "\x0ba\x0cb\x0d"]
    weights = r.normal(size=quality_classifier.DIMENSIONS)
    got = quality_classifier.LinearScorer(weights).of(quality_classifier.vectors(pa.array(texts, pa.string())))
    for text, score in zip(texts, got, strict=True):
        if not (text or "").strip():
            assert score == 0
            continue
        odds = sum(weights[c] * v for c, v in features_by_hand(text).items())
        assert abs(score - 1 / (1 + math.exp(-odds))) < 1e-5, text


def test_expectation_maximisation_equals_plain_loops():
    r = np.random.default_rng(4)
    patterns = np.unique(r.integers(-1, 2, (60, 4)), axis=0)
    counts = r.integers(1, 50, len(patterns)).astype(float)
    model = quality_classifier.LabelModel(patterns, counts, rounds=7)
    good = []
    for p in patterns.tolist():
        up, down = p.count(1), p.count(-1)
        good.append(min(max((up + 0.5) / (up + down + 1) - 0.3 * (down > 0), 0.05), 0.95))
    for _ in range(7):
        balance = min(max(sum(g * n for g, n in zip(good, counts, strict=True)) / counts.sum(), 0.5), 0.99)
        chance = lambda c, j, v: (sum(n * (g if c else 1 - g) for p, n, g in zip(patterns, counts, good, strict=True) if p[j] == v) + 1) / (sum(n * (g if c else 1 - g) for n, g in zip(counts, good, strict=True)) + 3)  # noqa: E731, B023
        table = {(c, j, v): chance(c, j, v) for c in (0, 1) for j in range(4) for v in (-1, 0, 1)}
        likely = lambda p, c: math.prod(table[c, j, v] for j, v in enumerate(p))  # noqa: E731, B023
        good = [balance * likely(p, 1) / (balance * likely(p, 1) + (1 - balance) * likely(p, 0)) for p in patterns.tolist()]
    assert np.allclose(model.posterior(patterns), good)


def test_runs_do_not_change_toxicity_scores(spark):
    docs, labels = tables(spark, SF)
    evidence = toxicity.learnt(docs, labels)
    texts = [r["text"] for r in docs.limit(150).collect()] + [None, "i d i o t", "id iot", ""]
    whole = evidence.scores(pa.array(texts, pa.string()))
    assert np.array_equal(whole, [evidence.scores(pa.array([t], pa.string()))[0] for t in texts])


def test_label_model_finds_the_bad_labeller():
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.8
    votes = np.stack([np.where(r.random(20_000) < p, truth, ~truth) * 2 - 1 for p in (0.95, 0.9, 0.85, 0.6)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_classifier.LabelModel(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - [0.95, 0.9, 0.85, 0.6]).max() < 0.03 and abs(model.balance - 0.8) < 0.02


def test_toxicity_held_out_accuracy(spark):
    docs, labels = tables(spark, SF)
    got = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)).all()
    held = got[got.held_out]
    assert held[held.toxic == 0].predicted.mean() < 0.03 and held[held.toxic == 1].predicted.mean() > 0.7
    assert got.score.between(0, 1).all()


def test_disguises_are_read(spark):
    docs, labels = tables(spark, SF)
    evidence = toxicity.learnt(docs, labels)
    for text in ("an 1d10t here", "cl0wn", "what a m0r0n!", "sc-u-m", "a l o s e r b", "patheeeetic", "tr@sh", "w0rthle55"):
        assert evidence.scores(pa.array([text]))[0] >= 0.7, text
    calm = evidence.scores(pa.array(["", None, "a quiet day", "password=5aaa9ac60bfe", "x y z", "100% 3.5"], pa.string()))
    assert (calm < 0.2).all()


def test_long_spaced_doubled_and_letterless_disguises_are_read(spark):
    docs, labels = tables(spark, SF)
    evidence = toxicity.learnt(docs, labels)
    assert "=idiot" in evidence.listed
    texts = ["id" + "i" * 70 + "ot", "i" + "." * 40 + "d" + "-." * 40 + "i.o.t", "i d i o t.", '"i d i o t', "(i, d, i, o, t)", "i " * 70 + "d i o t", "iddiot", "1d1000000000t"]
    for text in texts:
        assert evidence.scores(pa.array([text]))[0] >= 0.7, text
    calm = ["a better letter from summer", "1. 2. 3. 4.", "plan a, plan b, c. and d", "100% 3.5 2024-05-06 12:30", "#" * 500, "x1" * 5000]
    assert (evidence.scores(pa.array(calm)) < 0.2).all()
    model = channel.CharacterModel(channel.trigram_counts(["ass", "glass", "table"], np.array([900.0, 9.0, 9.0])))
    made_up = toxicity.Evidence({"=ass": (9.0, 9.0), "=" + "ab" * 15: (9.0, 9.0)}, 0.01, model)
    assert (made_up.scores(pa.array(["@$$", "4$$", "455", " ".join("ab" * 15)])) >= 0.7).all()


def test_split_joined_foreign_and_very_long_disguises_are_read(spark):
    docs, labels = tables(spark, SF)
    evidence = toxicity.learnt(docs, labels)
    texts = ["id iot", "idi ot", "i di ot", "an 1d 10t,", "so-1d10t", "such_an/idiot", "\u0456d\u0456\u043et", "\u00ecd\u00ed\u00f6t", "\uff49\uff44\uff49\uff4f\uff54", "idi\u200bot"]
    texts += ["1" + "-" * 58 + "d10t", "1" + "-" * 600 + "d10t", "id" + "i" * 40 + "ot", "id" + "i" * 800 + "ot", "id" + "-" * 300 + " iot", "d i s g u s t i n g"]
    for text in texts:
        assert evidence.scores(pa.array([text]))[0] >= 0.7, text
    calm = ["the id of iota", "as sure as that", "a " * 3000, "- " * 3000, "i di to", "1 2 3 4 5 6", "\u0442\u043e\u0442 \u0434\u043e\u043c", "i\u0307" * 50]
    assert (evidence.scores(pa.array(calm)) < 0.2).all()
    # a frequent word is no part of another, whatever the model says
    model = channel.CharacterModel(channel.trigram_counts(["penis", "pen", "is"], np.array([900.0, 9.0, 9.0])))
    made_up = toxicity.Evidence({"=penis": (9.0, 9.0)}, 0.01, model, frozenset(["pen", "is"]))
    assert made_up.scores(pa.array(["the pen is red", "a pe nis"])).round(1).tolist() == [0.0, 1.0]


def test_spans_equal_brute_force():
    r = np.random.default_rng(5)
    words = sorted({"".join(r.choice(list("abi1-"), r.integers(1, 5))) for _ in range(60)})
    listed = ["aba", "bibab", "ia", "abab"]
    skeletons = channel.Skeletons(words)
    offsets = np.concatenate(([0], np.cumsum(r.integers(0, 30, 40))))
    codes = r.integers(0, len(words), offsets[-1])
    fold = lambda x: "".join(k for k, _ in groupby(c for c in x.replace("1", "i") if c != "-"))
    wanted = channel.Skeletons(listed)
    got = {(i, tuple(words[c] for c in codes[a:b])) for i, a, b in channel.spans(codes, offsets, skeletons, np.sort(wanted.hashes), 5)}
    want = set()
    for i, (a, b) in enumerate(pairwise(offsets.tolist())):
        own = [words[c] for c in codes[a:b]]
        for start in range(len(own)):
            for stop in range(start + 1, len(own) + 1):
                if fold("".join(own[start:stop])) in listed:
                    want.add((i, fold("".join(own[start:stop]))))
    assert {(i, fold("".join(x))) for i, x in got} == want


def test_long_readings_are_whole(spark):
    model = channel.CharacterModel(channel.trigram_counts(["idiot", "clown"], np.array([9.0, 9.0])))
    assert channel.decode("1d10t-cl0wn-" * 300, model) == "idiotclown" * 300


def test_the_filter_loses_no_reading():
    r = np.random.default_rng(8)
    listed = {"=idiot": (9.0, 1.0), "=boss": (9.0, 1.0), "clow": (9.0, 1.0), "pathe": (9.0, 1.0), "=\u00e9lan": (9.0, 1.0)}
    model = channel.CharacterModel(channel.trigram_counts([x.strip("=") for x in listed] * 3, np.full(15, 50.0)))
    evidence = toxicity.Evidence(listed, 0.05, model)
    swaps = {"i": "i1!*", "o": "o0\u043e", "a": "a4@\u00e0*", "s": "s5$", "e": "e3*", "t": "t7+", "l": "l1|", "\u00e9": "\u00e9e3"}
    words = []
    for _ in range(3000):
        base = str(r.choice(["idiot", "boss", "clown", "pathetic", "\u00e9lan", "idiom", "plan", "clo", "host"]))
        spelt = "".join(str(r.choice(list(swaps.get(c, c)))) * int(r.choice([1, 1, 1, 2, 4])) + str(r.choice(["", "", "", "-", "."])) for c in base)
        words.append(str(r.choice(["", "so-", "x_", '"'])) + spelt + str(r.choice(["", ".", "!", "-x"])))
    words = pa.array(words, pa.string())
    bare = pa.compute.utf8_ltrim(pa.compute.utf8_rtrim(words, channel.TRAILING), channel.LEADING)
    passed = evidence.candidates(words, bare, channel.Skeletons(bare.to_pylist()))
    found = [bool(evidence.of_word(w)) for w in words.to_pylist()]
    assert sum(found) > 500 and all(p for p, f in zip(passed, found, strict=True) if f)


def test_training_reads_no_held_out_label(spark):
    docs, labels = tables(spark, SF)
    other = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learnt(docs, labels), toxicity.learnt(docs, other)
    assert one.listed == two.listed and one.base == two.base and one.common == two.common


def test_toxicity_without_labels_and_odd_rows(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs([(1, None), (None, ""), (2, "x " * 100_000)]), none).collect()
    assert len(got) == 3 and all(r["predicted"] == 0 for r in got) and not [r for r in got if r["doc_id"] is None][0]["held_out"]
    assert toxicity.toxicity(docs([(1, "a")]).limit(0), none).count() == 0


def test_masked_letters_of_listed_words_are_read():
    words = ["trash", "scum", "clown", "loser", "idiot", "worthless"]
    plain = ["the", "this", "that", "thing", "there", "crash", "these", "shall", "which", "whether", "her", "letter"]
    model = toxicity.CharacterModel(toxicity.trigram_counts(plain * 40, np.ones(40 * len(plain))))
    evidence = toxicity.Evidence({"=" + w: (9.0 + i, 3.0) for i, w in enumerate(words)}, 0.05, model)
    bare = evidence.scores(pa.array(["nothing here"]))[0]
    for w in words:
        for i in range(1, len(w) - 1):
            for mask in "*#%?":
                text = f"so {w[:i]}{mask}{w[i + 1 :]}, he said"
                assert evidence.scores(pa.array([text]))[0] > 0.4, text
    read = ["*rash", "tras*", "t**sh", "tr*sh!", "(l*$er)", "w*rth#ess", "ID*OT?"]
    assert (evidence.scores(pa.array(read)) > 0.4).all()
    left = ["lose?", "t***h", "*****", "scum5", "5*6", "a*b", "tr*shy", "cl*ss", "idio?"]
    assert (evidence.scores(pa.array(left[:3] + left[4:])) == bare).all()


def test_every_row_trains_the_quality_scorer(spark):
    r = np.random.default_rng(9)
    texts = [" ".join([*r.choice(["the", "of", "and", "cat", "dog", "!!", "#$%"], 6), f"w{i:05d}x"]) for i in range(4600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3, "doc_id long, text string")
    one, two = (quality_classifier.fitted(quality_classifier.prepared(rows.repartition(n, "text"), [])) for n in (3, 8))
    own = [4 + xxhash.xxh3_64_intdigest(f"ww{i:05d}x") % (quality_classifier.DIMENSIONS - 4) for i in range(4600)]
    assert (one.weights[own] != 0).all()
    assert np.array_equal(one.weights, two.weights) and one.cut == two.cut


def test_slopes_equal_plain_loops():
    r = np.random.default_rng(10)
    texts = [" ".join(r.choice(["the", "The", "x-y", "12", "!!"], r.integers(1, 30))) for _ in range(40)]
    weights, targets, votes, times = r.normal(size=quality_classifier.DIMENSIONS), r.random(9), r.integers(0, 9, 40), r.integers(1, 3, 40)
    found = list(quality_classifier.vectors(pa.array(texts)))
    data = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in zip(zip(*found, strict=True), (np.uint16, np.float32), strict=True)]
    batch = pa.RecordBatch.from_arrays([*data, pa.array(votes), pa.array(times)], names=["columns", "weights", "_votes", "_times"])
    got = sum(np.frombuffer(b["data"][0].as_py(), np.int64) for b in quality_classifier.Slopes(weights, targets, True)([batch.slice(0, 7), batch.slice(7)])) / quality_classifier.UNIT
    want = np.zeros(len(got))
    for text, vote, n in zip(texts, votes, times, strict=True):
        own = features_by_hand(text)
        chance = 1 / (1 + math.exp(-sum(weights[c] * v for c, v in own.items())))
        want[0] += 1 / n
        want[1] -= (targets[vote] * math.log(chance) + (1 - targets[vote]) * math.log(1 - chance)) / n
        for c, v in own.items():
            want[2 + c] += (chance - targets[vote]) * v / n
            want[2 + quality_classifier.DIMENSIONS + c] += v * v / n
    assert np.abs(got - want).max() < 1e-5


def test_cheapest_cut_equals_every_cut_tried(spark):
    r = np.random.default_rng(11)
    for size, levels in ((1, 1), (60, 12), (300, 1000)):
        rows = [(float(x) / levels, int(a), int(b)) for x, a, b in zip(r.integers(0, levels + 1, size), r.integers(0, 9, size), r.integers(0, 9, size), strict=True)]
        edges = sorted({0.0, 1.0, *(s for s, _, _ in rows)})
        tried = [(sum(a for s, a, _ in rows if s < cut) + sum(b for s, _, b in rows if s >= cut), low - high, cut) for low, high in pairwise(edges) for cut in [(low + high) / 2]]
        cut = quality_classifier.cheapest_cut(spark.createDataFrame(rows, "score double, lost long, wrong long").repartition(5))
        least = min(tried)
        assert any(abs(cut - c) < 1e-9 for cost, gap, c in tried if cost == least[0] and abs(gap - least[1]) < 1e-9)


def test_quality_pass_splits_texts_once(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "persisted", lambda df: df)
    rows = spark.createDataFrame([(1, "the cat and the dog"), (2, None)], "doc_id long, text string")
    made = quality_classifier.prepared(rows, ["doc_id"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.split("ArrowEvalPython [")[1].split("]")[0].count("_studied(") == 1
    assert not any(name in plan for name in ("split(", "regexp_extract_all(", "sort_array("))
    assert [r["_votes"] is None for r in made.orderBy("_0").collect()] == [False, True]


def counts_texts():
    r = np.random.default_rng(12)
    parts = ["the", "der", "cat", "D\u00e9j\u00e0", "!!", "a!!", "b!!!", "#$", "x|<y>", "12", "\u00a0", "\u2028"]
    texts = ["".join(w + r.choice([" ", "  ", "\n", "\t\x0b", "\n \n"]) for w in r.choice(parts, r.integers(1, 60))) for _ in range(150)]
    odd = [None, "", " \n", "\n\n", "a!!\u0085", "a!!\u2028", "a!!\u2029\n", "a!!\n", "a!! ", "a\r\na\r\n", "a\na\n \n \na", "a a a a a", "a b c a b", "a b c a b c", "\x0ba\x0cb\x0d"]
    return [*odd, *texts, *odd]


def test_quality_counts_equal_rule_metrics(spark):
    texts = counts_texts()
    got = quality_classifier.counted(quality_classifier.Words(pa.array(texts, pa.string())))
    shouts = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"!!(?=[\x20\x09-\x0D]|$)"), F.lit(0)))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_shouts", shouts)
    want = quality_rules.measured(rows).orderBy("doc_id").collect()
    for name in quality_classifier.COUNTS:
        assert got[name].tolist() == [w[name] for w in want], name
    for few in ([], [None], [" ", ""]):
        words = quality_classifier.Words(pa.array(few, pa.string()))
        assert all(x.tolist() == [0] * len(few) for x in quality_classifier.counted(words).values())
        assert quality_classifier.sparse(words)[0].tolist() == [0, 1, 2, 3] * len(few)


def test_repeats_among_very_many_words():
    words = quality_classifier.Words(pa.array(counts_texts(), pa.string()))
    want = quality_classifier.counted(words)["n_repeat_words"].tolist()
    words.dictionary = pa.nulls(1 << 30)  # so that numbers of windows exceed 63 bits
    assert quality_classifier._repeats(words).tolist() == want and max(want) > 3


def test_shortened_words_keep_their_shapes():
    words = ["abc", "", "aBcDEf", "\u00e9ab\u00e9", "", "ab1cd", "z", "a", "x-yz", "\u00dfab", "ab", "cd"]
    got = quality_classifier._shortened(pa.array(words))
    assert got.to_pylist() == [re.sub("[a-z]+", "a", w) for w in words]
    assert len(quality_classifier._shortened(pa.array([], pa.string()))) == 0
