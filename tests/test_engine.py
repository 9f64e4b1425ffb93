import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators import histograms, homopolymers, profiles, superwords, tables, words
from seqloom.plans import expressions, jobs
from seqloom.streaming.counts import running_counts

TURN = str.maketrans("acgt", "tgca")


def canonical(w):
    return min(w, w[::-1].translate(TURN))


def counted(seqs, k):
    return Counter(canonical(w) for s in seqs for i in range(len(s) - k + 1) if not set(w := s[i : i + k].lower()) - set("acgt"))


def reads(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")


def table(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "kmer string, count int")


def as_dict(df):
    return {r["kmer"]: r["count"] for r in df.collect()}


@pytest.fixture(scope="module")
def seqs():
    r = random.Random(3)
    long = "".join(r.choice("acgtACGTn" if r.random() < 0.05 else "acgt") for _ in range(3000))
    return ["", "acg", "ACGTACGTAC", "acgnacgtacgtacgtnn", long, long[:700], "a" * 100]


@pytest.mark.parametrize("k", [5, 11, 31, 32, 40])
def test_counts_against_brute_force(spark, seqs, k):
    assert as_dict(words.count_table(reads(spark, seqs), k)) == dict(counted(seqs, k))


def test_slices_overlap(spark, seqs, monkeypatch):
    whole = counted(seqs, 7)
    assert sum(len(c) - 6 for s in seqs for _, c in words.slices(s, 7)) == sum(max(len(s) - 6, 0) for s in seqs)
    monkeypatch.setattr(words, "SLICE", 50)
    found = Counter()
    for s in seqs:
        for _, codes in words.slices(s, 7):
            kmers, valid = words.canonical_words(codes, 7)
            found.update(kmers[valid].tolist())
    assert sorted(found.values()) == sorted(whole.values())


def test_counts_saturate_and_keep_totals(spark):
    job = jobs.count(reads(spark, ["acgta" * 1] * 40000), 5)
    assert as_dict(job.table) == {canonical("acgta"): 32767}
    assert [tuple(r) for r in job.histogram.bins.collect()] == [(32767, 1)]
    assert job.histogram.ends.first()["i_high"] == 40000


def test_words_need_five_letters(spark):
    with pytest.raises(ValueError):
        words.count_table(reads(spark, ["acgt"]), 4)


def test_profiles(spark, seqs):
    whole = counted(seqs, 7)
    made = {r["read_id"]: r["counts"] for r in profiles.arrays(profiles.absolute(reads(spark, seqs), 7), reads(spark, seqs)).collect()}
    for i, s in enumerate(seqs):
        assert made[i] == [whole.get(canonical(s[p : p + 7].lower()), 0) if not set(s[p : p + 7].lower()) - set("acgt") else 0 for p in range(len(s) - 6)]


def test_one_invalid_letter_zeroes_k_windows(spark):
    rows = profiles.absolute(reads(spark, ["acgtacgnacgtacg"]), 5).orderBy("pos").collect()
    assert [r["count"] for r in rows].count(0) == 5


def test_merged_intervals(spark):
    prof = spark.createDataFrame([(0, p, 1 if p in (0, 3, 7) else 0) for p in range(9)], "read_id long, pos int, count int")
    rows = sorted(tuple(r) for r in profiles.intervals(prof, 3, True).select("beg", "end").collect())
    assert rows == [(0, 6), (7, 10)]


def test_runs_leave_zeros_out(spark):
    prof = spark.createDataFrame([(0, p, c) for p, c in enumerate([0, 2, 2, 0, 0, 2, 3])], "read_id long, pos int, count int")
    assert sorted(tuple(r) for r in profiles.runs(prof).select("first", "last", "count").collect()) == [(1, 2, 2), (5, 5, 2), (6, 6, 3)]


def test_symmetric(spark):
    assert as_dict(tables.symmetric(table(spark, {"acgt": 5, "aaac": 2}))) == {"acgt": 5, "aaac": 2, "gttt": 2}


def test_expressions(spark):
    a, b = table(spark, {"aaaaa": 3, "aaaac": 2, "ccccc": 9}), table(spark, {"aaaaa": 4, "aaaac": 5, "ggggg": 7})
    got = {n: as_dict(t) for n, t in tables.evaluated([a, b], {"mean": "A &* B", "rest": "A &- B", "xor": "a^b", "gc": "A{-50}", "in": "#A |+ #B", "limited": "A - B[5-]"}).items()}
    assert got["mean"] == {"aaaaa": 3, "aaaac": 3}
    assert got["rest"] == {}
    assert got["xor"] == {"ccccc": 9, "ggggg": 7}
    assert got["gc"] == {"aaaac": 2}
    assert got["in"] == {"aaaaa": 2, "aaaac": 2, "ccccc": 1, "ggggg": 1}
    assert got["limited"] == {"ccccc": 9}  # presence decides first


@pytest.mark.parametrize("text", ["A & B", "A |", "(A", "A B", "k", "#((A | B)[2])", "A[2", "A{x}", "", "1"])
def test_wrong_expressions(text):
    with pytest.raises(expressions.ExpressionError):
        expressions.parsed(text)


def test_precedence():
    tree = expressions.parsed("A |+ B - C")
    assert tree.operator == "|" and tree.right.operator == "-"
    assert expressions.least_value(expressions.parsed("A &+ B[7-]"), [2, 3]) == 9


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.text("ac", min_size=5, max_size=5), st.integers(1, 9)), st.dictionaries(st.text("ac", min_size=5, max_size=5), st.integers(1, 9)))
def test_xor_is_both_differences(x, y):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session")
    ts = [table(spark, x), table(spark, y)]
    out = tables.evaluated(ts, {"xor": "A ^ B", "or": "(A - B) |. (B - A)"})
    assert as_dict(out["xor"]) == as_dict(out["or"]) == {k: v for k, v in {**x, **y}.items() if (k in x) != (k in y)}


def test_tables_access(spark):
    t = table(spark, {"aaaac": 1, "aaagg": 2, "ccccc": 3})
    assert as_dict(tables.at(t, "1-2")) == {"aaagg": 2, "ccccc": 3}
    assert as_dict(tables.at(t, "aa")) == {"aaaac": 1, "aaagg": 2}
    asked = spark.createDataFrame([("GGGGG",), ("ttttt",)], "word string")
    assert {tuple(r) for r in tables.lookup(t, asked).collect()} == {("GGGGG", 3), ("ttttt", -1)}
    assert tables.seek(t, "aaaad").first()["kmer"] == "aaagg"
    assert tables.sliced(t, 2, 3).first()["kmer"] == "aaagg"


def test_disordered(spark):
    rows = spark.createDataFrame([("aaaaa", 1, 0), ("ccccc", 1, 1), ("aaccc", 1, 2), ("ggggg", 1, 3)], "kmer string, count int, o long")
    assert [r["kmer"] for r in tables.disordered(rows, "o").collect()] == ["aaccc"]


def test_stored_order(spark):
    rows = [("f1", i, w) for i, w in enumerate(["aaaaa", "ccccc", "aaccc", "ggggg"])] + [("f2", i, w) for i, w in enumerate(["ggggg", "ttttt"])]
    placed = spark.createDataFrame([(f, i, w, 1) for f, i, w in rows], "file string, row long, kmer string, count int")
    for run in (1, 2, 3, 100):
        assert sorted(r["kmer"] for r in tables.disordered_stored(placed, run).collect()) == ["aaccc", "ggggg"]
    assert tables.disordered_stored(placed.limit(0)).count() == 0


def test_seeks(spark):
    t = table(spark, {"aaaac": 1, "aaagg": 2, "ccccc": 3})
    assert tables.seek(t, "GGGGG").first()["kmer"] == "ccccc" and tables.seek_entry(t, "GGGGG").count() == 0
    assert tables.seek_entry(t, "aaag").first()["kmer"] == "aaagg" and tables.seek_ordinal(t, 2).first()["kmer"] == "ccccc"


def test_haplotype_sites(spark):
    t = table(spark, {"aacaa": 1, "aagaa": 2, "ccacc": 3, "ggtgg": 3, "ggagg": 4, "ggcgg": 5})
    got = sorted(tuple(r) for r in tables.haplotype_sites(t, 5).collect())
    assert got == [(0, "aa", "C", "aa", 1), (0, "aa", "G", "aa", 2), (1, "gg", "A", "gg", 4), (1, "gg", "C", "gg", 5), (1, "gg", "T", "gg", 3)]


def variants(r, k):
    """Sequences whose words often differ from another one in a letter, on either strand, invalid letters and short sequences included."""
    base = "".join(r.choices("acgt", k=300))
    seqs = []
    for _ in range(12):
        s = list(base[r.randrange(100) :])
        for i in range(r.randrange(k), len(s), k + 3):
            s[i] = r.choice("acgtn")
        s = "".join(s)
        seqs.append(r.choice([s, s[::-1].translate(TURN), s.upper()]))
    return [*seqs, "ac" * 60, "a" * 80, "", "acg", None]


@pytest.mark.parametrize("k", [5, 8, 21, 22, 40, 41, 63, 70])
def test_haplotypes_of_sequences_equal_those_of_their_table(spark, k):
    r = random.Random(k)
    df = reads(spark, variants(r, k))
    found = counted([s for s in variants(random.Random(k), k) if s], k)
    found = {w: n for w, n in found.items() if n <= 9}
    groups = {}
    for w in found:
        groups.setdefault((w[: k // 2], w[k // 2 + 1 :]), []).append(w)
    want = sorted((le, w[k // 2].upper(), ri, found[w]) for (le, ri), ws in groups.items() if len(ws) > 1 for w in ws)
    got = sorted(tuple(x) for x in tables.haplotypes_of(df, k, 1, 9).collect())
    assert got == want and len(want) > 3
    # every minimizer split, few buckets; the sites as well
    rule = superwords.flank_rule(df, k)
    hot = superwords.plan(df, k, 1.0, rule)[1]
    codes = words._CODE[np.frombuffer("".join(s for s in variants(random.Random(k), k) if s).encode(), np.uint8)]
    hot = np.unique(np.concatenate([hot, rule.minimizers(codes)]))
    split = superwords.paired(df, k, 1, 9, rule, (3, hot))
    assert sum(len(x["_g"]) for x in split.collect()) == len(want)


@pytest.mark.parametrize("k", [5, 8, 30, 31, 32, 61, 62, 63, 93, 124, 128])
def test_centre_moves_and_returns(k):
    r = np.random.default_rng(k)
    words_ = np.stack([r.integers(0, 1 << 2 * size, 300) for size in words.limbs(k)], axis=1)
    words_ = words_[:, 0] if words_.shape[1] == 1 else words_
    turned = words.centre_last(words_, k)
    assert len(np.unique(turned, axis=0)) == len(np.unique(words_, axis=0))
    assert words.centre_split(words.centre_last(words_[:0], k), k)[0].shape == words_[:0].shape
    for got, want in zip(words.centre_split(turned, k), words.without_centre(words_, k), strict=True):
        assert (got == want).all()


def test_sites_of_sequences(spark):
    df = reads(spark, variants(random.Random(4), 21))
    t = words.count_table(df, 21)
    assert sorted(map(tuple, tables.haplotype_sites_of(df, 21, 1, 9).collect())) == sorted(map(tuple, tables.haplotype_sites(t, 21, 1, 9).collect()))
    assert tables.haplotypes_of(df.limit(0), 21).count() == 0


def test_tagged_buckets(spark):
    t = table(spark, {"accaa": 1, "acgaa": 2, "ggtgg": 3})
    assert [r["line"] for r in tables.tagged_buckets(t, 5, 2).orderBy("ord").collect()] == ["K 5 2 1 1", "S 6 caagaa\nC 2 1 2", "S 3 tgg\nC 1 3"]
    assert tables.tagged_buckets(t.limit(0), 5, 2).count() == 0


def test_fit_range_is_widened(spark):
    h = histograms.of_counts(spark.createDataFrame([(1,), (3,), (1500,), (2500,)], "n long"), 5)
    assert {tuple(r) for r in h.for_fitting().collect()} == {(1, 1), (3, 1), (1000, 4)}
    assert {tuple(r) for r in h.for_fitting(9, 40).collect()} == {(1, 1), (3, 1), (1000, 4)}
    assert {tuple(r) for r in h.for_fitting(1, 2000).collect()} == {(1, 1), (3, 1), (1500, 1), (2000, 1)}


def homopolymers_by_hand(counts, k, error, low, high):
    """The rule of the module's text: sorted lists of flanks are merged word by word."""
    half, sites = k // 2, {}
    for w, n in sorted(counts.items()):
        left, right, base = w[:half], w[half:], w[half - 1]
        size = len(left) - len(left.rstrip(base))
        x = len(right) - len(right.lstrip(base)) - size + 1
        if size <= 5 and x >= 0:
            x = min(x, 3)
            sites.setdefault((left, size, base), [[], [], [], []])[x].append((right[size + x - 1 :], n))
    out = Counter()
    for (_, size, base), lists in sites.items():
        while any(lists):
            taken = []
            for x in range(4):
                if not lists[x]:
                    continue
                flank, before = lists[x][0][0], lists[taken[0]][0][0][: k - half - size + 1 - x] if taken else ""
                if not taken or flank < before:
                    taken = [x]
                elif flank == before:
                    taken.append(x)
            n = [lists[x].pop(0)[1] if x in taken else 0 for x in range(4)]
            kind = "at" if base in "at" else "cg"
            if low <= n[1] <= high and n[0] <= error and n[2] <= error:
                chosen, length = n[0:3], 2 * size
            elif low <= n[2] <= high and n[1] <= error and n[3] <= error and 2 * size < 10:
                chosen, length = n[1:4], 2 * size + 1
            else:
                continue
            for name, value in zip(("less", "good", "more"), chosen, strict=True):
                out[kind, length, name] += value
    return out


def homopolymers_found(spark, counts, k, *limits):
    rows = homopolymers.errors(table(spark, counts), k, *limits).collect()
    return {(g["base_class"], g["len"], c): g[c] for g in rows for c in ("less", "good", "more") if g[c]}


@pytest.mark.parametrize("k", [30, 33, 64])
def test_homopolymer_flanks_with_common_letters(spark, k):
    """Flanks that differ only in their last letters, so that many words meet at one site."""
    r = random.Random(k)
    half, counts = k // 2, {}
    for _ in range(40):
        base, size = r.choice("acgt"), r.randint(1, 5)
        other = "c" if base != "c" else "g"
        left = other * (half - size) + base * size
        left = "".join(r.choice("acgt") for _ in range(half - size - 1)) + left[half - size - 1 :]
        flank = other + "".join(r.choice("acgt") for _ in range(k - half - size - 3))
        for _ in range(r.randint(2, 14)):
            x = r.randint(0, 3)
            counts[(left + base * (size - 1 + x) + flank + "".join(r.choice("acg") for _ in range(3)))[:k]] = r.choice([1, 1, 2, 9, 40])
    want = homopolymers_by_hand(counts, k, 2, 5, 100)
    assert homopolymers_found(spark, counts, k, 2, 5, 100) == {key: v for key, v in want.items() if v} and len(want) > 10


def test_homopolymer_words_that_only_share_the_shortest_flank(spark):
    """The one word of class 0 and the one of class 1 agree but for the letters that class 3 lacks: they are not of one place."""
    left, flank = "c" * 14 + "a", "g" * 12
    counts = {left + flank + "aca": 2, left + "a" + flank + "cc": 40}
    assert homopolymers_found(spark, counts, 30, 2, 5, 100) == {("at", 2, "good"): 40}
    counts = {left + flank + "cca": 2, left + flank + "ccg": 1, left + "a" + flank + "cc": 40, left + "aa" + flank + "c": 1, left + "aa" + flank + "g": 30, left + "aaa" + flank: 2}
    assert homopolymers_found(spark, counts, 30, 2, 5, 100) == {("at", 2, "less"): 2, ("at", 2, "good"): 40, ("at", 2, "more"): 1, ("at", 3, "good"): 30}


@pytest.mark.parametrize("k", [30, 31, 64])
def test_homopolymer_errors_by_hand(spark, k):
    r = random.Random(k)
    counts = {}
    for _ in range(120):
        left, base, flank = "".join(r.choice("acgt") for _ in range(k // 2)), r.choice("acgt"), "".join(r.choice("acgt") for _ in range(k))
        size = r.randint(1, 6)
        left = left[: k // 2 - size].rstrip(base)[: k // 2 - size].rjust(k // 2 - size, "c" if base != "c" else "g") + base * size
        for x in range(5):
            if r.random() < 0.6:
                counts[(left + base * (size - 1 + x) + flank)[:k]] = r.choice([1, 1, 2, 9, 40])
    want = homopolymers_by_hand(counts, k, 2, 5, 100)
    got = homopolymers.errors(table(spark, counts), k, 2, 5, 100).collect()
    assert {(g["base_class"], g["len"], c): g[c] for g in got for c in ("less", "good", "more") if g[c]} == {key: v for key, v in want.items() if v} and len(want) > 10


def test_error_rates(spark):
    rows = spark.createDataFrame([("at", 4, 1, 97, 2)], "base_class string, len int, less long, good long, more long")
    assert homopolymers.with_rate(rows).first()["error_rate"] == 3.0


def test_histogram_concat_and_merge(spark):
    h = histograms.of_counts(spark.createDataFrame([(1,), (1,), (3,), (50,)], "n long"), 5, 1, 10)
    both = histograms.concatenated([h, h])
    assert {tuple(r) for r in both.bins.collect()} == {(1, 4), (3, 2), (10, 2)}
    assert tuple(both.ends.first()) == (4, 100)
    assert {tuple(r) for r in h.as_instances().bins.collect()} == {(1, 2), (3, 3), (10, 50)}
    assert "Histogram of unique 5-mers" in h.shown("x").orderBy("ord").first()["line"]


def test_empty_reads(spark):
    empty = reads(spark, ["x"]).limit(0)
    assert words.count_table(empty, 7).count() == 0
    assert profiles.absolute(empty, 7).count() == 0
    assert jobs.count(empty, 7).histogram.ends.first()["i_high"] == 0


def test_streaming_counts(spark, tmp_path, seqs):
    reads(spark, seqs).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("read_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = running_counts(stream, 7).writeStream.outputMode("complete").format("memory").queryName("counts_so_far").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert as_dict(spark.table("counts_so_far")) == dict(counted(seqs, 7))


def test_profile_text_forms(spark):
    prof = spark.createDataFrame([(0, p, c) for p, c in enumerate([0, 2, 2])], "read_id long, pos int, count int")
    assert [r["line"] for r in profiles.lines(prof).orderBy("read_id", "pos").collect()] == ["Read\t1", "0", "2", "2"]
    assert [r["line"] for r in profiles.run_lines(prof).collect()] == ["1\t2\t2"]
    assert [r["line"] for r in profiles.tagged_lines(prof).collect()] == ["P 3 0 2 2"]


@pytest.mark.parametrize("k", [5, 7, 21, 31, 32, 62, 63, 101])
def test_super_words_lose_no_window(k, seqs):
    """Stretches, packing, splitting of hot minimizers, counts and profiles by plain loops, without Spark."""
    given = [*seqs, None, "acgté" * 9]
    want = counted([s for s in given if s], k)
    batch = pa.RecordBatch.from_arrays([pa.array(given), pa.array(range(len(given)), pa.int64())], names=["seq", "_key"])
    codes = next(superwords.letters(iter([batch]), k))[0]
    for hot in (np.zeros(0, np.uint64), np.unique(superwords.window_minimizers(codes, k))[:3]):
        sent = pa.Table.from_batches(list(superwords._sent(k, 6, hot, None)(iter([batch]))))
        found, profile = {}, {}
        for bucket in set(sent.column("bucket").to_pylist()):
            made = superwords._summed(k, 1, ["kmer", "n"])(sent.filter(pc.equal(sent.column("bucket"), bucket)))
            names = words.spelled(words.word_numbers(made.column("kmer").combine_chunks(), k), k).to_pylist()
            assert not found.keys() & set(names)
            found |= dict(zip(names, made.column("n").to_pylist(), strict=True))
        assert found == want
        placed = pa.Table.from_batches(list(superwords._placed(k, 6, hot)(iter([batch]))))
        for bucket in set(placed.column("bucket").to_pylist()):
            made = superwords._answered(k, True)(placed.filter(pc.equal(placed.column("bucket"), bucket)))
            for key, first, counts in zip(*(made.column(c).to_pylist() for c in ("key", "first", "counts")), strict=True):
                for i, n in enumerate(counts):
                    assert (key, first + i) not in profile
                    profile[key, first + i] = n
        windows = {(i, p): s[p : p + k].lower() for i, s in enumerate(given) if s for p in range(len(s) - k + 1)}
        assert profile == {at: 0 if set(w) - set("acgt") else want[canonical(w)] for at, w in windows.items()}


def test_super_words_are_few_bytes():
    """Of letters without repeats, a window costs at least three times fewer bytes than a word and its count."""
    r = random.Random(8)
    batch = pa.RecordBatch.from_arrays([pa.array(["".join(r.choices("acgt", k=20_000)) for _ in range(10)])], names=["seq"])
    for k in (21, 40):
        size = sum(b.nbytes for b in superwords._sent(k, 16, np.zeros(0, np.uint64), None)(iter([batch])))
        assert 3 * size < 10 * (20_000 - k + 1) * (8 * len(words.limbs(k)) + 8)


def test_long_sequences_in_slices(spark, monkeypatch):
    r = random.Random(4)
    seq = "".join(r.choices("acgtn", [30, 30, 30, 30, 1], k=3000))
    batch = pa.RecordBatch.from_arrays([pa.array(["acgtacgt", seq, "ttacgtacga"]), pa.array([7, 8, 9])], names=["seq", "_key"])
    monkeypatch.setattr(superwords, "CHUNK", 256)
    monkeypatch.setattr(superwords, "PIECE", 64)
    placed = pa.Table.from_batches(list(superwords._placed(7, 3, np.zeros(0, np.uint64))(iter([batch]))))
    got = {}
    for bucket in range(3):
        made = superwords._answered(7, True)(placed.filter(pc.equal(placed.column("bucket"), bucket)))
        for key, first, counts in zip(*(made.column(c).to_pylist() for c in ("key", "first", "counts")), strict=True):
            assert first // 64 == (first + len(counts) - 1) // 64
            got |= {(key, first + i): n for i, n in enumerate(counts)}
    whole = counted([seq, "acgtacgt", "ttacgtacga"], 7)
    assert len(got) == 2994 + 2 + 4 and all(got[8, p] == (0 if "n" in seq[p : p + 7] else whole[canonical(seq[p : p + 7])]) for p in range(2994))


def test_hot_minimizers_are_found_and_split(spark):
    seqs = ["a" * 60 + "c"] * 3000 + ["acgtaccgtgtacgatcgatcgtagctagctagtcgatgc"] * 20
    buckets, hot = superwords.plan(reads(spark, seqs), 11, sample=1.0)
    assert 1 <= len(hot) < buckets
    assert as_dict(words.readable(superwords.counted(reads(spark, seqs), 11, planned=(buckets, hot)).withColumnRenamed("n", "count"), 11)) == dict(counted(seqs, 11))


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_runs_and_intervals_over_blocks(spark, block):
    r = random.Random(block)
    counts = {key: [r.choice([0, 0, 2, 2, 2, 3]) for _ in range(60)] for key in range(5)}
    prof = spark.createDataFrame([(key, p, c) for key, own in counts.items() for p, c in enumerate(own)], "read_id long, pos int, count int")
    want_runs, want_hits = set(), set()
    for key, own in counts.items():
        p = 0
        while p < 60:
            q = p
            while q + 1 < 60 and own[q + 1] == own[p]:
                q += 1
            if own[p]:
                want_runs.add((key, p, q, own[p]))
            p = q + 1
        open_at = last = None
        for p, c in enumerate(own):
            if c:
                if last is not None and p - last > 2:
                    want_hits.add((key, open_at, last + 2))
                    open_at = None
                open_at, last = p if open_at is None else open_at, p
        if last is not None:
            want_hits.add((key, open_at, last + 2))
    assert {tuple(x) for x in profiles.runs(prof, block).select("read_id", "first", "last", "count").collect()} == want_runs
    assert {tuple(x) for x in profiles.intervals(prof, 2, True, block).select("seq_idx", "beg", "end").collect()} == want_hits


def test_pieces_of_profiles(spark, seqs):
    whole = counted(seqs, 7)
    made = {}
    for row in profiles.pieces(superwords.probed(reads(spark, seqs), 7)).collect():
        made[row["read_id"], row["first"]] = row["counts"]
    assert made.keys() == {(i, 0) for i, s in enumerate(seqs) if len(s) > 6}
    for (i, _), counts in made.items():
        s = seqs[i].lower()
        assert counts == [0 if set(s[p : p + 7]) - set("acgt") else whole[canonical(s[p : p + 7])] for p in range(len(s) - 6)]


def test_aligned_groups_and_haplotypes_of_long_words(spark):
    r = random.Random(9)
    base = "".join(r.choices("acgt", k=80))
    rows = [("x", base), ("y", base[:40] + "acgt"["cgta".index(base[40])] + base[41:]), (None, base[:50])]
    df = spark.createDataFrame(rows, "lang string, seq string")
    wide = tables.counted_apart(df, 41, "lang", ["x", "y"])
    got = {row["kmer"]: (row["c0"], row["c1"]) for row in words.readable(wide, 41).collect()}
    cx, cy = counted([rows[0][1]], 41), counted([rows[1][1]], 41)
    assert got == {w: (cx.get(w, 0), cy.get(w, 0)) for w in cx.keys() | cy.keys()}
    t = table(spark, {w: 1 for w in cx.keys() | cy.keys()})
    pairs = tables.haplotypes(t, 41).collect()
    assert len(pairs) == 2 and {p["left"] + p["centre"].lower() + p["right"] for p in pairs} <= got.keys() and len({(p["left"], p["right"]) for p in pairs}) == 1
    assert {p["site"] for p in tables.haplotype_sites(t, 41).collect()} == {0}
    e = tables.evaluated_on(wide, 2, "(A |+ B){-50}", 41).collect()
    assert {x["kmer"] for x in e} == {w for w in got if 1 <= 100 * sum(c in "gc" for c in w) // 41 <= 50}
