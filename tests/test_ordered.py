"""Tables in order without sampling them first, what is stored of them, and packed runs between tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seqloom.functions.planes import numbers, planed, planed_steps, summed_steps
from seqloom.operators import homopolymers, profiles, superwords, tables, words
from seqloom.sources import artifacts


@pytest.fixture(scope="module")
def reads(spark):
    r = random.Random(5)
    seqs = ["".join(r.choices("acgtn", [9, 9, 9, 9, 1], k=r.choice([3, 21, 60, 300]))) for _ in range(400)] + ["acgt" * 60, "a" * 300, None, ""]
    return spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string").repartition(3).cache()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_planes():
    r = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.array([0]), np.array([255, 256, 65_536]), r.integers(0, 1 << 62, 100)):
        assert numbers(planed(values)).tolist() == values.tolist()
    for values in (np.zeros(0, np.int64), np.array([-(2**63), 2**63 - 1, -1, 0]), r.integers(-(1 << 63), (1 << 63) - 1, 100)):
        assert summed_steps(planed_steps(values)).tolist() == values.tolist()


@pytest.mark.parametrize("k", [5, 12, 21, 31])
def test_words_read_backward(k):
    r = random.Random(k)
    some = ["".join(r.choices("acgt", k=k)) for _ in range(50)]
    packed = np.array([sum("acgt".index(c) << 2 * (k - 1 - i) for i, c in enumerate(w)) for w in some], np.int64)
    assert words.spelled(packed, k).to_pylist() == some
    assert words.spelled(words.backward(packed, k), k).to_pylist() == [w[::-1] for w in some]
    assert words.spelled(words.complement(packed, k), k).to_pylist() == [w[::-1].translate(str.maketrans("acgt", "tgca")) for w in some]


@pytest.mark.parametrize("k, cutoff, turned", [(21, 1, False), (21, 1, True), (31, 2, False), (8, 1, True), (41, 1, False), (41, 1, True)])
def test_ordered_tables(spark, reads, k, cutoff, turned):
    made = words.ordered_table(reads, k, cutoff, turned)
    want = dict(rows_of(words.count_table(reads, k, cutoff)))
    if k < 32:
        assert "rangepartitioning" not in made._jdf.queryExecution().toString()  # the table is made once
    got = rows_of(made)
    assert got == sorted(want.items(), key=lambda x: x[0][::-1] if turned else x[0])


def test_stored_order_of_files(spark, reads, tmp_path):
    path = str(tmp_path / "x")
    words.ordered_table(reads, 21, turned=True).write.options(**artifacts.STORED).parquet(path)
    names = artifacts.stored_files(spark, path)
    order = rows_of(words.ordered_table(reads, 21, turned=True))
    want = sorted(b for a, b in zip(order, order[1:], strict=False) if a[0] >= b[0])
    assert len(names) > 1 and len(want) > 100
    for run in (1, 7, 1 << 16):
        assert sorted(rows_of(tables.disordered_files(spark, names, run))) == want
        assert sorted(rows_of(tables.disordered_stored(artifacts.placed_rows(spark, path), run))) == want
    once_more = order + rows_of(spark.read.parquet(names[0]))
    again = sorted(b for a, b in zip(once_more, once_more[1:], strict=False) if a[0] >= b[0])
    assert sorted(rows_of(tables.disordered_files(spark, names + names[:1]))) == again


@pytest.fixture(scope="module")
def counted(spark, sf):
    return sorted(rows_of(entry.queries()["kmer_count"](spark, sf)))


#: Queries that need words in order, and what they make of the sorted table.
IN_ORDER = {
    "table_ordinals": lambda t: t[1000:2000],
    "stored_table_seek": lambda t: [r for r in t if r[0] >= "gattaca"][:1],
    "stored_table_range": lambda t: [r for r in t if "aacc" <= r[0] < "acct"],
    "table_slice": lambda t: t[len(t) // 4 : 2 * len(t) // 4],
    "table_order_check_sorted": lambda t: t[:1],
    "table_ranges": lambda t: [(*r, True) for r in t],
}


@pytest.mark.parametrize("name", IN_ORDER)
def test_in_order_without_making_the_table_twice(spark, sf, counted, name, monkeypatch):
    def twice(*_):
        raise AssertionError("Spark makes a table twice to sort it by ranges")

    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", twice)
    assert sorted(rows_of(entry.queries()[name](spark, sf))) == IN_ORDER[name](counted)


def test_words_are_looked_up_where_they_are_counted(spark, reads):
    made = superwords.looked_up(reads, 21, F.col("read_id") % 7 == 0)
    assert "Join" not in made._jdf.queryExecution().toString()
    table = dict(rows_of(words.count_table(reads, 21)))
    turned = str.maketrans("acgt", "tgca")
    asked = {s[i : i + 21] for n, s in reads.collect() if n % 7 == 0 and s for i in range(len(s) - 20)}
    assert sorted(rows_of(made)) == sorted((w, table[min(w, w[::-1].translate(turned))]) for w in asked if "n" not in w)
    assert superwords.looked_up(reads, 21, F.lit(None).cast("boolean")).count() == 0


def test_look_up_query_joins_nothing(spark, sf):
    assert "Join" not in entry.queries()["table_lookup"](spark, sf)._jdf.queryExecution().toString()


def test_chains_of_alternatives_stay_short(spark):
    wide = spark.createDataFrame([("aaaaa", 1, 0, 0, 5), ("ccccc", 0, 0, 0, 0), ("ggggg", 0, 2, 3, 9)], "kmer string, c0 long, c1 long, c2 long, c3 long")
    made = {text: tables.evaluated_on(wide, 4, text) for text in ("#A |+ #B |+ #C |+ #D", "A |> B |> C |> D", "A |. B |. C |. D", "A |< B |< C |< D", "(A &< D) |+ (B &< C)")}
    assert [sorted(r[1] for r in x.collect()) for x in made.values()] == [[2, 3], [5, 9], [1, 2], [1, 2], [1, 2]]
    plan = made["#A |+ #B |+ #C |+ #D"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 30


@pytest.fixture(scope="module")
def long_reads(spark):
    r = random.Random(3)
    seqs = ["acgt" * 40_000, "a" * 70_000 + "n" + "a" * 65_600, "".join(r.choices("acgtn", [9, 9, 9, 9, 1], k=3000)), "acg", "", None, "acgtta" * 30]
    return spark.createDataFrame([*enumerate(seqs), (None, "gattacag" * 9)], "read_id long, seq string").repartition(3)


def test_pieces_in_packed_runs(long_reads):
    made, want = ({(r["read_id"], r["first"]): r["counts"] for r in x.collect()} for x in (superwords.pieced(long_reads, 7), profiles.pieces(superwords.probed(long_reads, 7))))
    assert made == want and (None, 0) in made and {first for n, first in made if n == 0} == {0, 65_536, 131_072}


def test_runs_of_pieces(long_reads):
    own = long_reads.where("read_id IS NOT NULL")
    made = profiles.runs_of_pieces(superwords.pieced(own, 7))
    assert sorted(rows_of(made.select("read_id", "first", "last", "count"))) == sorted(rows_of(profiles.runs(profiles.absolute(own, 7)).select("read_id", "first", "last", "count")))


@pytest.mark.parametrize("name", ["profile_runs", "profile_codec"])
def test_no_place_is_shuffled_alone(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "pos" not in plan.split("Exchange", 1)[1] and "counts" not in plan.split("Exchange", 1)[1]


def test_tagged_buckets_in_order(spark, reads):
    lines, first = tables.tagged_buckets_of(reads, 21, 3)
    assert "rangepartitioning" not in lines._jdf.queryExecution().toString()
    got = [r["line"] for r in lines.collect()]
    want = [r["line"] for r in tables.tagged_buckets(words.count_table(reads, 21), 21, 3).orderBy("ord").collect()]
    assert first() + got == want


@pytest.mark.parametrize("k", [30, 31])
def test_homopolymer_errors_of_sequences(spark, k):
    r = random.Random(k)
    seqs = []
    for _ in range(60):
        left, flank, base = "".join(r.choices("acgt", k=20)), "".join(r.choices("acgt", k=20)), r.choice("acgt")
        for _ in range(r.randint(2, 9)):
            end = list(flank)
            end[r.randrange(9, 15)] = r.choice("acgt")
            seqs += [left + base * r.randint(1, 9) + "".join(end)] * r.choice([1, 1, 3, 8])
    own = spark.createDataFrame(list(enumerate(seqs)), "read_id long, seq string")
    made = homopolymers.errors_of(own, k, 2, 2, 500)
    assert "Window" not in made._jdf.queryExecution().toString()  # which would shuffle and sort words as rows
    want = rows_of(homopolymers.errors(words.count_table(own, k), k, 2, 2, 500))
    assert sorted(rows_of(made)) == sorted(want) and len(want) > 9
    assert homopolymers.errors_of(own.limit(0), k, 2, 2, 500).count() == 0
