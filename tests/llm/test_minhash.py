import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import components, minhash


def shingles(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(k)), strict=False))


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)], low[find(i)] == d) for i, (d, s) in enumerate(sets))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    out, n = [], 0
    for family in range(12):
        base = [word() for _ in range(r.choice([40, 120, 400]))]
        for _ in range(30 if family == 0 else 5):
            copy = list(base)
            for _ in range(r.randint(0, len(copy) // 20)):
                copy[r.randrange(len(copy))] = word()
            out.append((n, " ".join(copy)))
            n += 1
    odd = [None, "", " \t ", "one", "One", "one two", "ONE  two\n", " ", "a b c", "A b\x0bc"]
    return out + [(1000 + i, t) for i, t in enumerate(odd)] + [(2000, "w " * 5000), (2001, "w " * 4000)]


@pytest.mark.parametrize(("k", "percent", "part", "leaders"), [(3, 85, 3000, 16), (5, 80, 3000, 16), (3, 85, 7, 16), (3, 85, 5, 1), (3, 85, None, 2)])
def test_against_brute_force(docs, rows, k, percent, part, leaders):
    sizes = {"part": part} if part else {"shingles": 700}  # by members, or by their shingles
    got = minhash.near_duplicates(docs(rows), k=k, percent=percent, leaders=leaders, **sizes).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, percent)


def test_second_places_make_every_open_pair_meet_once(spark):
    """Of the pairs of a bucket that are neither in one part nor in one component, every one meets; others never do."""
    first = spark.createDataFrame([(i, 7, 5, i % 5, i % 5, 10) for i in range(40)], "rep long, bucket long, parts int, mine int, one int, weight long")
    component = lambda i: 0 if i < 28 else 30 if i in (30, 31) else i
    linked = spark.createDataFrame([(i, component(i)) for i in range(40) if component(i) != i], "node long, component long")
    places = {}
    for r in minhash._second_places(first, linked, 4, 1000).collect():
        places.setdefault((r["one"], r["two"]), []).append((r["rep"], r["side"], r["label"]))
        assert r["label"] == component(r["rep"])
    met = [frozenset((a[0], b[0])) for own in places.values() for a in own for b in own if a[1] < b[1] and a[2] != b[2]]
    want = {frozenset((i, j)) for i in range(40) for j in range(i) if i % 5 != j % 5 and component(i) != component(j)}
    assert set(met) == want and max(map(len, places.values())) <= 8 + 8
    everyone = linked.unionByName(spark.createDataFrame([(i, 0) for i in range(28, 40)], "node long, component long")).groupBy("node").agg(F.min("component").alias("component"))
    assert minhash._second_places(first, everyone, 4, 1000).count() == 0


def test_empty_null_and_repeated_rows(docs):
    assert minhash.near_duplicates(docs([(1, "a")]).limit(0)).count() == 0
    got = minhash.near_duplicates(docs([(None, "a b c"), (5, "a b c"), (5, "a b c")]), k=3, percent=85).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("5", 5), ("5", 5), ("None", 5)]


def test_keys_of_letters(spark):
    rows = [("b", "one two three"), ("a", "ONE two three"), (None, "one two three"), ("z", "other"), (None, "lost"), (None, "lost"), ("e", None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "name string, body string"), k=3, percent=85, key="name", text="body")
    assert got.columns == ["name", "n_shingles", "component_id", "kept"]
    want = [("a", 1, "a", True), ("b", 1, "a", False), (None, 1, "a", False), ("z", 1, "z", True), (None, 1, None, True), (None, 1, None, False), ("e", 0, "e", True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_rows_without_an_identifier_are_compared(docs, spark, sf):
    r = random.Random(9)
    words = lambda: [f"w{r.randrange(10**6)}" for _ in range(200)]
    one, two, alone = words(), words(), words()
    near = lambda x: " ".join([*x[:-1], "other"])
    rows = [(5, "a b c"), (None, "A b c"), (7, " ".join(one)), (None, near(one)), (None, " ".join(two)), (None, near(two)), (None, " ".join(alone)), (None, ""), (None, None)]
    got = minhash.near_duplicates(docs(rows), k=3, percent=85).collect()
    have = sorted(((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got), key=str)
    want = [(5, 1, 5, True), (None, 1, 5, False), (7, 198, 7, True), (None, 198, 7, False)]
    want += [(None, 198, None, True), (None, 198, None, False), (None, 198, None, True), (None, 0, None, True), (None, 0, None, True)]
    assert have == sorted(want, key=str)
    rows += [(8, near(alone)), (8, " ".join([*alone[:-2], "yet", "other"]))]
    assert corpus_pipeline.near_stage(spark, docs(rows, more=False), sf).count() == 6


def test_near_stage_keeps_one_of_each_component(docs, rows, spark, sf):
    """Against brute force; identifiers are null or repeated here and there, so that rows, not identifiers, are counted."""
    want = brute(rows, 5, 80)
    odd = [(None if d % 11 == 0 else d - d % 2 if d < 1000 else d, t) for d, t in rows]
    got = corpus_pipeline.near_stage(spark, docs(odd, more=False), sf).collect()
    component = dict(zip([t for _, t in rows], [c for _, (_, _, c, _) in sorted(zip([d for d, _ in rows], want, strict=True))], strict=True))
    kept = [component[r["text"]] for r in got]
    alone = [c for (_, n, c, _), (_, t) in zip(want, sorted(rows), strict=True) if not n]
    assert sorted(set(kept)) == sorted({c for _, _, c, _ in want}) and len(kept) == len({c for _, n, c, _ in want if n}) + len(alone)


def test_registers_merge_and_estimate():
    sketch = minhash.SetSketch(2000)
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 1 << 63, 3000).astype(np.uint64) for _ in range(2))
    shared = a[:2000]
    one, two = a, np.concatenate([shared, b[:1000]])
    x, y = sketch.registers(one), sketch.registers(two)
    assert (sketch.merged(x, y) == sketch.registers(np.union1d(one, two))).all()
    assert abs((x == y).mean() - 2000 / 4000) < 0.05
    like = minhash.JointLikelihood(0.85)
    count = lambda p, q: (np.array([(q < p).sum()]), np.array([(q > p).sum()]), np.array([(q == p).sum()]))
    assert not like.plausible(*count(x, y), 3000, np.array([3000.0]))[0]
    near = np.concatenate([a[:2800], b[:200]])
    assert like.plausible(*count(x, sketch.registers(near)), 3000, np.array([3000.0]))[0]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100
