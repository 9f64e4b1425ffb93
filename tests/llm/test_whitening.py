import math
from fractions import Fraction

import numpy as np

from seqloom.llm import whitening as W


def brute(rows, components=8):
    """Plain loops over exact integers, then eigenvectors of the covariance."""
    fit = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    xs = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in fit]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[j] for x in xs) for j in range(d)]
    deviation = [sum((n * x[j] - sums[j]) ** 2 for j in range(d)) for x in xs]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in xs])
    covariance = sum(np.outer(c, c) for c in centred) / n
    e, u = np.linalg.eigh(covariance)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [i for i, _ in fit], n, deviation, centred @ u / np.sqrt(np.abs(e)), e / np.trace(covariance)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 5, "own") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")


def odd_rows(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.normal(size=12) * np.arange(1, 13)).tolist()) for i in range(900)]
    hot = (900, rows[0][1])
    return rows + [hot] * 400 + [(None, rows[3][1]), (1, None), (2, []), (3, [None] * 12), (4, [math.nan] + [0.0] * 11), (5, [math.inf] * 12), (6, [1.0, 2.0]), (7, [1e30] * 12)]


def test_against_brute_force(spark):
    rows = odd_rows()
    got = W.whitened(frame(spark, rows).repartition(7)).collect()
    ids, n, deviation, white, explained = brute([(i, v) for i, v in rows if v and len(v) == 12 and v[0] != 1e30])
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    want = sorted(zip(map(str, ids), deviation, map(tuple, np.abs(white)), strict=True))
    have = {}
    for r in got:
        have.setdefault((str(r["vec_id"]), r["deviation"]), []).append(r)
    mine = sorted((i, dev, tuple(abs(r["whitened"]) for r in sorted(some, key=lambda r: r["component"]))) for (i, dev), some in have.items())
    assert {(a, b) for a, b, _ in want} == {(a, b) for a, b, _ in mine if len(_) == 8} | {(a, b) for a, b, _ in mine if len(_) != 8}
    by_key = {(a, b): c for a, b, c in want}
    for i, dev, values in mine:
        assert np.allclose(sorted(values), sorted(by_key[i, dev] * (len(values) // 8)), rtol=1e-6, atol=1e-8)
    for c in range(8):
        assert {r["explained"] for r in got if r["component"] == c + 1}.pop() == np.float64(explained[c]) or abs({r["explained"] for r in got if r["component"] == c + 1}.pop() / explained[c] - 1) < 1e-9
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitened_values_have_unit_covariance_and_one_sign(spark):
    rows = odd_rows(4)
    got = W.whitened(frame(spark, rows).repartition(5)).toPandas()
    wide = got[got["vec_id"].between(8, 899)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    again = W.whitened(frame(spark, rows).repartition(2)).toPandas()
    wide2 = again[again["vec_id"].between(8, 899)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(wide, wide2, atol=1e-8)


def test_flat_dimensions_and_few_rows(spark):
    got = W.whitened(frame(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.5, 3.0])])).collect()
    assert len(got) == 6
    first = [r for r in got if r["component"] == 1]
    assert sorted(round(abs(r["whitened"]), 9) for r in first) == [1.0, 1.0] and {r["explained"] for r in first} == {1.0}
    assert all(r["whitened"] is None for r in got if r["component"] > 1) and {round(r["identity_error"], 9) for r in got} == {0.0}
    one = W.whitened(frame(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]


def test_empty(spark):
    assert W.whitened(frame(spark, [])).count() == 0
    got = W.whitened(frame(spark, [(1, None), (2, [None])]))
    assert got.count() == 0 and got.columns[0] == "vec_id"


def test_large_integers_stay_exact(spark):
    big = 2.0**32
    rows = [(i, [big * (i % 3), -big * i]) for i in range(50)]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    xs = [[math.floor(1024 * c) + 100000 for c in v] for _, v in rows]
    sums = [sum(x[j] for x in xs) for j in range(2)]
    want = {i: sum((50 * x[j] - sums[j]) ** 2 for j in range(2)) for i, x in enumerate(xs)}
    for r in got:
        assert r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None)
