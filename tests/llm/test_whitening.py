import math

import numpy as np
import pytest

from lexiloom.llm import whitening


def brute(rows, k=4):
    """By the eigenvectors of the covariance; whole numbers in Python's integers."""
    x = {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in rows}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in fit])
    values, vectors = np.linalg.eigh(a.T @ a / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, row in x.items():
        deviation = sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True))
        c = np.array([(n * v - s) / n for v, s in zip(row, sums, strict=True)])
        for j in range(k):
            out[i, j + 1] = (n, deviation, c @ vectors[:, j] / np.sqrt(values[j]), values[j] / values.sum())
    return out


def check(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    sign = {}
    for r in got:
        n, deviation, white, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation if deviation < 1 << 63 else None)
        assert r["explained"] == pytest.approx(explained, rel=1e-8)
        assert abs(r["whitened"]) == pytest.approx(abs(white), rel=1e-6, abs=1e-8)
        if abs(white) > 1e-3:
            sign.setdefault(r["component"], set()).add(np.sign(white) == np.sign(r["whitened"]))
        assert r["identity_error"] < 1e-9
    assert all(len(v) == 1 for v in sign.values())


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(700, 6)) * [3, 2, 1, 0.7, 0.5, 0.2] + 5) @ rng.normal(size=(6, 6))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # copies count once
    odd = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [math.nan] * 6), (2003, [math.inf] * 6), (2004, [1.0]), (2005, [])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "vec_id long, embedding array<float>, whitened double").repartition(40)
    check(whitening.whiten(df).collect(), brute(rows))


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(whitening.whiten(df).collect(), brute([(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]))


def test_tree_of_factors_keeps_small_components(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-1000, 1000, (500, 3)) * np.array([1_000_000_000, 1, 1])
    df = spark.createDataFrame([(i, (x / 256).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(70)
    fit = whitening.quantised(df).select("x").distinct().repartition(70)
    n, sums = whitening.exact_sums(fit, 3)
    assert (n, sums) == (len(set(map(tuple, v.tolist()))), np.unique(v, axis=0).sum(axis=0).tolist())
    values, _ = whitening.principal(whitening.final_factor(fit, n, sums, fan=3), n)
    a = np.unique(v, axis=0)
    assert values[1:] == pytest.approx(sorted(np.linalg.eigvalsh(np.cov(a[:, 1:].T.astype(float), bias=True)))[::-1], rel=1e-2)
    check(whitening.whiten(df, components=1).collect(), brute([(i, (x / 256).tolist()) for i, x in enumerate(v)], 1))


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (1, [0.5, 2.0])], schema)).collect()
    assert len(one) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, 0.0, 0.0)}
    flat = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [2.0, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], r["whitened"] and abs(r["whitened"])) for r in flat) == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0])], schema)).collect()
    assert {r["deviation"] for r in huge} == {None} and {abs(r["whitened"]) for r in huge if r["component"] == 1} == {1.0}
