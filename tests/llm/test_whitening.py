"""Whitening against numpy and exact arithmetic, and its defined cases."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import whitening
from paceline.llm.queries import op12_whitening
from paceline.llm.shared import scratch_folder

SCHEMA = "vec_id long, embedding array<float>, component int, n string"


def turned(values, seed):
    """A symmetric matrix of given eigenvalues in extended precision, and its eigenvectors."""
    rng = np.random.default_rng(seed)
    n = len(values)
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(4):
        q = q @ (np.eye(n, dtype=np.longdouble) * 3 - q.T @ q) / 2
    return q @ np.diag(np.array(values, np.longdouble)) @ q.T, q


@pytest.mark.parametrize("values", [
    [9.0, 5.0, 2.0, 1.0, 0.5, 0.25], [3.0, 1 + 1e-9, 1.0, 1 - 1e-9, 1e-3, 1e-4], [5, 1, 1, 1, 1, 0.5], [4, 1 + 1e-12, 1, 1e-8, 0, 0],
    list(np.linspace(1, 1.0001, 40)), [*(10 + np.arange(20) * 1e-8), *np.linspace(0.1, 5, 20)],
])
def test_refined_eigenvectors(values):
    a, q = turned(values, len(values))
    got, x = whitening.refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    order = np.argsort(-np.array(values, float), kind="stable")
    want = np.array(values, np.longdouble)[order]
    assert np.abs(got - want).max() < 1e-17 * max(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    assert np.abs(a @ x - x * got).max() < 1e-16 * max(values)
    for k in range(len(values)):  # a vector is as sure as its eigenvalue stands apart
        gap = min([abs(float(want[k] - v)) for j, v in enumerate(want) if j != k])
        if gap > 1e-13:
            assert 1 - abs(float(x[:, k] @ q[:, order[k]])) < (1e-17 * max(values) / gap) ** 2 + 1e-17


def brute(rows, most=16):
    """Exact n, S and deviations; eigenvalues and whitened rows by numpy."""
    kept = [(i, [int(np.floor(np.float64(c) * 64)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, total = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    cov = [[sum(Fraction((n * x[i] - total[i]) * (n * x[j] - total[j]), n**3) for x in distinct) for j in range(len(total))] for i in range(len(total))]
    values, vectors = np.linalg.eigh(np.array(cov, float))
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True)), np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, total, strict=True)]) @ vectors / np.sqrt(values)) for i, x in kept]
    return n, values / sum(float(cov[k][k]) for k in range(len(cov))), out


def test_rows_equal_numpy_and_exact_deviations(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(size=6) * np.array([5, 3, 2, 1, 0.7, 0.3])]) for k in range(60)]
    rows += [(100 + k, rows[0][1]) for k in range(30)] + [(None, rows[1][1]), (None, rows[2][1])]
    left_out = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6)]
    docs = spark.createDataFrame([(i, v, 9, "x") for i, v in rows + left_out], SCHEMA).repartition(4)
    got = whitening.whiten(docs, scratch_folder(spark, "white"), most=4).collect()
    n, share, want = brute(rows, 4)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n} == {60}
    sign = {}
    by = {(r.vec_id, r.component): r for r in got if r.vec_id is not None}
    for i, deviation, w in want:
        for k in range(4):
            if i is None:
                continue
            r = by[i, k + 1]
            assert r.deviation == deviation and abs(r.explained / share[k] - 1) < 1e-9 and r.identity_error < 1e-12
            sign.setdefault(k, np.sign(r.whitened * w[k]))
            assert abs(sign[k] * r.whitened - w[k]) < 1e-8
    assert sorted(r.deviation for r in got if r.vec_id is None and r.component == 1) == sorted(d for i, d, _ in want if i is None)


def test_deviations_past_64_bits_and_very_large_entries(spark):
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 2.0])]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA), scratch_folder(spark, "white")).collect()
    assert len(got) == 3 and {r.vec_id: r.deviation for r in got}[1] is None and all(abs(r.whitened) < 10 for r in got)
    centre = whitening.Centre(3, (2**50, -7))
    x = np.array([[2**49, 5], [1, -9]])
    assert [[int(v) for v in row] for row in centre.whole(x)] == [[3 * int(a) - s for a, s in zip(row, centre.total, strict=True)] for row in x]
    big = np.array([[2**45, -3], [2**44 + 1, 7]])
    assert (whitening.exact_products(big) == big.astype(object).T @ big.astype(object)).all()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_a_component(spark, rows):
    docs = spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA)
    assert whitening.whiten(docs, scratch_folder(spark, "white")).count() == 0


def test_components_of_no_width_and_ragged_rows_are_left_out(spark):
    rows = [(k, [float(k), float(2 * k), 1.0]) for k in range(9)] + [(50, [1.0]), (51, [1.0] * 5)]
    got = whitening.whiten(spark.createDataFrame([(i, v, 0, "") for i, v in rows], SCHEMA), scratch_folder(spark, "white")).collect()
    assert {(r.vec_id, r.component) for r in got} == {(k, 1) for k in range(9)}


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, share, want = brute(rows)
    got = op12_whitening(spark, sf).orderBy("vec_id", "component").collect()
    assert len(got) == 16 * len(want) and got[0].n == n
    assert [r.deviation for r in got if r.component == 1] == [d for _, d, _ in sorted(want, key=lambda x: x[0])]
    assert max(abs(r.explained / share[r.component - 1] - 1) for r in got) < 1e-9 and F and got[0].identity_error < 1e-10
