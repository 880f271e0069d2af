from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from farol.llm.whitening import characteristic_modulo, characteristic_polynomial, largest_roots, primes, scatter, whitened

KIND = "vec_id long, embedding array<float>, n int, white string, v long"


@pytest.fixture()
def vectors(spark):
    def make(table):
        return spark.createDataFrame([(i, v, 1, "w", 2) for i, v in table], KIND).repartition(3)

    return make


def by_definition(poly_of):
    """det(t - matrix) by Faddeev and LeVerrier, in whole numbers."""
    d = len(poly_of)
    a, m, out = np.array(poly_of, object), np.zeros((d, d), object), [1]
    for k in range(1, d + 1):
        m = a.dot(m) + out[-1] * np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
        out.append(-(a.dot(m).trace()) // k)
    return out[::-1]


def random_scatter(d, n, rank, seed):
    x = np.random.default_rng(seed).integers(-500, 500, (n, rank)) @ np.random.default_rng(seed + 1).integers(-3, 4, (rank, d))
    x = x.astype(object)
    return (n * x.T.dot(x) - np.outer(x.sum(0), x.sum(0))).tolist()


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (2, 2), (5, 5), (9, 4), (20, 20)])
def test_polynomial_is_exact(spark, d, rank):
    matrix = random_scatter(d, 40, rank, d)
    assert characteristic_polynomial(spark, matrix) == by_definition(matrix)


def test_polynomial_modulo_a_small_prime_with_vanishing_pivots():
    rnd = np.random.default_rng(5)
    for _ in range(50):
        a = rnd.integers(0, 3, (7, 7))
        assert characteristic_modulo(a, 3) == [c % 3 for c in by_definition(a.tolist())]


def test_primes():
    found = primes(200)
    assert found[0] == 2**31 - 1 and len(set(found)) == len(found) and math.prod(found) > 2**200
    assert all(all(p % q for q in range(2, 2000)) for p in found)


def test_roots_with_repeats_and_close_neighbours():
    poly = [1]
    roots = [7, 7, 10**6, 10**6 + 1, 3, 0, 123456789]
    for r in roots:
        poly = [(poly[k - 1] if k else 0) - r * (poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    got = [Fraction(r, 1 << 80) for r in largest_roots(poly, 9, 80)]
    assert [round(g) for g in got] == sorted(filter(None, roots), reverse=True)
    assert all(abs(g - round(g)) <= Fraction(1, 1 << 79) for g in got)


def check(table, got, wanted=8):
    """Compare with numpy's eigenvectors; repeated eigenvalues by their projector."""
    x = np.floor(1024 * np.array([v for _, v in table], np.float32).astype(np.float64))
    n, centred = len(x), x - x.mean(0)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:wanted]
    order = [k for k in order if values[k] > 1e-9 * values.max()]
    white = np.array([r["white"] for r in sorted(got, key=lambda r: r["vec_id"])])
    assert white.shape == (n, len(order))
    expected = centred @ basis[:, order] / np.sqrt(values[order])
    np.testing.assert_allclose(white @ white.T, expected @ expected.T, atol=1e-7)
    np.testing.assert_allclose(got[0]["explained"], values[order] / values.sum(), rtol=1e-9)
    total = [[int(a) + 100_000 for a in row] for row in x]
    sums = [sum(c) for c in zip(*total)]
    assert [r["deviation"] for r in sorted(got, key=lambda r: r["vec_id"])] == [
        sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in total]
    assert {r["n"] for r in got} == {n} and all(r["identity_error"] < 1e-9 for r in got)


@pytest.mark.parametrize(("n", "d"), [(300, 12), (5, 9), (2, 3), (50, 1)])
def test_whitening(spark, vectors, n, d):
    rnd = np.random.default_rng(n)
    table = [(i, [float(c) for c in rnd.normal(size=d) * np.linspace(1, 2, d)]) for i in range(n)]
    check(table, whitened(vectors(table)).collect())


def test_repeated_eigenvalues(spark, vectors):
    table = [(2 * k + s, [float((1 - 2 * s) * (i == k)) for i in range(5)]) for k in range(5) for s in range(2)]
    check(table, whitened(vectors(table), wanted=5).collect(), 5)


def test_unusable_rows_are_left_out(spark, vectors):
    rnd = np.random.default_rng(1)
    good = [(i, [float(c) for c in rnd.normal(size=4)]) for i in range(30)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [1.0, math.nan, 2.0, 3.0]), (103, [math.inf, 1.0, 1.0, 1.0]), (104, [1.0]), (105, [])]
    check(good, whitened(vectors(good + bad)).collect())


def test_huge_and_constant_entries(spark, vectors):
    rnd = np.random.default_rng(2)
    table = [(i, [float(np.float32(c)) for c in (rnd.normal() * 1e9, 5.0, rnd.normal())]) for i in range(20)]
    n, sums, matrix = scatter(vectors(table), "embedding", 3)
    x = [[math.floor(1024 * c) for c in v] for _, v in table]
    assert n == 20 and sums == [sum(c) for c in zip(*x)]
    assert matrix == [[n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j] for j in range(3)] for i in range(3)]
    got = whitened(vectors(table + [(50, [3e38, 5.0, 0.0])])).collect()
    assert len(got) == 21 and all(len(r["white"]) == 2 for r in got) and all(r["identity_error"] < 1e-4 for r in got)


def test_nothing_to_whiten(spark, vectors):
    assert whitened(vectors([(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitened(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whitened(vectors([(1, None), (2, [])])).count() == 0
    twice = whitened(vectors([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 2.5])])).collect()
    assert sorted((str(r["vec_id"]), len(r["white"])) for r in twice) == [("1", 1), ("1", 1), ("None", 1)]
