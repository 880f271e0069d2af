"""Whitening of integer vectors over the exact characteristic polynomial of their scatter.

The scatter matrix n * sum(x x') - S S' of integer vectors is an integer matrix: n^2 times their covariance. Spark
sums it exactly. Its characteristic polynomial is taken modulo many primes, each by reduction to Hessenberg form in
a task of its own, and put together by Chinese remaindering under Hadamard-like bounds on the coefficients. All its
roots are real, so the sign changes of a shifted polynomial count the roots above a place exactly; the largest
roots are isolated so and refined to far more digits than a double has. The component of a root spans the null
space of scatter - root, found by inverse iteration in integers with a fixed point.

What reaches the driver has the size of the matrix, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farol.llm.common import Stages, ready

#: Entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Integers are multiplied in digits of so many bits, so that doubles add their products without rounding.
DIGIT = 15
#: Fractional bits of roots and components beyond those that the matrix itself needs.
GUARD = 192
#: Scaled entries beyond this saturate.
LIMIT = 1 << 62


def _vectors(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    """floor(SCALE * c) of a batch as a matrix of integers."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dim)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    return np.where(scaled >= LIMIT, LIMIT, np.where(scaled <= -LIMIT, -LIMIT, np.clip(scaled, -LIMIT, LIMIT - 1024).astype(np.int64)))


def _digits(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of digit k * 2^(DIGIT * k); the last digit carries the sign."""
    out = []
    while x.size and (x.max() >= 1 << DIGIT or x.min() < -(1 << DIGIT)):
        out.append((x & ((1 << DIGIT) - 1)).astype(np.float64))
        x = x >> DIGIT
    return [*out, x.astype(np.float64)]


def _partial_sums(column: str, dim: int):
    """Sums of entries (i, -1) and of products (i, j <= i) of a task, by power of two, as rows (i, j, power, value)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            # 2^20 rows of products below 2^32 stay below 2^53
            for at in range(0, batch.num_rows, 1 << 20):
                digits = _digits(_vectors(batch.slice(at, 1 << 20), column, dim))
                for a, x in enumerate(digits):
                    one = totals.setdefault(a * DIGIT, np.zeros((dim, dim + 1), np.int64))
                    one[:, dim] += x.sum(0).astype(np.int64)
                    for b, y in enumerate(digits):
                        totals.setdefault((a + b) * DIGIT, np.zeros((dim, dim + 1), np.int64))[:, :dim] += (x.T @ y).astype(np.int64)
        i, j = np.tril_indices(dim)
        for power, t in totals.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([i, np.arange(dim)]).astype(np.int32)), pa.array(np.concatenate([j, np.full(dim, -1)]).astype(np.int32)),
                pa.array(np.full(len(i) + dim, power, np.int32)), pa.array(np.concatenate([t[i, j], t[:, dim]]))],
                names=["i", "j", "power", "value"])

    return work


def scatter(vectors: DataFrame, column: str, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, their sums per dimension and n * sum(x x') - S S' as exact integers, all without the shift."""
    n = vectors.count()
    sums, products = [0] * dim, [[0] * dim for _ in range(dim)]
    partial = vectors.select(column).mapInArrow(_partial_sums(column, dim), "i int, j int, power int, value long")
    for r in partial.groupBy("i", "j", "power").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        value = int(r["value"]) << r["power"]
        if r["j"] < 0:
            sums[r["i"]] += value
        else:
            products[r["i"]][r["j"]] += value
            if r["i"] != r["j"]:
                products[r["j"]][r["i"]] += value
    return n, sums, [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide every n below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        y = pow(base, odd, n)
        if y not in (1, n - 1) and all((y := y * y % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2^31, largest first, whose product has more than ``bits`` bits."""
    found, product, n = [], 1, (1 << 31) - 1
    while product.bit_length() <= bits + 1:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def characteristic_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo the prime p < 2^31, constant first."""
    a, d = matrix.astype(np.int64) % p, len(matrix)
    for k in range(1, d - 1):
        below = np.flatnonzero(a[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            a[:, [k, pivot]] = a[:, [pivot, k]]
        factors = a[k + 1:, k - 1] * pow(int(a[k, k - 1]), -1, p) % p
        a[k + 1:] = (a[k + 1:] - factors[:, None] * a[k][None, :] % p) % p
        # the same change of basis from the right; sums of so many products stay below 2^63
        change = np.zeros(d, np.int64)
        for r, f in enumerate(factors, k + 1):
            change = (change + a[:, r] * int(f)) % p
        a[:, k] = (a[:, k] + change) % p
    # polynomials of the leading blocks, each from those before
    polys = [np.array([1], np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - polys[k] * int(a[k, k])) % p
        product = 1
        for i in range(k - 1, -1, -1):
            product = product * int(a[i + 1, i]) % p
            new[:i + 1] = (new[:i + 1] - polys[i] * (product * int(a[i, k]) % p)) % p
        polys.append(new % p)
    return [int(c) for c in polys[d]]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix) of a symmetric positive semidefinite integer matrix, constant first."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # coefficient k is a symmetric sum of the roots, which are not negative and add up to the trace
    bound = max((math.comb(d, k) * trace**k // max(1, d**k) + 1 for k in range(d + 1)), default=1)
    used = primes(bound.bit_length() + 1)
    tables = spark.createDataFrame([(p,) for p in used], "p long").repartitionByRange(min(len(used), 4 * spark.sparkContext.defaultParallelism), "p")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"p": batch["p"], "coefficients": [
                characteristic_modulo(np.array([[v % p for v in row] for row in matrix], np.int64), p) for p in map(int, batch["p"])]})

    residues = {r["p"]: r["coefficients"] for r in tables.mapInPandas(work, "p long, coefficients array<long>").collect()}
    out, product = [0] * (d + 1), 1
    for p in used:
        inverse = pow(product, -1, p)
        out = [c + product * ((r - c) * inverse % p) for c, r in zip(out, residues[p])]
        product *= p
    return [c - product if 2 * c > product else c for c in out]


def _above(poly: list[int], place: int, bits: int) -> int:
    """Roots of a polynomial with real roots only above place / 2^bits, repeated ones repeatedly: by Descartes' rule, exact here."""
    c = [v << (bits * (len(poly) - 1 - k)) for k, v in enumerate(poly)]
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += place * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], place: int, bits: int) -> int:
    value = 0
    for k, v in enumerate(reversed(poly)):
        value = value * place + (v << (bits * k))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], wanted: int, bits: int) -> list[int]:
    """The largest positive roots, repeated ones repeatedly, falling, as floor(root * 2^bits).

    Intervals are halved until they hold one root or are as narrow as 2^-bits; a single root is then halved on by the sign alone.
    """
    top = 1 << max(v.bit_length() for v in [-poly[-2] if len(poly) > 1 else 0, 1])
    found: list[int] = []
    low, high = 0, top + 1
    # an interval (low, high] in units of 2^-scale with the numbers of roots above its ends
    pending = [(low, high, _above(poly, low, 0), 0, 0)]
    while pending and len(found) < wanted:
        low, high, above_low, above_high, scale = pending.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if high - low == 1 and scale == bits:
            found += [low] * inside
            continue
        if inside == 1:
            # the sign right of all larger roots tells the halves apart
            right = 1 if above_high % 2 == 0 else -1
            while scale < bits or high - low > 1:
                if high - low == 1:
                    low, high, scale = 2 * low, 2 * high, scale + 1
                middle = (low + high) // 2
                if _sign(poly, middle, scale) == right:
                    high = middle
                else:
                    low = middle
            found.append(low)
            continue
        if high - low == 1:
            low, high, scale = 2 * low, 2 * high, scale + 1
        middle = (low + high) // 2
        above = _above(poly, middle, scale)
        pending += [(low, middle, above_low, above, scale), (middle, high, above, above_high, scale)]
    return found[:wanted]


def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    length = math.isqrt(int((v * v).sum()))
    return np.array([(int(x) << bits) // length for x in v], object) if length else v


def null_vectors(matrix: list[list[int]], roots: list[int], bits: int) -> list[np.ndarray]:
    """A unit vector of each root, times 2^bits; those of repeated roots are at right angles to one another.

    Inverse iteration: matrix - root is factored once with pivots, in integers of ``bits`` binary places, and solved
    three times. A pivot that vanishes counts as the last place.
    """
    d, one, found = len(matrix), 1 << bits, []
    for number, root in enumerate(roots):
        a = np.array([[v << bits for v in row] for row in matrix], object)
        for i in range(d):
            a[i, i] -= root
        order = list(range(d))
        for k in range(d):
            pivot = max(range(k, d), key=lambda r: abs(a[r, k]))
            a[[k, pivot]], order[k], order[pivot] = a[[pivot, k]], order[pivot], order[k]
            a[k, k] = a[k, k] or 1
            factors = np.array([(int(v) << bits) // int(a[k, k]) for v in a[k + 1:, k]], object)
            a[k + 1:, k + 1:] -= (factors[:, None] * a[k, k + 1:][None, :]) >> bits
            a[k + 1:, k] = factors
        # a start that is at right angles to no component of a table by accident
        v = np.array([one // (1 + (7 * i + 3 * number) % 11) + i * one // d for i in range(d)], object)
        for _ in range(3):
            for u in found:
                v = v - ((int((u * v).sum()) >> bits) * u >> bits)
            v = _unit(v, bits)[order]
            for k in range(d):
                v[k + 1:] -= (a[k + 1:, k] * v[k]) >> bits
            for k in range(d - 1, -1, -1):
                v[k] = (int(v[k] - ((a[k, k + 1:] * v[k + 1:]).sum() >> bits if k + 1 < d else 0)) << bits) // int(a[k, k])
            v = _unit(v, bits)
        for _ in range(2):
            for u in found:
                v = v - ((int((u * v).sum()) >> bits) * u >> bits)
            v = _unit(v, bits)
        found.append(v)
    return found


def fitted(spark: SparkSession, matrix: list[list[int]], wanted: int) -> tuple[np.ndarray, list[float]]:
    """Components (rows, to double precision, the largest entry positive) and their eigenvalues of the scatter matrix, falling.

    Components without spread (eigenvalue 0) cannot be whitened and are left out.
    """
    poly = characteristic_polynomial(spark, matrix)
    bits = GUARD + max((abs(v).bit_length() for row in matrix for v in row), default=0)
    roots = largest_roots(poly, min(wanted, len(matrix)), bits)
    vectors = null_vectors(matrix, roots, bits)
    out = np.array([[int(x) / (1 << bits) for x in v] for v in vectors], np.float64).reshape(len(vectors), len(matrix))
    for v in out:
        v *= -1.0 if v[np.argmax(np.abs(v))] < 0 else 1.0
    return out, [r / (1 << bits) for r in roots]


def _projected(column: str, dim: int, n: int, sums: list[int], components: np.ndarray, values: list[float]):
    """vec_id, deviation and the whitened vector of every row."""
    scale = 1 / np.sqrt(np.array(values))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, column, dim)
            most = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, sums))
            # n * x - S in 64-bit integers where they and the sum of their squares fit
            kind = np.int64 if dim * most * most < 1 << 63 else object
            z = x.astype(kind) * n - np.array(sums, kind)
            deviation = (z * z).sum(1)
            white = (z.astype(np.float64) @ components.T) * scale
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array([int(v) if v < 1 << 63 else None for v in deviation], pa.int64()),
                pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "white"])

    return work


def _product_sums(means: list[float]):
    """Sums of products of centred entries of a task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(means), len(means)))
        for batch in batches:
            w = batch.column("white").flatten().to_numpy().reshape(-1, len(means)) - means
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "value"])

    return work


def whitened(embeddings: DataFrame, column: str = "embedding", wanted: int = 8) -> DataFrame:
    """embeddings -> vec_id, n, deviation, white, explained (arrays by component) and identity_error of every usable row.

    Rows whose vector is null, or holds null or non-finite entries, are left out, and so are vectors whose length is
    not the most frequent one (the longer of two). Vectors may repeat, and so may vec_id, which may be null. Entries
    whose scaled value exceeds 2^62 saturate; a deviation that no long holds is null. Without spread there is no
    component, so no result; the same holds for an empty table. Further columns of any name are ignored.
    """
    spark = ready(embeddings.sparkSession)
    stages = Stages(spark)
    entries = F.col(column).cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("v")).where("v IS NOT NULL").where(
        ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    dim = sizes["dim"] if sizes else 0
    rows = rows.where(F.size("v") == dim)
    n, sums, matrix = scatter(rows, "v", dim)
    components, values = fitted(spark, matrix, wanted)
    trace, k = sum(matrix[i][i] for i in range(dim)), len(values)
    if not k:
        return spark.createDataFrame([], "vec_id long, n long, deviation long, white array<double>, explained array<double>, identity_error double")
    out = stages.put("whitened", rows.mapInArrow(
        _projected("v", dim, n, sums, components, values), "vec_id long, deviation long, white array<double>"))
    means = out.agg(*[F.avg(F.col("white")[i]) for i in range(k)]).first()
    products = out.select("white").mapInArrow(_product_sums(list(means)), "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    error = max(abs(r["value"] / n - (r["place"] % (k + 1) == 0)) for r in products.collect())
    return out.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "white",
                      F.array(*[F.lit(v / trace) for v in values]).alias("explained"), F.lit(error).alias("identity_error"))
