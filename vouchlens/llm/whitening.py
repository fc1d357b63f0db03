"""Embedding whitening from the exact characteristic polynomial.

Vectors become integers, so their scatter matrix n*sum(x x') - S S' is an integer matrix,
n^2 times the covariance, summed without rounding. Its characteristic polynomial is found
modulo many primes, one Spark row each (Hessenberg form, then the recurrence of its
minors), and put together by Chinese remaindering. All roots are real, so the sign
changes of the polynomial shifted to a point count the roots beyond it exactly; bisection
isolates the largest ones to hundreds of bits. Each component is a null-space vector of
scatter minus root by inverse iteration in integers of fixed point, again in Spark tasks.
What the driver holds depends on the dimension only, never on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchlens.session import written_once

#: Entries are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Bits of an integer's limb, rows whose limb products stay below 2^53 in sum, and how many such sums a long holds
#: (up to four of them have the same weight).
LIMB, BATCH, SUMS = 20, 1 << 12, 1 << 7
#: Roots are told apart and known to trace / 2^ROOT_BITS; vectors are computed with WORK_BITS after the point.
ROOT_BITS, WORK_BITS = 192, 448


# --- rows ----------------------------------------------------------------------


def integers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id and y, the integer vector without its shift, of each row that takes part.

    A vector takes part if it has entries, all finite, and the most frequent length (the
    larger one on a tie). An entry beyond the range of a long is held at its end.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")
    ).where(F.size("v") > 0)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = rows.where(F.coalesce(finite, F.lit(False)))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    d = sizes.agg(F.max_by("d", F.struct("n", "d"))).scalar()
    return good.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("y"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def limbs(y: np.ndarray) -> np.ndarray:
    """y as sum of limb k * 2^(LIMB * k): limbs of LIMB bits, the last one signed; as few as will do."""
    out, rest = [], y
    while rest.min(initial=0) <= -1 << LIMB or rest.max(initial=0) >= 1 << LIMB:
        out.append(rest & ((1 << LIMB) - 1))
        rest = rest >> LIMB
    return np.stack([*out, rest]).astype(np.float64)


def scatter_sums(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, sums by dimension and sums of products of two dimensions, all exact.

    Each task adds up products of limbs (exact in doubles for BATCH rows) in longs and gives
    one row for each limb weight and pair of dimensions.
    """

    def rows_of(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for weight, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), weight)), pa.array(at), pa.array(sums.ravel()[at])], names=["weight", "cell", "part"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        added = 0
        for batch in batches:
            whole = matrix(batch.column(0))
            for at in range(0, len(whole), BATCH):
                if added == SUMS:
                    yield from rows_of(total)
                    total, added = {}, 0
                added += 1
                part = limbs(whole[at : at + BATCH])
                # a column of ones gives the sums by dimension along with the products
                ones = np.concatenate([np.ones((1, part.shape[1], 1)), np.zeros((len(part) - 1, part.shape[1], 1))])
                part = np.concatenate([part, ones], axis=2)
                for i, a in enumerate(part):
                    for j, b in enumerate(part):
                        found = (a.T @ b).astype(np.int64)
                        total[i + j] = total[i + j] + found if i + j in total else found
        yield from rows_of(total)

    parts = fit.select("y").mapInArrow(run, "weight long, cell long, part long")
    # a cell has one sum for each weight, whatever the rows
    rows = parts.groupBy("weight", "cell").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    cells = [0] * ((d + 1) * (d + 1))
    for r in rows:
        cells[r.cell] += int(r.s) << (LIMB * r.weight)
    square = np.array(cells, object).reshape(d + 1, d + 1)
    return int(square[d, d]), list(square[d, :d]), square[:d, :d]


# --- characteristic polynomial ---------------------------------------------------


def primes_below(top: int) -> Iterator[int]:
    """Primes in descending order from below ``top`` (up to 2^31: four witnesses prove them)."""
    n = top - 1 - top % 2
    while n > 2:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        if all(
            pow(a, odd, n) in (1, n - 1) or any(pow(a, odd << k, n) == n - 1 for k in range(1, twos)) for a in (2, 3, 5, 7)
        ):
            yield n
        n -= 2


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(tI - a) modulo p, constant first: Hessenberg form, then its leading minors."""
    h = (a % p).astype(np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        u = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * u % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, d + 1):
        weight, chain = np.zeros(k, np.int64), 1  # of the minors 0 to k-1
        weight[k - 1] = h[k - 1, k - 1]
        for i in range(k - 1, 0, -1):
            chain = chain * int(h[i, i - 1]) % p
            if not chain:
                break
            weight[i - 1] = int(h[i - 1, k - 1]) * chain % p
        minors[k, 1:] = minors[k - 1, :-1]
        minors[k] = (minors[k] - (weight[:, None] * minors[:k] % p).sum(0)) % p
    return minors[d].tolist()


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Integer coefficients of det(tI - a), constant first, for a positive semidefinite integer matrix.

    A coefficient is an elementary symmetric sum of the eigenvalues, which the mean
    eigenvalue bounds; so many primes are taken that twice the bound is below their product.
    """
    d, trace = len(a), int(sum(a.diagonal()))
    bound = 2 * max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1)) + 1
    primes, product = [], 1
    for p in primes_below(1 << 31):
        primes.append(p)
        product *= p
        if product > bound:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(0).to_pylist()
            found = [polynomial_modulo(a, primes[i]) for i in which]
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(found, pa.list_(pa.int64()))], names=["i", "c"])

    rows = spark.range(0, len(primes), 1, min(len(primes), 64)).mapInArrow(run, "i long, c array<long>").collect()
    coefficients = [0] * (d + 1)
    for r in rows:
        p = primes[r.i]
        rest = product // p
        one = rest * pow(rest, -1, p)
        for k, c in enumerate(r.c):
            coefficients[k] += one * c
    return [c - product if 2 * c > product else c for c in (c % product for c in coefficients)]


# --- roots -------------------------------------------------------------------------


def roots_above(coefficients: list[int], at: int) -> int:
    """Roots greater than ``at``, with multiplicity: sign changes after the shift (exact where all roots are real)."""
    c = coefficients[::-1]  # leading first: each pass of running sums divides by t - at
    for k in range(len(c), 1, -1):
        run = 0
        for i in range(k):
            run = run * at + c[i]
            c[i] = run
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


@dataclass(frozen=True)
class Root:
    """``times`` eigenvalues in (low, low + 1] / 2^bits, told apart from all others."""

    low: int
    times: int


def largest_roots(coefficients: list[int], top: int, wanted: int, bits: int) -> list[Root]:
    """The positive roots in falling order, at least ``wanted`` of them where there are so many, to 1 / 2^bits."""
    d = len(coefficients) - 1
    scaled = [c << (bits * (d - k)) for k, c in enumerate(coefficients)]
    known: dict[int, int] = {0: roots_above(scaled, 0), (top << bits) + 1: 0}

    def above(x: int) -> int:
        if x not in known:
            known[x] = roots_above(scaled, x)
        return known[x]

    def reached(x: int) -> bool:
        """Whether the next root, a single one, is at most x: there the sign is that of an even or odd number of roots above."""
        value = 0
        for c in reversed(scaled):
            value = value * x + c
        return not value or (value > 0) == (taken % 2 == 0)

    found, taken = [], 0
    wanted = min(wanted, known[0])
    while taken < wanted:
        low, high = max(x for x, n in known.items() if n > taken), min(x for x, n in known.items() if n <= taken)
        while high - low > 1 and not (above(low) == taken + 1 and above(high) == taken):
            middle = (low + high) // 2
            if above(middle) > taken:
                low = middle
            else:
                high = middle
        times = above(low) - taken
        while high - low > 1:  # a single root is left in between
            middle = (low + high) // 2
            if reached(middle):
                high = middle
            else:
                low = middle
        known[low], known[high] = taken + times, taken
        found.append(Root(low, times))
        taken += times
    return found


# --- components ----------------------------------------------------------------------


def factored(m: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """LU with row exchanges of a fixed-point matrix (integers / 2^bits), and the order of rows."""
    lu, order = m.copy(), np.arange(len(m))
    for k in range(len(lu)):
        pivot = k + max(range(len(lu) - k), key=lambda i: abs(lu[k + i, k]))
        if pivot != k:
            lu[[k, pivot]], order[[k, pivot]] = lu[[pivot, k]], order[[pivot, k]]
        if not lu[k, k]:
            lu[k, k] = 1  # a null space hit exactly
        if k + 1 < len(lu):
            lu[k + 1 :, k] = (lu[k + 1 :, k] << bits) // lu[k, k]
            lu[k + 1 :, k + 1 :] -= (lu[k + 1 :, k, None] * lu[k, k + 1 :]) >> bits
    return lu, order


def solved(lu: np.ndarray, order: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    x = b[order]
    for k in range(len(x)):
        x[k + 1 :] -= (lu[k + 1 :, k] * x[k]) >> bits
    for k in range(len(x) - 1, -1, -1):
        x[k] = (x[k] << bits) // lu[k, k]
        x[:k] -= (lu[:k, k] * x[k]) >> bits
    return x


def unit(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << bits) // max(1, isqrt(int((x * x).sum())))


def null_vectors(a: np.ndarray, root: Root, bits: int = WORK_BITS, steps: int = 3) -> list[list[float]]:
    """Unit eigenvectors of a root of ``a``, as many as it has times, orthogonal to each other."""
    d = len(a)
    scale = int(sum(a.diagonal())).bit_length()  # a / 2^scale has entries below one
    eye = np.array([[int(i == j) for j in range(d)] for i in range(d)], object)
    at = ((2 * root.low + 1) << bits) >> (ROOT_BITS + 1)
    lu, order = factored(((a << bits) >> scale) - eye * at, bits)
    draw = np.random.default_rng(1)
    basis: list[np.ndarray] = []
    for _ in range(root.times):
        x = unit(np.array([int(v) for v in draw.integers(-(1 << 30), 1 << 30, d)], object), bits)
        for _ in range(steps):
            x = unit(solved(lu, order, x, bits), bits)
            for _ in range(2):
                for other in basis:
                    x = x - ((other * (int((x * other).sum()) >> bits)) >> bits)
                x = unit(x, bits)
        basis.append(x)
    return [[int(v) / (1 << bits) for v in x] for x in basis]


@dataclass(frozen=True)
class Whitening:
    """n and S of the fit list; components in falling order of ``eigenvalues`` (of the scatter, n^2 times the covariance's)."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: list[float]
    explained: list[float]


def fit_whitening(fit: DataFrame, most: int = COMPONENTS) -> Whitening:
    """The whitening of a table of distinct integer vectors ``y``; without rows or spread it has no components."""
    spark = fit.sparkSession
    first = fit.select(F.size("y")).first()
    d = first[0] if first else 0
    n, sums, products = scatter_sums(fit, d) if d else (0, [], np.zeros((0, 0), object))
    scatter = products * n - np.outer(np.array(sums, object), np.array(sums, object)) if d else products
    trace = int(sum(scatter.diagonal()))
    if not trace:
        return Whitening(n, sums, np.zeros((d, 0)), [], [])
    polynomial = characteristic_polynomial(spark, scatter)
    # in units of 2^scale >= trace the roots lie in (0, 1]; the polynomial's keep integers
    scale = trace.bit_length()
    fine = max(0, ROOT_BITS - scale)
    roots = largest_roots(polynomial, trace, most, fine)
    if scale > ROOT_BITS:
        roots = [Root(r.low >> (scale - ROOT_BITS), r.times) for r in roots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(0).to_pylist()
            found = [null_vectors(scatter, roots[i]) for i in which]
            kind = pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(found, kind)], names=["i", "vectors"])

    rows = spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "i long, vectors array<array<double>>").collect()
    vectors, values, shares = [], [], []
    for r in sorted(rows):
        share = (2 * roots[r.i].low + 1) / (1 << (ROOT_BITS + 1))
        value = share * 2.0**scale
        for v in r.vectors:
            vectors.append(v)
            values.append(value)
            shares.append(value / trace)
    return Whitening(n, sums, np.array(vectors[:most]).T, values[:most], shares[:most])


def centred(y: np.ndarray, w: Whitening) -> np.ndarray:
    """n * y - S, exact: as longs where these hold them and the sum of their squares, else as Python integers."""
    reach = max(int(y.max(initial=0)), -int(y.min(initial=0)), *(abs(s) // w.n + 1 for s in w.sums))
    small = len(w.sums) * (2 * reach * w.n) ** 2 < 1 << 63
    kind = np.int64 if small else object
    return y.astype(kind) * w.n - np.array(w.sums, kind)


def whitened(away: np.ndarray, w: Whitening) -> np.ndarray:
    return away.astype(np.float64) @ (w.components / np.sqrt(np.array(w.eigenvalues)))


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, in size."""
    k = len(w.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            # rows are centred at S / n, which makes the mean of the whitened values zero
            values = whitened(centred(matrix(batch.column(0)), w), w)
            one = np.concatenate([values, np.ones((len(values), 1))], axis=1)
            total += one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "s"])

    rows = fit.select("y").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((k + 1) * (k + 1))
    for r in rows:
        total[r.cell] = r.s
    total = total.reshape(k + 1, k + 1) / w.n
    mean = total[k, :k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(
    vectors: DataFrame, most: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component.

    The fit list holds every distinct integer vector once, so copies don't weigh. Vectors
    that are null, empty, hold null or non-finite entries or differ from the most frequent
    length take no part. Components stop at the rank of the covariance: equal vectors, or
    one alone, give no rows. Equal eigenvalues share their space: any orthonormal vectors
    of it. Repeated rows and ids are returned each, null ids stay null, an empty table gives
    an empty result, other columns are not looked at. ``deviation`` is null where a long
    can't hold it; an entry beyond a long's range is held at its end.
    """
    rows = integers(vectors, id_column, vector_column)
    fit = written_once(rows.select("y").distinct())
    w = fit_whitening(fit, most)
    error = identity_error(fit, w) if w.eigenvalues else 0.0
    k = len(w.eigenvalues)
    largest = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k or not batch.num_rows:
                continue
            away = centred(matrix(batch.column(1)), w)
            deviation = [x if x <= largest else None for x in (away * away).sum(1).tolist()]
            m = len(away)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(at)),
                    pa.array(whitened(away, w).ravel()),
                    pa.array(np.tile(w.explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(run, schema)
