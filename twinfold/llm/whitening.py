"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries are rounded to integers x. With n distinct vectors and sums S the scatter n * sum(y y') - T T' (y: x less a whole
offset near the mean, T: sums of y) is n * n times the covariance and has integer entries. Its characteristic polynomial
is found modulo primes below 2**31 by Hessenberg reduction, a prime a row of a Spark job, and put together by Chinese
remainders. All its roots are real, so the sign changes of the polynomial shifted to a point count the roots above it
exactly: bisection isolates the largest roots and narrows them to about BITS bits. A component spans the null space of
the scatter less its root and is found by inverse iteration in whole-number arithmetic of twice that precision.

Sums and products are exact at any size: tasks add in floating point only while every sum stays below 2**53, in 64-bit integers below 2**63, and in
Python's integers beyond. Only matrices of the dimension's size reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Precision of roots, and the largest |64 * c| that is taken, so that x fits in 64 bits.
BITS, MOST = 256, 2.0**61


@dataclass(frozen=True)
class Whitening:
    """n, sums: of the distinct vectors; offset: taken off x; components: unit vectors in rows; roots: eigenvalues of the covariance; explained: their share of the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    roots: tuple[float, ...]
    explained: tuple[float, ...]
    identity_error: float = 0.0

    @property
    def offset(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)


def finite(vector: Column) -> Column:
    """Whether there is a vector without null, NaN or infinite entries, and none so large that x wouldn't fit in 64 bits."""
    fits = lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < MOST, F.lit(False))
    return F.coalesce(F.forall(vector, fits), F.lit(False))


def rounded(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def stacked(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), np.int64).reshape(len(x), -1)


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exactly, as Python integers."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    return (y.T @ y).astype(object) if most < 1 << 63 else y.astype(object).T @ y.astype(object)


def totals(rows: DataFrame, of, name: str) -> dict[tuple[int, int], int]:
    """Sums of of(batch of x), matrices of Python integers, by (i, j): added up in each task, then by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = None
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                one = of(stacked(pdf["x"].iloc[i : i + 4096]))
                whole = one if whole is None else whole + one
        if whole is not None:
            i, j = np.nonzero(np.ones(whole.shape, bool))
            yield pd.DataFrame({"i": i, "j": j, "s": [str(v) for v in whole.ravel()]})

    parts = rows.select("x").mapInPandas(run, "i int, j int, s string")
    return {(r["i"], r["j"]): int(r[name]) for r in parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias(name)).collect()}


def is_prime(p: int) -> bool:
    """Miller-Rabin, certain below 3.4e14 with these bases."""
    if p < 2 or any(p % q == 0 for q in (2, 3, 5, 7, 11, 13, 17)):
        return p in (2, 3, 5, 7, 11, 13, 17)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7, 11, 13, 17):
        x = pow(a, odd, p)
        if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """Primes below 2**31 whose product has more bits than asked for."""
    out, p, have = [], (1 << 31) - 1, 0.0
    while have <= bits:
        if is_prime(p):
            out.append(p)
            have += math.log2(p)
        p -= 2
    return out


def polynomial_mod(a: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(x - a) modulo a prime, constant first: reduction to Hessenberg form, then the recurrence of its leading minors."""
    h, d = a % p, len(a)
    for m in range(1, d - 1):
        there = np.flatnonzero(h[m:, m - 1])
        if not len(there):
            continue
        if there[0]:
            i = m + there[0]
            h[[m, i]] = h[[i, m]]
            h[:, [m, i]] = h[:, [i, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        minors[k + 1, 1:] = minors[k, :-1]
        worth, chain = np.empty(k + 1, np.int64), 1
        for i in range(k, -1, -1):
            worth[i] = int(h[i, k]) * chain % p
            chain = chain * int(h[i, i - 1]) % p if i else chain
        minors[k + 1] = (minors[k + 1] - (worth[:, None] * minors[: k + 1] % p).sum(0)) % p
    return minors[d].tolist()


def characteristic_polynomial(spark: SparkSession, a: np.ndarray) -> list[int]:
    """Coefficients, constant first, of det(x - a) for a positive semidefinite matrix of Python integers."""
    d = len(a)
    # The k-th coefficient is at most the k-th elementary symmetric function of the roots, all below (1 + trace / d) ** d.
    mean = -(-sum(a[i, i] for i in range(d)) // d)
    moduli = primes(d * (mean + 1).bit_length() + 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"p": pdf["p"], "c": [polynomial_mod((a % p).astype(np.int64), p) for p in pdf["p"].tolist()]})

    rows = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(min(len(moduli), spark.sparkContext.defaultParallelism)).mapInPandas(run, "p long, c array<long>").collect()
    whole = math.prod(moduli)
    out = [0] * (d + 1)
    for r in rows:
        rest = whole // r["p"]
        unit = rest * pow(rest, -1, r["p"])
        out = [(x + unit * c) % whole for x, c in zip(out, r["c"])]
    return [c - whole if 2 * c > whole else c for c in out]


def above(c: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are larger: the sign changes of its coefficients about the point (Descartes' rule, exact here)."""
    c = list(c)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(c: list[int], at: int) -> int:
    v = 0
    for x in reversed(c):
        v = v * at + x
    return v


def largest_roots(c: list[int], most: int, bits: int = BITS) -> tuple[list[int], int]:
    """The largest positive roots with their multiplicity, falling, in units of 2**-s, and s: each lies in the unit below its number or is it."""
    d = len(c) - 1
    zeros = next((i for i, x in enumerate(c) if x), d)
    top = max(1, abs(c[-2]) if d else 1)  # the trace
    s = max(32, bits - top.bit_length())
    q = [x << s * (d - k) for k, x in enumerate(c)]
    known: dict[int, int] = {}
    count = lambda y: known.setdefault(y, above(q, y)) if y not in known else known[y]
    out: list[int] = []
    for i in range(min(most, d - zeros)):
        low, high = 0, (top << s) + 1
        for y, n in known.items():  # what is known already
            low, high = (max(low, y), high) if n > i else (low, min(high, y))
        while high - low > 1 and not (count(low) == i + 1 and count(high) == i):
            middle = (low + high) // 2
            low, high = (middle, high) if count(middle) > i else (low, middle)
        if high - low > 1:  # a single root: its side follows from the sign
            sign = value(q, high) >= 0
            if value(q, high) == 0:
                low = high - 1
            while high - low > 1:
                middle = (low + high) // 2
                v = value(q, middle)
                low, high = (low, middle) if v == 0 or (v > 0) == sign else (middle, high)
        out.append(high)
    return out, s


def null_vectors(a: np.ndarray, root: int, s: int, many: int) -> list[list[float]]:
    """`many` orthonormal vectors that a - root * 2**-s takes to nothing, as nearly as the root is known: inverse iteration in fixed point."""
    d, top = len(a), max(1, sum(a[i, i] for i in range(len(a)))).bit_length()
    f = 2 * (s + top) + 64  # fractional bits of numbers in units of 2**top
    m = np.array([[(int(a[i, j]) << f >> top) - (((root << 1) - 1 << f) >> (s + top + 1) if i == j else 0) for j in range(d)] for i in range(d)], object)
    order, steps = list(range(d)), []
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(m[r, k]))
        if i != k:
            m[[k, i]] = m[[i, k]]
            order[k], order[i] = order[i], order[k]
        m[k, k] = m[k, k] or 1
        u = np.array([(x << f) // m[k, k] for x in m[k + 1 :, k]], object)
        steps.append((i, u))
        if k + 1 < d:
            m[k + 1 :, k:] = m[k + 1 :, k:] - (u[:, None] * m[k, k:] >> f)

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for k, (i, u) in enumerate(steps):
            b[[k, i]] = b[[i, k]]
            if k + 1 < d:
                b[k + 1 :] = b[k + 1 :] - (u * b[k] >> f)
        for k in range(d - 1, -1, -1):
            b[k] = ((b[k] - (int((m[k, k + 1 :] * b[k + 1 :]).sum()) >> f if k + 1 < d else 0)) << f) // m[k, k]
        return b

    def unit(v: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
        most = max(1, max(abs(x) for x in v))
        v = np.array([(x << f) // most for x in v], object)
        for w in held:
            v = v - (int((v * w).sum() >> f) * w >> f)
        norm = math.isqrt(int((v * v).sum())) or 1
        return np.array([(x << f) // norm for x in v], object)

    # Start vectors: a fixed rule that no component is likely to be at right angles to.
    rng, held = np.random.default_rng(12), []
    for _ in range(many):
        v = unit(np.array([int(x) << f - 32 for x in rng.integers(1, 1 << 32, d)], object), held)
        for _ in range(3):
            v = unit(solve(v), held)
        held.append(v)
    out = []
    for v in held:
        x = [int(e) / (1 << f) for e in v]
        lead = max(range(d), key=lambda i: abs(x[i]))
        out.append([e if x[lead] > 0 else -e for e in x])
    return out


def principal(spark: SparkSession, a: np.ndarray, n: int, most: int) -> tuple[np.ndarray, list[float], list[float]]:
    """Unit eigenvectors (rows), eigenvalues and shares of the trace of a / n**2 for a positive semidefinite integer matrix, the largest eigenvalues first."""
    roots, s = largest_roots(characteristic_polynomial(spark, a), most)
    if not roots:
        return np.empty((0, len(a))), [], []
    groups = [(r, roots.count(r)) for r in sorted(set(roots), reverse=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"].tolist():
                yield pd.DataFrame({"id": i, "v": null_vectors(a, groups[i][0], s, groups[i][1])})

    rows = spark.range(len(groups)).repartition(min(len(groups), spark.sparkContext.defaultParallelism)).mapInPandas(run, "id long, v array<double>").collect()
    vectors = [list(r["v"]) for r in sorted(rows, key=lambda r: r["id"])]
    trace = sum(int(a[i, i]) for i in range(len(a)))
    exact = [Fraction(2 * r - 1, 1 << s + 1) for r in roots]
    return np.array(vectors), [float(e / (n * n)) for e in exact], [float(e / trace) for e in exact]


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """x less the mean, whose numerator n * x - S is exact before it is divided."""
    y = x - model.offset
    t = [s - model.n * int(o) for s, o in zip(model.sums, model.offset)]
    if (int(np.abs(y).max(initial=0)) + 1) * model.n < 1 << 62:
        return (model.n * y - np.array(t, np.int64)) / model.n
    return ((model.n * y.astype(object) - np.array(t, object)) / model.n).astype(np.float64)


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """sum over dimensions of (n * x - S) ** 2 of each row, exactly."""
    y, n = x - model.offset, model.n
    t = np.array([s - n * int(o) for s, o in zip(model.sums, model.offset)], object)
    most, d = int(np.abs(y).max(initial=0)) + 1, x.shape[1]
    small = d * most * max(most, n) < 1 << 62
    own = y if small else y.astype(object)
    squares, mixed = (own * own).sum(1), (own * (t.astype(np.int64) if small else t)).sum(1)
    last = int((t * t).sum())
    return [n * n * int(q) - 2 * n * int(r) + last for q, r in zip(squares, mixed)]


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model) @ model.components.T / np.sqrt(np.array(model.roots))


def unwhitened(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows less the identity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(model.roots)
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                z = project(stacked(pdf["x"].iloc[i : i + 4096]), model)
                own, more = z.mean(0), len(z)
                spread += (z - own).T @ (z - own) + np.outer(own - mean, own - mean) * (n * more / (n + more))
                mean, n = mean + (own - mean) * (more / (n + more)), n + more
        if n:
            i, j = np.nonzero(np.ones((k, k), bool))
            yield pd.DataFrame({"i": i, "j": j, "s": (spread + n * np.outer(mean, mean)).ravel() / model.n, "m": np.repeat(n * mean / model.n, k)})

    sums = rows.select("x").mapInPandas(run, "i int, j int, s double, m double").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).collect()
    mean = {r["i"]: r["m"] for r in sums}
    return max((abs(r["s"] - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in sums), default=0.0)


def usable(docs: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vector is finite and of the most frequent length (ties: the longer), and that length."""
    rows = docs.where(finite(F.col(vector)))
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    d = sizes["d"] if sizes else 0
    return rows.where(F.size(vector) == d), d


def fit(docs: DataFrame, *, vector="embedding", most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct rounded vectors of usable rows; None where there are none, or all are alike, so that there is nothing to whiten."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows, d = usable(docs, vector)
    if not d:
        return None
    fitted = scratch.settle(rows.select(rounded(F.col(vector)).alias("x")).distinct(), "fitted")
    n = fitted.count()
    first = totals(fitted, lambda x: np.array([x.astype(object).sum(0) if int(np.abs(x).max()) * len(x) >= 1 << 62 else x.sum(0).astype(object)], object), "s")
    sums = tuple(first[0, i] for i in range(d))
    model = Whitening(n, sums, np.empty((0, d)), (), ())
    offset = model.offset
    second = totals(fitted, lambda x: products(x - offset), "s")
    t = np.array([s - n * int(o) for s, o in zip(sums, offset)], object)
    scatter = n * np.array([[second[i, j] for j in range(d)] for i in range(d)], object) - np.outer(t, t)
    components, roots, explained = principal(spark, scatter, n, most)
    model = Whitening(n, sums, components, tuple(roots), tuple(explained))
    model = Whitening(n, sums, components, tuple(roots), tuple(explained), unwhitened(fitted, model)) if roots else None
    scratch.clear()
    return model


def whiten(docs: DataFrame, model: Whitening, *, vector="embedding") -> DataFrame:
    """docs' usable rows of the model's dimension, all columns as a struct `row`, with deviation decimal(38,0), null beyond its 38 digits, and whitened array<double>."""

    @F.pandas_udf("deviation string, whitened array<double>")
    def run(x: pd.Series) -> pd.DataFrame:
        parts = [stacked(x.iloc[i : i + 4096]) for i in range(0, len(x), 4096)]
        return pd.DataFrame({"deviation": [str(v) for p in parts for v in deviations(p, model)], "whitened": [list(z) for p in parts for z in project(p, model)]})

    rows = docs.where(finite(F.col(vector)) & (F.size(vector) == len(model.sums)))
    out = rows.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), run(rounded(F.col(vector))).alias("w"))
    return out.select("row", F.col("w.deviation").try_cast("decimal(38,0)").alias("deviation"), "w.whitened")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row of `embeddings` with a finite vector, for up to 16 components.

    Rows without a vector, with null, NaN or infinite entries, or of another length than most rows are left out; null ids and repeated rows stay, and a
    repeated vector is fitted once. Components without variance are left out, so equal vectors, or none, give no rows. A deviation beyond 64 bits is an error here; `whiten` gives it as a decimal.
    """
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(docs)
    if model is None:
        return docs.limit(0).select("vec_id", F.lit(0).alias("component"), *[F.lit(0).cast("long").alias(c) for c in ("n", "deviation")], *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    each = whiten(docs, model).select("row.vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    share = F.array(*[F.lit(e) for e in model.explained])
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
