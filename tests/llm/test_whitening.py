"""Whitening against exact fractions and plain linear algebra."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from twinfold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, whitened int"


def polynomial(a):
    """Coefficients of det(x - a), constant first, by Faddeev and LeVerrier's sums of traces."""
    d, m, c = len(a), [[0] * len(a) for _ in a], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(a[i][t] * m[t][j] for t in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-Fraction(sum(a[i][t] * m[t][i] for i in range(d) for t in range(d)), k))
    return [int(x) for x in reversed(c)]


def gram(rng, d, rank, size):
    x = [[rng.randrange(-size, size) for _ in range(d)] for _ in range(rank)]
    return np.array([[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)], object)


@pytest.mark.parametrize("d,rank,size", [(1, 1, 5), (2, 1, 10**9), (5, 5, 1000), (7, 3, 10**12), (6, 6, 1), (4, 0, 2)])
def test_polynomial(spark, d, rank, size):
    a = gram(random.Random(d * size), d, rank, size) if rank else np.array([[0] * d] * d, object)
    assert whitening.characteristic_polynomial(spark, a) == polynomial(a.tolist())


def test_prime_with_zero_pivots():
    a = np.array([[0, 0, 0, 1], [0, 2, 0, 0], [1, 0, 0, 0], [0, 0, 3, 0]], np.int64)
    p = 2147483647
    assert whitening.polynomial_mod(a, p) == [c % p for c in polynomial(a.tolist())]


def test_roots():
    c = [1]
    for r in (0, 0, 3, 3, 3, 10, 1 << 40):
        c = [a - r * b for a, b in zip([0, *c], [*c, 0])]
    roots, s = whitening.largest_roots(c, 16)
    assert [Fraction(r, 1 << s) for r in roots] == [1 << 40, 10, 3, 3, 3]
    close, s = whitening.largest_roots([1, -3, 1], 2)  # (3 +- sqrt 5) / 2
    for root, sign in zip(close, (1, -1)):
        exact = (3 * (1 << s) + sign * math.isqrt(5 << 2 * s)) // 2
        assert abs(root - exact) <= 2


def test_vectors_of_repeated_and_close_roots(spark):
    d = 5
    a = np.array([[7 if i == j else 0 for j in range(d)] for i in range(d)], object)
    v, e, share = whitening.principal(spark, a, 1, 16)
    assert np.abs(v @ v.T - np.eye(d)).max() < 1e-15 and e == [7.0] * d and share == [0.2] * d
    big = 10**24
    a = np.array([[2 * big, 1, 0], [1, 2 * big, 0], [0, 0, big]], object)  # roots that differ by 1e-24 of their size
    v, e, _ = whitening.principal(spark, a, 1, 3)
    assert np.abs(np.abs(v[0]) - [math.sqrt(0.5), math.sqrt(0.5), 0]).max() < 1e-15 and v[0][0] * v[0][1] > 0 > v[1][0] * v[1][1]


def test_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + k) for k in range(6)], 0, 1, 2) for i in range(60)]
    rows += [(60, rows[0][1], 0, 1, 2), (60, rows[0][1], 0, 1, 2), (None, rows[1][1], None, 1, 2), (61, None, 0, 1, 2), (62, [1.0] * 5 + [None], 0, 1, 2), (63, [1.0] * 5 + [float("nan")], 0, 1, 2), (64, [float("-inf")] + [1.0] * 5, 0, 1, 2), (65, [1.0, 2.0], 0, 1, 2), (66, [], 0, 1, 2), (67, [3e38] * 6, 0, 1, 2)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    df = whitening.op12_whitening(spark, str(tmp_path))
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    got = df.collect()
    kept = [r for r in rows if r[1] and len(r[1]) == 6 and all(c is not None and abs(c) < 1e30 for c in r[1])]
    assert len(got) == 6 * len(kept)
    x = lambda v: [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]
    fitted = sorted({tuple(x(r[1])) for r in kept})
    n, sums = len(fitted), [sum(c) for c in zip(*fitted)]
    f = np.array([[n * c - s for c, s in zip(v, sums)] for v in fitted], np.float64) / n
    e, u = np.linalg.eigh(f.T @ f / n)
    e, u = e[::-1], u[:, ::-1]
    by = {(r["vec_id"], r["component"]): r for r in got}
    for i, v, *_ in kept:
        z = np.array([n * c - s for c, s in zip(x(v), sums)], np.float64) / n @ u / np.sqrt(e)
        for k in range(6):
            r = by[i, k + 1]
            assert r["n"] == n and r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(x(v), sums))
            assert abs(abs(r["whitened"]) - abs(z[k])) < 1e-9 and abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-10 and r["identity_error"] < 1e-12


def test_nothing_to_whiten(spark, tmp_path):
    for i, rows in enumerate(([], [(1, [2.0, 3.0], 0, 0, 0), (2, [2.0, 3.0], 0, 0, 0)], [(1, None, 0, 0, 0)], [(1, [], 0, 0, 0)])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{i}/embeddings.parquet")
        out = whitening.op12_whitening(spark, f"{tmp_path}/{i}")
        assert out.collect() == [] and dict(out.dtypes)["deviation"] == "bigint"


def test_values_beyond_64_bits(spark):
    """Sums and deviations that no 64-bit integer holds; clashing names stay inside the row."""
    rows = [(i, [float((i % 7) * 2**49), float(i * i % 5), 1.0], 0, 5, 6) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = whitening.fit(docs)
    x = lambda v: [math.floor(64 * c) + 1000000 for c in v]
    fitted = {tuple(x(r[1])) for r in rows}
    assert model.n == len(fitted) and list(model.sums) == [sum(c) for c in zip(*fitted)] and len(model.roots) == 2
    for r in whitening.whiten(docs, model).collect():
        assert int(r["deviation"]) == sum((model.n * c - s) ** 2 for c, s in zip(x(r["row"]["embedding"]), model.sums)) and r["row"]["whitened"] == 6
    assert model.identity_error < 1e-9
