"""Every registered query of the catalogue against DuckDB."""

import pytest

from twinfold.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, same):
    same(QUERIES[name], SQL[name])


def test_picture_hashes(spark, sf_dir):
    """The signs of the lowest frequencies, by plain loops, for the shortest texts."""
    import math

    docs = {str(r["doc_id"]): r["text"].encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["path"]: r["phash"] for r in QUERIES["picture_hashes"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for name in sorted(docs, key=lambda d: len(docs[d]))[3:6]:
        rows = max(1, -(-len(docs[name]) // 32))
        data = docs[name].ljust(rows * 32, b"\0")
        cover = lambda i, j: max(0.0, min((i + 1) * rows / 32, j + 1) - max(i * rows / 32, j)) * 32 / rows
        small = [[sum(cover(i, j) * data[32 * j + c] for j in range(rows)) for c in range(32)] for i in range(32)]
        low = [sum(small[y][x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * w * (2 * x + 1) / 64) for y in range(32) for x in range(32)) for u in range(8) for w in range(8)]
        middle = (sorted(low)[31] + sorted(low)[32]) / 2
        near = [abs(v - middle) < 1e-6 * max(map(abs, low)) for v in low]
        bits = f"{int(got[name], 16):064b}"
        assert all(n or (b == "1") == (v > middle) for b, v, n in zip(bits, low, near))
