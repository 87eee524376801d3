"""Repeated bytes against plain sets of strings; suffix arrays and common prefixes against sorting."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from twinfold.llm import suffix

SCHEMA = "doc_id long, text string, key int, rank int, data string"


def plain(docs, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text), by the smallest id of each string."""
    rank = lambda d: suffix.NOBODY if d is None else d
    first, out = {}, []
    for d, t, *_ in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first[b[i : i + length]] = min(first.get(b[i : i + length], suffix.NOBODY), rank(d))
    for d, t, *_ in docs:
        b = (t or "").encode()
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < rank(d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g > h for g, h in zip(gone, b"\0" + gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r["row"]["doc_id"], len(r["data"]), sum(e - s for s, e in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def planted():
    """Passages of about 50 bytes and more in unlike surroundings, periodic texts, copies, nulls, short and equal ids, wide characters."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefé日\0 ") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(30)) for _ in range(6)]
    docs = []
    for d in range(120):
        t = "".join(word() for _ in range(rng.randrange(0, 60)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 20)
            t += p[a : a + rng.randrange(15, 80)] + "".join(word() for _ in range(rng.randrange(0, 12)))
        docs.append((d, t))
    for n in (48, 49, 50, 51, 52):
        docs += [(200 + n, "left" + passages[0].encode()[:200].decode(errors="ignore")[:n] + "right"), (300 + n, "LEFT" + passages[0][:n])]
    docs += [(400, "ab" * 300), (401, "x" + "ab" * 100), (402, "a" * 500), (399, "a" * 120), (403, "ba" * 40)]
    docs += [(500, docs[5][1]), (2, docs[5][1]), (5, docs[9][1]), (None, docs[9][1]), (None, docs[9][1]), (None, "only here " * 9), (None, "only here " * 9), (600, None), (601, ""), (-7, docs[3][1])]
    long = "".join(word() for _ in range(4000))
    docs += [(700, long), (701, long[:9000] + "!" + long[9000:]), (702, long[5000:])]
    return [(d, t, 1, 2, "x") for d, t in docs]


def test_against_plain(spark, planted, monkeypatch):
    table = spark.createDataFrame(planted, SCHEMA).repartition(5)
    want = plain(planted)
    assert digest(suffix.remove_repeats(table)) == want
    # Small shards and runs, so that nearly every anchor goes on in another shard.
    monkeypatch.setattr(suffix, "RUN", 3000)
    monkeypatch.setattr(suffix, "SLICE", 700)
    assert digest(suffix.remove_repeats(table, shard=300)) == want
    monkeypatch.setattr(suffix, "MAX_BROADCAST", 0)
    assert digest(suffix.remove_repeats(table, shard=2000)) == want


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    out = suffix.op11_repeated_bytes(spark, sf_dir)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain(docs) and out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for text in (b"", b"a", b"aaaaaaaa", b"abababab\xffabab", bytes(rng.randrange(2) for _ in range(400)), bytes(rng.randrange(97, 100) for _ in range(3000)), b"\0" * 70 + b"\xff" * 70):
        data = np.frombuffer(text, np.uint8)
        order = suffix.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        starts = np.arange(0, len(text), 37)
        got = suffix.common_prefixes(data, order, starts, np.minimum(37, len(text) - starts), 50)
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert got[k] == min(50, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def test_sorted_runs_merge():
    rng = np.random.default_rng(2)
    runs = [(np.sort(rng.integers(0, 50, n)), np.full(n, i)) for i, n in enumerate((5, 0, 17, 9, 1))]
    values, of = suffix.merge_sorted(runs)
    assert values.tolist() == sorted(np.concatenate([r[0] for r in runs]).tolist())
    assert all(values[of == i].tolist() == r[0].tolist() for i, r in enumerate(runs))


@pytest.mark.parametrize("length", [24, 30, 50, 200])
def test_ranges_of_anchors_are_even(length):
    """Anchors are minima, crowded near 0: no range may get many more than its share."""
    data = np.random.default_rng(4).integers(97, 123, 600_000, dtype=np.uint8)
    anchors, schema = np.unique(suffix.window_anchors(data, length)), pa.schema([("key", pa.int64()), ("data", pa.binary())])

    class Rows:
        select = lambda self, *names: self
        mapInArrow = lambda self, run, kinds: run

    batch = pa.RecordBatch.from_pydict({"key": [7], "data": [data.tobytes()]}, schema=schema)
    got = pa.Table.from_batches(suffix.sorted_runs(Rows(), length, 20)(iter([batch])), None).to_pylist()
    assert np.concatenate([np.frombuffer(r["h"], np.uint64) for r in got]).tolist() == anchors.tolist() and [r["part"] for r in got] == list(range(20))
    assert max(len(r["h"]) for r in got) < 1.5 * 8 * len(anchors) / 20


def test_other_lengths_and_empty(spark, planted):
    table = spark.createDataFrame(planted[:60], SCHEMA)
    assert digest(suffix.remove_repeats(table, length=24)) == plain(planted[:60], 24)
    with pytest.raises(ValueError):
        suffix.remove_repeats(table, length=10)
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    assert digest(suffix.remove_repeats(spark.createDataFrame([(1, None, 1, 1, "")], SCHEMA)))[0][:4] == (1, 0, 0, 0)
