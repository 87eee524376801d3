"""Dense hashes and large batches: what a step holds and forms follows its input or its result."""

import random

from pyspark.sql import functions as F

from twinfold.operators import cluster, hamming


def dense(n, seed=5):
    """(rank, signed hash) of distinct hashes that agree in 50 bits."""
    rng = random.Random(seed)
    base, values = rng.getrandbits(64), set()
    while len(values) < n:
        values.add(base ^ sum(1 << b for b in rng.sample(range(3, 59, 4), rng.randint(0, 14))))
    values = list(values)
    rng.shuffle(values)
    return [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(values)]


def apart(g, h):
    return ((g ^ h) & (1 << 64) - 1).bit_count()


def test_dense_hashes_are_not_multiplied(spark, monkeypatch):
    """Cells whose hashes agree in nearly all bits are dealt in blocks, not cut again and again: only the sizes of cells are written."""
    ranked, written = dense(300), []
    settle = hamming.settle
    monkeypatch.setattr(hamming, "settle", lambda df, name: written.append(name) or settle(df, name))
    df = spark.createDataFrame(ranked, "rank long, h long")
    a, b = df.select(F.col("h").alias("ha"), F.col("rank").alias("low")), df.select(F.col("h").alias("hb"), F.col("rank").alias("high"))
    got = [tuple(r) for r in hamming.hamming_join(a, b, 5, on=("ha", "hb"), heavy=400).select("low", "high", "distance").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j, apart(g, h)) for i, g in ranked for j, h in ranked if apart(g, h) <= 5}
    assert written == ["sizes"]


def test_leaders_form_few_pairs(spark, monkeypatch):
    """Batches of any size give the greedy clusters, and pairs of hashes that an earlier batch claimed are never formed."""
    ranked, formed = dense(400), []
    monkeypatch.setattr(cluster, "BATCH", 40)
    monkeypatch.setattr(cluster, "EDGES", 150)
    pairs = cluster.self_pairs

    def counted(*a, **k):
        found = pairs(*a, **k)
        formed.append(found.count())
        return found

    monkeypatch.setattr(cluster, "self_pairs", counted)
    rows = spark.createDataFrame([(i, f"{h & (1 << 64) - 1:016x}", i % 3 * 100) for i, h in ranked], "file_id long, phash string, size_bytes long")
    leaders = {}
    for i, h in ranked:
        leaders.setdefault(next((j for j, g in ranked[: i + 1] if leaders.get(j) == j and apart(g, h) <= 5), i), i)
        leaders[i] = next(j for j, g in ranked[: i + 1] if (j == i or leaders.get(j) == j) and apart(g, h) <= 5)
    sizes = {j: list(leaders.values()).count(j) for j in leaders.values()}
    assert {tuple(r) for r in cluster.leader_clusters(rows).collect()} == {(i, j) for i, j in leaders.items() if sizes[j] > 1}
    every = sum(apart(g, h) <= 5 for i, g in ranked for j, h in ranked if i < j)
    assert len(formed) > 1 and 4 * sum(formed) < every

    # The same in buckets, where the order is that of unsigned hashes.
    want = {}
    for bucket in range(3):
        lead = []
        for i, h in sorted(((i, h & (1 << 64) - 1) for i, h in ranked if i % 3 == bucket), key=lambda r: r[1]):
            near = next((j for j, g in lead if apart(g, h) <= 5), i)
            lead += [(i, h)] if near == i else []
            want.setdefault(near, set()).add(i)
    assert {tuple(r) for r in cluster.leader_clusters_bucketed(rows, bucket_bytes=100).collect()} == {(i, j) for j, own in want.items() if len(own) > 1 for i in own}


def test_stream_match_hands_on_one_row_a_query(spark, tmp_path, monkeypatch):
    """Queries near very many known hashes, and copies of them: tasks reduce what they find before it is shuffled."""
    from twinfold.streaming import ingest

    ranked, handed = dense(200), []
    nearest = ingest.nearest_of
    monkeypatch.setattr(ingest, "nearest_of", lambda df: handed.append(df) or nearest(df))
    kind = "file_id long, group_id long, hash_sha256 string, phash string, type string, width int, height int, size_bytes long"
    row = lambda i, h, group: (i, group, f"s{i}", f"{h & (1 << 64) - 1:016x}", "image", 9, 9, 9)
    known = [row(i, h, i) for i, h in ranked[:150]] + [row(1000 + i, h, i) for i, h in ranked[:50]]
    new = spark.createDataFrame([row(2000 + i, h ^ 1, None) for i, h in ranked[140:]], kind)
    index = ingest.MatchIndex(spark, str(tmp_path), 5, buckets=4)
    index.build(spark.createDataFrame(known, kind), spark.createDataFrame([(i, i) for i in range(150)], "group_id long, original_file_id long"))
    got = {r["file_id"]: r["group_id"] for r in index.match(new).collect()}
    want = {}
    for i, h in ranked[140:]:
        near = min(((apart(g, h ^ 1), j) for j, g in ranked[:150] if apart(g, h ^ 1) <= 5), default=None)
        want |= {2000 + i: near[1]} if near else {}
    assert got == want
    assert sum(df.count() for df in handed) <= 60 * len(index.cuts)


def test_simhash_takes_texts_a_few_at_a_time():
    """Words of a batch of texts aren't held together, nor the bits of a long text's words."""
    import tracemalloc

    import pyarrow as pa

    from twinfold.plans import views

    rng = random.Random(1)
    texts = pa.array([" ".join(f"w{rng.randrange(5000)}" for _ in range(3000)).encode() for _ in range(300)] + [b"", None, b"one"], pa.binary())
    whole = [h for t in texts.to_pylist() for h in views.word_simhashes([t])]
    tracemalloc.start()
    got = [h for some in views.slices(texts) for h in views.word_simhashes(some)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == whole and got[-3:-1] == [None, None]
    assert peak < 40 << 20


def test_tall_pictures_are_hashed_in_strips():
    """What a picture takes beside its bytes follows its height, not the square of it, and doesn't change its means."""
    import tracemalloc

    import numpy as np

    from twinfold.operators import features

    h, w = 4100, 32
    x = np.random.default_rng(3).integers(0, 256, (h, w)).astype(np.uint8)
    data = x.tobytes()
    for tall, wide in ((h, w), (3000, 31), (h - 1, 7)):
        tracemalloc.start()
        got = features.small_picture(data, h, w, 1, (tall, wide))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        want = x.astype(float)
        for n in ((tall, wide), (32, 32)):
            want = features.across(features.across(want, n[1]).T, n[0]).T
        assert np.abs(got - want).max() < 1e-6
        assert peak < 16 << 20
