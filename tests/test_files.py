"""Listings, images and perceptual hashes of real files; streams over a folder that grows."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.operators import features, hamming
from twinfold.operators.cluster import evaluate_pairs
from twinfold.sources import files as src
from twinfold.streaming import ingest


def png(path, x):
    """A grey PNG."""
    h, w = x.shape
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in x)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def picture(seed, h, w):
    rng = np.random.default_rng(seed)
    waves = rng.normal(size=(6, 4))
    y, x = np.linspace(0, 1, h)[:, None], np.linspace(0, 1, w)
    z = sum(a * np.cos(2 * np.pi * (2 * b * x + 2 * c * y + d)) for a, b, c, d in waves)
    return 127 + 100 * z / abs(z).max()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for s in range(4):
        png(root / f"p{s}_a.png", picture(s, 480, 640))
        png(root / f"p{s}_b.png", picture(s, 240, 320))
    (root / "deep").mkdir()
    (root / "deep" / "bad.png").write_bytes(b"no picture")
    (root / "deep" / "film.mp4").write_bytes(bytes(range(256)) * 600)
    return str(root)


def test_listing(spark, tree, tmp_path):
    listed = src.list_files(spark, tree)
    assert listed.count() == 10
    assert "content" not in listed._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    src.write_manifest(listed, f"{tmp_path}/m")
    kept, invalid = src.read_manifest(spark, f"{tmp_path}/m", listed.where(~F.col("path").endswith("film.mp4")))
    assert kept.count() == 9 and invalid.first()["invalid"] == 1


def test_fingerprints(spark, tree):
    import hashlib

    data = bytes(range(256)) * 600
    row = src.read_contents(spark, tree).where(F.col("path").endswith("film.mp4"))
    one = row.select(features.fast_fp(F.col("content")).alias("a"), features.fast_fp_sha1(F.col("content")).alias("b"), features.full_sha256(F.col("content")).alias("c")).first()
    assert one["a"] == hashlib.sha256(data[:65536] + data[-65536:]).hexdigest()[:16]
    assert one["b"] == hashlib.sha1(data[:65536] + data[-65536:]).hexdigest()
    assert one["c"] == hashlib.sha256(data).hexdigest()


def test_images(spark, tree):
    images = src.read_images(spark, tree).where(F.col("path").endswith(".png"))
    sizes = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"]) for r in images.collect()}
    assert sizes["p0_a.png"] == (640, 480) and sizes["bad.png"] == (None, None)
    hashed = features.phash64(images).where("phash is not null").withColumn("name", F.element_at(F.split("path", "/"), -1))
    rows = {r["name"]: int(r["phash"], 16) for r in hashed.collect()}
    assert all((rows[f"p{s}_a.png"] ^ rows[f"p{s}_b.png"]).bit_count() <= 5 for s in range(4))
    assert all((rows["p0_a.png"] ^ rows[f"p{s}_a.png"]).bit_count() > 5 for s in range(1, 4))
    assert {(r["expected"], r["predicted"], r["n"]) for r in evaluate_pairs(hashed).collect()} == {(True, True, 4)}
    assert hamming.self_pairs(hamming.distinct_hashes(hashed.withColumn("file_id", F.monotonically_increasing_id())), 5).count() <= 4
    assert features.phash64(images, most=100_000).where("phash is not null").count() == 4


def test_evaluate_pairs_of_both_classes(spark):
    """Two names that say `fail` are expected to differ: a true negative, a false positive, a true and a false match; mixed pairs are left out."""
    rows = [("a_fail1", "0" * 16), ("a_fail2", "f" * 16), ("b_fail1", "0" * 16), ("b_fail2", "0" * 15 + "1"), ("c_1", "0" * 16), ("c_2", "0" * 16), ("c_fail", "0" * 16), ("d_1", "0" * 16), ("d_2", "f" * 16)]
    out = evaluate_pairs(spark.createDataFrame(rows, "name string, phash string")).collect()
    assert {(r["expected"], r["predicted"], r["n"]) for r in out} == {(False, False, 1), (False, True, 1), (True, True, 1), (True, False, 1)}


def test_snapshots_and_catalogue(spark, tmp_path):
    table = ingest.Snapshots(spark, f"{tmp_path}/t", "a long")
    assert table.read().count() == 0
    table.write(spark.range(3).select(F.col("id").alias("a")), 0)
    table.write(spark.range(5).select(F.col("id").alias("a")), 12)
    assert table.versions() == [0, 12] and table.read().count() == 5 and table.read(before=12).count() == 3
