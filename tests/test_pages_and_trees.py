"""Pages by rank, trees with links, strips of pictures, sizes for people, written manifests."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import scalars as x
from twinfold.operators import features, filters, paging, sinks
from twinfold.sources import tree


def test_pages_by_counts(spark):
    """Every page is that of a plain sort, for even, skewed, negative and repeated keys."""
    rng = random.Random(1)
    even, skewed = rng.sample(range(-(10**6), 10**6), 700), [rng.randrange(9) ** 20 - 5 for _ in range(300)] + [2**62, -(2**62)]
    for keys in (even, skewed, [5] * 40, [7], []):
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)] + [(None, -1)], "k long, i int")
        for page, size in ((1, 10), (2, 7), (len(keys) // 50 + 1, 50), (10**6, 10), (1, 10_000)):
            got = [r["k"] for r in paging.page_of(rows, "k", page, size, few=30).collect()]
            assert got == sorted(keys)[(page - 1) * size : page * size]
    with pytest.raises(ValueError):
        paging.page_of(rows, "k", 0, 10)


def test_page_table(spark, tmp_path):
    """Page 1,000,000 opens one part; pages across parts are whole; ranks are those of the order."""
    rows = spark.range(1_000_500).select(((F.col("id") * 7919) % 1_000_500).alias("v"))
    table = paging.PageTable(spark, f"{tmp_path}/p").build(rows, F.desc("v"))
    one = table.page(1_000_000, 1)
    assert [tuple(r) for r in one.collect()] == [(1_000_499 - 999_999, 999_999)]
    parts = table.counts()
    assert len(parts) > 1 and len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) == 1
    edge = parts[0][1]  # the first row of the second part
    got = table.page(2, edge - 3).collect() if edge < 2000 else table.page(edge // 10 + 1, 10).collect()
    assert [r["v"] for r in got] == [1_000_499 - r["rank"] for r in got] and len(got) == (edge - 3 if edge < 2000 else 10)
    assert table.page(200_000, 10).collect() == [] and table.page(1, 3).count() == 3
    empty = paging.PageTable(spark, f"{tmp_path}/e").build(rows.limit(0), "v")
    assert empty.page(1, 5).collect() == []


def test_tree(spark, tmp_path):
    root = tmp_path / "root"
    (root / "a" / "deep" / "deeper").mkdir(parents=True)
    (root / "b").mkdir()
    (root / "a" / "one.jpg").write_bytes(b"12345")
    (root / "a" / ".hidden").write_bytes(b"1")
    (root / "a" / "deep" / "deeper" / "two.png").write_bytes(b"")
    (root / "three éü.mp4").write_bytes(b"123")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "four.gif").write_bytes(b"1234")
    os.symlink("..", root / "b" / "loop")
    os.symlink(tmp_path / "outside", root / "b" / "out")
    os.symlink(root / "a" / "one.jpg", root / "b" / "link.jpg")
    os.symlink(root / "nowhere", root / "b" / "dead")
    os.symlink("self", root / "self")
    os.mkfifo(root / "pipe")
    plain = {"a/one.jpg": 5, "a/.hidden": 1, "a/deep/deeper/two.png": 0, "three éü.mp4": 3}

    def found(follow, at=None):
        files, counts = tree.walk(spark, at or str(root), follow=follow)
        rows = files.collect()
        assert all(r["modified"] is not None for r in rows) and counts.count() == 1
        return {r["path"].removeprefix(f"{root}/"): r["size_bytes"] for r in rows}, tuple(counts.select("files", "folders", "unreadable").first())

    assert found(False) == (plain, (4, 4, 0)) and found(False, f"file://{root}/") == (plain, (4, 4, 0))
    files, counts = found(True)
    # The root comes in again by its loop, once; a dead link and one to itself can't be read.
    assert {p: s for p, s in files.items() if "loop" not in p} == plain | {"b/out/four.gif": 4, "b/link.jpg": 5}
    assert {p.removeprefix("b/loop/") for p in files if "loop" in p} <= {*plain, "b/link.jpg"} and counts[2] == 3
    assert found(False, str(tmp_path / "no"))[1] == (0, 0, 1)
    if os.geteuid():  # root reads everything
        (root / "a" / "deep").chmod(0)
        assert found(False)[1] == (3, 3, 1)
        (root / "a" / "deep").chmod(0o755)


def shrunk(z, tall, wide):
    """Area means, cell by cell."""
    h, w = len(z), len(z[0])
    out = []
    for i in range(tall):
        row = []
        for j in range(wide):
            total = 0.0
            for y in range(math.floor(i * h / tall), min(h, math.ceil((i + 1) * h / tall))):
                for c in range(math.floor(j * w / wide), min(w, math.ceil((j + 1) * w / wide))):
                    total += z[y][c] * (min((i + 1) * h / tall, y + 1) - max(i * h / tall, y)) * (min((j + 1) * w / wide, c + 1) - max(j * w / wide, c))
            row.append(total * tall * wide / h / w)
        out.append(row)
    return out


@pytest.mark.parametrize("h,w,channels,strip", [(50, 70, 3, 1), (33, 200, 1, 4000), (200, 9, 4, 300), (1, 1, 1, 1), (64, 64, 3, 1 << 24)])
def test_strips(h, w, channels, strip, monkeypatch):
    """Pictures shrunk in strips of any size equal plain means."""
    monkeypatch.setattr(features, "STRIP", strip)
    rng = np.random.default_rng(h * w)
    x = rng.integers(0, 256, (h, w, channels)).astype(np.uint8)
    z = (x[..., 0] if channels == 1 else x[..., :3] @ np.array([0.114, 0.587, 0.299])).tolist()
    for size in ((h, w), (max(1, h // 3), max(1, w // 2)), (max(1, h - 1), w)):
        got = features.small_picture(x.tobytes(), h, w, channels, size)
        assert np.abs(got - np.array(shrunk(shrunk(z, *size), 32, 32))).max() < 1e-6


def test_shrink_before_hashing(spark):
    rng = np.random.default_rng(8)
    kind = "path string, image struct<height: int, width: int, nChannels: int, data: binary>, pixels long"
    rows, want = [], {}
    for name, h, w in (("small", 20, 20), ("wide", 30, 90), ("tall", 300, 7), ("bad", -1, -1)):
        data = rng.integers(0, 256, max(0, h * w * 3) if h > 0 else 0).astype(np.uint8)
        rows.append((name, (h, w, 3, bytearray(data.tobytes())), max(0, h * w) if h > 0 else 0))
        if h > 0:
            z = (data.reshape(h, w, 3) @ np.array([0.114, 0.587, 0.299])).tolist()
            r = math.sqrt(600 / (h * w))
            size = (h, w) if h * w <= 600 else (max(1, int(h * r)), max(1, int(w * r)))
            want[name] = features.phash_of(np.array(shrunk(shrunk(z, *size), 32, 32)))
    images = spark.createDataFrame(rows, kind)
    got = {r["path"]: r["phash"] for r in features.phash64(images, most=600, shrink=True).collect()}
    assert got == want | {"bad": None}
    plain = {r["path"]: r["phash"] for r in features.phash64(images, most=600).collect()}
    assert plain == {"small": want["small"], "wide": None, "tall": None, "bad": None}


def test_sizes_for_people(spark):
    rows = spark.createDataFrame([(s,) for s in (0, 1023, 1024, 1536, 10240, 10241)] + [(None,)], "size_bytes long")
    sizes = lambda *a: [r[0] for r in filters.size_range_human(rows, *a).collect()]
    assert sizes("1k", "10K") == [1024, 1536, 10240] and sizes("1.5K") == [1536, 10240, 10241] and sizes(None, "1023") == [0, 1023] and len(sizes()) == 7
    for bad in ("", "k", "1x", "-1", "1.5", "1 KB", "ten"):
        with pytest.raises(ValueError):
            filters.size_range_human(rows, bad)
    shown = spark.createDataFrame([(0,), (512,), (1024,), (1536,), (3 * 1024**3,)], "n long")
    assert [r[0] for r in shown.select(x.filesize(F.col("n"), always_decimal=True)).collect()] == ["0 B", "512.0 B", "1.0 KB", "1.5 KB", "3.0 GB"]


def test_files_that_need_a_hash(spark):
    rows = spark.createDataFrame([("a.jpg", 1), ("b.mp4", 1), ("c.txt", 2), ("d.jpg", 3), ("e.jpg", None)], "path string, size_bytes long")
    known = spark.createDataFrame([(3,), (3,), (9,)], "size_bytes long")
    one = features.extraction_stats(rows, known).first()
    assert (one["images"], one["videos"], one["unknown"], one["unique_sizes"], one["repeated_sizes"], one["files_in_repeated_sizes"], one["files_needing_hash"]) == (3, 1, 1, 3, 1, 2, 3)
    assert features.extraction_stats(rows).first()["files_needing_hash"] == 2 and features.extraction_stats(rows.limit(0), known).first()["files_needing_hash"] == 0


def test_writers(spark, tmp_path):
    """What the three writers leave, read back: the manifest in its order, sizes for people, lines of statistics."""
    kind = "file_id long, path_on_drive string, central_path string, size_bytes long, type string, review_status string, is_large int, group_id long"
    files = spark.createDataFrame([(1, "/b,\"x\".jpg", None, 5, "image", "keep", 0, 1), (2, "/a.jpg", "c", 6, "image", "keep", 0, 1), (3, "/z.mp4", None, 3_000_000, "video", "keep", 1, None), (4, "/y", None, 1, "image", "not_needed", 0, None)], kind)
    groups = spark.createDataFrame([(1, 1)], "group_id long, original_file_id long")
    sinks.write_backup_manifest(files, groups, f"{tmp_path}/m")
    parts = sorted((tmp_path / "m").glob("part-*.csv"))
    lines = [line for p in parts for line in p.read_text().splitlines()[1:]]
    assert all(p.read_text().splitlines()[0] == ",".join(sinks.MANIFEST) for p in parts) and [line.split(",")[0] for line in lines] == ["1", "2"]
    back = spark.read.option("header", True).option("escape", "\\").csv(f"{tmp_path}/m").collect()
    assert {r["path_on_drive"] for r in back} == {'/b,"x".jpg', "/a.jpg"}
    sinks.write_large_review(files, f"{tmp_path}/l")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/l").collect()] == [("/z.mp4", "3000000", "2.9", "video")]
    sinks.write_stats_report(spark.createDataFrame([(3, None, 1.5)], "a int, b string, c double"), f"{tmp_path}/s")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/s").collect()) == ["a: 3", "b", "c: 1.5"]
    assert json.loads(sinks.to_envelope(files.select("file_id").limit(1), "x").first()[0]) == {"result": "ok", "command": "x", "data": {"file_id": 1}}
