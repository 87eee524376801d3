"""Operators on small tables whose results are known, and against plain Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinfold.functions import scalars as x
from twinfold.operators import cluster, copyplan, filters, hamming, mutations, pages, stats

FILES = "file_id long, hash_sha256 string, phash string, width int, height int, size_bytes long, type string, drive_id long, path_on_drive string, is_large int, copied int, duplicate_of long, group_id long, review_status string, reviewed_at timestamp, review_note string"


@pytest.fixture(scope="module")
def files(spark):
    """Twelve files, five groups, three drives: equal images, similar images, equal videos, unlike images, one alone, three without a group."""
    g = {1: (1, None), 2: (1, 1), 3: (2, None), 4: (2, 3), 5: (3, None), 6: (3, 5), 7: (4, None), 8: (4, 7), 9: (5, None)}
    status = {1: "undecided", 2: "undecided", 3: "keep", 4: "keep", 5: "keep", 6: "not_needed", 7: "undecided", 8: "undecided", 9: "keep", 10: "undecided", 11: "not_needed", 12: "keep"}
    rows = []
    for i in range(1, 13):
        group, of = g.get(i, (None, None))
        video = i in (5, 6, 12)
        rows.append((i, f"h{min(i, 1) if i < 3 else i}", "%016x" % (i % 4), None if video else 100 + i, None if video else 100, 1000 * i, "video" if video else "image", 1 + (i % 3), f"/photos/f{i}.jpg" if i in (1, 2, 9) else f"/other/f{i}.mp4", int(i in (7, 8)), 0, of, group, status[i], None, None))
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def groups(spark):
    return spark.createDataFrame([(1, 1), (2, 3), (3, 5), (4, 7), (5, 9)], "group_id long, original_file_id long")


def ids(df, column="file_id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_exports(files, groups):
    plain = filters.export_filter(files, groups)
    assert ids(plain) == [3, 4, 5, 9, 12]
    assert plain.where("is_original = 1").count() == 3
    assert ids(filters.export_filter(files, groups, include_originals=True)) == [1, 3, 4, 5, 9, 12]
    assert filters.export_filter(files, groups, include_undecided=True, include_large=True).count() == 10


def test_pages(spark, files, groups):
    drives = spark.createDataFrame([(1, "a", "/m/a"), (2, "b", "/m/b/"), (3, "c", None)], "drive_id long, label string, mount_path string")
    page = pages.groups_page(files, groups, drives, 1, 10, "undecided").collect()
    assert [r["group_id"] for r in page] == [1, 4]
    assert [f["file_id"] for f in page[0]["files"]] == [1, 2] and page[0]["statuses"] == {"undecided": 2}
    assert pages.singles_page(files, drives, 1, 10, "undecided").count() == 1 and pages.singles_page(files, drives, 1, 10).count() == 3
    assert pages.page_meta(files.limit(0), 1, 10, least=1).first()["pages"] == 1
    assert ids(pages.matching_paths(files, "%PHOTOS%")) == [1, 2, 9]
    assert pages.file_info(files, groups, drives, files.where("file_id = 3")).first()["is_original"] == 1


def test_corrections(spark, files, groups):
    changed, now = mutations.promote(files, groups, spark.createDataFrame([(4,), (10,)], "file_id long"))
    assert now.where("group_id = 2").first()["original_file_id"] == 4
    assert {r["file_id"]: r["duplicate_of"] for r in changed.where("group_id = 2").collect()} == {3: 4, 4: None}
    moved = mutations.move_to_group(files, groups, spark.createDataFrame([(10, 1), (11, 99)], "file_id long, group_id long"))
    assert moved.where("file_id = 10").first()["duplicate_of"] == 1 and moved.where("file_id = 11").first()["group_id"] is None
    changed, now = mutations.make_original(files, groups, spark.createDataFrame([(2,)], "file_id long"))
    two = changed.where("file_id = 2").first()
    assert (two["group_id"], two["duplicate_of"]) == (6, None) and now.count() == 6


def test_marks(spark, files):
    marks = spark.createDataFrame([(1, "keep", "good"), (2, "odd", "x"), (99, "keep", None)], "file_id long, status string, note string")
    out = {r["file_id"]: r for r in mutations.mark(files, marks, F.current_timestamp()).collect()}
    assert out[1]["review_status"] == "keep" and out[1]["review_note"] == "good" and out[2]["review_status"] == "undecided"
    errors = {r["file_id"]: r["error"] for r in mutations.mark_report(files, marks).collect()}
    assert errors == {1: None, 2: "bad status", 99: "unknown file"}
    with pytest.raises(ValueError):
        mutations.bulk_mark(files, "%", "odd", F.current_timestamp())


def test_insert_is_idempotent(spark, files):
    new = spark.createDataFrame([(20, 1, "/a"), (21, 1, "/a"), (22, None, "/a"), (23, None, "/a"), (24, 2, "/photos/f1.jpg")], "file_id long, drive_id long, path_on_drive string")
    once = mutations.insert_or_ignore(files, new)
    assert set(ids(once)) - set(ids(files)) == {20, 22, 23}
    keyed = new.where("drive_id is not null")
    assert ids(mutations.insert_or_ignore(once, keyed)) == ids(once)
    assert once.where("file_id = 20").first()["review_status"] == "undecided"


def test_events_replay(spark, files):
    events = spark.createDataFrame([(2, "mark", 1, "keep", None), (1, "mark", 1, "not_needed", None), (3, "note", 1, None, "n"), (4, "mark_group", 3, "undecided", None), (5, "mark", 2, "odd", None)], "seq long, action string, target long, status string, note string")
    events = events.withColumn("at", F.current_timestamp())
    base = mutations.with_registers(files)
    once = mutations.apply_review_events(base, events)
    out = {r["file_id"]: r for r in once.collect()}
    assert out[1]["review_status"] == "keep" and out[1]["review_note"] == "n" and out[6]["review_status"] == "undecided" and out[2]["review_status"] == "undecided"
    again = mutations.apply_review_events(once, events.where("seq < 3"))
    assert sorted(again.drop("reviewed_at").collect()) == sorted(once.drop("reviewed_at").collect())


def test_validation(spark, files, groups):
    drives = spark.createDataFrame([(1,), (2,), (3,)], "drive_id long")
    out = {r["rule"]: r["violations"] for r in mutations.validate_catalogue(files, groups, drives).collect()}
    assert set(out.values()) == {0}
    broken = mutations.validate_catalogue(files, groups.where("group_id > 1"), drives.where("drive_id > 1"))
    out = {r["rule"]: r["violations"] for r in broken.collect()}
    assert out["orphan_group"] == 2 and out["orphan_drive"] == 4


def test_empty_tables(spark, files, groups):
    none = files.limit(0)
    assert stats.storage_stats(none).first()["total_bytes"] == 0
    assert cluster.exact_groups(none).count() == 0 and cluster.leader_clusters(none).count() == 0
    assert cluster.assign_groups(none, cluster.exact_groups(none)).count() == 0
    assert stats.scan_summary(none).first()["duplicate_percent"] == 0.0


def test_ids_are_dense(spark):
    out = mutations.assign_ids(spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")), ["v"], "n", start=5)
    assert sorted((r["v"], r["n"]) for r in out.collect()) == [(i, i + 5) for i in range(1000)]


def hashes(seed, n):
    rng = random.Random(seed)
    seeds = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    out = []
    for _ in range(n):
        h = rng.choice(seeds)
        for _ in range(rng.randint(0, 5)):
            h ^= 1 << rng.randrange(64)
        out.append(h)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hamming_and_leaders_against_loops(spark, seed):
    values = hashes(seed, 80)
    rows = spark.createDataFrame([(i, f"{h:016x}", 100) for i, h in enumerate(values)], "file_id long, phash string, size_bytes long")
    first = {}
    for i, h in enumerate(values):
        first.setdefault(h, i)
    order = sorted(first, key=first.get)
    want = {(first[a], first[b], (a ^ b).bit_count()) for n, a in enumerate(order) for b in order[n + 1 :] if (a ^ b).bit_count() <= 5}
    assert {tuple(r) for r in hamming.self_pairs(hamming.distinct_hashes(rows), 5).collect()} == want

    def greedy(order):
        claimed = {}
        for h in order:
            if h not in claimed:
                claimed.update({o: h for o in order if o not in claimed and (o ^ h).bit_count() <= 5})
        clusters = {}
        for i, h in enumerate(values):
            clusters.setdefault(claimed[h], set()).add(i)
        return {frozenset(c) for c in clusters.values() if len(c) > 1}

    def found(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["cluster"], set()).add(r["file_id"])
        return {frozenset(c) for c in out.values()}

    assert found(cluster.leader_clusters(rows)) == greedy(order)
    assert found(cluster.leader_clusters_bucketed(rows, bucket_bytes=1000)) == greedy(sorted(first))


def test_bad_hashes_have_no_pairs(spark):
    rows = spark.createDataFrame([(1, "zz"), (2, None), (3, ""), (4, "0xFF"), (5, " ff ")], "file_id long, phash string")
    assert {r["file_id"]: r["h"] for r in rows.select("file_id", hamming.parse_phash(F.col("phash")).alias("h")).collect()} == {1: None, 2: None, 3: None, 4: 255, 5: 255}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=8))
def test_parse_phash(spark, values):
    rows = spark.createDataFrame([(f"{v:x}",) for v in values], "p string")
    got = [r["h"] for r in rows.select(hamming.parse_phash(F.col("p")).alias("h")).collect()]
    assert [g % 2**64 for g in got] == values


def test_scalars(spark):
    rows = spark.createDataFrame([(0, "/a/b.JPG", "10K"), (1536, "x", "1.5m"), (None, "", "7"), (5 * 1024**4, "/d/.hidden", "bad")], "n long, p string, s string")
    out = rows.select(x.filesize(F.col("n")).alias("f"), x.filename(F.col("p")).alias("name"), x.suffix(F.col("p")).alias("e"), x.parse_size(F.col("s")).alias("b")).collect()
    assert [tuple(r) for r in out] == [("0 B", "b.JPG", ".jpg", 10240), ("1.5 KB", "x", "", 1572864), ("0 B", "Unknown", "", 7), ("5 TB", ".hidden", "", None)]
    like = spark.createDataFrame([("C:\\Photos\\a",), ("c:/photos",), ("É",)], "p string")
    assert [r[0] for r in like.select(x.like(F.col("p"), "c:\\PHOTOS%")).collect()] == [True, False, False]
    assert like.where(x.like(F.col("p"), "é")).count() == 0


def test_copy_plan(spark):
    rows = spark.createDataFrame([("a.jpg", 5), ("b.jpg", 7)], "relative_path string, size_bytes long")
    plan = copyplan.copy_plan(rows, rows.limit(1), overwrite=True)
    assert {r["action"]: r["bytes"] for r in copyplan.copy_summary(plan).collect()} == {"overwrite": 5, "copied": 7}


def test_mutations_without_values(spark, files):
    """Rows without ids or times are kept whole, and repeated marks and moves leave one row for each file."""
    new = spark.createDataFrame([(None, 1, "/n/a.jpg", 5), (None, 1, "/n/a.jpg", 7), (900, 1, "/n/b.jpg", 1), (None, 1, "/n/b.jpg", 2), (None, None, "/n/c.jpg", 3)], "file_id long, drive_id long, path_on_drive string, size_bytes long").withColumn("type", F.lit("image"))
    out = mutations.insert_or_ignore(files, new)
    fresh = sorted((r["path_on_drive"], r["size_bytes"], r["file_id"]) for r in out.where("path_on_drive like '/n/%'").collect())
    assert [(p, s) for p, s, _ in fresh] == [("/n/a.jpg", 5), ("/n/b.jpg", 1), ("/n/c.jpg", 3)] and fresh[1][2] == 900 and out.count() == 15
    runs = spark.createDataFrame([("a", None, 1), ("b", 5, 2), (None, 1, 3)], "scan_id string, t long, n long").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    again = spark.createDataFrame([("a", None, 7), ("a", None, 8), ("b", None, 9), ("b", 6, 4)], "scan_id string, t long, n long").withColumn("timestamp", F.timestamp_seconds("t")).drop("t")
    assert sorted((str(r["scan_id"]), r["n"]) for r in mutations.upsert_runs(runs, again).collect()) == [("None", 3), ("a", 8), ("b", 4)]
    kept, counts = mutations.retain_runs(runs, F.timestamp_seconds(F.lit(3)))
    assert sorted(r["n"] for r in kept.collect()) == [1, 2] and tuple(counts.first()) == (3, 2)
    assert sorted(r["n"] for r in mutations.drop_run(runs, "b").collect()) == [1, 3]
    marks = spark.createDataFrame([(1, "keep", "first", 1), (1, "not_needed", "last", 3), (1, "keep", "second", 2), (1, "odd", "bad", 4)], "file_id long, status string, note string, seq long")
    marked = mutations.mark(files, marks, F.current_timestamp())
    assert marked.count() == files.count() and tuple(marked.where("file_id = 1").select("review_status", "review_note").first()) == ("not_needed", "last")
    groups = spark.createDataFrame([(1, 1), (2, 3)], "group_id long, original_file_id long")
    twice = spark.createDataFrame([(1, "keep", "x"), (1, "not_needed", "y"), (77, "keep", None), (2, "odd", None)], "group_id long, status string, note string")
    assert mutations.mark_groups(files, twice, F.current_timestamp()).count() == files.count()
    report = {(r["group_id"], r["status"]): (r["members"], r["changed"], r["error"]) for r in mutations.group_mark_report(files, twice).collect()}
    assert report == {(1, "keep"): (2, 2, None), (1, "not_needed"): (2, 2, None), (77, "keep"): (0, 0, "unknown group"), (2, "odd"): (2, 0, "bad status")}
    moved = mutations.move_to_group(files, groups, spark.createDataFrame([(9, 1), (9, 2), (9, 99)], "file_id long, group_id long"))
    assert moved.count() == files.count() and tuple(moved.where("file_id = 9").select("group_id", "duplicate_of").first()) == (2, 3)
    assert tuple(mutations.set_groups(files, spark.createDataFrame([(10, 5, 9), (10, 4, 7)], "file_id long, group_id long, duplicate_of long")).where("file_id = 10").select("group_id", "duplicate_of").first()) == (5, 9)


def test_pairs_that_fail(spark):
    """Pairs of which both names say fail are expected to differ."""
    rows = [("a_1", 0), ("a_2", 1), ("a_3", 2**40 - 1), ("b_fail1", 0), ("b_fail2", 1), ("b_fail3", 2**50 - 1), ("b_ok", 0)]
    images = spark.createDataFrame([(n, f"{h:016x}") for n, h in rows], "name string, phash string")
    out = {(r["expected"], r["predicted"]): r["n"] for r in cluster.evaluate_pairs(images).collect()}
    assert out == {(True, True): 1, (True, False): 2, (False, True): 1, (False, False): 2}


def test_both_ways_of_the_hamming_join(spark):
    """Narrow and wide bands give the pairs of a plain comparison, for even and odd distances."""
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    hashes = {h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for h in base for _ in range(8)}
    ranked = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(sorted(hashes))]
    df = spark.createDataFrame(ranked, "rank long, h long")
    for k in (0, 1, 2, 4, 5):
        want = {(i, j, bin((g ^ h) & (2**64 - 1)).count("1")) for i, g in ranked for j, h in ranked if i < j and bin((g ^ h) & (2**64 - 1)).count("1") <= k}
        for wide in (False, True):
            got = [tuple(r) for r in hamming.self_pairs(df, k, wide=wide).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_leaders_of_long_chains(spark, monkeypatch):
    """A chain of 1,000 decisions ends in a few rounds, in one task and in rounds alike, beside other components."""
    chain = [(i, i + 1) for i in range(1000)] + [(2000, 2001), (2000, 2002), (2001, 2003)]
    got = {(r["leader"], r["member"]) for r in cluster.leaders(spark.createDataFrame(chain, "low long, high long")).collect()}
    assert got == {(i - i % 2, i) for i in range(1001)} | {(2000, 2000), (2000, 2001), (2000, 2002), (2003, 2003)}
    short = [(i, i + 1) for i in range(12)]
    monkeypatch.setattr(cluster, "ROUNDS", 2)
    monkeypatch.setattr(cluster, "SMALL", 3)
    assert {(r["leader"], r["member"]) for r in cluster.leaders(spark.createDataFrame(short, "low long, high long")).collect()} == {(i - i % 2, i) for i in range(13)}
    assert cluster.leaders(spark.createDataFrame([], "low long, high long")).count() == 0


def test_later_batches_match_earlier_arrivals(spark, tmp_path):
    """A file near an arrival of the batch before joins the arrival's group, and an original that came earlier counts."""
    from twinfold.streaming import ingest

    kind = "file_id long, group_id long, hash_sha256 string, phash string, type string, width int, height int, size_bytes long"
    row = lambda i, g, h, size: (i, g, f"s{i}", f"{h:016x}", "image", 10, 10, size)
    known = spark.createDataFrame([row(1, 1, 0, 5)], kind)
    groups = spark.createDataFrame([(1, 1)], "group_id long, original_file_id long")
    feed = str(tmp_path / "feed")
    for batch in ([row(10, None, 0b1111, 9), row(11, None, 2**60 - 1, 9)], [row(20, None, 0b11111111, 7)], [row(30, None, 2**60 - 1, 1)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(feed)
    stream = ingest.file_stream(spark, feed, kind)
    ingest.stream_match(stream, known, groups, 5, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    out = {r["file_id"]: (r["group_id"], r["duplicate_of"], r["promoted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {10: (1, None, 1), 20: (1, 10, 0)}


def test_heavy_bands(spark):
    """Values that many hashes share are cut further: the pairs of a plain comparison, once each, on both ways and on two sides."""
    rng = random.Random(9)
    low = rng.getrandbits(22)
    hashes = {low | rng.getrandbits(42) << 22 for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    hashes |= {h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for h in list(hashes) for _ in range(2)}
    hashes |= {low ^ (1 << a) ^ (1 << b) for a in range(0, 64, 7) for b in range(3, 64, 9)}  # very close ones, so that cells stay heavy to the end
    ranked = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(sorted(hashes))]
    df = spark.createDataFrame(ranked, "rank long, h long").withColumn("kind", F.col("rank") % 2)
    apart = lambda g, h: bin((g ^ h) & (2**64 - 1)).count("1")
    for k, wide, heavy in ((5, False, 20), (4, True, 20), (0, False, 1), (5, True, 500)):
        a, b = df.select("kind", F.col("h").alias("ha"), F.col("rank").alias("low")), df.select("kind", F.col("h").alias("hb"), F.col("rank").alias("high"))
        got = [tuple(r) for r in hamming.hamming_join(a, b, k, on=("ha", "hb"), also=("kind",), wide=wide, heavy=heavy).select("low", "high", "distance").collect()]
        want = {(i, j, apart(g, h)) for i, g in ranked for j, h in ranked if i % 2 == j % 2 and apart(g, h) <= k}
        assert len(got) == len(set(got)) and set(got) == want


def test_one_common_band(spark):
    """100,000 hashes with one value in common, against brute force over ids divisible by 50."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 100_000
    h = rng.integers(0, 2**53, n, dtype=np.int64) << 11 | 1234
    near = rng.integers(0, n, n // 5)
    h[near] = h[rng.integers(0, n, len(near))] ^ (1 << rng.integers(11, 63, len(near))) ^ (1 << rng.integers(11, 63, len(near)))
    h, first = np.unique(h, return_index=True)
    df = spark.createDataFrame([(int(i), int(v)) for i, v in enumerate(h)], "rank long, h long")
    pairs = hamming.self_pairs(df, 5)
    got = {tuple(r) for r in pairs.where("low % 50 = 0 or high % 50 = 0").collect()}
    want = set()
    for i in range(0, len(h), 50):
        d = np.bitwise_count((h ^ h[i]).view(np.uint64))
        want |= {(min(i, int(j)), max(i, int(j)), int(d[j])) for j in np.flatnonzero(d <= 5) if j != i}
    assert got == want and len(want) > 100
