"""Tables in buckets, and the streams that keep them: work by batch, replays, crashes, late events, random splits."""

import random

import pytest
from pyspark.sql import functions as F

from twinfold.operators import hamming, mutations
from twinfold.operators.cluster import join_existing_groups
from twinfold.streaming import ingest
from twinfold.streaming.buckets import MOST_PARTS, BucketedTable

FILES = "file_id long, drive_id long, path_on_drive string, group_id long, review_status string, reviewed_at timestamp, review_note string"


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


def catalogue(spark, n, first=0):
    return spark.createDataFrame([(i, i % 3, f"/f{i}", i // 4 if i % 4 < 2 else None, None if i % 5 == 0 else "undecided", None, None) for i in range(first, first + n)], FILES)


def folders(df):
    return {f.rsplit("/", 2)[-2] + "@" + f.rsplit("/", 3)[-3] for f in df.inputFiles()}


def test_buckets(spark, tmp_path):
    table = BucketedTable(spark, f"{tmp_path}/t", "k string, n long", ["k"], buckets=16)
    assert table.read().collect() == [] and table.current() == (-1, {}, {})
    old = spark.createDataFrame([(f"k{i}", i) for i in range(200)] + [(None, 7), (None, 8)], "k string, n long")
    table.create(old)
    new = spark.createDataFrame([("k3", 1000), ("k9", 1001), ("x", 1002)], "k string, n long")
    touched = table.touched(new)
    assert 1 <= len(touched) <= 3 and folders(table.read_for(new)) == {f"_bucket={b}@v0" for b in touched}
    table.append(new, stream="s", batch=0)
    assert rows_of(table.read()) == rows_of(old.union(new)) and table.has("s", 0) and not table.has("s", 1) and not table.has("other", 0)
    # One folder was written, for the buckets touched; others are still those of version 0.
    where = table.current()[1]
    assert all(held == ([0, 1] if b in touched else [0]) for b, held in where.items())
    table.replace(table.read(touched).where("n < 1000"), touched, stream="s", batch=1)
    assert rows_of(table.read()) == rows_of(old) and BucketedTable(spark, table.root, table.schema, ["k"], buckets=99).buckets == 16
    for i in range(MOST_PARTS + 2):
        table.append(spark.createDataFrame([("k3", i)], "k string, n long"), stream="s", batch=2 + i)
    assert len(table.current()[1][touched[0]]) <= MOST_PARTS and table.read().count() == 202 + MOST_PARTS + 2
    before = rows_of(table.read())
    assert table.vacuum() > 0 and rows_of(table.read()) == before and len(table.versions()) == 2 and table.vacuum() == 0


def test_ingest_work_replay_and_crash(spark, tmp_path, monkeypatch):
    """A batch touches its buckets; one that died before its manifest runs again; one that is in does nothing."""
    table = BucketedTable(spark, f"{tmp_path}/t", FILES, list(mutations.KEY), buckets=256)
    table.create(catalogue(spark, 1000))
    feed = str(tmp_path / "feed")
    catalogue(spark, 10, 995).coalesce(1).write.parquet(feed)  # five are known
    start = lambda: ingest.stream_ingest(ingest.file_stream(spark, feed, FILES), table, f"{tmp_path}/c").awaitTermination()
    start()
    want = rows_of(catalogue(spark, 1005), "file_id", "path_on_drive")
    assert rows_of(table.read(), "file_id", "path_on_drive") == want
    _, where, _ = table.current()
    assert sum(1 in held for held in where.values()) <= 10
    catalogue(spark, 3, 2000).coalesce(1).write.mode("append").parquet(feed)
    monkeypatch.setattr(BucketedTable, "commit", lambda *a: 1 / 0)
    with pytest.raises(Exception):
        start()
    assert rows_of(table.read(), "file_id", "path_on_drive") == want and "v2" in table.listed(f"{table.root}/data")
    monkeypatch.undo()
    start()
    want = rows_of(catalogue(spark, 1005).union(catalogue(spark, 3, 2000)), "file_id", "path_on_drive")
    assert rows_of(table.read(), "file_id", "path_on_drive") == want
    version = table.current()[0]
    table.has(f"{tmp_path}/c", 1) or pytest.fail("the batch isn't noted")
    start()
    assert table.current()[0] == version


def events_of(spark, rng, n):
    out = []
    for seq in range(n):
        action = rng.choice(["mark", "mark", "note", "mark_group", "odd"])
        out.append((rng.choice([seq, seq, seq // 2, None]), action, rng.randrange(8), rng.choice(["keep", "not_needed", "undecided", "bad", None]), rng.choice([None, f"n{seq}", "same"]), rng.randrange(5)))
    return spark.createDataFrame(out, "seq long, action string, target long, status string, note string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")


@pytest.mark.parametrize("seed", range(3))
def test_events_in_any_split(spark, seed):
    """Random parts in random order, some twice, give the result of all events at once."""
    rng = random.Random(seed)
    files = mutations.with_registers(catalogue(spark, 20))
    events = events_of(spark, rng, 60)
    once = mutations.apply_review_events(files, events)
    want = rows_of(once)
    assert rows_of(mutations.apply_review_events(catalogue(spark, 20), events)) == rows_of(once.drop("_seq_mark", "_seq_note"))
    rows = events.collect()
    rng.shuffle(rows)
    parts = [rows[i::4] for i in range(4)]
    now = files
    for part in [*parts, parts[0]]:
        now = spark.createDataFrame(mutations.apply_review_events(now, spark.createDataFrame(part, events.schema)).collect(), files.schema)
    assert rows_of(now) == want


def test_late_mark_beside_a_note(spark):
    files = mutations.with_registers(catalogue(spark, 4))
    event = lambda *e: spark.createDataFrame([e], "seq long, action string, target long, status string, note string").withColumn("at", F.timestamp_seconds(F.lit(1)))
    noted = mutations.apply_review_events(files, event(7, "note", 2, None, "kept"))
    marked = mutations.apply_review_events(noted, event(5, "mark", 2, "keep", "older"))
    assert tuple(marked.where("file_id = 2").select("review_status", "review_note", "_seq_mark", "_seq_note").first()) == ("keep", "kept", 5, 7)


def test_event_stream_writes_its_buckets(spark, tmp_path):
    files = mutations.with_registers(catalogue(spark, 400))
    schema = ", ".join(f"{c} {k}" for c, k in files.dtypes)
    table = BucketedTable(spark, f"{tmp_path}/t", schema, ["file_id"], buckets=128)
    table.create(files)
    kind = "seq long, action string, target long, status string, note string, at timestamp"
    batches = [[(9, "mark", 1, "keep", "a", None)], [(3, "mark", 1, "not_needed", "b", None), (4, "mark_group", 50, "keep", None, None)], [(5, "note", 77, None, "late", None), (6, "mark", 9999, "keep", None, None)]]
    feed = str(tmp_path / "feed")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(feed)
        ingest.stream_review_events(ingest.file_stream(spark, feed, kind), table, f"{tmp_path}/c").awaitTermination()
        assert sum(held == [i + 1] for held in table.current()[1].values()) <= 3
    whole = spark.createDataFrame([r for rows in batches for r in rows], kind)
    assert rows_of(table.read()) == rows_of(mutations.apply_review_events(files, whole))


def test_index_equals_rebuild(spark, tmp_path):
    """Each batch's rows are those of a match with all that is known; wide and narrow bands; only the buckets of its hashes are opened."""
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    kind = "file_id long, group_id long, hash_sha256 string, phash string, type string, width int, height int, size_bytes long"

    def row(i, group):
        h = rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        return i, group, rng.choice([f"s{rng.randrange(30)}", f"u{i}", None]), rng.choice([f"{h:016x}", f"{h:016x}", None, "zz"]), rng.choice(["image", "image", "video"]), rng.randrange(9), rng.randrange(9), rng.randrange(9)

    known = [row(i, i % 6 if i < 20 else None) for i in range(25)]
    groups = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, None)], "group_id long, original_file_id long")
    batches = [[row(100 * b - i, None) for i in range(12)] for b in (3, 1, 2)]
    for wide in (False, True):
        index = ingest.MatchIndex(spark, f"{tmp_path}/{wide}", 5, wide=wide, buckets=32)
        index.build(spark.createDataFrame(known, kind), groups)
        everything, current = list(known), {g: f for g, f in map(tuple, groups.collect())}
        for b, rows in enumerate(batches):
            index = ingest.MatchIndex(spark, f"{tmp_path}/{wide}", 5, buckets=32)  # opened anew
            assert index.wide == wide
            new, old = spark.createDataFrame(rows, kind), spark.createDataFrame(everything, kind)
            found = index.match(new)
            want = hamming.match_existing(new, old, 5)
            assert rows_of(found) == rows_of(want)
            joined = index.join(new, found)
            plain = join_existing_groups(old.unionByName(new), spark.createDataFrame(list(current.items()), "group_id long, original_file_id long"), want)
            assert rows_of(joined) == rows_of(plain)
            joined = spark.createDataFrame(joined.collect(), joined.schema)
            for _ in range(2):  # the second time does nothing
                index.add(new, joined, "s", b)
            placed = {r["file_id"]: r for r in joined.collect()}
            current |= {r["group_id"]: r["file_id"] for r in placed.values() if r["promoted"]}
            everything += [(i, placed[i]["group_id"] if i in placed else None, *rest) for i, _, *rest in rows]
        one = spark.createDataFrame([everything[-1][:3] + (f"{seeds[0]:016x}",) + everything[-1][4:]], kind)
        probes = (hamming.probed if wide else hamming.banded)(one.select(hamming.parse_phash(F.col("phash")).alias("h")), "h", index.cuts).withColumn("_band", F.col("_band").cast("int"))
        opened = {f.split("@")[0] for f in folders(index.bands.read_for(probes))}
        assert opened <= {f"_bucket={b}" for b in index.bands.touched(probes)}


def test_match_stream_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    kind = "file_id long, group_id long, hash_sha256 string, phash string, type string, width int, height int, size_bytes long"
    row = lambda i, g, h, size: (i, g, f"s{i}", f"{h:016x}", "image", 10, 10, size)
    known, groups = spark.createDataFrame([row(1, 1, 0, 5)], kind), spark.createDataFrame([(1, 1)], "group_id long, original_file_id long")
    feed, out = str(tmp_path / "feed"), str(tmp_path / "out")
    for batch in ([row(10, None, 0b1111, 9)], [row(20, None, 0b11111111, 7)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(feed)
    start = lambda: ingest.stream_match(ingest.file_stream(spark, feed, kind), known, groups, 5, out, str(tmp_path / "c"), buckets=8).awaitTermination()
    replace = BucketedTable.replace
    monkeypatch.setattr(BucketedTable, "replace", lambda *a, **k: 1 / 0)  # after the rows and two parts of the index
    with pytest.raises(Exception):
        start()
    monkeypatch.setattr(BucketedTable, "replace", replace)
    start()
    got = {r["file_id"]: (r["group_id"], r["duplicate_of"], r["promoted"]) for r in spark.read.parquet(out).collect()}
    assert got == {10: (1, None, 1), 20: (1, 10, 0)}


def test_first_seen_within_a_delay(spark, tmp_path):
    """With `late`, a key is forgotten once the stream is that much further (in the batch after, where Spark clears its state); equal sightings before are one."""
    kind, feed = "drive_id long, path_on_drive string, t long", str(tmp_path / "feed")
    for rows in ([(1, "/a", 0), (1, "/a", 5), (1, "/b", 5)], [(1, "/a", 50), (2, "/a", 50)], [(1, "/c", 10_000)], [(1, "/d", 10_001)], [(1, "/a", 10_002)]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(feed)
    seen = ingest.file_stream(spark, feed, kind).withColumn("seen_at", F.timestamp_seconds("t"))
    for late, want in ((None, [(1, "/a"), (1, "/b"), (1, "/c"), (1, "/d"), (2, "/a")]), ("10 minutes", [(1, "/a"), (1, "/a"), (1, "/b"), (1, "/c"), (1, "/d"), (2, "/a")])):
        out = f"{tmp_path}/out-{late is None}"
        ingest.stream_first_seen(seen, late=late).writeStream.format("parquet").option("checkpointLocation", f"{out}-c").outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
        assert rows_of(spark.read.parquet(out), "drive_id", "path_on_drive") == want
