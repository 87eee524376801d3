"""Registered queries over the catalogue's own operators, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as x
from ..operators import cluster, copyplan, features, filters, hamming, mutations, pages, paging, sinks, stats
from ..session import new_path
from ..sources import files as sources
from ..sources import tree
from ..streaming import ingest
from ..streaming.buckets import BucketedTable
from .views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = "2024-06-01 00:00:00"
_PIXELS = "coalesce(width, 0) * coalesce(height, 0)"
_FILES = """drives AS (SELECT CAST(row_number() OVER (ORDER BY source) AS BIGINT) AS drive_id, source AS label, '/mnt/' || source AS mount_path FROM (SELECT DISTINCT source FROM documents)),
f0 AS (SELECT d.doc_id AS file_id, sha256(d.text) AS hash_sha256, d.text AS text, d.n_chars AS size_bytes, drive_id,
  '/' || lang || '/' || source || '/' || d.doc_id || ['.jpg', '.PNG', '.mp4', '.txt'][d.doc_id % 4 + 1] AS path_on_drive,
  CASE WHEN d.doc_id % 4 < 2 THEN 'image' ELSE 'video' END AS type, CAST(n_chars > 4000 AS INT) AS is_large,
  CASE WHEN d.doc_id % 4 < 2 THEN CAST(100 + d.doc_id % 7 * 10 AS INT) END AS width, CASE WHEN d.doc_id % 4 < 2 THEN CAST(100 + d.doc_id % 5 * 10 AS INT) END AS height,
  CASE quality WHEN 1 THEN 'keep' WHEN 0 THEN 'not_needed' ELSE 'undecided' END AS review_status, CAST(NULL AS VARCHAR) AS review_note,
  TIMESTAMP '2024-01-01' + to_hours(CAST(d.doc_id % 97 AS INT)) AS created_at,
  substr(sha256(unhex(CASE WHEN strlen(text) > 128 THEN substr(hex(encode(text)), 1, 128) || right(hex(encode(text)), 128) ELSE substr(hex(encode(text)), 1, 128) END)), 1, 16) AS fast_fp
  FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN drives ON label = source),
eg AS (SELECT hash_sha256, cluster, row_number() OVER (ORDER BY cluster) AS group_id FROM (SELECT hash_sha256, min(file_id) AS cluster FROM f0 WHERE hash_sha256 IS NOT NULL GROUP BY 1 HAVING count(*) > 1)),
og AS (SELECT group_id, cluster, file_id AS original_file_id FROM f0 JOIN eg USING (hash_sha256) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY coalesce(width, 0) * coalesce(height, 0) DESC, size_bytes DESC, file_id) = 1),
files AS (SELECT f0.*, eg.group_id, CASE WHEN original_file_id <> file_id THEN original_file_id END AS duplicate_of FROM f0 LEFT JOIN eg USING (hash_sha256) LEFT JOIN og ON og.group_id = eg.group_id),
grps AS (SELECT group_id, original_file_id FROM og)"""
_HASH = """w AS (SELECT doc_id, md5(s) AS m FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda s: s <> '')) AS s FROM documents)),
bits AS (SELECT doc_id, b, i, sum((CAST('0x' || substr(m, 1 + 4 * b, 4) AS INT) >> i) & 1) AS s, count(*) AS n FROM w, (SELECT unnest(range(4))::INT AS b), (SELECT unnest(range(16))::INT AS i) GROUP BY ALL),
ph AS (SELECT doc_id AS file_id, string_agg(v, '' ORDER BY b) AS phash FROM (SELECT doc_id, b, printf('%04x', CAST(sum(CASE WHEN 2 * s > n THEN 1 << i ELSE 0 END) AS INT)) AS v FROM bits GROUP BY doc_id, b) GROUP BY 1),
hf AS (SELECT f0.*, phash, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS lo FROM f0 LEFT JOIN ph USING (file_id)),
dh AS (SELECT phash, hi, lo, min(file_id) AS rank FROM hf WHERE phash IS NOT NULL GROUP BY ALL)"""


def leaders_sql(rows: str, by: str = "") -> str:
    """Greedy leaders in order, by folding the ordered list of (rank, hi, lo)."""
    fold = "list_reduce(list([[rank, hi, lo]] ORDER BY place), lambda acc, h: CASE WHEN len(list_filter(acc, lambda l: bit_count(xor(l[2], h[1][2])) + bit_count(xor(l[3], h[1][3])) <= 5)) > 0 THEN acc ELSE list_concat(acc, h) END)"
    return f"SELECT {by + ', ' if by else ''}{fold} AS leaders FROM {rows}" + (f" GROUP BY {by}" if by else "")


def add(name: str, sql: str | None = None, *, hashed: bool = False):
    """Register a query; its SQL may use the views' tables."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH {_FILES}" + (f",\n{_HASH}" if hashed else "") + f"\n{sql}"
        return f

    return put


def at(text: str = NOW):
    return F.lit(text).cast("timestamp")


def clock(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# Statistics
add("count_tables", "SELECT 'files' AS table_name, count(*) AS n FROM files UNION ALL SELECT 'groups', count(*) FROM grps UNION ALL SELECT 'drives', count(*) FROM drives")(lambda v: stats.count_tables(v.files, v.groups, v.drives))
add("status_counts", "SELECT review_status, count(*) AS n FROM files GROUP BY 1")(lambda v: stats.status_counts(v.base))
add("type_counts", "SELECT type, count(*) AS n FROM files GROUP BY 1")(lambda v: stats.type_counts(v.base))
add("storage_stats", "SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, CAST(trunc(avg(size_bytes)) AS BIGINT) AS avg_bytes, count(*) FILTER (is_large = 1) AS large_files, CAST(524288000 AS BIGINT) AS large_threshold_bytes FROM files")(lambda v: stats.storage_stats(v.base))
add("drive_usage", "SELECT drive_id, label, mount_path, count(file_id) AS file_count, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM drives LEFT JOIN files USING (drive_id) GROUP BY ALL")(lambda v: stats.drive_usage(v.base, v.drives))
add("scan_summary", "SELECT count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) FILTER (is_large = 1) AS large_files, count(*) FILTER (type = 'image') AS images, count(*) FILTER (type = 'video') AS videos, count(duplicate_of) AS duplicates, count(*) - count(duplicate_of) AS originals, round(count(duplicate_of) * 100.0 / count(*), 4) AS duplicate_percent FROM files")(lambda v: stats.scan_summary(v.files))
add("basic_stats", "SELECT count(*) AS total, count(*) FILTER (type = 'image') AS images, count(*) FILTER (type = 'video') AS videos, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, round(sum(size_bytes) / 1073741824, 2) AS total_gb, round(sum(size_bytes) / count(*) / 1048576, 1) AS average_mb FROM files")(lambda v: stats.basic_stats(v.base))
add("review_progress", "SELECT count(*) AS total, count(*) FILTER (review_status <> 'undecided') AS reviewed, count(*) FILTER (review_status = 'undecided') AS remaining, round(count(*) FILTER (review_status <> 'undecided') * 100.0 / count(*), 1) AS percent, count(*) - (SELECT count(*) FROM grps) AS unique_files FROM files")(lambda v: stats.review_progress(v.files, v.groups))
add("group_status_map", "SELECT group_id, string_agg(review_status || '=' || n, ',' ORDER BY review_status) AS statuses FROM (SELECT group_id, review_status, count(*) AS n FROM files WHERE group_id IS NOT NULL GROUP BY ALL) GROUP BY 1")(
    lambda v: stats.group_status_map(v.files).select("group_id", F.array_join(F.transform(F.array_sort(F.map_entries("statuses")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("statuses"))
)
add("distinct_groups", "SELECT count(DISTINCT group_id) AS n_groups FROM files WHERE review_status = 'keep'")(lambda v: stats.distinct_groups(v.files, "keep"))
add("distinct_sizes", "SELECT DISTINCT size_bytes FROM files")(lambda v: stats.distinct_sizes(v.base))
add("stage_gate", "SELECT count(*) AS candidates, count(*) FILTER (file_id % 3 <> 0) AS present, count(*) FILTER (file_id % 3 = 0) AS left_over, count(*) FILTER (file_id % 3 = 0) = 0 AS done FROM files")(lambda v: stats.stage_gate(v.base.select("drive_id", "path_on_drive"), v.base.where("file_id % 3 <> 0")))
add("export_counts", "SELECT count(*) AS exported, count(*) FILTER (o) AS originals, count(*) FILTER (NOT o) AS regular FROM (SELECT file_id IN (SELECT original_file_id FROM grps) AS o, * FROM files) WHERE (review_status = 'keep' OR (review_status = 'undecided' AND o)) AND is_large = 0")(lambda v: stats.export_counts(v.files, v.groups, include_originals=True))

# Filters
_NAME = "regexp_extract(path, '[^/]*$')"
_P = "SELECT path_on_drive AS path, size_bytes, file_id FROM f0"
add("media_only", f"SELECT * FROM ({_P}) WHERE file_id % 4 < 3")(lambda v: filters.media_only(v.listing))
add("size_filter", f"SELECT * FROM ({_P}) WHERE size_bytes BETWEEN 500 AND 4000")(lambda v: filters.filter_by_size(v.listing, 500, 4000))
add("min_size", f"SELECT * FROM ({_P}) WHERE size_bytes >= 1024")(lambda v: filters.min_size(v.listing)[0])
add("extension_filter", f"SELECT * FROM ({_P}) WHERE lower(path) LIKE '%.png' OR lower(path) LIKE '%.mp4'")(lambda v: filters.filter_by_extension(v.listing, [".png", ".MP4"]))
add("pattern_filter", f"SELECT * FROM ({_P}) WHERE path LIKE '/en/%' AND NOT regexp_matches(path, '^/.*/src1./.*$')")(lambda v: filters.filter_by_pattern(v.listing, ["/en/*"], ["*/src1?/*"]))
add("discover_filters", f"SELECT * FROM ({_P}) WHERE file_id % 4 < 3 AND size_bytes >= 800 AND path LIKE '%/src%' AND NOT path LIKE '%.mp4'")(lambda v: filters.discover_with_filters(v.listing, least=800, include=["*/src*"], exclude=["*.mp4"]))
add("match_any", f"SELECT * FROM ({_P}) WHERE regexp_matches({_NAME}, '(?i)(^1.*png)|(9[.]j)')")(lambda v: filters.match_any(v.listing, ["^1.*png", "9[.]j"], ignore_case=True))
add("preset_match", f"SELECT * FROM ({_P}) WHERE path LIKE '%.jpg'")(lambda v: filters.preset(v.listing, "images"))
add("exclude_subtree", f"SELECT * FROM ({_P}) WHERE path NOT LIKE '%/src3/%'")(lambda v: filters.exclude_subtree(v.listing, "src3", path="path"))
add("size_range_human", f"SELECT * FROM ({_P}) WHERE size_bytes BETWEEN 1536 AND 10240")(lambda v: filters.size_range_human(v.listing, "1.5K", "10k"))
add("size_range_open", f"SELECT * FROM ({_P}) WHERE size_bytes <= 2048")(lambda v: filters.size_range_human(v.listing, most="2K"))
add("path_like", "SELECT file_id, path_on_drive FROM files WHERE path_on_drive ILIKE '%/SRC1/%.png'")(lambda v: pages.matching_paths(v.base, "%/SRC1/%.png"))
add("search_paths", "SELECT file_id, path_on_drive, review_status, count(*) OVER () AS total FROM files WHERE path_on_drive ILIKE '%/src1/%' ORDER BY file_id LIMIT 20")(lambda v: pages.bulk_preview(v.base, "%/src1/%", 20))
add("status_filter", "SELECT file_id FROM files WHERE review_status = 'keep'")(lambda v: filters.status_filter(v.base, "keep").select("file_id"))
add("pages_names", "SELECT page_id, coalesce(nullif(regexp_extract(url, '[^/]*$'), ''), 'Unknown') AS name, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS suffix FROM pages")(lambda v: v.urls.select("page_id", x.filename(F.col("path")).alias("name"), x.suffix(F.col("path")).alias("suffix")))

# Fingerprints
_B = "SELECT file_id, encode(text) AS c, hex(encode(text)) AS h, strlen(text) AS n FROM f0"
add("fast_fp", "SELECT file_id, fast_fp FROM f0")(lambda v: v.base.select("file_id", "fast_fp"))
add("fast_fp_sha1", f"SELECT file_id, sha1(CASE WHEN n > 64 THEN unhex(substr(h, 1, 128) || right(h, 128)) ELSE c END) AS fast_fp FROM ({_B})")(lambda v: v.table("documents").select(F.col("doc_id").alias("file_id"), features.fast_fp_sha1(F.col("text").cast("binary"), 64).alias("fast_fp")))
add("full_sha256", "SELECT file_id, hash_sha256 FROM f0")(lambda v: v.table("documents").select(F.col("doc_id").alias("file_id"), features.full_sha256(F.col("text").cast("binary")).alias("hash_sha256")))
add("needs_full_hash", """, n AS (SELECT file_id, size_bytes, fast_fp FROM f0 WHERE file_id % 3 = 0), k AS (SELECT * FROM f0 WHERE file_id % 3 <> 0)
SELECT *, (size_bytes IN (SELECT size_bytes FROM k) OR count(*) OVER (PARTITION BY size_bytes) > 1) AND ((size_bytes, fast_fp) IN (SELECT (size_bytes, fast_fp) FROM k) OR count(*) OVER (PARTITION BY size_bytes, fast_fp) > 1) AS needs_hash FROM n""")(
    lambda v: features.needs_full_hash(v.base.where("file_id % 3 = 0").select("file_id", "size_bytes", "fast_fp"), v.base.where("file_id % 3 <> 0"))
)
add("extraction_stats", "SELECT CAST(sum((SELECT 1)) FILTER (file_id % 4 < 2) AS BIGINT) AS images, count(*) FILTER (file_id % 4 = 2) AS videos, count(*) FILTER (file_id % 4 = 3) AS unknown, count(DISTINCT size_bytes) - count(DISTINCT size_bytes) FILTER (k > 1) AS unique_sizes, count(DISTINCT size_bytes) FILTER (k > 1) AS repeated_sizes, count(*) FILTER (k > 1) AS files_in_repeated_sizes, count(*) FILTER (k > 1 OR size_bytes IN (SELECT size_bytes + 3 FROM f0)) AS files_needing_hash FROM (SELECT *, count(*) OVER (PARTITION BY size_bytes) AS k FROM f0)")(lambda v: features.extraction_stats(v.listing, v.base.select((F.col("size_bytes") + 3).alias("size_bytes"))))
add("discovery_stats", "SELECT count(*) FILTER (m AND b) AS files_found, count(*) FILTER (b AND file_id % 4 < 2) AS images, count(*) FILTER (b AND file_id % 4 = 2) AS videos, count(*) FILTER (m AND NOT b) AS too_small, round(sum(size_bytes) FILTER (m AND b) / 1073741824, 4) AS total_gb, round(sum(size_bytes) FILTER (m AND b) / count(*) FILTER (m AND b) / 1048576, 4) AS average_mb FROM (SELECT *, file_id % 4 < 3 AS m, size_bytes >= 1024 AS b FROM f0)")(lambda v: features.discovery_stats(v.listing))
add("pixels", f"SELECT file_id, CAST({_PIXELS} AS BIGINT) AS pixels FROM f0")(lambda v: v.base.select("file_id", x.pixels(F.col("width"), F.col("height")).alias("pixels")))
add("cap_to_pixels", f"SELECT file_id, CASE WHEN width * height <= 15000 THEN width ELSE greatest(1, CAST(floor(width * sqrt(15000.0::DOUBLE / (width * height))) AS INT)) END AS w, CASE WHEN width * height <= 15000 THEN height ELSE greatest(1, CAST(floor(height * sqrt(15000.0::DOUBLE / (width * height))) AS INT)) END AS h FROM f0 WHERE type = 'image'")(
    lambda v: v.base.where("type = 'image'").select("file_id", x.cap_to_pixels(F.col("width"), F.col("height"), 15000).alias("c")).select("file_id", F.col("c.width").alias("w"), F.col("c.height").alias("h"))
)
add("type_and_large", "SELECT file_id, CASE WHEN file_id % 4 < 2 THEN 'image' WHEN file_id % 4 = 2 THEN 'video' ELSE 'unknown' END AS kind, size_bytes > 4000 AS large_v1, size_bytes >= 4000 AS large_v2 FROM f0")(lambda v: v.base.select("file_id", x.media_type(F.col("path_on_drive"), unknown=True).alias("kind"), x.is_large(F.col("size_bytes"), limit=4000).alias("large_v1"), x.is_large(F.col("size_bytes"), limit=4000, inclusive=True).alias("large_v2")))
add("skip_large", "SELECT file_id FROM f0 WHERE is_large = 0")(lambda v: features.skip_large(v.base).select("file_id"))

# Groups and clusters
add("exact_groups", "SELECT file_id, cluster FROM f0 JOIN eg USING (hash_sha256)")(lambda v: cluster.exact_groups(v.base))
add("elect_original", "SELECT og.cluster, original_file_id AS original, count(*) AS members FROM og JOIN files USING (group_id) GROUP BY ALL")(lambda v: cluster.elect_original(v.base, cluster.exact_groups(v.base)))
add("assign_groups", "SELECT file_id, group_id, duplicate_of FROM files WHERE group_id IS NOT NULL")(lambda v: cluster.assign_groups(v.base, cluster.exact_groups(v.base)))
add("simhash", "SELECT file_id, phash FROM hf", hashed=True)(lambda v: v.hashed.select("file_id", "phash"))
add("parse_phash", "SELECT file_id, CAST(hi AS BIGINT) AS hi, CAST(lo AS BIGINT) AS lo FROM hf", hashed=True)(
    lambda v: v.hashed.select("file_id", hamming.parse_phash(F.concat(F.lit(" 0x"), F.upper("phash"))).alias("h")).select("file_id", F.shiftrightunsigned("h", 32).alias("hi"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"))
)
_D = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"
add("hamming_pairs", f"SELECT a.rank AS low, b.rank AS high, CAST({_D} AS INT) AS distance FROM dh a JOIN dh b ON a.rank < b.rank AND {_D} <= 5", hashed=True)(lambda v: hamming.self_pairs(hamming.distinct_hashes(v.hashed), 5))
_LC = f", l AS ({leaders_sql('(SELECT *, rank AS place FROM dh)')}), claimed AS (SELECT phash, min(CASE WHEN bit_count(xor(hi, x[2])) + bit_count(xor(lo, x[3])) <= 5 THEN x[1] END) AS cluster FROM dh, (SELECT unnest(leaders) AS x FROM l) GROUP BY phash), each_file AS (SELECT file_id, cluster FROM hf JOIN claimed USING (phash))"
add("leader_clusters", f"{_LC} SELECT * FROM each_file QUALIFY count(*) OVER (PARTITION BY cluster) > 1", hashed=True)(lambda v: cluster.leader_clusters(v.hashed))
_LB = f""", bh AS (SELECT bucket, phash, hi, lo, rank, row_number() OVER (ORDER BY bucket, phash) AS place FROM (SELECT size_bytes // 1000 AS bucket, phash, hi, lo, min(file_id) AS rank FROM hf WHERE phash IS NOT NULL GROUP BY ALL)),
l AS ({leaders_sql('bh', 'bucket')}), u AS (SELECT bucket, unnest(leaders) AS x, generate_subscripts(leaders, 1) AS k FROM l),
claimed AS (SELECT bh.bucket, phash, min_by(x[1], k) AS cluster FROM bh JOIN u ON bh.bucket = u.bucket AND bit_count(xor(hi, x[2])) + bit_count(xor(lo, x[3])) <= 5 GROUP BY ALL)
SELECT file_id, cluster FROM hf JOIN claimed ON bucket = size_bytes // 1000 AND claimed.phash = hf.phash QUALIFY count(*) OVER (PARTITION BY bucket, cluster) > 1"""
add("leader_clusters_bucketed", _LB, hashed=True)(lambda v: cluster.leader_clusters_bucketed(v.hashed, bucket_bytes=1000))
_CASCADE = f""", rest AS (SELECT * FROM hf WHERE type = 'image' AND hash_sha256 NOT IN (SELECT hash_sha256 FROM eg)), rh AS (SELECT phash, hi, lo, min(file_id) AS rank FROM rest WHERE phash IS NOT NULL GROUP BY ALL),
l AS ({leaders_sql('(SELECT *, rank AS place FROM rh)')}), claimed AS (SELECT phash, min(CASE WHEN bit_count(xor(hi, x[2])) + bit_count(xor(lo, x[3])) <= 5 THEN x[1] END) AS cluster FROM rh, (SELECT unnest(leaders) AS x FROM l) GROUP BY phash),
near AS (SELECT file_id, cluster, 'near' AS how FROM rest JOIN claimed USING (phash) QUALIFY count(*) OVER (PARTITION BY cluster) > 1),
both_ways AS (SELECT file_id, cluster, 'exact' AS how FROM f0 JOIN eg USING (hash_sha256) UNION ALL SELECT * FROM near),
cascade AS (SELECT * FROM both_ways UNION ALL SELECT file_id, file_id, 'single' FROM f0 WHERE file_id NOT IN (SELECT file_id FROM both_ways))"""
add("dedup_cascade", f"{_CASCADE} SELECT * FROM cascade", hashed=True)(lambda v: cluster.dedup_cascade(v.hashed))
add("dedup_summary", f"{_CASCADE} SELECT count(*) FILTER (n > 1) AS n_groups, count(*) FILTER (n = 1) AS n_singles, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT cluster, count(*) AS n FROM cascade GROUP BY 1)", hashed=True)(lambda v: cluster.dedup_summary(cluster.dedup_cascade(v.hashed)))
_OLD = ", old AS (SELECT * FROM hf WHERE file_id % 3 <> 0 AND phash IS NOT NULL), kh AS (SELECT phash, hi, lo, min(file_id) AS rank FROM old GROUP BY ALL), q AS (SELECT * FROM hf WHERE file_id % 3 = 0 AND phash IS NOT NULL)"
add("nearest_hash", f"{_OLD} SELECT a.file_id AS q, b.rank AS group_id, CAST({_D} AS INT) AS distance FROM q a JOIN kh b ON {_D} <= 5 QUALIFY row_number() OVER (PARTITION BY a.file_id ORDER BY {_D}, b.rank) = 1", hashed=True)(
    lambda v: hamming.nearest_hash(
        v.hashed.where("file_id % 3 = 0").select(F.col("file_id").alias("q"), hamming.parse_phash(F.col("phash")).alias("h")).where("h is not null"),
        hamming.distinct_hashes(v.hashed.where("file_id % 3 <> 0")).withColumn("group_id", F.col("rank")),
        5,
    )
)


def _match(v):
    known = v.hashed.where("file_id % 3 <> 0").select("file_id", F.col("file_id").alias("group_id"), "hash_sha256", "phash")
    return hamming.match_existing(v.hashed.where("file_id % 3 = 0"), known, 5)


_MATCH = f"""{_OLD}, sha AS (SELECT hash_sha256, min(file_id) AS g FROM hf WHERE file_id % 3 <> 0 GROUP BY 1),
nn AS (SELECT a.file_id, b.rank AS g FROM q a JOIN kh b ON a.type = 'image' AND {_D} <= 5 QUALIFY row_number() OVER (PARTITION BY a.file_id ORDER BY {_D}, b.rank) = 1),
matched AS (SELECT n.file_id, coalesce(sha.g, nn.g) AS group_id, CASE WHEN sha.g IS NOT NULL THEN 'exact' ELSE 'near' END AS how FROM (SELECT * FROM hf WHERE file_id % 3 = 0) n LEFT JOIN sha USING (hash_sha256) LEFT JOIN nn ON nn.file_id = n.file_id WHERE coalesce(sha.g, nn.g) IS NOT NULL)"""
add("match_existing", f"{_MATCH} SELECT * FROM matched", hashed=True)(_match)
_JOIN = f"""{_MATCH}, m AS (SELECT file_id, group_id, 1 AS new FROM matched UNION ALL SELECT DISTINCT group_id, group_id, 0 FROM matched),
best AS (SELECT m.group_id, m.file_id AS o FROM m JOIN f0 USING (file_id) QUALIFY row_number() OVER (PARTITION BY m.group_id ORDER BY {_PIXELS} DESC, size_bytes DESC, new, file_id) = 1)
SELECT file_id, group_id, CASE WHEN o <> file_id THEN o END AS duplicate_of, CAST(o = file_id AS INT) AS promoted FROM matched JOIN best USING (group_id)"""
add("join_existing_groups", _JOIN, hashed=True)(lambda v: cluster.join_existing_groups(v.hashed, v.hashed.where("file_id % 3 <> 0").select(F.col("file_id").alias("group_id"), F.col("file_id").alias("original_file_id")), _match(v)))
add("reuse_group", "SELECT cluster, original_file_id AS original, CASE WHEN cluster % 2 = 0 THEN cluster + 100000 ELSE 500 + row_number() OVER (PARTITION BY cluster % 2 ORDER BY cluster) - 1 END AS group_id FROM og")(
    lambda v: cluster.reuse_group(cluster.elect_original(v.base, cluster.exact_groups(v.base)), cluster.exact_groups(v.base).select("file_id", F.when(F.col("cluster") % 2 == 0, F.col("cluster") + 100000).alias("group_id")), first_id=500)
)
add("group_every_single", "SELECT file_id, 999 + row_number() OVER (ORDER BY file_id) AS group_id FROM f0")(lambda v: cluster.group_every_single(v.base, first_id=1000))
add("should_promote", f"SELECT a.file_id, {_PIXELS.replace('width', 'a.width').replace('height', 'a.height')} > {_PIXELS.replace('width', 'b.width').replace('height', 'b.height')} OR ({_PIXELS.replace('width', 'a.width').replace('height', 'a.height')} = {_PIXELS.replace('width', 'b.width').replace('height', 'b.height')} AND a.size_bytes > b.size_bytes) AS promote FROM f0 a JOIN f0 b ON b.file_id = a.file_id + 1")(
    lambda v: v.base.alias("a").join(v.base.alias("b"), F.col("b.file_id") == F.col("a.file_id") + 1).select(F.col("a.file_id").alias("file_id"), cluster.should_promote(x.pixels(F.col("a.width"), F.col("a.height")), F.col("a.size_bytes"), x.pixels(F.col("b.width"), F.col("b.height")), F.col("b.size_bytes"), F.lit(True)).alias("promote"))
)
add("evaluate_pairs", f"SELECT a.file_id % 3 <> 0 AS expected, {_D} <= 5 AS predicted, count(*) AS n FROM hf a JOIN hf b ON a.file_id // 10 = b.file_id // 10 AND a.file_id < b.file_id AND (a.file_id % 3 = 0) = (b.file_id % 3 = 0) AND a.phash IS NOT NULL AND b.phash IS NOT NULL GROUP BY ALL", hashed=True)(
    lambda v: cluster.evaluate_pairs(v.hashed.where("phash is not null").select(F.concat(F.floor(F.col("file_id") / 10).cast("string"), F.when(F.col("file_id") % 3 == 0, "_fail").otherwise("_"), F.col("file_id").cast("string")).alias("name"), "phash"))
)

# Queues, pages, lookups
_DIM = "CASE WHEN width <> 0 AND height <> 0 THEN width || 'x' || height END"
_FULL = "mount_path || path_on_drive"
add("review_queue", f"SELECT file_id, path_on_drive, type, size_bytes, group_id, {_DIM} AS dimensions, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM files WHERE review_status = 'undecided' ORDER BY files.created_at DESC, file_id LIMIT 50")(lambda v: pages.review_queue(v.files, 50).withColumn("created_at", clock(F.col("created_at"))))
add("review_queue_order", "SELECT file_id, row_number() OVER (ORDER BY created_at DESC, file_id) - 1 AS place FROM files WHERE review_status = 'undecided' ORDER BY place LIMIT 50")(lambda v: pages.review_queue(v.files, 50).select("file_id", F.monotonically_increasing_id().alias("place")))
add("singles_page_order", "SELECT file_id, row_number() OVER (ORDER BY file_id) - 26 AS place FROM files WHERE group_id IS NULL AND review_status = 'keep' ORDER BY place LIMIT 25 OFFSET 25")(lambda v: pages.singles_page(v.files, v.drives, 2, 25, "keep").coalesce(1).select("file_id", F.monotonically_increasing_id().alias("place")))
add("groups_page_order", "SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN file_id = original_file_id THEN 0 ELSE 1 END, file_id) - 1 AS INT) AS place, file_id FROM files JOIN grps USING (group_id) WHERE group_id IN (SELECT group_id FROM grps ORDER BY group_id LIMIT 10)")(
    lambda v: pages.groups_page(v.files, v.groups, v.drives, 1, 10).select("group_id", F.posexplode("files").alias("place", "f")).select("group_id", "place", "f.file_id")
)
add("groups_page", f"""SELECT group_id, original_file_id, file_id, path_on_drive, review_status, CAST(file_id = original_file_id AS INT) AS is_original, {_FULL} AS full_path FROM files JOIN grps USING (group_id) JOIN drives USING (drive_id)
WHERE group_id IN (SELECT group_id FROM grps WHERE group_id IN (SELECT group_id FROM files WHERE review_status = 'undecided') ORDER BY group_id LIMIT 10 OFFSET 10)""")(
    lambda v: pages.groups_page(v.files, v.groups, v.drives, 2, 10, "undecided").select("group_id", "original_file_id", F.explode("files").alias("f")).select("group_id", "original_file_id", "f.file_id", "f.path_on_drive", "f.review_status", "f.is_original", "f.full_path")
)
def _paged(v):
    """The fourth page of all files by size, from a stored table of pages."""
    return paging.PageTable(v.spark, new_path(v.spark, "pages")).build(v.base.select("file_id", "size_bytes"), "size_bytes", "file_id").page(4, 30)


add("stored_page", "SELECT * FROM (SELECT file_id, size_bytes, row_number() OVER (ORDER BY size_bytes, file_id) - 1 AS rank FROM f0) WHERE rank BETWEEN 90 AND 119")(_paged)
add("singles_page", f"SELECT file_id, path_on_drive, {_FULL} AS full_path, size_bytes, type, review_status, label FROM files JOIN drives USING (drive_id) WHERE group_id IS NULL AND review_status = 'keep' ORDER BY file_id LIMIT 25 OFFSET 25")(lambda v: pages.singles_page(v.files, v.drives, 2, 25, "keep"))
add("page_meta", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 7)) AS BIGINT) AS pages, TRUE AS has_prev, 2 < greatest(1, ceil(count(*) / 7)) AS has_next FROM grps WHERE group_id IN (SELECT group_id FROM files WHERE review_status = 'keep')")(lambda v: pages.page_meta(pages.groups_with(v.files, v.groups, "keep"), 2, 7, least=1))
add("file_info", f"SELECT file_id, group_id, CAST(file_id IN (SELECT original_file_id FROM grps) AS INT) AS is_original, type, size_bytes, {_DIM} AS dimensions, review_status, label, {_FULL} AS full_path, fast_fp FROM files JOIN drives USING (drive_id)")(lambda v: pages.file_info(v.files, v.groups, v.drives, v.files).drop("phash", "review_note", "central_path"))
add("file_path", "SELECT file_id, path_on_drive, mount_path FROM files JOIN drives USING (drive_id)")(lambda v: pages.file_path(v.base, v.drives, v.base))
_EXPORT = "SELECT file_id, path_on_drive, size_bytes, type, review_status, CAST(file_id IN (SELECT original_file_id FROM grps) AS INT) AS is_original FROM files WHERE review_status IN ('keep', 'undecided') AND is_large = 0"
add("export_backup", _EXPORT)(lambda v: sinks.backup_manifest(v.files, v.groups, include_undecided=True).drop("central_path"))
add("large_review", "SELECT path_on_drive AS source_path, size_bytes, printf('%.1f', size_bytes / 1048576.0::DOUBLE) AS size_mb, type FROM files WHERE is_large = 1")(lambda v: sinks.large_review(v.base))
add("envelope", """SELECT '{"result":"ok","command":"queue","data":{"file_id":' || file_id || ',"type":"' || type || '"}}' AS value FROM files""")(lambda v: sinks.to_envelope(v.base.select("file_id", "type"), "queue"))
add("stats_report", "SELECT 'total_files: ' || count(*) AS value FROM files UNION ALL SELECT 'total_bytes: ' || sum(size_bytes) FROM files")(lambda v: sinks.stats_report(stats.storage_stats(v.base).select("total_files", "total_bytes")))

# Runs: scans of customers stand for a ledger
_RUNS = "runs AS (SELECT 'scan_' || o_orderkey AS scan_id, '/src/' || (o_custkey % 10) AS source_path, o_orderdate AS timestamp, o_orderkey AS processed_count FROM orders)"


def _runs(v):
    o = v.table("orders")
    return o.select(F.concat(F.lit("scan_"), F.col("o_orderkey").cast("string")).alias("scan_id"), F.concat(F.lit("/src/"), (F.col("o_custkey") % 10).cast("string")).alias("source_path"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderkey").alias("processed_count"))


add("list_runs", f", {_RUNS} SELECT scan_id, processed_count FROM runs WHERE source_path = '/src/3'")(lambda v: pages.list_runs(_runs(v), "/src/3").select("scan_id", "processed_count"))
add("upsert_runs", f", {_RUNS} SELECT scan_id, CASE WHEN processed_count % 7 = 0 THEN -processed_count ELSE processed_count END AS processed_count FROM runs")(lambda v: mutations.upsert_runs(_runs(v), _runs(v).where("processed_count % 7 = 0").withColumn("processed_count", -F.col("processed_count"))).select("scan_id", "processed_count"))
add("retain_runs", f", {_RUNS} SELECT scan_id FROM runs WHERE timestamp >= TIMESTAMP '1996-01-01'")(lambda v: mutations.retain_runs(_runs(v), at("1996-01-01 00:00:00"))[0].select("scan_id"))
add("retain_counts", f", {_RUNS} SELECT count(*) AS before, count(*) FILTER (timestamp >= TIMESTAMP '1996-01-01') AS after FROM runs")(lambda v: mutations.retain_runs(_runs(v), at("1996-01-01 00:00:00"))[1])
add("retain_untimed_runs", f", {_RUNS} SELECT scan_id FROM runs WHERE timestamp >= TIMESTAMP '1996-01-01' OR processed_count % 5 = 0")(lambda v: mutations.retain_runs(_runs(v).withColumn("timestamp", F.when(F.col("processed_count") % 5 != 0, F.col("timestamp"))), at("1996-01-01 00:00:00"))[0].select("scan_id"))
add("upsert_untimed_runs", f", {_RUNS} SELECT scan_id, processed_count * CASE WHEN processed_count % 14 = 0 THEN -2 WHEN processed_count % 7 = 0 THEN -1 ELSE 1 END AS processed_count FROM runs")(
    lambda v: mutations.upsert_runs(_runs(v), _runs(v).where("processed_count % 7 = 0").withColumns({"processed_count": -F.col("processed_count"), "timestamp": F.lit(None).cast("timestamp")}).unionByName(_runs(v).where("processed_count % 14 = 0").withColumn("processed_count", -2 * F.col("processed_count")))).select("scan_id", "processed_count")
)
add("drop_run", f", {_RUNS} SELECT scan_id FROM runs WHERE scan_id <> 'scan_7'")(lambda v: mutations.drop_run(_runs(v), "scan_7").select("scan_id"))
add("run_config", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda v: sources.read_run_config(v.table("events").select(F.col("event_id").alias("scan_id"), F.col("props").alias("config_json"))).select(F.col("scan_id").alias("event_id"), F.try_element_at("config", F.lit("k")).alias("k")))

add("read_run_config", "SELECT CAST(event_id AS VARCHAR) AS scan_id, json_extract_string(props, '$.k') AS k FROM events")(
    lambda v: sources.read_run_config(v.table("events").select(F.col("event_id").cast("string").alias("scan_id"), F.col("props").alias("config_json"))).select("scan_id", F.try_element_at("config", F.lit("k")).alias("k"))
)


def _ledger(v):
    """The runs with a stage, settings and files found."""
    n = F.col("processed_count")
    found = F.array_repeat(F.struct(F.lit("/a").alias("path"), n.alias("size_bytes")), (n % 5).cast("int"))
    return _runs(v).withColumns({"stage": F.when(n % 2 == 0, "completed").otherwise("grouping"), "config_json": F.concat(F.lit('{"workers":"'), (n % 8).cast("string"), F.lit('"}')), "discovered": found})


add("run_info", f", {_RUNS} SELECT scan_id, source_path, CASE WHEN processed_count % 2 = 0 THEN 'completed' ELSE 'grouping' END AS stage, processed_count, CAST(processed_count % 5 AS INT) AS n_discovered, CAST(processed_count % 8 AS VARCHAR) AS workers FROM runs WHERE scan_id = 'scan_7'")(
    lambda v: pages.run_info(_ledger(v), "scan_7").select("scan_id", "source_path", "stage", "processed_count", "n_discovered", F.try_element_at("config", F.lit("workers")).alias("workers"))
)
add("catalogue_summary", f""", {_RUNS} SELECT 'table' AS section, 'files' AS name, count(*) AS n FROM files UNION ALL SELECT 'table', 'groups', count(*) FROM grps UNION ALL SELECT 'table', 'drives', count(*) FROM drives
UNION ALL SELECT 'table', 'scan_runs', count(*) FROM runs UNION ALL SELECT 'status', review_status, count(*) FROM files GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM files GROUP BY 2""")(lambda v: stats.catalogue_summary(v.files, v.groups, v.drives, _runs(v)))

# Sources
add("load_drive_records", "SELECT file_id, path_on_drive, size_bytes, type, hash_sha256, width, height, is_large FROM files WHERE drive_id = 3")(lambda v: sources.load_drive_records(v.base, 3))


def _catalogue(v):
    """The catalogue written to a snapshot and read back."""
    path = new_path(v.spark, "catalogue")
    sources.write_catalogue({"files": v.files, "groups": v.groups, "drives": v.drives, "scan_runs": _ledger(v)}, path)
    return sources.read_catalogue(v.spark, path)


add("read_catalogue", "SELECT file_id, hash_sha256, group_id, duplicate_of, review_status, path_on_drive, CAST(NULL AS VARCHAR) AS phash FROM files")(lambda v: _catalogue(v)["files"].select("file_id", "hash_sha256", "group_id", "duplicate_of", "review_status", "path_on_drive", "phash"))
add("read_catalogue_runs", f", {_RUNS} SELECT scan_id, processed_count, CAST(processed_count % 5 AS INT) AS n_discovered FROM runs")(lambda v: _catalogue(v)["scan_runs"].select("scan_id", "processed_count", F.size("discovered").alias("n_discovered")))


def _listed(v):
    """Bytes of files below a folder, by language; the documents' texts are written there as lines."""
    path = new_path(v.spark, "tree")
    v.table("documents").select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(path)
    lang = F.nullif(F.regexp_extract("path", "/lang=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return sources.list_files(v.spark, path).groupBy(lang.alias("lang")).agg(F.sum("size_bytes").alias("bytes"))


add("list_files", "SELECT lang, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes FROM documents GROUP BY 1")(_listed)


def _walked(v, what):
    """A tree with a folder and a file for each source and language, walked."""
    path = new_path(v.spark, "tree")
    folder = F.concat_ws("-", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")))
    v.table("documents").select(folder.alias("folder"), F.coalesce("text", F.lit("")).alias("text")).repartition("folder").write.partitionBy("folder").text(path)
    files, counts = tree.walk(v.spark, path)
    named = files.where(F.col("path").contains("/folder=") & ~F.col("path").contains("/."))
    return counts.select("folders", "unreadable") if what else named.select(F.regexp_extract("path", "/folder=([^/]*)/", 1).alias("folder"), "size_bytes")


_TREE = "SELECT coalesce(source, 'none') || '-' || coalesce(lang, 'none') AS folder, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY 1"
add("walk_tree", _TREE)(lambda v: _walked(v, 0))
add("walk_counts", f"SELECT count(*) AS folders, 0 AS unreadable FROM ({_TREE})")(lambda v: _walked(v, 1))


def _manifest(v):
    path = new_path(v.spark, "manifest")
    sources.write_manifest(v.listing.where("file_id % 2 = 0"), path)
    return sources.read_manifest(v.spark, path, v.listing.where("file_id % 3 <> 0"))


add("read_manifest", f"SELECT path, size_bytes FROM ({_P}) WHERE file_id % 6 IN (2, 4)")(lambda v: _manifest(v)[0])
add("manifest_invalid", f"SELECT count(*) AS invalid FROM ({_P}) WHERE file_id % 6 = 0")(lambda v: _manifest(v)[1])


def _pictures(v, **how):
    """Perceptual hashes of the texts' bytes, taken as grey pictures 32 wide."""
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / 32)).cast("int")
    data = F.rpad(F.col("text").cast("binary"), rows * 32, F.lit(b"\x00"))
    one = v.table("documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.struct(rows.alias("height"), F.lit(32).alias("width"), F.lit(1).alias("nChannels"), data.alias("data")).alias("image"), (rows * 32).alias("pixels"))
    return features.phash64(one, **how)


# Pixels (y, x, b) of r x 32 pictures; area means down to h x w, then to 32 x 32, as weights of rows and columns; then the lowest frequencies.
def _picture_sql(h: str, w: str) -> str:
    over = lambda n, m, i, y: f"greatest(0, least(({i} + 1) * {n}::DOUBLE / {m}, {y} + 1) - greatest({i} * {n}::DOUBLE / {m}, {y})) * {m} / {n}"
    return f"""WITH px AS (SELECT doc_id, r, (k - 1) // 32 AS y, (k - 1) % 32 AS x, CAST('0x' || c AS INT) AS b FROM (SELECT doc_id, r, unnest(bs) AS c, generate_subscripts(bs, 1) AS k FROM (SELECT doc_id, greatest(1, CAST(ceil(strlen(text) / 32) AS INT)) AS r, regexp_extract_all(hex(encode(text)), '..') AS bs FROM documents WHERE text IS NOT NULL))),
dims AS (SELECT DISTINCT r, {h} AS h, {w} AS w FROM (SELECT greatest(1, CAST(ceil(strlen(text) / 32) AS INT)) AS r FROM documents WHERE text IS NOT NULL)),
u AS (SELECT unnest(range(8)) AS u), i AS (SELECT unnest(range(32)) AS i),
down AS (SELECT r, y, t, {over('r', 'h', 't', 'y')} AS o FROM (SELECT *, unnest(range(CAST(floor(y * h::DOUBLE / r) AS INT), least(h, CAST(ceil((y + 1) * h::DOUBLE / r) AS INT)))) AS t FROM (SELECT *, unnest(range(r)) AS y FROM dims))),
half AS (SELECT r, t, u, sum({over('h', '32', 'i', 't')} * cos(pi() * u * (2 * i + 1) / 64)) AS c FROM (SELECT *, unnest(range(h)) AS t FROM dims), i, u GROUP BY ALL),
rowf AS (SELECT r, y, u, sum(o * c) AS c FROM down JOIN half USING (r, t) GROUP BY ALL),
colf AS (SELECT r, x, u AS v, sum(o * {over('w', '32', 'i', 's')} * cos(pi() * u * (2 * i + 1) / 64)) AS c FROM (SELECT *, {over('32', 'w', 's', 'x')} AS o FROM (SELECT *, unnest(range(w)) AS s FROM dims), (SELECT unnest(range(32)) AS x)), i, u GROUP BY ALL),
part AS (SELECT doc_id, r, x, u, sum(b * c) AS c FROM px JOIN rowf USING (r, y) GROUP BY ALL),
low AS (SELECT doc_id, u, v, floor(sum(part.c * colf.c) * 1000 + 0.5) AS f FROM part JOIN colf USING (r, x) GROUP BY ALL),
bits AS (SELECT doc_id, string_agg(CASE WHEN f > m THEN '1' ELSE '0' END, '' ORDER BY u, v) AS s FROM (SELECT *, median(f) OVER (PARTITION BY doc_id) AS m FROM low) GROUP BY 1)
SELECT CAST(d.doc_id AS VARCHAR) AS path, coalesce((SELECT string_agg(printf('%x', list_sum(list_transform(range(4), lambda j: CAST(substr(s, CAST(4 * q + j + 1 AS BIGINT), 1) AS INT) * (8 >> j)))::INT), '' ORDER BY q) FROM (SELECT unnest(range(16)) AS q)), '0000000000000000') AS phash FROM documents d LEFT JOIN bits USING (doc_id) WHERE d.text IS NOT NULL"""


QUERIES["picture_hashes"], SQL["picture_hashes"] = (lambda spark, sf_dir: _pictures(Views(spark, sf_dir), most=1 << 30)), _picture_sql("r", "32")
_CAP = "CASE WHEN 32 * r <= 700 THEN {n} ELSE greatest(1, CAST(floor({n} * sqrt(700::DOUBLE / (32 * r))) AS INT)) END"
QUERIES["picture_hashes_shrunk"], SQL["picture_hashes_shrunk"] = (lambda spark, sf_dir: _pictures(Views(spark, sf_dir), most=700, shrink=True)), _picture_sql(_CAP.format(n="r"), _CAP.format(n="32"))

# Mutations
_NEW = "SELECT file_id FROM f0 WHERE file_id % 3 <> 0 UNION ALL SELECT min(file_id) + 1000000 FROM f0 WHERE file_id % 2 = 0 AND file_id % 3 = 0 GROUP BY drive_id, path_on_drive"


def _new(v):
    return v.base.where("file_id % 2 = 0").withColumn("file_id", F.col("file_id") + 1000000)


add("insert_or_ignore", _NEW)(lambda v: mutations.insert_or_ignore(v.base.where("file_id % 3 <> 0"), _new(v).unionByName(_new(v).withColumn("file_id", F.col("file_id") + 5))).select("file_id"))
add("insert_without_ids", "SELECT file_id, path_on_drive FROM f0 WHERE file_id % 3 <> 0 UNION ALL SELECT NULL, path_on_drive FROM f0 WHERE file_id % 2 = 0 AND file_id % 3 = 0")(
    lambda v: mutations.insert_or_ignore(v.base.where("file_id % 3 <> 0"), _new(v).unionByName(_new(v)).withColumn("file_id", F.lit(None).cast("long"))).select("file_id", "path_on_drive")
)
add("insert_or_get_ids", "SELECT path_on_drive, CASE WHEN file_id % 3 <> 0 THEN file_id ELSE (SELECT max(file_id) FROM f0 WHERE file_id % 3 <> 0) + row_number() OVER (PARTITION BY file_id % 3 = 0 ORDER BY drive_id, path_on_drive) END AS file_id, file_id % 3 = 0 AS inserted FROM f0 WHERE file_id % 2 = 0")(lambda v: mutations.insert_or_get_ids(v.base.where("file_id % 3 <> 0"), _new(v)).select("path_on_drive", "file_id", "inserted"))
add("get_or_create_drives", "SELECT drive_id, label, mount_path FROM drives UNION ALL SELECT (SELECT max(drive_id) FROM drives) + row_number() OVER (ORDER BY lang), lang, '/mnt/' || lang FROM (SELECT DISTINCT lang FROM documents)")(
    lambda v: mutations.get_or_create_drives(v.drives, v.table("documents").select(F.col("lang").alias("label"), F.concat(F.lit("/mnt/"), "lang").alias("mount_path")).union(v.drives.select(F.lit("other"), "mount_path")))
)
add("set_null_orphans", "SELECT file_id, CASE WHEN group_id % 2 = 0 THEN group_id END AS group_id, CASE WHEN drive_id > 3 THEN drive_id END AS drive_id FROM files")(lambda v: mutations.set_null_orphans(v.files, v.groups.where("group_id % 2 = 0"), v.drives.where("drive_id > 3"))[0].select("file_id", "group_id", "drive_id"))
add("validate_catalogue", """SELECT 'status' AS rule, count(*) FILTER (file_id % 10 = 0) AS violations FROM files UNION ALL SELECT 'type', 0 UNION ALL SELECT 'flags', 0 UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'unique_path', 0
UNION ALL SELECT 'orphan_group', count(*) FILTER (group_id % 2 <> 0) FROM files UNION ALL SELECT 'orphan_drive', 0 UNION ALL SELECT 'orphan_duplicate', 0 UNION ALL SELECT 'orphan_original', 0 UNION ALL SELECT 'original_elsewhere', 0""")(
    lambda v: mutations.validate_catalogue(v.files.withColumn("review_status", F.when(F.col("file_id") % 10 == 0, "odd").otherwise(F.col("review_status"))), v.groups.where("group_id % 2 = 0"), v.drives)
)


def _marks(v):
    return v.base.where("file_id % 5 = 1").select("file_id", F.when(F.col("file_id") % 2 == 0, "keep").otherwise("bad").alias("status"), F.lit("seen").alias("note"))


_SHOW = "SELECT file_id, {s} AS review_status, {n} AS review_note FROM files"
_show = ("file_id", "review_status", "review_note")
add("mark", _SHOW.format(s="CASE WHEN file_id % 10 = 6 THEN 'keep' ELSE review_status END", n="CASE WHEN file_id % 10 = 6 THEN 'seen' END"))(lambda v: mutations.mark(v.base, _marks(v), at()).select(*_show))
add("mark_repeated", _SHOW.format(s="CASE WHEN file_id % 5 = 1 THEN 'not_needed' ELSE review_status END", n="CASE WHEN file_id % 5 = 1 THEN 'again' END"))(
    lambda v: mutations.mark(v.base, _marks(v).withColumns({"status": F.lit("keep"), "seq": F.lit(1)}).unionByName(_marks(v).withColumns({"status": F.lit("not_needed"), "note": F.lit("again"), "seq": F.lit(2)})), at()).select(*_show)
)
add("mark_report_untold", "SELECT file_id, 'keep' AS status, CASE WHEN file_id % 3 > 0 THEN review_status END AS old_status, file_id % 3 = 0 OR review_status <> 'keep' AS changed, CAST(NULL AS VARCHAR) AS error FROM files")(
    lambda v: mutations.mark_report(v.base.withColumn("review_status", F.when(F.col("file_id") % 3 > 0, F.col("review_status"))), v.base.select("file_id", F.lit("keep").alias("status"), F.lit(None).cast("string").alias("note")))
)
add("group_mark_report_untold", "SELECT group_id, 'keep' AS status, count(*) AS members, count(*) FILTER (file_id % 3 = 0 OR review_status <> 'keep') AS changed, CAST(NULL AS VARCHAR) AS error FROM files WHERE group_id IS NOT NULL GROUP BY 1")(
    lambda v: mutations.group_mark_report(v.files.withColumn("review_status", F.when(F.col("file_id") % 3 > 0, F.col("review_status"))), v.groups.select("group_id", F.lit("keep").alias("status"), F.lit(None).cast("string").alias("note")))
)
add("mark_report", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'keep' ELSE 'bad' END AS status, review_status AS old_status, file_id % 2 = 0 AND review_status <> 'keep' AS changed, CASE WHEN file_id % 2 = 1 THEN 'bad status' END AS error FROM files WHERE file_id % 5 = 1")(lambda v: mutations.mark_report(v.base, _marks(v)))
add("mark_group", _SHOW.format(s="CASE WHEN group_id % 3 = 0 THEN 'not_needed' ELSE review_status END", n="CAST(NULL AS VARCHAR)"))(lambda v: mutations.mark_groups(v.files, v.groups.where("group_id % 3 = 0").select("group_id", F.lit("not_needed").alias("status"), F.lit(None).cast("string").alias("note")), at()).select(*_show))
add("group_mark_report", "SELECT group_id, 'keep' AS status, count(*) AS members, count(*) FILTER (review_status <> 'keep') AS changed, CAST(NULL AS VARCHAR) AS error FROM files WHERE group_id % 3 = 0 GROUP BY 1 UNION ALL SELECT -group_id, 'keep', 0, 0, 'unknown group' FROM grps WHERE group_id % 3 = 1")(
    lambda v: mutations.group_mark_report(v.files, v.groups.where("group_id % 3 < 2").select(F.when(F.col("group_id") % 3 == 0, F.col("group_id")).otherwise(-F.col("group_id")).alias("group_id"), F.lit("keep").alias("status"), F.lit(None).cast("string").alias("note")))
)
add("set_groups", "SELECT file_id, CASE WHEN file_id % 4 = 0 THEN 7 ELSE group_id END AS group_id, CASE WHEN file_id % 4 = 0 THEN file_id + 1 ELSE duplicate_of END AS duplicate_of FROM files")(
    lambda v: mutations.set_groups(v.files, v.base.where("file_id % 4 = 0").select("file_id", F.lit(7).cast("long").alias("group_id"), (F.col("file_id") + 1).alias("duplicate_of"))).select("file_id", "group_id", "duplicate_of")
)
add("bulk_mark", _SHOW.format(s="CASE WHEN path_on_drive ILIKE '%/src2/%' THEN 'keep' ELSE review_status END", n="review_note"))(lambda v: mutations.bulk_mark(v.base, "%/SRC2/%", "keep", at()).select(*_show))
_CHOSEN = "chosen AS (SELECT group_id, max(file_id) AS c FROM files WHERE duplicate_of IS NOT NULL AND group_id % 2 = 0 GROUP BY 1)"


def _chosen(v):
    return v.files.where("duplicate_of is not null and group_id % 2 = 0").groupBy("group_id").agg(F.max("file_id").alias("file_id")).select("file_id")


add("promote", f", {_CHOSEN} SELECT file_id, CASE WHEN c IS NULL THEN duplicate_of WHEN c <> file_id THEN c END AS duplicate_of FROM files LEFT JOIN chosen USING (group_id)")(lambda v: mutations.promote(v.files, v.groups, _chosen(v))[0].select("file_id", "duplicate_of"))
add("promote_groups", f", {_CHOSEN} SELECT group_id, coalesce(c, original_file_id) AS original_file_id FROM grps LEFT JOIN chosen USING (group_id)")(lambda v: mutations.promote(v.files, v.groups, _chosen(v))[1])
_FRESH = f"{_CHOSEN}, fresh AS (SELECT c, (SELECT max(group_id) FROM grps) + row_number() OVER (ORDER BY c) AS g FROM chosen)"
add("make_original", f", {_FRESH} SELECT file_id, coalesce(g, group_id) AS group_id, CASE WHEN g IS NULL THEN duplicate_of END AS duplicate_of FROM files LEFT JOIN fresh ON c = file_id")(lambda v: mutations.make_original(v.files, v.groups, _chosen(v))[0].select("file_id", "group_id", "duplicate_of"))
add("move_to_group", f", {_CHOSEN} SELECT file_id, CASE WHEN c IS NULL THEN f.group_id ELSE 1 END AS group_id, CASE WHEN c IS NULL THEN duplicate_of ELSE (SELECT original_file_id FROM grps WHERE group_id = 1) END AS duplicate_of FROM files f LEFT JOIN chosen ON c = file_id")(lambda v: mutations.move_to_group(v.files, v.groups, _chosen(v).withColumn("group_id", F.lit(1).cast("long"))).select("file_id", "group_id", "duplicate_of"))


def _events(v):
    """A click marks the file of the user's id as kept, a view as not needed; a purchase leaves a note."""
    e = v.table("events")
    kind = F.col("event_id") % 3
    return e.select(F.col("event_id").alias("seq"), F.when(kind == 2, "note").otherwise("mark").alias("action"), F.col("user_id").alias("target"), F.when(kind == 0, "keep").when(kind == 1, "not_needed").alias("status"), F.when(kind != 1, F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("note"), at().alias("at"))


_EV = ", ev AS (SELECT event_id AS seq, user_id AS file_id, event_id % 3 AS k, CASE event_id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'not_needed' END AS s, CASE WHEN event_id % 3 <> 1 THEN 'n' || event_id END AS n FROM events), mk AS (SELECT file_id, arg_max(s, seq) AS s FROM ev WHERE k < 2 GROUP BY 1), nt AS (SELECT file_id, arg_max(struct_pack(n := n), seq).n AS n, count(*) AS c FROM ev GROUP BY 1)"
_EVENTS = f"{_EV} SELECT file_id, coalesce(s, review_status) AS review_status, nt.n AS review_note FROM files LEFT JOIN mk USING (file_id) LEFT JOIN nt USING (file_id)"
add("apply_review_events", _EVENTS)(lambda v: mutations.apply_review_events(v.files, _events(v)).select(*_show))

# Scalars
add("scalars_size", "SELECT file_id, CASE WHEN k = 0 THEN '0 B' WHEN k < 1024 THEN k || ' B' WHEN k < 1048576 THEN CASE WHEN k % 1024 = 0 THEN (k // 1024) || ' KB' ELSE printf('%.1f KB', k / 1024.0::DOUBLE) END ELSE CASE WHEN k % 1048576 = 0 THEN (k // 1048576) || ' MB' ELSE printf('%.1f MB', k / 1048576.0::DOUBLE) END END AS text, printf('%.1f', k / 1048576.0::DOUBLE) AS mb FROM (SELECT file_id, size_bytes * (file_id % 512) AS k FROM f0)")(
    lambda v: v.base.select("file_id", (F.col("size_bytes") * (F.col("file_id") % 512)).alias("k")).select("file_id", x.filesize(F.col("k")).alias("text"), x.size_mb(F.col("k")).alias("mb"))
)
add("scalars_picture", f"SELECT file_id, CASE WHEN width IS NULL THEN 'Unknown' ELSE printf('%.1f MP', width * height / 1e6) END AS megapixels, {_DIM} AS dimensions FROM f0")(lambda v: v.base.select("file_id", x.megapixels(F.col("width"), F.col("height")).alias("megapixels"), x.dimensions(F.col("width"), F.col("height")).alias("dimensions")))
add("scalars_paths", f"SELECT file_id, {_FULL} AS complete, path_on_drive AS resolved, mount_path || '/' || substr(path_on_drive, 2) AS joined, regexp_extract(path_on_drive, '[^/]*$') AS name, CASE WHEN length(path_on_drive) > 37 THEN '...' || right(path_on_drive, 34) ELSE path_on_drive END AS short FROM f0 JOIN drives USING (drive_id)")(
    lambda v: v.base.join(v.drives, "drive_id").select("file_id", x.complete_path(F.col("mount_path"), F.col("path_on_drive")).alias("complete"), x.resolved_path(F.col("mount_path"), F.col("path_on_drive")).alias("resolved"), x.resolved_path(F.col("mount_path"), F.substring("path_on_drive", 2, 1000)).alias("joined"), x.filename(F.col("path_on_drive")).alias("name"), x.short_source(F.col("path_on_drive")).alias("short"))
)
add("scalars_ids", "SELECT file_id, 'scan_' || strftime(created_at, '%Y%m%d_%H%M%S') || '_' || substr(md5(label), 1, 8) AS scan_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, split_part(label, '_', 1) AS prefix FROM f0 JOIN drives USING (drive_id)")(lambda v: v.base.join(v.drives, "drive_id").select("file_id", x.scan_id(F.col("label"), F.col("created_at")).alias("scan_id"), x.utc_iso(F.col("created_at")).alias("iso"), x.name_prefix(F.col("label")).alias("prefix")))
add("parse_size", "SELECT file_id, CASE file_id % 4 WHEN 0 THEN size_bytes WHEN 1 THEN size_bytes * 1024 WHEN 2 THEN CAST(floor((size_bytes + 0.5) * 1048576) AS BIGINT) END AS bytes FROM f0")(
    lambda v: v.base.select("file_id", x.parse_size(F.concat(F.col("size_bytes").cast("string"), F.array(F.lit(""), F.lit("K"), F.lit(".5m"), F.lit("x"))[(F.col("file_id") % 4).cast("int")])).alias("bytes"))
)

# Copies
_PLAN = "SELECT path_on_drive AS relative_path, size_bytes, CASE WHEN file_id % 3 = 0 THEN 'exists' ELSE 'copied' END AS action FROM f0 WHERE path_on_drive LIKE '%.jpg'"


def _plan(v):
    rows = v.base.select(F.col("path_on_drive").alias("relative_path"), "size_bytes", "file_id")
    return copyplan.copy_plan(filters.preset(rows, "images", path="relative_path"), rows.where("file_id % 3 = 0"))


add("copy_plan", _PLAN)(_plan)
add("copy_summary", f"SELECT action, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ({_PLAN}) GROUP BY 1")(lambda v: copyplan.copy_summary(_plan(v)))


# Streams: the tables' rows arrive in batches of files
def _feed(v, df, name, n=4):
    path = new_path(v.spark, name)
    df.repartition(n).write.parquet(path)
    return ingest.file_stream(v.spark, path, ", ".join(f"{c} {k}" for c, k in df.dtypes), files_per_batch=2)


def _stream_ingest(v):
    known = v.base.where("file_id % 3 <> 0")
    table = BucketedTable(v.spark, new_path(v.spark, "ingest"), ", ".join(f"{c} {k}" for c, k in known.dtypes), list(mutations.KEY))
    table.create(known)
    ingest.stream_ingest(_feed(v, _new(v), "feed"), table, new_path(v.spark, "progress")).awaitTermination()
    return table.read().select("file_id")


def _stream_events(v, *, late=False):
    files = mutations.with_registers(v.files)
    table = BucketedTable(v.spark, new_path(v.spark, "marks"), ", ".join(f"{c} {k}" for c, k in files.dtypes), ["file_id"])
    table.create(files)
    events, path = _events(v), new_path(v.spark, "events")
    middle = events.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    # Two files for each of two batches, earlier events first, or last.
    early = F.col("seq") <= middle
    events.where(~early if late else early).repartition(2).write.parquet(path)
    events.where(early if late else ~early).repartition(2).write.mode("append").parquet(path)
    stream = ingest.file_stream(v.spark, path, ", ".join(f"{c} {k}" for c, k in events.dtypes), files_per_batch=2)
    ingest.stream_review_events(stream, table, new_path(v.spark, "progress")).awaitTermination()
    return table.read().select(*_show)


def _stream_match(v, batches=1):
    known = v.hashed.where("file_id % 3 <> 0").withColumn("group_id", F.col("file_id"))
    groups = known.select("group_id", F.col("file_id").alias("original_file_id"))
    out = new_path(v.spark, "matched")
    new = v.hashed.where("file_id % 3 = 0").select("file_id", "hash_sha256", "phash", "type", "width", "height", "size_bytes")
    path = new_path(v.spark, "feed")
    for b in range(batches):  # a file each, read in the order of writing
        new.where(F.floor(F.col("file_id") / 3) % batches == b).coalesce(1).write.mode("append").parquet(path)
    ingest.stream_match(ingest.file_stream(v.spark, path, ", ".join(f"{c} {k}" for c, k in new.dtypes)), known, groups, 5, out, new_path(v.spark, "progress")).awaitTermination()
    return v.spark.read.parquet(out).drop("batch")


def _stream_first_seen(v):
    rows = v.base.select("drive_id", "path_on_drive")
    out = new_path(v.spark, "seen")
    stream = ingest.stream_first_seen(_feed(v, rows.union(rows), "feed"))
    stream.writeStream.format("parquet").option("checkpointLocation", new_path(v.spark, "progress")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return v.spark.read.parquet(out)


add("stream_ingest", _NEW)(_stream_ingest)
add("stream_review_events", _EVENTS)(_stream_events)
add("stream_late_events", _EVENTS)(lambda v: _stream_events(v, late=True))
add("stream_match", _JOIN, hashed=True)(_stream_match)


def _match_sql(b: int, known: str, originals: str) -> str:
    """CTEs of one batch: r{b} its rows, k{b} what is known after it, o{b} the originals after it."""
    new = f"n{b} AS (SELECT * FROM hf WHERE file_id % 3 = 0 AND file_id // 3 % 2 = {b})"
    sha = f"sha{b} AS (SELECT hash_sha256, arg_min(g, file_id) AS g FROM {known} WHERE hash_sha256 IS NOT NULL GROUP BY 1)"
    nn = f"nn{b} AS (SELECT a.file_id, b.g FROM n{b} a JOIN {known} b ON a.type = 'image' AND a.phash IS NOT NULL AND b.phash IS NOT NULL AND {_D} <= 5 QUALIFY row_number() OVER (PARTITION BY a.file_id ORDER BY {_D}, b.file_id) = 1)"
    got = f"m{b} AS (SELECT n.file_id, coalesce(s.g, nn.g) AS group_id FROM n{b} n LEFT JOIN sha{b} s USING (hash_sha256) LEFT JOIN nn{b} nn ON nn.file_id = n.file_id WHERE coalesce(s.g, nn.g) IS NOT NULL)"
    all_of = f"a{b} AS (SELECT file_id, group_id, 1 AS new FROM m{b} UNION ALL SELECT o, group_id, 0 FROM {originals} WHERE group_id IN (SELECT group_id FROM m{b}))"
    best = f"b{b} AS (SELECT group_id, file_id AS o FROM a{b} JOIN f0 USING (file_id) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY {_PIXELS} DESC, size_bytes DESC, new, file_id) = 1)"
    rows = f"r{b} AS (SELECT file_id, group_id, CASE WHEN o <> file_id THEN o END AS duplicate_of, CAST(o = file_id AS INT) AS promoted FROM m{b} JOIN b{b} USING (group_id))"
    after = f"k{b} AS (SELECT * FROM {known} UNION ALL SELECT h.file_id, h.hash_sha256, h.phash, h.hi, h.lo, m.group_id FROM m{b} m JOIN hf h USING (file_id)), o{b} AS (SELECT * FROM b{b} UNION ALL SELECT group_id, o FROM {originals} WHERE group_id NOT IN (SELECT group_id FROM b{b}))"
    return ", ".join((new, sha, nn, got, all_of, best, rows, after))


_START = "ks AS (SELECT file_id, hash_sha256, phash, hi, lo, file_id AS g FROM hf WHERE file_id % 3 <> 0), os AS (SELECT file_id AS group_id, file_id AS o FROM ks)"
add("stream_match_batches", f", {_START}, {_match_sql(0, 'ks', 'os')}, {_match_sql(1, 'k0', 'o0')} SELECT * FROM r0 UNION ALL SELECT * FROM r1", hashed=True)(lambda v: _stream_match(v, 2))
add("stream_first_seen", "SELECT drive_id, path_on_drive FROM files")(_stream_first_seen)
