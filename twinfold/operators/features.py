"""Fingerprints and statistics of files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MAX_PIXELS, SMALLEST, cap_to_pixels, media_type

END = 64 * 1024


def fast_fp(content: Column, end: int = END) -> Column:
    """16 hex digits of the SHA-256 of the first bytes and, beyond twice as many, the last ones."""
    both = F.concat(F.substring(content, 1, end), F.substring(content, -end, end))
    return F.substring(F.sha2(F.when(F.octet_length(content) > 2 * end, both).otherwise(F.substring(content, 1, end)), 256), 1, 16)


def fast_fp_sha1(content: Column, end: int = END) -> Column:
    """SHA-1 of the first bytes and, beyond as many, the last ones, which may overlap them."""
    both = F.concat(F.substring(content, 1, end), F.substring(content, -end, end))
    return F.sha1(F.when(F.octet_length(content) > end, both).otherwise(content))


def full_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def needs_full_hash(new: DataFrame, known: DataFrame, *, scope: str = "existing_or_batch") -> DataFrame:
    """new (file_id, size_bytes, fast_fp) with needs_hash: the size isn't unique and the (size, fast_fp) is known, in the catalogue or (unless scope is `existing`) twice in the batch."""
    sizes = known.select("size_bytes").distinct().withColumn("_size", F.lit(True))
    prints = known.where("fast_fp is not null").select("size_bytes", "fast_fp").distinct().withColumn("_print", F.lit(True))
    by_size = new.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("_n"))
    by_print = new.where("fast_fp is not null").groupBy("size_bytes", "fast_fp").agg(F.count(F.lit(1)).alias("_m"))
    joined = new.join(sizes, "size_bytes", "left").join(by_size, "size_bytes", "left").join(prints, ["size_bytes", "fast_fp"], "left").join(by_print, ["size_bytes", "fast_fp"], "left")
    seen = F.coalesce("_print", F.lit(False))
    if scope != "existing":
        seen = seen | (F.coalesce("_m", F.lit(0)) > 1)
    repeated = F.coalesce("_size", F.lit(False)) | (F.col("_n") > 1)
    return joined.select(*new.columns, (repeated & seen).alias("needs_hash"))


def skip_large(df: DataFrame, *, hash_large: bool = False) -> DataFrame:
    """Rows whose content is to be read."""
    return df if hash_large else df.where("is_large = 0")


def extraction_stats(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row over (path, size_bytes): files by type, sizes that occur once or more often, files of repeated sizes, and files that need a hash of their
    contents: those whose size occurs again, here or in known (size_bytes). Files without a size are of one size."""
    kind = media_type(F.col("path"), unknown=True)
    sizes = df.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(kind == k).alias(k) for k in ("image", "video", "unknown")])
    there = (df if known is None else known).select(F.col("size_bytes").alias("_known")).distinct().withColumn("_there", F.lit(known is not None))
    sizes = sizes.join(there, F.col("size_bytes").eqNullSafe(F.col("_known")), "left")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return sizes.agg(total("image", "images"), total("video", "videos"), total("unknown", "unknown"), F.count_if(F.col("n") == 1).alias("unique_sizes"), F.count_if(F.col("n") > 1).alias("repeated_sizes"), total(F.when(F.col("n") > 1, F.col("n")), "files_in_repeated_sizes"), total(F.when((F.col("n") > 1) | F.coalesce("_there", F.lit(False)), F.col("n")), "files_needing_hash"))


def discovery_stats(df: DataFrame) -> DataFrame:
    """One row over listed (path, size_bytes): media files found, by type, GB, average MB, and those too small."""
    kind = media_type(F.col("path"), unknown=True)
    found = (kind != "unknown") & (F.col("size_bytes") >= SMALLEST)
    of = lambda k: F.count_if(found & (kind == k))
    size = F.coalesce(F.sum(F.when(found, F.col("size_bytes"))), F.lit(0)).cast("long")
    return df.agg(F.count_if(found).alias("files_found"), of("image").alias("images"), of("video").alias("videos"), F.count_if((kind != "unknown") & (F.col("size_bytes") < SMALLEST)).alias("too_small"), F.round(size / 1024**3, 4).alias("total_gb"), F.coalesce(F.round(size / F.nullif(F.count_if(found), F.lit(0)) / 1024**2, 4), F.lit(0.0)).alias("average_mb"))


#: Bytes of grey values, or of weights of rows, that are held at a time, and rows of a shrunken picture that are formed together.
STRIP, BAND = 16 << 20, 256


def grey(data: bytes, height: int, width: int, channels: int, first: int, last: int) -> np.ndarray:
    """Grey values of rows first to last of an image as Spark's image source gives it (blue, green, red)."""
    x = np.frombuffer(data, np.uint8, (last - first) * width * channels, first * width * channels).reshape(last - first, width, channels)
    return x[..., 0].astype(np.float64) if channels == 1 else x[..., 0] * 0.114 + x[..., 1] * 0.587 + x[..., 2] * 0.299


def row_weights(n: int, side: int, first: int, last: int, low: int, high: int) -> np.ndarray:
    """How much of each of the target rows first to last, of `side`, lies in the rows low to high of n, as shares of a target row."""
    edges, rows = np.arange(first, last + 1) * n / side, np.arange(low, high)
    return np.maximum(0, np.minimum(edges[1:, None], rows + 1) - np.maximum(edges[:-1, None], rows)) * side / n


def across(x: np.ndarray, side: int) -> np.ndarray:
    """Area means of columns: every target column averages what it covers, by differences of running sums."""
    n = x.shape[1]
    if n == side:
        return x
    edges = np.arange(side + 1) * n / side
    whole = np.minimum(edges.astype(np.int64), n - 1)
    sums = np.concatenate((np.zeros((len(x), 1)), np.cumsum(x, 1)), 1)
    at = sums[:, whole] + x[:, whole] * (edges - whole)
    return np.diff(at, axis=1) * side / n


def strips(data: bytes, height: int, width: int, channels: int, size: tuple[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, grey rows) of the picture shrunk to size (height, width) by area means, a few rows at a time; as it is if that is its size."""
    tall, wide = size
    if (tall, wide) == (height, width):
        part = max(1, STRIP // 8 // max(width, BAND))
        for y in range(0, height, part):
            yield y, grey(data, height, width, channels, y, min(height, y + part))
        return
    # A row of weights is as long as the strip, so strips are of few rows, and weights follow the picture's height, not its square.
    step = max(1, min(BAND, STRIP // 8 // max(1, -(-height // tall) * width)))
    for t in range(0, tall, step):
        end = min(tall, t + step)
        low, high = t * height // tall, min(height, -(-end * height // tall))
        # Target rows that are tall themselves are added up over parts of the strip.
        part, rows = max(1, STRIP // 8 // max(width, end - t)), np.zeros((end - t, wide))
        for y in range(low, high, part):
            z = min(high, y + part)
            rows += row_weights(height, tall, t, end, y, z) @ across(grey(data, height, width, channels, y, z), wide)
        yield t, rows


def small_picture(data: bytes, height: int, width: int, channels: int, size: tuple[int, int] | None = None, side: int = 32) -> np.ndarray:
    """Area means of side x side cells of the picture, after it is shrunk to size."""
    size, out = size or (height, width), np.zeros((side, side))
    for t, rows in strips(data, height, width, channels, size):
        out += row_weights(size[0], side, 0, side, t, t + len(rows)) @ across(rows, side)
    return out


def phash_of(small: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies of the 32 x 32 picture, in thousandths, are above their median. Those at the median are not."""
    k, n = np.arange(8)[:, None], np.arange(32)
    basis = np.cos(np.pi * k * (2 * n + 1) / 64)
    low = np.floor(basis @ small @ basis.T * 1000 + 0.5)
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def phash64(images: DataFrame, *, most: int = MAX_PIXELS, shrink: bool = False) -> DataFrame:
    """path, phash of read_images' rows. Pictures of more pixels have none; with shrink they are shrunk to `most` (cap_to_pixels) before they are hashed. Unreadable ones have none.

    A task holds a batch of pictures' bytes (spark.sql.execution.arrow.maxBytesPerBatch, or one picture) and STRIP bytes of grey values, whatever the pictures' size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = zip(*(batch[c].to_pylist() for c in ("height", "width", "nChannels", "th", "tw")))
            # Pixels are read where they lie in the batch; paths are copied, so that what is handed on doesn't keep it.
            hashes = [phash_of(small_picture(d.as_buffer(), h, w, c, (th, tw))) if (w or 0) > 0 and (h or 0) > 0 else None for d, (h, w, c, th, tw) in zip(batch["data"], sizes)]
            paths = batch["path"].to_pylist()
            del batch
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(hashes, pa.string())], ["path", "phash"])

    size = cap_to_pixels(F.col("image.width"), F.col("image.height"), most)
    rows = images.select("path", "image.data", "image.height", "image.width", "image.nChannels", "pixels", size["height"].alias("th"), size["width"].alias("tw"))
    take = rows if shrink else rows.where(F.col("pixels") <= most)
    hashed = take.drop("pixels").mapInArrow(run, "path string, phash string")
    return hashed if shrink else hashed.unionByName(rows.where(F.col("pixels") > most).select("path", F.lit(None).cast("string").alias("phash")))
