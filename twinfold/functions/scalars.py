"""Scalar functions of a catalogue, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of media files, limits in bytes, and the name patterns of presets.
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp", ".heic")
VIDEOS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".mpeg", ".mpg")
PRESET_IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif", "raw", "cr2", "nef", "arw", "orf", "rw2", "dng", "psd")
PRESET_VIDEOS = ("mp4", "mov", "avi", "mkv", "wmv", "m4v", "webm", "hevc", "mts", "m2ts", "3gp", "flv", "mpeg", "mpg")
SMALLEST, LARGE, MAX_PIXELS, THRESHOLD = 1024, 500 * 1024 * 1024, 24_000_000, 5


def filename(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(F.coalesce(last, F.lit("")) == "", "Unknown").otherwise(last)


def suffix(path: Column) -> Column:
    """Last extension, lower-cased; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1))


def filesize(size: Column, *, always_decimal: bool = False) -> Column:
    """Bytes for people, in steps of 1024 up to TB."""
    n = size.cast("double")
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        x = n / F.lit(float(1024**k))
        text = F.format_string(f"%.1f {unit}", F.bround(x, 1))
        if not always_decimal:
            text = F.when(x == F.floor(x), F.format_string(f"%d {unit}", x.cast("long"))).otherwise(text)
        out = text if k == 4 else F.when(n < float(1024 ** (k + 1)), text).otherwise(out)
    return F.when(F.coalesce(size, F.lit(0)) == 0, "0 B").otherwise(out)


def megapixels(width: Column, height: Column) -> Column:
    return F.when((F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0), F.format_string("%.1f MP", width.cast("long") * height / 1e6)).otherwise("Unknown")


def dimensions(width: Column, height: Column) -> Column:
    return F.when((width != 0) & (height != 0), F.concat(width.cast("string"), F.lit("x"), height.cast("string")))


def complete_path(mount: Column, path: Column) -> Column:
    return F.when(F.coalesce(mount, F.lit("")) == "", path).otherwise(F.concat(F.regexp_replace(mount, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", "")))


def resolved_path(mount: Column, path: Column) -> Column:
    """As a path join: an absolute path takes the mount's place."""
    whole = F.concat(F.regexp_replace(mount, "/+$", ""), F.lit("/"), path)
    return F.when(path.startswith("/") | (F.coalesce(mount, F.lit("")) == ""), path).otherwise(whole)


def parse_size(text: Column) -> Column:
    """Bytes of `10K`, `1.5M`, `2G` or a whole number, in steps of 1024; NULL for anything else."""
    clean = F.lower(F.trim(text))
    times = F.when(clean.endswith("k"), 1024.0).when(clean.endswith("m"), 1024.0**2).when(clean.endswith("g"), 1024.0**3)
    return F.when(clean.rlike("^[0-9]*[.]?[0-9]+[kmg]$"), F.floor(F.regexp_replace(clean, "[kmg]$", "").try_cast("double") * times)).otherwise(clean.try_cast("long"))


def scan_id(source: Column, at: Column) -> Column:
    return F.concat(F.lit("scan_"), F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(F.md5(source.cast("binary")), 1, 8))


def utc_iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def size_mb(size: Column) -> Column:
    return F.format_string("%.1f", F.bround(size / F.lit(1048576.0), 1))


def short_source(text: Column) -> Column:
    return F.when(F.length(text) > 37, F.concat(F.lit("..."), F.substring(text, -34, 34))).otherwise(text)


def name_prefix(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def media_type(path: Column, *, unknown: bool = False) -> Column:
    kind = F.when(suffix(path).isin(*IMAGES), "image")
    return kind.when(suffix(path).isin(*VIDEOS), "video").otherwise("unknown") if unknown else kind.otherwise("video")


def pixels(width: Column, height: Column) -> Column:
    return F.coalesce(width, F.lit(0)).cast("long") * F.coalesce(height, F.lit(0)).cast("long")


def cap_to_pixels(width: Column, height: Column, most: int = MAX_PIXELS) -> Column:
    """(width, height) shrunk in proportion to at most this many pixels, one at least."""
    scale = F.sqrt(F.lit(float(most)) / pixels(width, height))
    fit = lambda side: F.greatest(F.lit(1), F.floor(side * scale).cast("int"))
    small = pixels(width, height) <= most
    return F.struct(F.when(small, width).otherwise(fit(width)).alias("width"), F.when(small, height).otherwise(fit(height)).alias("height"))


def is_large(size: Column, *, limit: int = LARGE, inclusive: bool = False) -> Column:
    return (size >= limit) if inclusive else (size > limit)


def like(path: Column, pattern: str) -> Column:
    """LIKE that folds A-Z only and has no escape sign: a backslash in the pattern is a backslash."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    folded = pattern.translate(str.maketrans(upper, lower)).replace("\\", "\\\\")
    return F.translate(path, upper, lower).like(folded)
