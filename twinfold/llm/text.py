"""Word rules shared by the training-data operators, as Spark columns and as numpy code for tasks."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; lower() is the quick way where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and any character beyond ASCII, lower-cased; null has none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Hand freed memory back to the system: Python workers wait for their next task, and what they keep counts against the executor."""
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(2 * n + 64, _STEP, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def space_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words of UTF-8 texts between bytes 20 and 09-0D, A-Z lower-cased.

    Returns a 64-bit hash of each word of all texts in order, and the number of words of each text.
    """
    data = np.frombuffer(b" ".join(texts).translate(LOWER_TABLE) + b" ", np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(data) and not gap[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[0::2], edge[1::2]
    sizes = last - first
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    counts = np.diff(np.searchsorted(first, ends), prepend=0)
    if not len(first):
        return np.empty(0, np.uint64), counts
    weights, hashes = powers(int(sizes.max()) + 1), np.empty(len(first), np.uint64)
    # A megabyte at a time, since each byte takes 8 while it is hashed.
    cuts = np.unique(np.concatenate((np.searchsorted(first, np.arange(0, len(data), 1 << 20)), [len(first)])))
    for i, j in zip(cuts[:-1], cuts[1:]):
        at = np.flatnonzero(~gap[first[i] : last[j - 1]]) + first[i]
        value = _BYTE[data[at]] * weights[at - np.repeat(first[i:j], sizes[i:j])]
        hashes[i:j] = np.add.reduceat(value, np.cumsum(sizes[i:j]) - sizes[i:j])
    return mix(hashes), counts
