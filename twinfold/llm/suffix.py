"""Repeated passages by suffix arrays: bytes covered by a string of `length` bytes that also starts in a document with a smaller id.

Sending every byte's suffix to its place would move the corpus fifty times over, so the suffixes that can matter are found first. The
anchor of a window of `length` bytes is its smallest hash of GRAM consecutive bytes; equal windows have equal anchors,
and neighbouring windows share theirs, so a text has one anchor for about fourteen bytes.

1. Each task takes the anchors of a few megabytes of texts as sorted runs, cut by range; the runs of a range are merged by
   binary search, which tells the anchors that more than one document has.
2. Later copies of whole texts apart, texts are cut at these anchors into pieces: the windows that share the anchor, together. Equal pieces are one, with the smallest id that has it.
3. Pieces, in order of their anchors, are cut into shards. A shard's suffix array is made by Larsson and Sadakane's
   refinement, its common prefixes by Kasai's walk; suffixes with `length` bytes in common are one window, with the smallest id of its pieces.
   An anchor at the edge of a shard goes on in the next: its sorted windows leave the shard as a run, and such runs are
   merged by binary search, in as many parts as the anchor has shards.
4. Windows first seen in a smaller id cover bytes; documents that have some are read once more, to take these out.

A frequent anchor or passage is a row for each run or shard, not for each document, until step 4's join, which Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, partitions
from .text import mix, powers

LENGTH, GRAM = 50, 24
#: Windows in a piece, as many as bits of a number.
WINDOWS = 64
#: Bytes of texts whose anchors make one run, bytes looked at together, bytes of pieces in a shard, anchors in a range.
RUN, SLICE, SHARD, RANGE = 4 << 20, 1 << 18, 1 << 20, 1_000_000
#: Most documents whose names are broadcast, 16 bytes each, to pick them; more are picked by a shuffle.
MAX_BROADCAST = 1_000_000
NOBODY = (1 << 63) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM consecutive bytes."""
    whole, have, size, now = None, 0, 1, data.astype(np.uint64)
    for bit in range(GRAM.bit_length()):
        if GRAM >> bit & 1:
            if whole is None:
                whole, have = now, size
            else:
                n = min(len(whole), len(now) - have)
                whole, have = whole[:n] * powers(size + 1)[size] + now[have : have + n], have + size
        now = now[: len(now) - size] * powers(size + 1)[size] + now[size:]
        size *= 2
    return mix(whole)


def window_anchors(data: np.ndarray, length: int) -> np.ndarray:
    """The smallest hash in each `length` bytes."""
    low, size, wide = gram_hashes(data), 1, length - GRAM + 1
    while 2 * size <= wide:
        low, size = np.minimum(low[: len(low) - size], low[size:]), 2 * size
    return np.minimum(low[: len(low) - (wide - size)], low[wide - size :])


def anchor_runs(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of at most WINDOWS windows that share an anchor: index of the text, first window, number of windows, anchor, and where it starts in the bytes that come last."""

    def parts() -> Iterator[list[tuple[int, int, bytes]]]:
        held, n = [], 0
        for i, t in enumerate(texts):
            for at in range(0, max(1, len(t) - length + 1), SLICE) if len(t) >= length else ():
                piece = t[at : at + SLICE + length - 1] if len(t) > SLICE else t
                held.append((i, at, piece))
                n += len(piece)
                if n >= SLICE:
                    yield held
                    held, n = [], 0
        if held:
            yield held

    for held in parts():
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        sizes = np.array([len(p) for _, _, p in held], np.int64)
        first = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(held)), sizes - (length - 1))
        v = np.arange(len(part)) + part * (length - 1)  # windows that don't cross into the next text
        low = window_anchors(data, length)[v]
        start = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (part[1:] != part[:-1]))))
        n = np.diff(np.append(start, len(low)))
        times = -(-n // WINDOWS)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        start, n = np.repeat(start, times) + inner * WINDOWS, np.minimum(np.repeat(n, times) - inner * WINDOWS, WINDOWS)
        owner = np.array([i for i, _, _ in held], np.int64)[part[start]]
        shift = np.array([at for _, at, _ in held], np.int64) - first
        yield owner, v[start] + shift[part[start]], n, low[start], v[start], data


def bunches(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, about `size` bytes of `data` at a time, so that few texts become Python objects together."""
    bunch = np.cumsum(pc.binary_length(batch.column("data")).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(np.diff(bunch)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def merge_sorted(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted runs, each with arrays that go along, as one: two at a time, the places of the one's values in the other found by binary search."""
    while len(runs) > 1:
        out = []
        for a, b in zip(runs[::2], runs[1::2]):
            at = np.searchsorted(a[0], b[0], side="right") + np.arange(len(b[0]))
            there = np.zeros(len(a[0]) + len(b[0]), bool)
            there[at] = True
            both = [np.empty(len(there), x.dtype) for x in a]
            for z, x, y in zip(both, a, b):
                z[there], z[~there] = y, x
            out.append(tuple(both))
        runs = out + runs[len(runs) & ~1 :]
    return runs[0]


def range_cuts(parts: int, length: int) -> np.ndarray:
    """Hashes that cut anchors into `parts` ranges of about as many each.

    Anchors are minima and lie near 0: a gram with a share x of all hashes below its own is one, for windows of m + 1 grams, with the chance (1 - x)^m (1 + m x).
    """
    m, x = length - GRAM, np.linspace(0, 1, (1 << 16) + 1)
    below = 1 - (1 - x) ** (m + 1) - m * (1 - (1 - x) ** (m + 2)) / (m + 2)  # anchors up to x, by integration
    at = np.interp(np.arange(1, parts) / parts * below[-1], below, x)
    return np.minimum(at * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def packed(part: int, run: int, keys: np.ndarray, h: np.ndarray, owner: np.ndarray, many: np.ndarray, kind: int) -> tuple:
    used, at = np.unique(owner, return_inverse=True)
    return part, run, kind, h.tobytes(), at.astype(np.uint32).tobytes(), keys[used].tobytes(), np.packbits(many).tobytes()


RUNS = "part int, run long, kind int, h binary, owner binary, keys binary, many binary"


def sorted_runs(rows: DataFrame, length: int, parts: int) -> DataFrame:
    """Anchors of (key, data) by range: of RUN bytes of texts together each anchor once, with one document that has it, and whether others have it too.

    Rows of kind 1 hold anchors that several of these documents have, for all of them; they pass through the merge.
    """
    cuts = range_cuts(parts, length)

    def made(keys: list[int], texts: list[bytes], turn: int, name: int) -> pa.RecordBatch:
        found = [np.empty((2, 0), np.uint64)]
        for owner, _, _, h, _, _ in anchor_runs(texts, length):
            found.append(np.array([h, owner.astype(np.uint64)]))
        h, owner = np.concatenate(found, 1)
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])))[: len(h)]
        h, owner = h[new], owner[new].astype(np.int64)
        first = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
        many = ~np.concatenate((first[1:], [True]))[: len(h)]  # another document follows
        names, out = np.array(keys, np.int64), []
        again = many | ~first
        if again.any():
            out.append(packed(turn % parts, name, names, h[again], owner[again], many[again], 1))
        h, owner, many = h[first], owner[first], many[first]
        cut = np.searchsorted(h, cuts)
        for i, (a, b) in enumerate(zip([0, *cut], [*cut, len(h)])):
            if a < b:
                out.append(packed(i, name, names, h[a:b], owner[a:b], many[a:b], 0))
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds[i]) for i in range(7)], names=[c.split()[0] for c in RUNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        keys, texts, n, turn = [], [], 0, task
        for batch in batches:
            for part in bunches(batch, RUN // 4):
                keys += part.column("key").to_pylist()
                texts += part.column("data").to_pylist()
                n += sum(map(len, texts[len(texts) - part.num_rows :]))
                if n >= RUN:
                    yield made(keys, texts, turn, task << 32 | turn - task)
                    keys, texts, n, turn = [], [], 0, turn + 1
        if n:
            yield made(keys, texts, turn, task << 32 | turn - task)

    return rows.select("key", "data").mapInArrow(run, RUNS)


SHARED = "run long, keys binary, sizes binary, h binary"


def by_key(key: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, how many hashes each has, and the hashes, sorted by key."""
    order = np.lexsort((h, key))
    names, sizes = np.unique(key, return_counts=True)
    return names, sizes.astype(np.uint32), h[order]


def merge_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """SHARED: the anchors that other documents have too, of one range's runs; a row for each run, since a row for each document would be one for each of its ranges."""
    out, runs = [], []
    for kind, run, h, owner, keys, many in zip(pdf["kind"], pdf["run"].tolist(), pdf["h"], pdf["owner"], pdf["keys"], pdf["many"]):
        h, key = np.frombuffer(h, np.uint64), np.frombuffer(keys, np.int64)[np.frombuffer(owner, np.uint32)]
        if kind:
            out.append((run, *by_key(key, h)))
        else:
            runs.append((h, key, np.full(len(h), run), np.unpackbits(np.frombuffer(many, np.uint8), count=len(h)).astype(bool)))
    if runs:
        h, key, of, many = merge_sorted(runs)
        same = h[1:] == h[:-1]
        shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
        told = np.flatnonzero(shared & ~many)  # who has many was told above
        told = told[np.argsort(of[told], kind="stable")]
        cuts = np.flatnonzero(np.diff(of[told])) + 1
        out += [(int(of[at[0]]), *by_key(key[at], h[at])) for at in np.split(told, cuts) if len(at)]
    return pd.DataFrame([(run, *[x.tobytes() for x in some]) for run, *some in out], columns=[c.split()[0] for c in SHARED.split(", ")]).astype({"run": "int64"})


def join_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """key, h (binary): the shared anchors of each document of one run, from all ranges."""
    key = np.concatenate([np.repeat(np.frombuffer(k, np.int64), np.frombuffer(n, np.uint32)) for k, n in zip(pdf["keys"], pdf["sizes"])])
    names, sizes, h = by_key(key, np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["h"]]))
    return pd.DataFrame({"key": names, "h": [x.tobytes() for x in np.split(h, np.cumsum(sizes)[:-1])]})


_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
_BACK = np.uint64(pow(int(powers(2)[1]), -1, 1 << 64))


def span_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each stretch of bytes."""
    power, back = powers(len(data))[: len(data)], np.full(len(data) + 1, _BACK, np.uint64)
    back[0] = 1
    back, out = np.multiply.accumulate(back)[start], []
    for table in _BYTES:
        sums = np.concatenate(([np.uint64(0)], np.cumsum(table[data] * power, dtype=np.uint64)))
        out.append(mix((sums[end] - sums[start]) * back + (end - start).astype(np.uint64)).view(np.int64))
    return out


PIECE = "d1 long, d2 long, h long, key long, rank long, at long, n int, piece binary"


def cut_pieces(rows: DataFrame, length: int) -> DataFrame:
    """The pieces at shared anchors of rows (key, rank, data, hs: lists of anchors), each named by a 128-bit hash; where a task meets a piece again soon, its bytes are left out."""

    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bunches(batch, RUN):
                known = [np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in hs])) for hs in part.column("hs").to_pylist()]
                keys, ranks = part.column("key").to_numpy(), part.column("rank").to_numpy()
                for owner, at, n, h, start, buffer in anchor_runs(part.column("data").to_pylist(), length):
                    kept = []
                    for d in np.unique(owner).tolist():
                        a, b = np.searchsorted(owner, (d, d + 1))
                        hs = known[d]
                        kept.append(a + np.flatnonzero(hs[np.minimum(np.searchsorted(hs, h[a:b]), len(hs) - 1)] == h[a:b]))
                    keep = np.concatenate(kept)
                    if len(keep):
                        o, s, m = owner[keep], start[keep], n[keep]
                        d1, d2 = span_names(buffer, s, s + m + length - 1)
                        pieces, new = np.full(len(keep), None, object), np.unique(d1, return_index=True)[1]
                        pieces[new] = [buffer[x:y].tobytes() for x, y in zip(s[new].tolist(), (s + m + length - 1)[new].tolist())]
                        yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in (d1, d2, h[keep].view(np.int64), keys[o], ranks[o], at[keep], m.astype(np.int32))], pa.array(pieces, pa.binary())], names=names)

    return rows.select("key", "rank", "data", "hs").mapInArrow(run, PIECE)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson and Sadakane's refinement: suffixes are sorted by 8 bytes, then groups that are still equal by the rank of what follows twice as far each round."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64) + np.uint64(1)
    head = np.zeros(n, np.uint64)
    for i in range(7):  # seven letters of nine bits: an end comes before every byte
        head = head << np.uint64(9) | np.where(np.arange(n) + i < n, wide[i : n + i], np.uint64(0))
    order = np.argsort(head, kind="stable")
    new = np.concatenate(([True], head[order][1:] != head[order][:-1]))[:n]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    step = 7
    while True:
        size = np.diff(np.append(np.flatnonzero(new), n))
        at = np.flatnonzero(np.repeat(size, size) > 1)  # places of suffixes that aren't told apart yet
        if not len(at):
            return order
        p = order[at]
        after = np.where(p + step < n, rank[np.minimum(p + step, n - 1)] + 1, 0)
        key = rank[p] << 32 | after
        by = np.argsort(key, kind="stable")
        order[at], key = p[by], key[by]
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new[at] = fresh
        rank[p[by]] = np.maximum.accumulate(np.where(fresh, at, 0))
        step *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Kasai's walk: how many bytes, up to `most`, each suffix shares with the one before it in the order. The pieces are walked side by side, since a walk may begin anywhere; places between pieces stay 0."""
    n, place = len(data), np.empty(len(data), np.int64)
    place[order] = np.arange(n)
    wide = np.concatenate((data.astype(np.int16), np.arange(-1, -most - 2, -1).astype(np.int16)))
    out = np.zeros(n, np.int64)
    by = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by], sizes[by]
    same = np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -t, side="left"))  # pieces longer than t
        i = starts[:live] + t
        before = place[i] - 1
        j = order[np.maximum(before, 0)]
        h = np.where(before >= 0, np.maximum(same[:live] - 1, 0), 0)
        more = np.flatnonzero((before >= 0) & (h < most))
        while len(more):
            h_more, i_more, j_more = h[more], i[more], j[more]
            equal = (wide[np.minimum(i_more + h_more, n + most)] == wide[np.minimum(j_more + h_more, n + most)]) & (np.maximum(i_more, j_more) + h_more < n)
            more = more[equal]
            h[more] += 1
            more = more[h[more] < most]
        same[:live] = h
        out[place[i]] = h
    return out


def as_bits(piece: np.ndarray, at: np.ndarray, pieces: int) -> np.ndarray:
    """A number for each piece, with a bit for each window listed."""
    grid = np.zeros((pieces, WINDOWS), np.uint8)
    grid[piece, at] = 1
    return np.packbits(grid, axis=1, bitorder="little").view("<i8").ravel()


SHARDED = "d1 long, d2 long, first long, bits long, h long, shard string, windows binary, low binary, pieces binary, firsts binary, owner binary, at binary, of binary"
_NONE = (None,) * 9


def shard_windows(held: list[tuple], length: int, name: str) -> pd.DataFrame:
    """Of one shard's pieces (h, piece, first, d1, d2), in order of h: (d1, d2, first, bits) of pieces whose anchor is inside, a row of windows for the first and the last anchor.

    bits: the windows that a piece with a smaller first id has too. A row of windows: them, sorted, with the smallest first id of each; the pieces with
    their first ids; and for each window of a piece its owner, its place and its number in the row.
    """
    h = np.array([x[0] for x in held], np.int64)
    first = np.array([x[2] for x in held], np.int64)
    names = np.array([x[3:] for x in held], np.int64)
    sizes = np.array([len(x[1]) for x in held], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\xff".join(x[1] for x in held) + b"\xff", np.uint8)
    order = suffix_array(data)
    shared = common_prefixes(data, order, starts, sizes, length)
    piece = np.repeat(np.arange(len(held)), sizes + 1)
    at = np.arange(len(data)) - starts[piece]
    valid = np.flatnonzero(at[order] <= (sizes - length)[piece[order]])
    # Between two windows the suffixes share no more than the least of those that lie between.
    new = np.minimum.reduceat(shared[: valid[-1] + 1], np.concatenate(([0], valid[:-1] + 1))) < length
    new[:1] = True
    group = np.cumsum(new) - 1
    owner, place = piece[order[valid]], at[order[valid]]
    low = np.minimum.reduceat(first[owner], np.flatnonzero(new))
    hit = low[group] < first[owner]
    bits = as_bits(owner[hit], place[hit], len(held))
    edge = np.isin(h, [h[0], h[-1]])
    out = [(*held[i][3:], int(first[i]), int(bits[i]), *_NONE) for i in np.flatnonzero(~edge & (bits != 0)).tolist()]
    for anchor in dict.fromkeys((int(h[0]), int(h[-1]))):
        mine = np.flatnonzero(h == anchor)
        own = np.flatnonzero((owner >= mine[0]) & (owner <= mine[-1]))
        groups, of = np.unique(group[own], return_inverse=True)
        head = order[valid[np.flatnonzero(new)[groups]]]
        windows = b"".join(data[p : p + length].tobytes() for p in head.tolist())
        out.append((None, None, None, None, anchor, name, windows, low[groups].tobytes(), names[mine].tobytes(), first[mine].tobytes(), (owner[own] - mine[0]).astype(np.int32).tobytes(), place[own].astype(np.int32).tobytes(), of.astype(np.int32).tobytes()))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SHARDED.split(", ")], dtype=object).astype({c: "Int64" for c in ("d1", "d2", "first", "bits", "h")})


def sharded(pieces: DataFrame, length: int, shard: int) -> DataFrame:
    """shard_windows of pieces (h, piece, first, d1, d2), which partitions hold in order of h; a shard ends after `shard` bytes, in the middle of an anchor if need be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        held, n, turn = [], 0, 0
        for pdf in batches:
            for x in zip(pdf["h"].tolist(), pdf["piece"], pdf["first"].tolist(), pdf["d1"].tolist(), pdf["d2"].tolist()):
                held.append(x)
                n += len(x[1])
                if n >= shard:
                    yield shard_windows(held, length, f"{context.partitionId()}-{turn}")
                    held, n, turn = [], 0, turn + 1
        if held:
            yield shard_windows(held, length, f"{context.partitionId()}-{turn}")

    return pieces.mapInPandas(run, SHARDED)


def merged_edges(edges: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """d1, d2, bits of the pieces in rows of windows (sharded's), after the rows of an anchor are merged, in as many parts as there are."""
    sizes = edges.groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("parts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, shard, windows, low, parts in zip(pdf["h"].tolist(), pdf["shard"], pdf["windows"], pdf["low"], pdf["parts"].tolist()):
                w, low = np.frombuffer(windows, f"S{length}"), np.frombuffer(low, np.int64)
                part = (mix(w.view(np.uint8).reshape(-1, length).astype(np.uint64) @ powers(length)[:length]) % np.uint64(parts)).astype(np.int64)
                for p in range(parts):
                    own = np.flatnonzero(part == p)
                    if len(own):
                        yield pd.DataFrame({"h": [h], "part": [p], "shard": [shard], "windows": [w[own].tobytes()], "low": [low[own].tobytes()], "at": [own.astype(np.int32).tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [(np.frombuffer(w, f"S{length}"), np.frombuffer(x, np.int64), np.full(len(w) // length, i), np.frombuffer(at, np.int32)) for i, (w, x, at) in enumerate(zip(pdf["windows"], pdf["low"], pdf["at"]))]
        w, low, of, at = merge_sorted(runs)
        new = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        least = np.repeat(np.minimum.reduceat(low, new), np.diff(np.append(new, len(w))))
        return pd.DataFrame({"h": pdf["h"], "shard": pdf["shard"], "low": [least[of == i].tobytes() for i in range(len(pdf))], "at": [at[of == i].tobytes() for i in range(len(pdf))]})

    def finish(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pieces, firsts, owner, at, of, low in zip(rows["pieces"], rows["firsts"], rows["owner"], rows["at"], rows["of"], rows["low"]):
            low, first = np.frombuffer(low, np.int64).copy(), np.frombuffer(firsts, np.int64)
            for places, least in zip(found["at"], found["low"]):
                low[np.frombuffer(places, np.int32)] = np.frombuffer(least, np.int64)
            owner, at, of = (np.frombuffer(x, np.int32) for x in (owner, at, of))
            hit = low[of] < first[owner]
            bits = as_bits(owner[hit], at[hit], len(first))
            some = np.flatnonzero(bits)
            d1, d2 = np.frombuffer(pieces, np.int64).reshape(-1, 2)[some].T
            out.append(pd.DataFrame({"d1": d1, "d2": d2, "bits": bits[some]}))
        return pd.concat(out)

    slim = edges.select("h", "shard", "windows", "low").join(sizes, "h")
    parts = slim.mapInPandas(cut, "h long, part int, shard string, windows binary, low binary, at binary")
    least = parts.groupBy("h", "part").applyInPandas(merge, "h long, shard string, low binary, at binary")
    rows = edges.select("h", "shard", "low", "pieces", "firsts", "owner", "at", "of")
    return rows.groupBy("h", "shard").cogroup(least.groupBy("h", "shard")).applyInPandas(finish, "d1 long, d2 long, bits long")


def removed(data: bytes, at: np.ndarray, bits: np.ndarray, length: int) -> tuple[list[tuple[int, int]], bytes]:
    """Spans (start, end) that the windows `at` + each bit cover, and the bytes between them."""
    grid = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(grid)
    starts = np.unique(at[row] + bit)
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > starts[:-1] + length)))
    first, last = starts[new].tolist(), (starts[np.append(new[1:], len(starts)) - 1] + length).tolist()
    return list(zip(first, last)), b"".join(data[a:b] for a, b in zip([0, *last], [*first, len(data)]))


def few(names: DataFrame) -> DataFrame:
    return F.broadcast(names) if names.count() <= MAX_BROADCAST else names


def repeated_windows(rows: DataFrame, total: int, *, length: int = LENGTH, shard: int = SHARD, scratch: Scratch) -> DataFrame:
    """key, rank, hits (list of (at, bits)) of rows (key, rank, data; `total` bytes) with windows that a smaller rank has."""
    parts = max(partitions(rows.sparkSession), total // (14 * RANGE) + 1)
    runs = sorted_runs(rows.select("key", "data").where(F.octet_length("data") >= length), length, parts)
    shared = scratch.settle(runs.groupBy("part").applyInPandas(merge_ranges, SHARED).groupBy("run").applyInPandas(join_ranges, "key long, h binary"), "shared")
    texts = rows.join(few(shared.select("key").distinct()), "key", "left_semi").join(shared.groupBy("key").agg(F.collect_list("h").alias("hs")), "key")
    pieces = scratch.settle(cut_pieces(texts.select("key", "rank", "data", "hs"), length), "pieces")
    name = ["d1", "d2"]
    firsts = scratch.settle(pieces.groupBy(*name).agg(F.first("h").alias("h"), F.min("rank").alias("first")), "firsts")
    # An anchor with one piece has nothing to compare: its windows came first where the piece did.
    several = scratch.settle(firsts.join(firsts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h").select("h", "first", *name), "several")
    held = pieces.where("piece is not null").select(*name, "piece").join(several, name, "left_semi").dropDuplicates(name)
    work = scratch.settle(held.join(several, name).select("h", "piece", "first", *name), "work")
    size = work.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    order = work.repartitionByRange(max(partitions(rows.sparkSession), size // shard + 1), "h", *name).sortWithinPartitions("h", *name)
    shards = scratch.settle(sharded(order, length, shard), "shards")
    edges = shards.where("d1 is null").select("h", "shard", "windows", "low", "pieces", "firsts", "owner", "at", "of")
    bits = shards.where("d1 is not null").select(*name, "bits").unionByName(merged_edges(edges, length, scratch))
    facts = scratch.settle(firsts.select(*name, "first").join(bits, name, "left"), "facts")
    every = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), WINDOWS - F.col("n"))
    met = pieces.select(*name, "key", "rank", "at", "n").join(facts, name).withColumn("bits", F.when(F.col("rank") > F.col("first"), every).otherwise(F.coalesce("bits", F.lit(0).cast("long"))))
    return met.where("bits <> 0").groupBy("key", "rank").agg(F.collect_list(F.struct("at", "bits")).alias("hits"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, shard: int = SHARD, doc="doc_id", text="text") -> DataFrame:
    """row (all columns of docs as a struct, so that no name can clash), data (the text's bytes), spans (removed: start, end), kept (the bytes between them).

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id, on the input as it is. Null texts are empty; shorter ones
    lose nothing. Rows without an id come after all others and lose nothing to each other; nor do rows with the same id, equal or not. An empty table gives none.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    scratch = Scratch(docs.sparkSession)
    data, number = F.coalesce(docs[text].cast("binary"), F.lit(b"")), docs[doc].cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(number, data).alias("key"), F.coalesce(number, F.lit(NOBODY)).alias("rank"), data.alias("data"))
    # Later copies of a whole text go whole and tell nothing new, however many they are.
    slim = scratch.settle(rows.select("key", "rank", F.octet_length("data").alias("n"), F.unhex(F.md5("data")).alias("t")).where(F.col("n") >= length), "slim")
    copies = slim.groupBy("t").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    later = scratch.settle(slim.join(copies, "t").where(F.col("rank") > F.col("first")).select("key", "rank").distinct(), "copies")
    total = slim.agg(F.sum("n")).first()[0] or 0
    hits = scratch.settle(repeated_windows(rows.drop("row").join(few(later), ["key", "rank"], "left_anti"), total, length=length, shard=shard, scratch=scratch), "hits")
    known = scratch.settle(hits.select("key", "rank", F.lit(False).alias("whole")).unionByName(later.withColumn("whole", F.lit(True))), "known")
    scratch.clear(but=2)

    @F.pandas_udf("spans array<struct<start: long, end: long>>, kept binary")
    def taken(data: pd.Series, at: pd.Series, bits: pd.Series) -> pd.DataFrame:
        found = [removed(t, np.asarray(a, np.int64), np.asarray(b, np.int64), length) for t, a, b in zip(data, at, bits)]
        return pd.DataFrame({"spans": [[{"start": a, "end": b} for a, b in s] for s, _ in found], "kept": [k for _, k in found]})

    spans = "array<struct<start: long, end: long>>"
    same = rows.join(few(known), ["key", "rank"], "left").where("whole is null or whole")
    size = F.octet_length("data").cast("long")
    gone = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end"))).cast(spans)
    same = same.select("row", "data", F.when(F.col("whole"), gone).otherwise(F.array().cast(spans)).alias("spans"), F.when(F.col("whole"), F.lit(b"")).otherwise(F.col("data")).alias("kept"))
    hit = rows.join(few(known.where("not whole")), ["key", "rank"], "left_semi").join(hits, ["key", "rank"]).select("row", "data", taken("data", F.col("hits.at"), F.col("hits.bits")).alias("w"))
    return same.unionByName(hit.select("row", "data", "w.spans", "w.kept"))


def op11_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document after it lost what 50-byte strings of documents with smaller ids cover; see remove_repeats for nulls, ties and repeated rows."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    size, left = F.octet_length("data").cast("long"), F.octet_length("kept").cast("long")
    return out.select("row.doc_id", size.alias("n_bytes"), (size - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
