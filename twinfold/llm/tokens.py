"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file is a Parquet table of blocks. A block holds whole documents in order: `docs` (ids), `unnamed` (places of
documents without an id), `counts` (tokens of each), `control` and `data`. Every token id is replaced by its rank, the most frequent id having rank 0. `control` has two bits
per rank, four ranks to a byte, lowest bits first: the number of bytes less one. `data` has those bytes, lowest first.
Beside it lies the table of ranks. Blocks go by (`shard`, `run`, `before`): a run is a stretch of a shard that one task has
packed, and begins with the shard's row number `run`; `before` counts the tokens of the run's earlier blocks.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property
from types import ModuleType
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, partitions, remove
from .text import give_back

#: Tokens after which a block ends; a longer document has a block to itself.
BLOCK = 1 << 19
#: Code points whose pieces are hashed at once, about.
SIGNS = 1 << 19
#: Of an encoder that goes with its task and of one that its worker keeps: known pieces (some 200 bytes each), the code points that are encoded at once (a longer
#: text goes alone), and the bytes of texts that become Python objects together.
BRIEF, BRIEF_SIGNS, BRIEF_SLICE = 60_000, 1 << 17, 1 << 19
LASTING, LASTING_SIGNS, LASTING_SLICE = 1_000_000, 1 << 21, 4 << 20
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
SIZES = (_CODES + 1).astype(np.uint8)  # bytes of the four ranks of each control byte
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
STORED = "shard string, seq long, doc_id long, named boolean, ids binary, seen array<int>, times array<long>"
BLOCKS = "shard string, run long, before long, docs array<long>, unnamed array<int>, counts array<long>, control binary, data binary"

# Kinds of signs to the byte-level pre-tokeniser, and the ends it takes off at an apostrophe.
SPACE, LETTER, DIGIT, OTHER, ODD = range(5)
ENDS = ("s", "t", "m", "d", "re", "ve", "ll")
TABLE = 1 << 17
_RNG = np.random.default_rng(20240301)
_SIGN = _RNG.integers(1, 2**63, TABLE, dtype=np.int64).astype(np.uint64)
_STEP = 0xD1342543DE82EF95


def kinds() -> np.ndarray:
    """The kind of each code point below TABLE. ODD ones are those that Python and the library see differently: numbers that aren't digits, 1C-1F, and what isn't assigned in Python's tables."""

    def kind(c: str) -> int:
        if c.isspace():
            return ODD if "\x1c" <= c <= "\x1f" else SPACE
        if c.isalnum():
            return LETTER if c.isalpha() else DIGIT if c.isdecimal() else ODD
        return ODD if category(c) == "Cn" else OTHER

    return np.fromiter(map(kind, map(chr, range(TABLE))), np.uint8, TABLE)


class Encoder:
    """Encodes texts with the tokenizers library.

    Texts are cut into the pre-tokeniser's pieces, and each new piece is encoded by the library once. Equal pieces of a batch
    are found by a 64-bit hash (two that differ agree in 1 of 10**9 batches or fewer), and each distinct one is looked up by
    its signs. Texts with ODD signs or a special token go to the library whole, as do all texts if the tokenizer is of another kind.
    """

    def __init__(self, path: str, keep: int = BRIEF, signs: int = BRIEF_SIGNS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.keep, self.signs, self.known, self.older = path, keep, signs, {}, {}
        tokenizer = Tokenizer.from_file(path)
        about = json.loads(tokenizer.to_str())
        self.special = [t["content"] for t in about["added_tokens"]]
        self.code = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        before, model = about["pre_tokenizer"] or {}, about["model"]
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_pieces = about["normalizer"] is None and all(about[k] is None for k in ("truncation", "padding")) and {k: before.get(k) for k in usual} == usual and model["type"] == "BPE" and not model["dropout"]
        if self.by_pieces:
            self.kinds = kinds()
            del tokenizer  # two at a time would take twice the memory; the other is read again if a text asks for it
            self.bare = Tokenizer.from_str(json.dumps(about | {"pre_tokenizer": before | {"use_regex": False}, "post_processor": None}))
        del about, before, model
        give_back()  # what was read takes more than what is kept

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        distinct = [t for t in dict.fromkeys(texts) if t]
        part = np.cumsum([len(t) for t in distinct]) // self.signs
        found: dict[str, bytes] = {}
        for k in np.unique(part):
            some = distinct[np.searchsorted(part, k) : np.searchsorted(part, k, "right")]
            found.update(zip(some, self.encode(some) if self.by_pieces else self.whole(some)))
        return [found.get(t, b"") for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        signs = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        first = np.cumsum([0] + [len(t) for t in texts])
        kind = self.kinds[np.minimum(signs, TABLE - 1)]
        kind[signs >= TABLE] = ODD
        strange = np.add.reduceat(kind == ODD, first[:-1]) > 0
        strange |= np.array([any(s in t for s in self.special) for t in texts])
        if strange.any():
            whole, rest = ([t for t, s in zip(texts, strange) if s == x] for x in (True, False))
            found = dict(zip(whole, self.whole(whole))) | (dict(zip(rest, self.encode(rest))) if rest else {})
            return [found[t] for t in texts]
        starts = piece_starts(signs, kind, first)
        ends = np.append(starts[1:], first[-1])
        codes, values = pd.factorize(piece_hashes(signs, starts, ends))
        some = np.empty(len(values), np.int64)
        some[codes[::-1]] = np.arange(len(codes))[::-1]
        text = "".join(texts)
        ids = self.look_up([text[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist())])
        flat, sizes = np.frombuffer(b"".join(ids), self.kind), np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        n = sizes[codes]
        out = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        cut = np.append(0, np.cumsum(np.add.reduceat(n, np.searchsorted(starts, first[:-1])))) * self.kind.itemsize
        return [out[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Of about `keep` known pieces the older half is dropped at a time, but for those met again meanwhile."""
        if len(self.known) > self.keep // 2:
            self.known, self.older = {}, self.known
        ids, new = list(map(self.known.get, pieces)), []
        for p in [p for p, x in zip(pieces, ids) if x is None]:
            if (x := self.older.get(p)) is None:
                new.append(p)
            else:
                self.known[p] = x
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            e = self.bare.encode(part, is_pretokenized=True, add_special_tokens=False)
            every, ends = array(self.code, e.ids).tobytes(), np.searchsorted(np.array(e.word_ids), np.arange(len(part)), "right") * self.kind.itemsize
            self.known.update(zip(part, (every[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist()))))
        return [self.known[p] if x is None else x for p, x in zip(pieces, ids)]


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which it keeps from task to task with the pieces that it knows."""
    held = sys.modules.setdefault("twinfold_worker", ModuleType("twinfold_worker")).__dict__.setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path, LASTING, LASTING_SIGNS)
    return held[path]


def piece_starts(signs: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin; `first` has the starts of texts and their common end.

    A piece is a run of one kind with a space before it, or white space but for the last sign before another kind, which is that space or stands alone. At a
    run of other signs without a space before it, an apostrophe and one of ENDS are a piece.
    """
    n = len(signs)
    start, gap = np.empty(n + 3, bool), kind == SPACE
    start[1:n] = kind[1:] != kind[:-1]
    start[first[:-1]] = True
    start[n:] = True
    new_text = np.zeros(n + 1, bool)
    new_text[first] = True
    led = np.flatnonzero((signs[:-1] == 32) & ~gap[1:] & ~new_text[1:-1]) + 1
    start[led] = False
    start[np.flatnonzero(gap[:-1] & ~gap[1:] & ~new_text[1:-1])] = True
    quotes = np.flatnonzero((signs == 39) & start[:n])
    left = first[np.searchsorted(first, quotes, "right")] - quotes - 1  # signs behind it in its text
    ahead = np.append(signs, np.zeros(2, np.uint32))
    for end in ENDS:
        here = (left >= len(end)) & np.logical_and.reduce([ahead[quotes + 1 + i] == ord(c) for i, c in enumerate(end)])
        at = quotes[here]
        start[at + 1] = False
        start[at + 1 + len(end)] = True
    return np.flatnonzero(start[:n])


def piece_hashes(signs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, by differences of running sums, about SIGNS signs at a time."""
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(signs), SIGNS)), len(starts)))
    for i, j in zip(cuts[:-1], cuts[1:]):
        a, b = starts[i], ends[j - 1]
        up, down = powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_SIGN[signs[a:b]] * up[: b - a], out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a]
    return out


_UP = _DOWN = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    global _UP, _DOWN
    if len(_UP) < n:
        both = [np.full(n, x, np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64))]
        for x in both:
            x[0] = 1
        _UP, _DOWN = (np.multiply.accumulate(x) for x in both)
    return _UP, _DOWN


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks below 2**32."""
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    most = int(sizes.max(initial=1))
    octets = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :most]
    return control.tobytes(), octets[np.arange(most, dtype=np.uint8) < sizes[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n ranks, by looking control bytes up in a table of sizes."""
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    octets = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    value = octets[at]
    for k in range(1, int(sizes.max(initial=1))):
        value = value | octets[at + k] << np.uint32(8 * k)
    return value & _MASKS[sizes]


def named(doc: str, text: str) -> list[Column]:
    """Ids without nulls, which would make them floating numbers in a task, and whether there is one."""
    return [F.coalesce(F.col(doc).cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col(doc).isNotNull().alias("named"), F.col(text).alias("text")]


def file_order(docs: DataFrame, *, doc="doc_id", text="text") -> DataFrame:
    """doc_id, named, text, shard, seq of a table read from Parquet: the name of the row's file and its place there, so that (shard, seq) is the order in which the table was written."""
    name = F.col("_metadata.file_name")
    number = F.lpad(F.regexp_extract(name, r"^part-(\d+)", 1), 20, "0")
    return docs.select(*named(doc, text), F.concat(number, F.lit(" "), name).alias("shard"), F.col("_metadata.row_index").alias("seq"))


def by_id(docs: DataFrame, *, doc="doc_id", text="text") -> DataFrame:
    """doc_id, named, text, shard, seq in ascending order of ids, dealt to tasks by range; rows without an id first, rows of one id by a hash of their text."""
    rows = docs.select(*named(doc, text)).withColumn("tie", F.xxhash64("text"))
    order = ["named", "doc_id", "tie"]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    return dealt.select("doc_id", "named", "text", F.lpad(F.spark_partition_id().cast("string"), 20, "0").alias("shard"), F.lit(-1).cast("long").alias("seq"))


def write_tokens(rows: DataFrame, path: str, tokenizer: str, *, end: int | None = 0, block: int = BLOCK, lasting: bool = False) -> None:
    """Encode whole texts (null: empty) of by_id's or file_order's rows, in their order, and write blocks at path/blocks and ranks at path/ranks.

    Each row is one document; `end` closes it. lasting: whether Python workers keep their encoders (some 400 MB each) for later tasks, which is quicker. Rows are encoded where they stand and packed when the ranks are known; the unpacked ids are deleted then.
    """
    spark = rows.sparkSession
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if vocabulary <= 1 << 16 else 4
    stored = new_path(spark, "ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, times, seq = (worker_encoder if lasting else Encoder)(tokenizer), np.zeros(vocabulary, np.int64), 0
        together = LASTING_SLICE if lasting else BRIEF_SLICE
        tail = b"" if end is None else np.array([end], f"<u{width}").tobytes()
        kinds = pa.schema([("shard", pa.string()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("named", pa.bool_()), ("ids", pa.binary()), ("seen", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])
        for batch in batches:
            # Texts become Python objects about so many bytes at a time.
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) // together
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for part in (batch.slice(i, j - i) for i, j in zip(cuts, cuts[1:])):
                ids = [x + tail for x in encoder([t or "" for t in part.column("text").to_pylist()])]
                times += np.bincount(np.frombuffer(b"".join(ids), f"<u{width}"), minlength=vocabulary)
                n, place = part.num_rows, part.column("seq").to_numpy()
                place = np.where(place < 0, np.arange(seq, seq + n), place)
                yield pa.RecordBatch.from_arrays([part.column("shard"), pa.array(place, pa.int64()), part.column("doc_id"), part.column("named"), pa.array(ids, pa.binary()), pa.nulls(n, kinds.field("seen").type), pa.nulls(n, kinds.field("times").type)], schema=kinds)
                seq += n
                if not lasting:
                    give_back()
        del encoder
        give_back()
        seen = np.flatnonzero(times)
        yield pa.RecordBatch.from_pydict({"shard": [None], "seq": [-1], "doc_id": [0], "named": [False], "ids": [None], "seen": [seen.tolist()], "times": [times[seen].tolist()]}, schema=kinds)

    rows.select("shard", "seq", "doc_id", "named", "text").mapInArrow(encode, STORED).write.option("compression", "zstd").parquet(stored)
    ids = spark.read.schema(STORED).parquet(stored)
    # One row for each id of the vocabulary at most.
    each = ids.where("seen is not null").select(F.explode(F.arrays_zip("seen", "times")).alias("x")).groupBy("x.seen").agg(F.sum("x.times").alias("n"))
    number = np.zeros(vocabulary, np.int64)
    for i, n in each.collect():
        number[i] = n
    order = np.lexsort((np.arange(vocabulary), -number))
    rank = np.empty(vocabulary, np.uint32)
    rank[order] = np.arange(vocabulary)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(vocabulary), "id": order, "n": number[order]})).coalesce(1).write.parquet(f"{path}/ranks")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, before, last, names, held, n = None, 0, None, [], [], 0

        def close() -> pd.DataFrame:
            control, data = pack(rank[np.frombuffer(b"".join(held), f"<u{width}")])
            return pd.DataFrame({"shard": [run[0]], "run": [run[1]], "before": [before], "docs": [[d for d, _ in names]], "unnamed": [[i for i, (_, there) in enumerate(names) if not there]], "counts": [[len(x) // width for x in held]], "control": [control], "data": [data]})

        for pdf in batches:
            for shard, seq, d, there, x in zip(pdf["shard"], pdf["seq"].tolist(), pdf["doc_id"].tolist(), pdf["named"], pdf["ids"]):
                follows = last == (shard, seq - 1)
                if held and (n >= block or not follows):
                    yield close()
                    before, names, held, n = before + n, [], [], 0
                if not follows:
                    run, before = (shard, seq), 0
                names.append((d, there))
                held.append(x)
                n, last = n + len(x) // width, (shard, seq)
        if held:
            yield close()

    ids.where("seq >= 0").select("shard", "seq", "doc_id", "named", "ids").mapInPandas(write, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    remove(spark, stored)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written files in their order: doc_id, start (tokens before), n_tokens, ids (binary, little-endian, 4 bytes each), ids_crc32."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    length = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    # One row for each run, that is for each stretch of a file that one task has packed.
    ends = sorted(tuple(r) for r in blocks.groupBy("shard", "run").agg(F.max(F.col("before") + length).alias("n")).collect())
    start, starts = 0, {}
    for shard, run, n in ends:
        starts[shard, run], start = start, start + n
    order = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()], np.uint32)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                counts = np.asarray(b.counts, np.int64)
                ends = np.cumsum(counts)
                ids = order[unpack(b.control, b.data, int(ends[-1]))].astype("<u4")
                parts = [ids[e - c : e].tobytes() for c, e in zip(counts, ends)]
                first = starts[b.shard, b.run] + b.before
                docs = pd.array(np.asarray(b.docs, np.int64), "Int64")
                docs[np.asarray(b.unnamed, np.int64)] = pd.NA
                yield pd.DataFrame({"doc_id": docs, "start": first + ends - counts, "n_tokens": counts, "ids": parts, "ids_crc32": [zlib.crc32(p) for p in parts]})

    return blocks.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def token_files(rows: DataFrame, *, lasting: bool = False) -> DataFrame:
    """Write the token files of by_id's or file_order's rows to the shared folder and describe each document as read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = new_path(rows.sparkSession, "tokens")
    write_tokens(rows, path, public_tokenizers.path("byte_bpe_50k.json"), lasting=lasting)
    return read_tokens(rows.sparkSession, path).drop("ids")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in ascending order of doc_id: doc_id, start, n_tokens, ids_crc32 as read back from the files. Null texts are empty; empty tables give no rows."""
    return token_files(by_id(spark.read.parquet(f"{sf_dir}/documents.parquet")), lasting=True)
