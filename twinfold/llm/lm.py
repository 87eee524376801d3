"""Language-model scores: a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Tokens are words and an end mark. A token's restaurant is that of the word before it (or of the document's start): each of
the OWN - 1 most frequent words has its own, and all other words share the rest of the LEAVES by hash. Restaurants share
parents: that of a restaurant is named by the one of the CONTEXTS - 1 most frequent words that comes most often before its own
words, or none. All parents share the root, and the root's base is uniform over the training words and one unknown word.

Everything a word has at all levels lies in one bucket, so its customers are reseated without other buckets: given the
restaurants' totals, words are independent. A sweep takes a dish's customers out of a restaurant and seats them again one
after another (beyond STEADY in growing batches) by the Chinese-restaurant rule, from the leaves to the root. Totals are
exchanged after every sweep: BURN sweeps, then KEEP more that start from the seats reached, whose predictive probabilities
are averaged. Sampling is seeded, so later stages run the same sweeps with the same totals again rather than store the
seats. The strength is fixed; the discounts of the three levels are read off the dishes of one and two customers after every sweep.
A history is a list of (totals, discounts), one before any sweep and one after each.

The HEAD most frequent words get a table of probabilities that every task holds; the other tokens are sent to their
word's bucket, where heavy buckets are held several times so that a task gets a bounded part of them. Both ways give the same
figures; HEAD only sets how much is sent.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import partitions, settle
from .text import space_words

HEAD, CONTEXTS = 1 << 6, 64
LEAVES, OWN = 1 << 17, 1 << 16
BURN, KEEP, STEADY = 2, 3, 64
STRENGTH = 0.1
END = np.uint64(0x5EED0FE7D0C5)
#: Training or scored tokens for which there is one bucket at least, and text bytes and tokens handled at once.
PER_BUCKET, BYTES, TOKENS = 4_000_000, 4 << 20, 2_500_000
LEVELS = LEAVES + CONTEXTS + 1  # restaurants: leaves, then parents, then the root


def pieces(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """Batches cut into runs of rows of about BYTES of text."""
    for pdf in batches:
        sizes = np.array([len(t) if isinstance(t, str) else 0 for t in pdf[column]])
        part = np.cumsum(sizes) // BYTES
        for _, rows in pdf.groupby(part, sort=True):
            yield rows


def tokenise(texts) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts in order, and each text's number of tokens (with its end)."""
    words, counts = space_words([t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts])
    n = counts + 1
    tokens = np.full(int(n.sum()), END, np.uint64)
    is_end = np.zeros(len(tokens), bool)
    is_end[np.cumsum(n) - 1] = True
    tokens[~is_end] = words
    return tokens, n


def slots(words: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The restaurant of the tokens after each word; own are the sorted words with one of their own."""
    shared = OWN + (words >> np.uint64(20)) % np.uint64(LEAVES - OWN)
    if not len(own):
        return shared.astype(np.uint32)
    at = np.minimum(np.searchsorted(own, words), len(own) - 1)
    return np.where(own[at] == words, at.astype(np.uint64) + np.uint64(1), shared).astype(np.uint32)


def catalogue(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words by bucket and word, the bucket of each, and each token's place among them."""
    words, place = np.unique(tokens, return_inverse=True)
    bucket = (words % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return words[order], bucket[order], rank[place]


def leaves(names: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leaf restaurant of each token, from the one that each token gives the next; 0 at the start of a document."""
    out = np.zeros(len(names), np.int64)
    out[1:] = names[:-1]
    out[np.cumsum(n) - n] = 0
    return out


def starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def squeeze(x: np.ndarray) -> bytes:
    """Numbers in few bytes: first bytes of all, then second bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze_runs(x: np.ndarray) -> bytes:
    """The same for numbers in runs: the distinct ones and the lengths of their runs."""
    at = starts(x)
    return squeeze(np.concatenate((x[at], np.diff(at, append=len(x)).astype(np.uint64))))


def unsqueeze_runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.split(unsqueeze(data, np.uint64), 2)


def word_counts(train: DataFrame) -> DataFrame:
    """w, n: occurrences of every token."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def close() -> pd.DataFrame:
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"w": w.view(np.int64), "n": n})

        for pdf in pieces(batches):
            held.append(tokenise(pdf["text"])[0])
            size += len(held[-1])
            if size >= TOKENS:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return train.select("text").mapInPandas(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


PACKED = "bucket int, w binary, leaf binary, n binary"


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, runs = unsqueeze_runs(row.w)
    return np.repeat(words, runs.astype(np.int64)), unsqueeze(row.leaf, np.uint32), unsqueeze(row.n, np.int64)


def seat_counts(train: DataFrame, own: np.ndarray, buckets: int) -> DataFrame:
    """One row per bucket: its words' counts in leaf restaurants, ordered by word and leaf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def close() -> pd.DataFrame:
            words, bucket, rank = catalogue(np.concatenate([t for t, _ in held]), buckets)
            key = np.sort(rank * LEAVES + leaves(slots(words, own)[rank], np.concatenate([n for _, n in held])))
            at = starts(key)
            n, (rank, leaf) = np.diff(at, append=len(key)), np.divmod(key[at], LEAVES)
            w, first = words[rank], starts(bucket[rank])
            rows = [(int(bucket[rank[i]]), squeeze_runs(w[i:j]), squeeze(leaf[i:j].astype(np.uint32)), squeeze(n[i:j])) for i, j in zip(first, [*first[1:], len(n)])]
            return pd.DataFrame(rows, columns=["bucket", "w", "leaf", "n"])

        for pdf in pieces(batches):
            held.append(tokenise(pdf["text"]))
            size += len(held[-1][0])
            if size >= TOKENS:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        w, leaf, n = (np.concatenate(x) for x in zip(*map(unpacked, pdf.itertuples(index=False))))
        words, place = np.unique(w, return_inverse=True)
        key = place * LEAVES + leaf
        order = np.argsort(key)
        key = key[order]
        at = starts(key)
        n, (place, leaf) = np.add.reduceat(n[order], at) if len(at) else n, np.divmod(key[at], LEAVES)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "w": [squeeze_runs(words[place])], "leaf": [squeeze(leaf.astype(np.uint32))], "n": [squeeze(n)]})

    # A number that is given keeps buckets from being put together in one task.
    return train.select("text").mapInPandas(run, PACKED).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(combine, PACKED)


def shared_parents(packed: DataFrame, own: np.ndarray, favourites: np.ndarray) -> np.ndarray:
    """The parent of each leaf restaurant: 1 + the place of the favourite most often before its words (ties: the first), 0 where none is."""
    code = np.zeros(LEAVES, np.int64)
    code[slots(favourites, own)] = np.arange(1, len(favourites) + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                w, leaf, n = unpacked(row)
                after = (code[leaf] > 0) & (w != END)
                key, at = np.unique(slots(w[after], own).astype(np.int64) * CONTEXTS + code[leaf[after]], return_inverse=True)
                yield pd.DataFrame({"leaf": key // CONTEXTS, "parent": key % CONTEXTS, "n": np.bincount(at, n[after], len(key)).astype(np.int64)})

    met = packed.mapInPandas(run, "leaf int, parent int, n long").groupBy("leaf", "parent").agg(F.sum("n").alias("n"))
    best = met.groupBy("leaf").agg(F.max(F.struct("n", (-F.col("parent")).alias("less"))).alias("best")).select("leaf", (-F.col("best.less")).alias("parent")).toPandas()  # LEAVES rows at most
    out = np.zeros(LEAVES, np.uint8)
    out[best["leaf"].to_numpy(np.int64)] = best["parent"].to_numpy(np.uint8)
    return out


class Seating:
    """The restaurants of one bucket's words."""

    def __init__(self, w: np.ndarray, leaf: np.ndarray, n: np.ndarray, parents: np.ndarray, vocabulary: int):
        new_word = np.concatenate(([True], w[1:] != w[:-1])) if len(w) else np.empty(0, bool)
        word, context = np.cumsum(new_word) - 1, parents[leaf].astype(np.int64)
        key = word * CONTEXTS + context
        order = np.argsort(key * LEAVES + leaf)
        self.n, self.leaf, self.base = n[order], leaf[order].astype(np.int64), 1 / (vocabulary + 1)
        new_parent = starts(key[order])
        self.words = w[new_word]
        self.parent_keys = key[order][new_parent]
        self.parent = np.repeat(np.arange(len(new_parent)), np.diff(new_parent, append=len(n)))  # of each leaf entry
        self.root, self.context = np.divmod(self.parent_keys, CONTEXTS)  # of each parent entry
        # Customers of one table a dish, and the leaf entries that can have more.
        self.single = [np.bincount(self.parent, minlength=len(self.root)), np.bincount(self.root, minlength=len(self.words))]
        self.several = np.flatnonzero(self.n > 1)
        self.tables = [np.ones(len(self.n), np.int64), np.ones(len(self.root), np.int64), np.ones(len(self.words), np.int64)]

    def customers(self) -> list[np.ndarray]:
        t, many = self.tables, self.several
        above = self.single[0] + np.bincount(self.parent[many], t[0][many] - 1, len(t[1])).astype(np.int64)
        return [self.n, above, np.bincount(self.root, t[1], len(t[2])).astype(np.int64)]

    def totals(self) -> np.ndarray:
        """Customers and tables of each restaurant (2 x LEVELS)."""
        at = (self.leaf, LEAVES + self.context, np.full(len(self.words), LEVELS - 1))
        return np.array([sum(np.bincount(a, x, LEVELS) for a, x in zip(at, level)) for level in (self.customers(), self.tables)]).astype(np.int64)

    def figures(self) -> np.ndarray:
        """The totals in a row, then the dishes of one and of two customers on each level."""
        return np.concatenate((self.totals().ravel(), [(c == k).sum() for k in (1, 2) for c in self.customers()]))

    def probabilities(self, totals: np.ndarray, discounts: np.ndarray) -> dict:
        """What the predictive probability of any word in any leaf is made of."""
        c, t = self.customers(), self.tables
        full = STRENGTH + totals[0]
        back = (STRENGTH + np.repeat(discounts, (LEAVES, CONTEXTS, 1)) * totals[1]) / full
        root = (c[2] - discounts[2] * t[2]) / full[-1] + back[-1] * self.base
        parent = (c[1] - discounts[1] * t[1]) / full[LEAVES + self.context]
        leaf = (c[0] - discounts[0] * t[0]) / full[self.leaf]
        return {"root": root, "parent": parent, "leaf": leaf, "to_root": back[LEAVES:-1], "to_parent": back[:LEAVES], "unknown": back[-1] * self.base}

    def sweep(self, totals: np.ndarray, discounts: np.ndarray, rng: np.random.Generator) -> None:
        """Reseat all customers, leaves first; totals are those of the stage before. A dish with one customer has one table."""
        _, c, top = self.customers()
        t, many, above = self.tables, self.several, self.parent[self.several]
        weight = STRENGTH + np.repeat(discounts, (LEAVES, CONTEXTS, 1)) * totals[1]
        full = STRENGTH + totals[0]
        root = (top - discounts[2] * t[2] + weight[-1] * self.base) / full[-1]
        at = LEAVES + self.context[above]
        parent = (c[above] - discounts[1] * t[1][above] + weight[at] * root[self.root[above]]) / full[at]
        t[0][many] = reseat(self.n[many], weight[self.leaf[many]] * parent, discounts[0], rng)
        t[1] = reseat(self.customers()[1], weight[LEAVES + self.context] * root[self.root], discounts[1], rng)
        t[2] = reseat(self.customers()[2], np.full(len(self.words), weight[-1] * self.base), discounts[2], rng)


def reseat(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after customers come in one by one; fresh: the weight of a new table that serves their dish."""
    several = np.flatnonzero(customers > 1)
    order = several[np.argsort(-customers[several], kind="stable")]
    c, a, t = customers[order], fresh[order], np.ones(len(order))
    k, top = 1, int(c[0]) if len(c) else 0
    while k < top:
        step = 1 if k < STEADY else k // 8
        m = int(np.searchsorted(-c, -k))  # those with more than k customers
        new = a[:m] / (a[:m] + k - discount * t[:m])
        t[:m] += rng.random(m) < new if step == 1 else rng.binomial(np.minimum(step, c[:m] - k), new)
        k += step
    out = np.ones(len(customers), np.int64)
    out[order] = t
    return out


def samples(row, parents: np.ndarray, vocabulary: int, history: list[tuple]) -> Iterator[Seating]:
    """The seating after each sweep, sweep i by history[i]; the same for the same arguments."""
    seats = Seating(*unpacked(row), parents, vocabulary)
    rng = np.random.default_rng((row.bucket, 12345))
    for totals, discounts in history:
        seats.sweep(totals, discounts, rng)
        yield seats


def kept_samples(row, parents: np.ndarray, vocabulary: int, history: list[tuple]) -> Iterator[tuple[Seating, dict]]:
    """The seatings after burn-in, each with its probabilities by the totals that belong to it."""
    for i, seats in enumerate(samples(row, parents, vocabulary, history[:-1])):
        if i >= BURN:
            yield seats, seats.probabilities(*history[i + 1])


def sealed(history: list[tuple]) -> bytes:
    """A history as tasks take it along: most totals are small or the same in all its entries."""
    return zlib.compress(pickle.dumps([(np.diff(totals, axis=0, prepend=0), discounts) for totals, discounts in history]), 1)


def opened(history: bytes) -> list[tuple]:
    return [(np.cumsum(totals, axis=0), discounts) for totals, discounts in pickle.loads(zlib.decompress(history))]


def gather(packed: DataFrame, parents: np.ndarray, vocabulary: int, history: list[tuple]) -> np.ndarray:
    """Figures of all buckets: those of one table a dish without a history, and what its sweeps have changed with one."""

    so_far = sealed(history)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        history, change = opened(so_far), np.zeros(2 * LEVELS + 6, np.int64)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                seats = Seating(*unpacked(row), parents, vocabulary)
                before = seats.figures() if history else 0
                for seats in samples(row, parents, vocabulary, history):
                    pass
                change += seats.figures() - before
        there = np.flatnonzero(change)
        yield pd.DataFrame({"k": there, "x": change[there]})

    # Two numbers a restaurant at most.
    rows = packed.mapInPandas(run, "k int, x long").groupBy("k").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(2 * LEVELS + 6, np.int64)
    out[rows["k"].to_numpy(np.int64)] = rows["x"].to_numpy(np.int64)
    return out


def settled(figures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals (2 x LEVELS) and the discounts of the three levels."""
    ones, twos = figures[-6:].reshape(2, 3)
    return figures[:-6].reshape(2, LEVELS), np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.95)


def head_table(packed: DataFrame, words: np.ndarray, parents: np.ndarray, vocabulary: int, history: list[tuple]) -> np.ndarray:
    """log10 of averaged probabilities (words x LEAVES); words are sorted."""
    so_far = sealed(history)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        history = opened(so_far)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                total = 0.0
                for seats, p in kept_samples(row, parents, vocabulary, history):
                    among = np.flatnonzero(np.isin(seats.words, words, assume_unique=True))
                    place = np.full(len(seats.words), -1)
                    place[among] = np.arange(len(among))
                    parent = p["to_root"] * p["root"][among][:, None]
                    here = place[seats.root]
                    parent[here[here >= 0], seats.context[here >= 0]] += p["parent"][here >= 0]
                    leaf = p["to_parent"] * parent[:, parents]
                    here = place[seats.root[seats.parent]]
                    leaf[here[here >= 0], seats.leaf[here >= 0]] += p["leaf"][here >= 0]
                    total = total + leaf
                table = np.log10(total / KEEP).astype(np.float32)
                yield pd.DataFrame({"w": [seats.words[among].tobytes()], "rows": [table.tobytes()]})

    out = np.zeros((len(words), LEAVES), np.float32)
    for found in packed.mapInPandas(run, "w binary, rows binary").collect():
        out[np.searchsorted(words, np.frombuffer(found["w"], np.uint64))] = np.frombuffer(found["rows"], np.float32).reshape(-1, LEAVES)
    return out


def locate(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of wanted keys in sorted keys, and len(keys) for others."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


class Judge:
    """Averaged probabilities and counts of any tokens of one bucket; row is None where the bucket has no training word."""

    def __init__(self, row, parents: np.ndarray, vocabulary: int, history: list[tuple]):
        if row is None:
            self.seats = Seating(np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64), parents, vocabulary)
            states = [self.seats.probabilities(*own) for own in history[BURN + 1 :]]
        else:
            states = []
            for self.seats, state in kept_samples(row, parents, vocabulary, history):
                states.append(state)
        s, self.parents = self.seats, parents
        # One more value at the end of each array is what a word, or a word in a restaurant, has that isn't there.
        self.states = [{**q, "root": np.append(q["root"], q["unknown"]), "parent": np.append(q["parent"], 0.0), "leaf": np.append(q["leaf"], 0.0)} for q in states]
        self.leaf_keys = s.parent_keys[s.parent] * LEAVES + s.leaf
        self.count = np.append(np.bincount(s.root[s.parent], s.n, len(s.words)), 0.0)

    def __call__(self, w: np.ndarray, runs: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """w: words, each for so many tokens as runs says."""
        word, context = np.repeat(locate(self.seats.words, w), runs), self.parents[leaf]
        key = word * CONTEXTS + context
        up, own = locate(self.seats.parent_keys, key), locate(self.leaf_keys, key * LEAVES + leaf)
        p = sum(q["to_parent"][leaf] * (q["to_root"][context] * q["root"][word] + q["parent"][up]) + q["leaf"][own] for q in self.states)
        return self.count[word], p / KEEP


SENT = "bucket int, copy int, chunk long, doc_id binary, known binary, base binary, score binary, w binary, leaf binary, doc binary"
PARTS = "chunk long, names binary, place binary, known binary, base binary, score binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_documents(docs: DataFrame, train: DataFrame, *, doc="doc_id", text="text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs, learning from the rows of train.

    Null texts are empty: one token, the end. Rows are told apart by their place, so equal and null ids do no harm. With
    nothing to learn from, every token has probability 1 under the base and the model.
    """
    spark = docs.sparkSession
    train = train.select(F.col(text).alias("text"))
    counts = settle(word_counts(train), "words")
    total, vocabulary = (x or 0 for x in counts.agg(F.sum("n"), F.count("w")).first())
    top = counts.orderBy(F.desc("n"), "w").limit(max(HEAD, OWN)).toPandas()
    by_count, n = top["w"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    frequent = by_count[by_count != END]
    own, favourites = np.sort(frequent[: OWN - 1]), np.sort(frequent[: CONTEXTS - 1])
    order = np.argsort(by_count[:HEAD])
    words, word_n = by_count[order], n[order]
    # Scored tokens meet their bucket too; a token has six bytes, about, with the space behind it.
    scored = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 6
    buckets = max(partitions(spark), total // PER_BUCKET, scored // PER_BUCKET)
    packed = settle(seat_counts(train, own, buckets), "seats")
    parents = shared_parents(packed, own, favourites)
    # Buckets are held once for every PER_BUCKET tokens that are expected there.
    bucket = F.pmod(F.pmod("w", F.lit(buckets)) + F.when(F.col("w") < 0, F.lit((1 << 64) % buckets)).otherwise(F.lit(0)), F.lit(buckets))
    rest = counts.where(~F.col("w").isin(words.view(np.int64).tolist())).groupBy(bucket.cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    heavy = rest.where(F.col("n") * F.lit(scored / max(1, total)) > PER_BUCKET).toPandas()
    copies = np.ones(buckets, np.int64)
    copies[heavy["bucket"].to_numpy(np.int64)] = np.ceil(heavy["n"].to_numpy(float) * scored / max(1, total) / PER_BUCKET).astype(np.int64)

    start = gather(packed, parents, vocabulary, [])
    history = [settled(start)]
    for _ in range(BURN + KEEP):
        history.append(settled(start + gather(packed, parents, vocabulary, history)))
    floor, so_far = total + 0.5 * (vocabulary + 1), sealed(history)
    shared = spark.sparkContext.broadcast((words, head_table(packed, words, parents, vocabulary, history), np.log10((word_n + 0.5) / floor)))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, table, base = shared.value
        turn = TaskContext.get().partitionId()
        chunk = turn << 32
        for pdf in pieces(batches):
            tokens, n = tokenise(pdf["text"])
            distinct, bucket, rank = catalogue(tokens, buckets)
            leaf, owner = leaves(slots(distinct, own)[rank], n), np.repeat(np.arange(len(n)), n)
            at = locate(heads, distinct)[rank]
            is_head = at < len(heads)
            whose, at, hl = owner[is_head], at[is_head], leaf[is_head]
            sums = [np.bincount(whose, x, len(n)) for x in (None, base[at], table[at, hl])]
            names = np.stack([1 - pdf["named"].to_numpy(np.int64), pdf["doc_id"].to_numpy(np.int64), n])
            out = [(int(turn % buckets), 0, chunk, names.tobytes(), sums[0].astype(np.int64).tobytes(), sums[1].tobytes(), sums[2].tobytes(), b"", b"", b"")]
            rest = np.flatnonzero(~is_head)
            rest = rest[np.argsort(rank[rest] * LEAVES + leaf[rest])]  # by bucket, and in order they pack better
            w, leaf, owner, bucket = distinct[rank[rest]], leaf[rest].astype(np.uint32), owner[rest].astype(np.int32), bucket[rank[rest]]
            first = starts(bucket)
            for b, i, j in zip(bucket[first], first, [*first[1:], len(rest)]):
                out.append((int(b), int(turn % copies[b]), chunk, b"", b"", b"", b"", squeeze_runs(w[i:j]), squeeze(leaf[i:j]), squeeze(owner[i:j])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")])
            chunk, turn = chunk + 1, turn + 1

    def score(sent: pd.DataFrame, seats: pd.DataFrame) -> pd.DataFrame:
        out, judge = [], None
        for r in sent.itertuples(index=False):
            if r.doc_id:
                out.append((r.chunk, r.doc_id, b"", r.known, r.base, r.score))
                continue
            judge = judge or Judge(next(seats.itertuples(index=False), None), parents, vocabulary, opened(so_far))
            w, runs = unsqueeze_runs(r.w)
            c, p = judge(w, runs.astype(np.int64), unsqueeze(r.leaf, np.uint32).astype(np.int64))
            place, at = np.unique(unsqueeze(r.doc, np.int32), return_inverse=True)
            sums = [np.bincount(at, x, len(place)) for x in (c > 0, np.log10((c + 0.5) / floor), np.log10(p))]
            out.append((r.chunk, b"", place.tobytes(), sums[0].astype(np.int64).tobytes(), sums[1].tobytes(), sums[2].tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of one chunk's documents, from their head and tail sums."""
        null, ids, size = np.frombuffer(next(x for x in pdf["names"] if x), np.int64).reshape(3, -1)
        sums = [np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))]
        for r in pdf.itertuples(index=False):
            place = np.arange(len(ids)) if r.names else np.frombuffer(r.place, np.int32)
            for total, x, kind in zip(sums, (r.known, r.base, r.score), (np.int64, np.float64, np.float64)):
                total[place] += np.frombuffer(x, kind)
        names = pd.array(ids, "Int64")
        names[null.astype(bool)] = pd.NA
        return pd.DataFrame({"doc_id": names, "n_tokens": size, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    # A column with nulls would come as floating numbers.
    named = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col(doc).isNotNull().alias("named"), F.col(text).alias("text"))
    sent = named.mapInPandas(send, SENT)
    if len(heavy):
        lots = packed.join(F.broadcast(spark.createDataFrame([(int(b), int(copies[b])) for b in heavy["bucket"]], "bucket int, copies int")), "bucket", "left")
        lots = lots.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    else:
        lots = packed.withColumn("copy", F.lit(0))
    parts = sent.groupBy("bucket", "copy").cogroup(lots.groupBy("bucket", "copy")).applyInPandas(score, PARTS)
    whole = parts.groupBy("chunk").applyInPandas(merge, SCORED)
    return whole.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc) -> F.col:
    """Whether an id is in the held-out fold; a null id is in none, and isn't learned from."""
    return F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(5)) == 1


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those outside the held-out fold; null texts are empty, an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_documents(docs, docs.where(~held_out(F.col("doc_id"))))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
