"""Spelling variants against plain comparison of all words."""

import random
import zlib

from twinfold.llm import variants

SCHEMA = "doc_id long, text string, word int, key int"


def edits(a, b):
    """Whether one inserted, deleted or replaced code point tells them apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def plain(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, o) for o, m in counts.items() if edits(w, o))
        form = near[0][1] if near and -near[0][0] >= 10 * n else None
        out[w] = [form, w, n, len(near), counts[form] if form else None]
    for w in out:
        at = w
        while out[at][0]:
            at = out[at][0]
        out[w][1] = at
    return {w: tuple(v) for w, v in out.items()}


def by_word(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_against_plain(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcéÿ") for _ in range(rng.choice([7, 7, 8, 9]))) for _ in range(150)}
    for w in sorted(words)[:80]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abÿ") + w[i + 1 :]}
    words |= {"a" * 40, "a" * 41, "a" * 39 + "b", "aaaaaaa", "aaaaaa"}
    counts = {w: rng.choice([2, 3, 30, 31, 400, 5000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = plain(counts)
    assert any(v[0] and v[1] != v[0] for v in want.values())
    for symbols in (None, 2, 30):
        assert by_word(variants.variants(table, symbols=symbols)) == want


def test_chain_of_forms(spark):
    chain = ["kaaaaaaa", "kbaaaaaa", "kbbaaaaa", "kbbbaaaa", "kbbbbaaa"]
    counts = {w: 2 * 10**i for i, w in enumerate(chain)}
    got = by_word(variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert all(got[w][1] == chain[-1] for w in chain) and got == plain(counts)


def test_ties_and_nulls(spark):
    rows = [("banana1", None), (None, 4), ("bananax", 2), ("bananay", 20), ("bananaé", 20), ("bananaz", 20)]
    got = by_word(variants.variants(spark.createDataFrame(rows, "word string, n long")))
    assert got["bananax"] == ("bananay", "bananay", 2, 3, 20) and set(got) == {"bananax", "bananay", "bananaé", "bananaz"}
    assert variants.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_runs_and_noise(spark):
    texts = [(1, "Überfluß ÜBERFLUß naïveté123naïveté élan_vital", 0, 0), (2, None, 0, 0), (3, "", 0, 0), (None, "Nameless words here", 0, 0), (5, "x" * 300_000 + " " + "letters " * 20_000, 0, 0), (1, "Überfluß", 0, 0)]
    got = sorted(tuple(r) for r in variants.runs(spark.createDataFrame(texts, SCHEMA)).collect())
    want, noisy = [], []
    for d, t, *_ in texts:
        for w in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in t or "").split():
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            want.append(("" if d is None else str(d), w))
            if len(w) >= 7:
                h = zlib.crc32(f"{want[-1][0]}:{w}".encode())
                noisy.append(w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :])
    assert got == sorted(want)
    assert sorted(r["run"] for r in variants.noisy(variants.runs(spark.createDataFrame(texts, SCHEMA))).collect()) == sorted(noisy)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert variants.op13_spelling_variants(spark, str(tmp_path)).collect() == []
