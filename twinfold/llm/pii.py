r"""Personal data and what reveals it (DataFrame functions only).

Four patterns find protected entities: e-mail and IP addresses, card and phone numbers. Then corpus counts say how much the
words around them give away. An entity's information is -log2 p(e), with p(e) the entity's share of the mentions
of all entities. A word t discloses log2 p(e|t) / p(e) of it, with p(e|t) = n(e,t) / n(t): the occurrences of t within
WINDOW words of e over the occurrences of t in the corpus. Where that is ALPHA of the entity's information or more,
p(e|t) is SURE or more, and the two have met in SUPPORT different texts or more, t is sanitised wherever it occurs, in texts
without e too (WINDOW is for the estimate only): it is generalised to its first STEM letters if the words that share these don't disclose e themselves, else removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import Scratch, settle

WINDOW, ALPHA, SURE, SUPPORT, STEM = 6, 0.8, 0.5, 3, 3
#: Entries of an array that are added up in one stretch.
STRETCH = 128

# The patterns of each kind. Possessive repeats and look-behinds give the matches of
# email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, ip `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`,
# card `[0-9]([\x20-]?[0-9])+` and phone `\+[0-9][\x20().0-9-]+[0-9]` in one pass and without deep recursion.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Runs of fewer than 13 digits are no cards, so they aren't looked at.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = (("email", EMAIL, "@"), ("ip", IP, "."), ("card", CARD, None), ("phone", PHONE, "+"))
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = r"[^\x09-\x0D ]+"
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def accepted(kind: str, value: Column) -> Column:
    """What a match must pass besides its pattern."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def let(x: Column, f) -> Column:
    """f(x), with x worked out once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(numbers: Column) -> Column:
    """Running sums of an array that isn't empty, by stretches of STRETCH, so that a long one doesn't cost the square of its length."""
    within = lambda xs, i: total(F.slice(xs, i - i % STRETCH + 1, i % STRETCH + 1))
    whole = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int")), lambda c: total(F.slice(xs, c * STRETCH + 1, STRETCH)))
    before = lambda sums: F.transform(sums, lambda _, c: total(F.slice(sums, F.lit(1), c)))
    return let(numbers, lambda xs: let(let(whole(xs), before), lambda starts: F.transform(xs, lambda _, i: starts[F.floor(i / STRETCH).cast("int")] + within(xs, i))))


def places(text: Column, pattern: str, kind: Column) -> Column:
    """All matches with their places in code points (from 0, end exclusive), by adding up what lies between them."""
    between = F.split(text, pattern, -1)

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda g, v: F.length(g) + F.length(v))
        each = F.zip_with(found, running(steps), lambda v, end: F.struct(kind.alias("kind"), (end - F.length(v)).alias("start"), end.alias("end"), v.alias("value")))
        return F.when(F.size(found) > 0, each).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by kind as listed, then by start."""

    def one(kind: str, pattern: str, sign: str | None) -> Column:
        there = text.contains(sign) if sign else text.rlike("[0-9][ -]?[0-9]")
        return F.when(there, F.filter(places(text, pattern, F.lit(kind)), lambda s: accepted(kind, s["value"]))).otherwise(F.array().cast(SPAN))

    return F.concat(*[one(*k) for k in KINDS])


def entity(span: Column) -> Column:
    """Two spellings of one number are one entity; so are two cases of one address."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"])))


def term(word: Column) -> Column:
    """A word as counted: lower case, without signs around it."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def word_places(texts: DataFrame) -> DataFrame:
    """text_key, j, start, end, value: the words of different texts (text_key, text), numbered from 1, with their places in code points."""
    each = texts.select("text_key", F.posexplode(F.split("text", r"[\x09-\x0D ]", -1)).alias("i", "value"))
    line = Window.partitionBy("text_key").orderBy("i")
    end = F.sum(F.length("value") + 1).over(line).cast("int") - 1
    placed = each.select("text_key", F.sum((F.col("value") != "").cast("int")).over(line).alias("j"), end.alias("end"), "value").where("value <> ''")
    return placed.withColumn("start", F.col("end") - F.length("value"))


def context(marked: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """text_key, entity, term, n: the words within `window` words of an entity's spans in different texts (text_key, text, spans). Words that overlap a base span are left out.

    A text's words and the ends of its spans are rows in order of place, so words are numbered by a running count and a span's first
    and last word are those last begun at its first and last sign. What stands near a word comes from a range of these
    numbers. All of it follows the one shuffle by text_key, and costs in proportion to words and spans.
    """
    row = lambda value, entity, kind, at: F.struct(value.cast("string").alias("value"), entity.cast("string").alias("entity"), F.lit(kind).alias("kind"), at.cast("int").alias("at"))
    null = F.lit(None)
    words = F.transform(F.split("text", r"[\x09-\x0D ]", -1), lambda w: row(w, null, 0, null))
    ends = F.flatten(F.transform("spans", lambda s: F.array(row(null, entity(s), 1, s["start"]), row(null, entity(s), 2, s["end"] - 1))))
    each = marked.select("text_key", F.posexplode(F.concat(words, ends)).alias("i", "x")).select("text_key", "i", "x.*")
    text = Window.partitionBy("text_key")
    size = F.coalesce(F.length("value"), F.lit(0))
    begun = F.sum(F.when(F.col("kind") == 0, size + 1).otherwise(0)).over(text.orderBy("i")) - size - 1
    placed = each.withColumn("at", F.coalesce("at", begun.cast("int"))).where("kind > 0 or value <> ''")
    numbered = placed.withColumn("j", F.sum((F.col("kind") == 0).cast("int")).over(text.orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    of = lambda kind: F.when(F.col("kind") == kind, F.col("entity"))
    line = text.orderBy("j")
    near = numbered.select(
        "text_key", "kind", "value",
        F.collect_set(of(2)).over(line.rangeBetween(-window, -1)).alias("left"), F.collect_set(of(1)).over(line.rangeBetween(1, window)).alias("right"),
        F.count(of(1)).over(line.rangeBetween(Window.unboundedPreceding, 0)).alias("opened"), F.count(of(2)).over(line.rangeBetween(Window.unboundedPreceding, -1)).alias("closed"),
    )
    beside = near.where("kind = 0 and opened = closed").select("text_key", term(F.col("value")).alias("term"), F.explode(F.array_union("left", "right")).alias("entity")).where("term <> ''")
    return scratch.settle(beside.groupBy("text_key", "entity", "term").agg(F.count(F.lit(1)).alias("n")), "near")


def disclosures(texts: DataFrame, found: DataFrame, near: DataFrame, scratch: Scratch, *, alpha: float = ALPHA, sure: float = SURE, support: int = SUPPORT, stem: int = STEM) -> DataFrame:
    """entity, term, put: words that disclose an entity and what is put for them ('' where they are removed).

    Texts that repeat count once for the support, and as often as they stand for the shares. Only words that meet some
    entity often enough are counted in the corpus.
    """
    marked = found.where(F.size("spans") > 0)
    copies = marked.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    counted = near.join(copies, "text_key").withColumn("n", F.col("n") * F.col("copies"))
    met = counted.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n_both")).where(F.col("texts") >= support)
    mentions = scratch.settle(marked.select(F.explode("spans").alias("span")).groupBy(entity(F.col("span")).alias("entity")).agg(F.count(F.lit(1)).alias("n_entity")), "entities")
    total = mentions.agg(F.sum("n_entity")).first()[0] or 1
    met = scratch.settle(met, "met")
    stems = met.select(F.substring("term", 1, stem).alias("stem")).distinct()
    words = texts.select(F.explode(F.split("text", r"[\x09-\x0D ]+")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = words.select(term(F.col("word")).alias("term"), "n").where("term <> ''").groupBy("term").agg(F.sum("n").alias("n_term"))
    counts = scratch.settle(counts.withColumn("stem", F.substring("term", 1, stem)).join(stems, "stem", "left_semi"), "counts")
    classes = counts.groupBy("stem").agg(F.sum("n_term").alias("n_stem"))
    known = met.join(mentions, "entity").join(counts.select("term", "n_term", "stem"), "term").join(classes, "stem")

    def reveals(both: Column, n: Column) -> Column:
        share, prior = both / n, F.col("n_entity") / F.lit(total)
        return (share >= sure) & (F.log2(share / prior) >= -alpha * F.log2(prior))

    class_both = counted.groupBy("entity", F.substring("term", 1, stem).alias("stem")).agg(F.sum("n").alias("n_class"))
    revealing = known.where(reveals(F.col("n_both"), F.col("n_term"))).join(class_both, ["entity", "stem"])
    general = (F.length("term") > stem) & ~reveals(F.col("n_class"), F.col("n_stem"))
    return revealing.select("entity", "term", F.when(general, F.concat("stem", F.lit("*"))).otherwise(F.lit("")).alias("put"))


def occurrences(texts: DataFrame, told: DataFrame, scratch: Scratch) -> DataFrame:
    """text_key, start, end, value, put: every place of the disclosing terms (term, put) in all texts; equal texts count once."""
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    # The texts stay behind while their words are looked up; only those with a hit are read again.
    each = keyed.select("text_key", F.explode(F.array_distinct(F.split("text", r"[\x09-\x0D ]+"))).alias("value"))
    hits = scratch.settle(each.withColumn("term", term(F.col("value"))).join(told, "term").select("text_key", "value", "put").distinct(), "hits")
    rows = keyed.join(hits.select("text_key").distinct(), "text_key", "left_semi").dropDuplicates(["text_key"])
    return word_places(rows).join(hits, ["text_key", "value"]).select("text_key", "start", "end", "value", "put")


def find_spans(docs: DataFrame, *, doc="doc_id", text="text") -> DataFrame:
    """doc_id, text_key (a hash of the text), base (spans of the four kinds), terms (start, end, value, put) of each row; null counts as empty.

    Equal rows (id and text) are found alike and all stay; rows without an id are kept.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = texts.withColumn("text_key", F.xxhash64("text")).withColumn("spans", base_spans(F.col("text")))
    found = settle(spans.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "spans")
    marked = found.where(F.size("spans") > 0).select("text_key", "text", "spans").dropDuplicates(["text_key"])
    near = context(marked, scratch)
    told = settle(disclosures(texts, found, near, scratch), "disclosures").groupBy("term").agg(F.min("put").alias("put"))
    scratch.clear()
    kind = "array<struct<start:int,end:int,value:string,put:string>>"
    none = F.array().cast(kind)
    if told.isEmpty():
        return found.select("doc_id", "text_key", F.col("spans").alias("base"), none.alias("terms"))
    # A table of its own, so that the rows of a text with very many copies can be split where they meet it.
    each = settle(occurrences(texts, told, scratch).groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value", "put"))).cast(kind).alias("terms")), "terms")
    scratch.clear()
    joined = found.join(each, "text_key", "left").withColumn("terms", apart(F.coalesce("terms", none), F.col("spans")))
    return joined.select("doc_id", "text_key", F.col("spans").alias("base"), "terms")


def apart(terms: Column, spans: Column) -> Column:
    """Terms that overlap no span."""
    return F.when(F.size(spans) == 0, terms).otherwise(F.filter(terms, lambda t: ~F.exists(spans, lambda s: (s["start"] < t["end"]) & (s["end"] > t["start"]))))


def sanitised(docs: DataFrame, *, doc="doc_id", text="text") -> DataFrame:
    """docs, all columns, with entities and what discloses them taken out of the text."""
    found = find_spans(docs, doc=doc, text=text).where((F.size("base") > 0) | (F.size("terms") > 0)).dropDuplicates(["doc_id", "text_key"])
    # The columns of docs travel as one, so that no name can clash.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc].alias("id"), F.xxhash64(docs[text]).alias("key"))
    joined = rows.join(found, rows["id"].eqNullSafe(found["doc_id"]) & (rows["key"] == found["text_key"]), "left")
    own = F.col("row").getField(text)
    clean = F.when(F.col("base").isNull(), own).otherwise(sanitise(own, F.col("base"), F.col("terms")))
    return joined.select(*[clean.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def sanitise(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans as [KIND], terms generalised or removed; of spans that overlap the first, longest one counts."""
    marks = F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))), F.transform(terms, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["put"].alias("put"))))

    def walk(part: Column, own: Column, begin: Column) -> Column:
        """Pieces of one stretch of marks and where they end; own is the text from `begin` on."""

        def step(at: Column, m: Column) -> Column:
            pieces = F.array(F.substring(own, at["end"] - begin + 1, m["start"] - at["end"]), m["put"])
            free = m["start"] >= at["end"]
            return F.struct(F.when(free, F.concat(at["out"], pieces)).otherwise(at["out"]).alias("out"), F.when(free, -m["end"]).otherwise(at["end"]).alias("end"))

        return F.aggregate(part, F.struct(F.array().cast("array<string>").alias("out"), begin.alias("end")), step)

    def stretch(at: Column, part: Column) -> Column:
        own = F.substring(text, at["end"] + 1, F.array_max(F.transform(part, lambda m: -m["end"])) - at["end"])
        joined = lambda w: F.struct(F.concat(at["out"], F.array(F.array_join(w["out"], ""))).alias("out"), w["end"].alias("end"))
        return let(let(own, lambda o: walk(part, o, at["end"])), joined)

    def whole(ms: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ms) - 1) / STRETCH).cast("int")), lambda c: F.slice(ms, c * STRETCH + 1, STRETCH))
        walked = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("end")), stretch)
        return let(walked, lambda w: F.concat(F.array_join(w["out"], ""), F.substring(text, w["end"] + 1, F.length(text))))

    return let(F.array_sort(marks), lambda ms: F.when(F.size(ms) > 0, whole(ms)).otherwise(text))


def listed(spans: Column, kind: str | None = None) -> Column:
    name = (lambda s: s["kind"]) if kind is None else (lambda s: F.lit(kind))
    return F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string")))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of every document, base ones and disclosing terms, with counts and a digest of the base ones; null texts are empty and have none."""
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = listed(F.col("base"))
    return found.select(
        "doc_id",
        *[count(kind) for kind, _, _ in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, listed(F.col("terms"), "term")), ",").alias("spans"),
    )
