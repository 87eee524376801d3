"""Secret scan: candidates by pattern, false positives removed by a random forest (DataFrame functions and Spark ML only).

Features are the candidate's length, its changes of character class and variety, how unlikely its transitions from sign to sign
are in frequent corpus words and how much of its letters these cover, the path it was found under and the words beside it. The forest learns from labelled findings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from .pii import let, places

#: Characters looked at before a candidate; labelled findings that the forest is fitted on, about.
CONTEXT, SAMPLE = 60, 20_000
#: A dictionary word's least share of all words, which bounds their number by its inverse, and least count, which only matters below 250,000 words.
SHARE, COMMON = 2e-5, 5
TREES, DEPTH, THRESHOLD = 20, 5, 0.5

# What candidates consist of, the words that announce a secret and paths of examples.
SIGNS = "A-Za-z0-9_+/=-"
WORDS = "token|secret|key|passwd|password|pwd|auth|bearer|credential"
NAME = rf"(?:{WORDS})(?:s|[_-][A-Za-z0-9_-]{{0,20}})?"
# A long run starts at its first sign, but behind the `=` where a name of a secret and `=` lead it.
LONG = rf"(?:(?<![{SIGNS}])(?=[A-Za-z_+/=-]*+[0-9])(?=[{SIGNS}]{{16}})(?![A-Za-z0-9_-]{{0,40}}?(?i:{NAME})=[A-Za-z0-9_+/-]{{8}})|(?<==)(?<=(?i:{NAME})=)(?=[A-Za-z_+/=-]*+[0-9]))[{SIGNS}]{{16,}}+"
# The name may have a closing quote of its own (JSON, YAML); a value without quotes ends at white space, without the signs that close a clause.
ANNOUNCED = rf"(?:(?<=[\"'])(?<={NAME}[\"']? {{0,2}}[=:] {{0,2}}[\"'])[^\"'\s]{{8,}}+|(?<=[=:] {{0,2}})(?<={NAME}[\"']? {{0,2}}[=:] {{0,2}})(?![=:])[^\"'\s]{{8,}}?(?=[,;.)]*+(?:[\"'\s]|$)))"
# Shapes that only secrets have: JSON web tokens and the prefixes of well-known keys.
SHAPE = r"(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9_-])"
EXAMPLES = "test|example|sample|fixture|mock|doc"
FEATURES = ["length", "changes", "variety", "digits", "capitals", "coverage", "surprise", "depth", "example", "announced", "near", "assigned", "quoted", "shape"]
#: Scores without a forest, where labels of one class are missing: known shapes and announced values that are assigned, varied bare runs, all others.
PRIOR = (0.9, 0.6, 0.1)


def dictionary(docs: DataFrame, *, text="text") -> DataFrame:
    """word, n: words of four letters or more, lower-cased, that make up SHARE of all words; at most 1 / SHARE of them."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), r"[^\p{L}]+")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = settle(words.where("word <> ''").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    return words.where((F.length("word") >= 4) & (F.col("n") >= F.lit(max(float(COMMON), SHARE * total))))


def sign_classes(text: Column) -> Column:
    """The text in 28 kinds of signs: small letters a-z, 0 for digits, _ for all others."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]", "0"), "[^a-z0]", "_")


def transitions(words: DataFrame) -> Column:
    """A map of how unlikely, in bits, each of 28 x 28 transitions of signs is in the dictionary's words with a blank on either side."""
    spelled = words.select("n", F.split(sign_classes(F.concat(F.lit(" "), "word", F.lit(" "))), "").alias("s"))
    pairs = spelled.select("n", F.explode(F.transform(F.slice("s", F.lit(1), F.size("s") - 1), lambda c, i: F.concat(c, F.col("s")[i + 1]))).alias("pair"))
    found = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # 784 at most
    signs = "abcdefghijklmnopqrstuvwxyz0_"
    entries = []
    for a in signs:
        whole = sum(found.get(a + b, 0) for b in signs)
        entries += [x for b in signs for x in (F.lit(a + b), F.lit(math.log2((whole + len(signs)) / (found.get(a + b, 0) + 1))))]
    return F.create_map(*entries)


def surprise(value: Column, bits: Column) -> Column:
    """Mean bits of the value's transitions; 0 for a single sign."""
    pairs = lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda c, i: F.try_element_at(bits, F.concat(c, s[i + 1])))
    mean = lambda s: F.aggregate(pairs(s), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))) / F.greatest(F.lit(1), F.size(s) - 1)
    return let(F.split(sign_classes(value), ""), mean)


def candidates(docs: DataFrame, *, doc="doc_id", text="text", path="source") -> DataFrame:
    """doc_id, text_key, path, start, end, value, before, after of every candidate; null texts have none, equal rows count once."""
    rows = docs.select(F.col(doc).alias("doc_id"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).alias("text")).withColumn("text_key", F.xxhash64("text"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    long = F.when(F.col("text").rlike("[0-9]"), places(F.col("text"), LONG, F.lit("secret"))).otherwise(none)
    announced = F.when(F.col("text").rlike(f"(?i){WORDS}"), places(F.col("text"), f"(?i){ANNOUNCED}", F.lit("secret"))).otherwise(none)
    shaped = F.when(F.col("text").rlike(SHAPE), places(F.col("text"), SHAPE, F.lit("secret"))).otherwise(none)
    each = rows.select("doc_id", "text_key", "path", "text", F.explode(F.array_union(F.array_union(long, announced), shaped)).alias("span"))
    start, end = F.col("span.start"), F.col("span.end")
    taken = F.least(F.lit(CONTEXT), start)
    out = each.select("doc_id", "text_key", "path", start.alias("start"), end.alias("end"), F.col("span.value").alias("value"), F.lower(F.substring("text", start - taken + 1, taken)).alias("before"), F.substring("text", end + 1, F.lit(CONTEXT)).alias("after"))
    return out.dropDuplicates(["doc_id", "text_key", "path", "start", "end"])


def share(value: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(value, F.lit(pattern), F.lit(0))) / F.length(value)


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with FEATURES. words is the dictionary, at most 1 / SHARE rows, and is broadcast."""
    bits = transitions(words)
    key = ["doc_id", "text_key", "path", "start", "end"]
    runs = found.select(*key, F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{4,}"), F.lit(0))).alias("word"))
    covered = runs.join(F.broadcast(words.select("word")), "word").groupBy(*key).agg(F.sum(F.length("word")).alias("covered"))
    left, right = found.alias("l"), covered.alias("r")
    joined = left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "left").select("l.*", "r.covered")
    letters = F.greatest(F.lit(1), F.length(F.regexp_replace("value", r"[^\p{L}]", "")))
    flag = lambda c: c.cast("double")
    before, value = F.col("before"), F.col("value")
    return joined.withColumns(
        {
            "length": F.log(F.length("value").cast("double")),
            "changes": share(value, "(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]|(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
            "variety": F.log(F.size(F.array_distinct(F.split("value", ""))).cast("double") + 1),
            "digits": share(value, "[0-9]"),
            "capitals": share(value, "[A-Z]"),
            "coverage": F.coalesce("covered", F.lit(0)) / letters,
            "surprise": surprise(value, bits),
            "depth": F.size(F.split("path", "/")).cast("double"),
            "example": flag(F.lower("path").rlike(EXAMPLES)),
            "announced": flag(before.rlike(rf"{NAME.lower()}[^\p{{L}}]{{1,6}}$")),
            "near": flag(before.rlike(WORDS)),
            "assigned": flag(before.rlike(r"[=:]\s{0,2}[\"']?$")),
            "quoted": flag(before.rlike("[\"']$") & F.col("after").rlike("^[\"']")),
            "shape": flag(value.rlike(f"^{SHAPE}$")),
        }
    ).drop("covered")


def told() -> Column:
    """Announced and assigned."""
    return (F.col("announced") > 0) & (F.col("assigned") > 0)


def varied() -> Column:
    """Runs of 24 signs or more, capitals, small letters and digits among them, that no words cover."""
    return (F.col("length") > 3.17) & (F.col("variety") > 2.8) & (F.col("coverage") < 0.3) & (F.col("digits") > 0) & (F.col("capitals") > 0) & F.col("value").rlike("[a-z]") & ~F.col("value").contains("/")


def by_rule(features: DataFrame) -> DataFrame:
    """Findings with a label where a rule is sure: the tables hold no labelled findings, so these stand for them.

    1: known shapes, varied bare runs, and announced, assigned and varied values that no words cover. 0: numbers, parts
    of addresses, repetitions, and words unless they are announced and assigned.
    """
    real = (F.col("shape") > 0) | varied() | (told() & (F.col("coverage") < 0.3) & (F.col("variety") > 2.0) & (F.col("length") > 2.7))
    false = (F.col("digits") == 1) | ((F.col("coverage") >= 0.5) & ~told() & (F.col("shape") == 0)) | (F.col("variety") < 1.4) | F.col("after").startswith("@") | F.col("before").endswith("@") | F.col("before").rlike(r"https?://\S*$")
    return features.withColumn("label", F.when(false, 0.0).when(real, 1.0)).where("label is not null")


def judge(features: DataFrame, labelled: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """features with score (the forest's probability of a secret) and secret. Where labels have one class only, or none, score is by PRIOR."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    labelled = settle(labelled.select("label", *FEATURES, F.xxhash64("doc_id", "start", "value").alias("_draw")), "labelled")
    n, positive = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, n):
        score = F.when((F.col("shape") > 0) | told(), F.lit(PRIOR[0])).when(varied(), F.lit(PRIOR[1])).otherwise(F.lit(PRIOR[2]))
        return features.withColumn("score", score).withColumn("secret", score >= threshold)
    # Half of the sample for each class at most, drawn by hash.
    half = F.when(F.col("label") > 0, F.lit(min(1.0, sample / 2 / positive))).otherwise(F.lit(min(1.0, sample / 2 / (n - positive))))
    drawn = labelled.where(F.pmod(F.col("_draw"), F.lit(1 << 20)) < half * (1 << 20)).coalesce(1).sortWithinPartitions("_draw", *FEATURES)
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=1)
    model = forest.fit(assemble.transform(drawn))
    judged = model.transform(assemble.transform(features)).withColumn("score", vector_to_array("probability")[1])
    return judged.select(*features.columns, "score", (F.col("score") >= threshold).alias("secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, doc="doc_id", text="text", path="source") -> DataFrame:
    """All candidates with features, score and secret; labelled: findings with FEATURES and label, by rule if not given."""
    features = settle(described(candidates(docs, doc=doc, text=text, path=path), settle(dictionary(docs, text=text), "dictionary")), "candidates")
    return judge(features, by_rule(features) if labelled is None else labelled)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents with the forest's score; null and empty texts have none, equal rows count once."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "secret")
