"""Secret scan with a random forest that removes false positives, with DataFrame operations only.

Candidates are runs of token characters, with or without a digit, and values of any length after a secret word. Their features: length, character classes and transitions, how
well dictionary words of the corpus cover them, their path, and the words beside them. The forest is trained on
labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import cut_lineage

#: Shortest candidate without a secret word before it, and its characters.
SHORTEST = 16
_RUN = r"[A-Za-z0-9+/_=.\-]{16,}"
#: The forest is fitted on about this many labelled findings, dealt by hash.
TRAIN_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 6, 7
#: Words in at least this share of the documents form the dictionary, so that its size is bounded by the mean number of
#: distinct words of a document over this share.
WORD_SHARE = 0.0005
#: Words beside a candidate that speak for or against a secret.
SECRET_WORDS = r"token|secret|passw|pwd|api_?key|apikey|access|auth|credential|private"
DUMMY_WORDS = r"example|sample|dummy|test|placeholder|changeme|xxxx|your"
#: A word that ends with a secret word or its assignment, so that the value comes next; a word of signs between the two; the
#: value as a word of its own; values assigned to a secret word in the same word.
_KEY = rf"(?i)(?:{SECRET_WORDS})[A-Za-z0-9_.\-]*[\"'`\])]*[=:]*>?[\"'`(]*$"
_SIGNS = r"^[^A-Za-z0-9]+$"
_VALUE = r"^[\"'`(\[{<]*([^\s\"'`]*[^\s\"'`,;.:!?)\]}>=])"
_OWN_VALUE = rf"(?i)(?:{SECRET_WORDS})[A-Za-z0-9_.\-]*[\"'`\])]*[=:]+>?[\"'`(]*([^\s\"'`,;()<>=:][^\s\"'`,;()<>]*)"
#: Letters drawn at random surprise by log(26) = 3.26 nats a letter at least on average; words by clearly less.
WORD_SURPRISE = 2.75
_PLACEHOLDER_PATH = r"test|example|sample|fixture|mock|doc"

FEATURES = [
    "length", "digits", "uppers", "lowers", "symbols", "turns", "variety", "hexadecimal", "surprise", "coverage",
    "path_length", "path_dummy", "word_secret", "word_dummy", "assigned", "quoted", "next_length",
]


def find_candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: key, position (number of the word), candidate, path, before (up to three words), after.

    Null or empty texts have none; a null path is empty. Every candidate of a word that holds several is found. A value after a
    secret word is one at any length, unless it holds a longer candidate or is part of it.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.col(text).cast("string").alias("_t"))
    rows = rows.withColumn("_s", F.col("_t").rlike(f"(?i){SECRET_WORDS}")).filter(F.col("_s") | F.col("_t").rlike(_RUN))
    rows = rows.withColumn("_w", F.split("_t", r"\s+"))
    at = lambda i: F.coalesce(F.get("_w", i), F.lit(""))
    follows = lambda i: at(i - 1).rlike(_KEY) | (at(i - 1).rlike(_SIGNS) & at(i - 2).rlike(_KEY))
    hits = F.transform("_w", lambda w, i: F.struct(i.alias("i"), w.alias("w"), (F.col("_s") & follows(i) & ~w.rlike(_SIGNS)).alias("f")))
    hits = F.filter(hits, lambda x: x.f | x.w.rlike(_RUN) | (F.col("_s") & x.w.rlike(_OWN_VALUE)))
    rows = rows.select("_key", "path", "_w", F.explode(hits).alias("h"))
    i = F.col("h.i")
    beside = lambda k: at(i + k)
    rows = rows.select(
        "_key", "path", i.cast("long").alias("position"), F.col("h.w").alias("word"),
        F.lower(F.concat_ws(" ", beside(-3), beside(-2), beside(-1))).alias("before"), F.lower(beside(1)).alias("after"),
        F.regexp_extract_all("h.w", F.lit(f"({_RUN})")).alias("_runs"),
        F.array_distinct(F.concat(
            F.when(F.col("h.f"), F.array(F.regexp_extract("h.w", _VALUE, 1))).otherwise(F.array().cast("array<string>")),
            F.regexp_extract_all("h.w", F.lit(_OWN_VALUE), 1),
        )).alias("_values"),
    )
    apart = F.filter("_values", lambda v: (v != "") & ~F.exists("_runs", lambda x: v.contains(x) | x.contains(v)))
    rows = rows.select("_key", "path", "position", "word", "before", "after", F.posexplode(F.concat("_runs", apart)).alias("part", "candidate"))
    return rows.withColumnRenamed("_key", key)


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, docs: the letter words of at least four letters that are frequent in the corpus, counted once per document."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text).cast("string")), F.lit(r"(?<![a-z0-9])([a-z]{4,})(?![a-z0-9])")))
    total = docs.count()
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    return counts.filter(F.col("docs") >= WORD_SHARE * total)


def _transitions(words: DataFrame) -> Column:
    """Map from letter pairs (676 at most) to how surprising the second letter is after the first, in nats."""
    padded = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    pairs = words.select(F.explode(padded).alias("pair"), "docs").groupBy("pair").agg(F.sum("docs").alias("n"))
    rows = pairs.collect()
    first: dict[str, int] = {}
    for r in rows:
        first[r.pair[0]] = first.get(r.pair[0], 0) + r.n
    entries = [x for r in rows for x in (F.lit(r.pair), F.lit(float(-_log((r.n + 1) / (first[r.pair[0]] + 26)))))]
    return F.create_map(*entries) if entries else F.create_map(F.lit(""), F.lit(0.0))


def _log(x: float) -> float:
    import math

    return math.log(x)


def with_features(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with the columns FEATURES."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    share = lambda p: F.regexp_count(c, F.lit(p)) / n
    low = F.lower(c)
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(low, i, F.lit(2)))
    table = _transitions(words)
    letters = F.filter(pairs, lambda p: p.rlike("^[a-z]{2}$"))
    surprise = F.aggregate(letters, F.lit(0.0), lambda a, p: a + F.coalesce(table[p], F.lit(7.0)))
    out = candidates.select(
        "*",
        n.alias("length"),
        share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[a-z]").alias("lowers"), share("[^A-Za-z0-9]").alias("symbols"),
        share(r"(?<=[0-9])(?=[^0-9])|(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[a-z])(?=[A-Z])").alias("turns"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("variety"),
        c.rlike("^[0-9a-fA-F]+$").cast("double").alias("hexadecimal"),
        F.when(F.size(letters) > 0, surprise / F.size(letters)).otherwise(F.lit(0.0)).alias("surprise"),
        F.length("path").cast("double").alias("path_length"), F.lower("path").rlike(_PLACEHOLDER_PATH).cast("double").alias("path_dummy"),
        (F.col("before").rlike(SECRET_WORDS) | F.col("word").rlike(_OWN_VALUE)).cast("double").alias("word_secret"),
        (F.col("before").rlike(DUMMY_WORDS) | F.col("after").rlike(DUMMY_WORDS)).cast("double").alias("word_dummy"),
        (F.col("before").rlike(r"[=:]\W*$") | F.col("word").rlike(r"^[^\s]*[=:][\"']") | F.col("word").rlike(_OWN_VALUE)).cast("double").alias("assigned"),
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted"), F.length("after").cast("double").alias("next_length"),
        F.regexp_extract_all(low, F.lit("([a-z]{4,})")).alias("_parts"), F.xxhash64("candidate").alias("_c"),
    )
    # Coverage depends on the candidate alone: each distinct candidate meets the dictionary once.
    parts = out.select("candidate", "_c", "_parts").groupBy("candidate").agg(F.first("_parts").alias("p")).select("candidate", F.explode("p").alias("word"))
    covered = parts.join(words.select("word"), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("letters"))
    return out.join(covered, "candidate", "left").withColumn("coverage", F.coalesce("letters", F.lit(0)) / F.col("length")).drop("_parts", "_c", "letters")


def weak_labels(findings: DataFrame) -> DataFrame:
    """Labelled findings where a careful rule can tell: an assigned, quoted value after a secret word is one; host names, file
    names, addresses, plain numbers and words of running text are none. Others have no label and are left out."""
    real = (F.col("word_secret") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & (F.col("word_dummy") == 0)
    no = F.col("candidate").rlike(r"^[0-9.\-]+$") | F.col("candidate").rlike(r"\.(com|org|net|html?|pdf|png|jpg)$")
    prose = F.col("candidate").rlike(r"^[A-Z]?[a-z]+[.]?$") & (F.col("assigned") == 0) & (F.col("quoted") == 0) & (F.col("surprise") < WORD_SURPRISE)
    return findings.withColumn("label", F.when(no, 0.0).when(real, 1.0).when(prose, 0.0)).filter("label is not null")


def fit_forest(labelled: DataFrame):
    """A forest for findings with FEATURES and label (0 or 1), or None unless both labels occur: one alone tells nothing apart."""
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # Half of the sample for each label, so that the rarer one is not lost in the other.
    share = F.when(F.col("label") == 1.0, F.lit(min(1.0, TRAIN_FINDINGS / 2 / counts[1.0]))).otherwise(F.lit(min(1.0, TRAIN_FINDINGS / 2 / counts[0.0])))
    chosen = labelled.filter(F.pmod(F.xxhash64("candidate", "before", "after", "path"), F.lit(1_000_000)) < share * 1_000_000)
    if chosen.select("label").distinct().count() < 2:
        chosen = labelled
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(chosen).select("features", "label")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def score(findings: DataFrame, forest) -> DataFrame:
    """The findings with probability and is_secret (probability of at least one half). Without labels of both kinds to learn
    from nothing is removed: the probability is null and every finding a secret."""
    if forest is None:
        return findings.withColumn("probability", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(findings)
    rows = forest.transform(rows).withColumn("probability", F.round(vector_to_array("probability")[1], 9))
    return rows.withColumn("is_secret", F.col("probability") >= 0.5).drop("features", "rawPrediction", "prediction")


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """All candidates of all documents with the forest's verdict. The candidate itself stays out of the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    findings = cut_lineage(with_features(find_candidates(docs), cut_lineage(dictionary(docs))))
    out = score(findings, fit_forest(weak_labels(findings)))
    return out.select("doc_id", "position", "part", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")
