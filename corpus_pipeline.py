"""Corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, tokens.

``run`` applies the stages to ``documents``. Each result is written as Parquet below the session's checkpoint folder and read
again for the next stage, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.bpe import bpe_round_trip, vocabulary_path
from attesta.llm.decontaminate import find_leaks
from attesta.llm.hyperminhash import near_duplicates
from attesta.llm.language import learned, predict
from attesta.llm.line_windows import remove_repeated_lines
from attesta.session import ensure_checkpoint_dir

#: A document whose language is less certain goes.
LEAST_SCORE = 0.5


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with an id; without one no later stage could tell rows apart."""
    return docs.filter(F.col("doc_id").isNotNull())


def _packed(names: list[str]) -> Column:
    """Columns as one struct, where their names do not meet those that an operator makes."""
    return F.struct(*(F.col(f"`{c}`") for c in names)).alias("_doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language. Null and empty texts, texts without a letter and rows without an id go."""
    docs = _numbered(docs)
    # The whole row passes through the scoring, so nothing has to be joined.
    rows = predict(docs.select("doc_id", "text", _packed(docs.columns)), learned(docs), keep=["_doc"])
    return rows.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left go. n_chars is counted anew."""
    rows = docs.select("doc_id", "text", _packed([c for c in docs.columns if c != "text"]))
    out = remove_repeated_lines(rows).filter((F.col("n_removed") == 0) | (F.coalesce(F.col("text"), F.lit("")) != ""))

    def column(name: str) -> Column:
        own = F.col("text") if name == "text" else F.col("_doc").getField(name)
        if name == "n_chars":
            own = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(own)
        return own.alias(name)

    return out.select(*map(column, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = 85) -> DataFrame:
    """One document of each group of near duplicates, alike to ``percent`` or more: the one with the smallest id, once. Of several texts with one id the longest
    stays, then the first in order; then the other columns decide."""
    kept = near_duplicates(docs, percent=percent).filter("kept").select(F.col("id").alias("doc_id")).distinct()
    others = _packed([c for c in docs.columns if c != "text"])
    rows = docs.join(kept, "doc_id", "left_semi")
    # A fixed choice: aggregated in each task first, so that many copies of one id do not meet in one.
    order = F.struct((-F.coalesce(F.length("text"), F.lit(-1))).alias("size"), "text", others)
    best = rows.groupBy("doc_id").agg(F.min(order).alias("_r"))
    return best.select(*(F.col("_r.text") if c == "text" else F.col("_r._doc").getField(c).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining documents, with counts and digests."""
    return bpe_round_trip(docs, vocabulary_path(), with_ids=True)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the encoder; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
