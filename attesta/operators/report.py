"""Aggregates behind a report's charts and manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.urls import authority

# How many domains and bars a chart shows.
TOP_DOMAINS = 8
MAX_BARS = 15


def source_mix(evidence: DataFrame, order: str, top: int = TOP_DOMAINS) -> DataFrame:
    """The domains with the most evidence; ties go to the one seen first."""
    counts = evidence.filter(F.coalesce("url", F.lit("")) != "").groupBy(authority("url").alias("domain")).agg(
        F.count("*").alias("n"), F.min(order).alias("first_seen")
    )
    return counts.orderBy(F.col("n").desc(), F.col("first_seen")).limit(top)


def coverage_counts(evidence: DataFrame, bars: int = MAX_BARS) -> DataFrame:
    """Evidence rows per sub-question, the first ones by id."""
    counts = evidence.groupBy("sub_question_id").agg(F.count("*").alias("n"))
    return counts.orderBy("sub_question_id").limit(bars)


def funnel(chunks: DataFrame, decided: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: chunks, chunks after dedup, distinct chunks that became evidence."""
    names = ["n_chunks", "n_chunks_after_dedup", "n_chunks_evidence"]
    counts = [
        chunks.agg(F.count("*")),
        decided.agg(F.count_if(F.col("dup_of").isNull())),
        evidence.agg(F.count_distinct("chunk_id")),
    ]
    rows = [c.toDF("n").select(F.lit(name).alias("name"), "n") for name, c in zip(names, counts)]
    union = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return union.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in names])
