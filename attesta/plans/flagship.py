"""From documents to numbered evidence in one lineage.

documents -> chunks -> best 200 chunks per question -> rerank to 40 -> verdicts ->
budgeted selection -> citation numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.config import Settings
from attesta.functions import text as tx
from attesta.operators import evidence, retrieve, triage
from attesta.plans import inputs as src
from attesta.session import cut_lineage, spread_out
from attesta.sources.tables import read_table


def cited_evidence(spark: SparkSession, sf: str, settings: Settings | None = None) -> DataFrame:
    """``(number, sub_question_id, chunk_id, rerank_score, token_count)``.

    A chunk is judged relevant unless its document is labelled low quality; the
    confidence is the share of the question's words that it contains.
    """
    settings = settings or Settings()
    docs = src.document_rows(spark, sf)
    chunks = src.chunks_of(docs)
    questions = read_table(spark, sf, "benchmark").select(
        F.concat(F.lit("sq"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("sub_question_id"),
        F.col("text").alias("question"),
    )
    found = retrieve.lexical_top_k(
        chunks, questions, settings.retrieve.ann_top_k, "chunk_id", "text", "sub_question_id", "question", carry=["doc_id"]
    )
    found = cut_lineage(found.withColumnRenamed("rn", "ann_rank").withColumnRenamed("score", "overlap"))
    # Only documents with a candidate are chunked again, to fetch the texts.
    texts = src.chunks_of(docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi"))
    texts = texts.drop("doc_id").join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")
    # The shuffle after the projection makes Spark compute the terms once per chunk;
    # a join right behind it would compute them again for every match.
    texts = texts.withColumn("terms", tx.terms("text")).repartition("chunk_id")
    asked = questions.select("sub_question_id", tx.terms("question").alias("asked"))
    candidates = spread_out(found).join(texts, "chunk_id").join(asked, "sub_question_id")
    ranked = retrieve.rerank(
        candidates, settings.retrieve.rerank_top_k, tx.term_hits, question="asked", text="terms"
    ).drop("terms", "asked")
    labels = read_table(spark, sf, "labels").select("doc_id", "quality")
    judged = ranked.join(labels, "doc_id", "left").withColumn(
        "verdict",
        F.struct(
            (F.coalesce("quality", F.lit(1)) == 1).alias("relevant"),
            tx.sentence("text", 0).alias("claim"),
            tx.sentence("text", 1).alias("evidence_span"),
            F.col("overlap").alias("confidence"),
        ),
    )
    # At most rerank_top_k rows per question.
    kept = triage.keep_relevant(judged, settings.triage.confidence_floor).withColumnRenamed("score", "rerank_score")
    kept = cut_lineage(kept)
    selected = evidence.select_evidence(kept, settings.report.corpus_budget_tokens)
    numbered = selected.join(evidence.number_citations(selected), "chunk_id")
    return numbered.select(
        "number", "sub_question_id", "chunk_id", "rerank_score", F.col("token_count").cast("bigint").alias("token_count")
    )
