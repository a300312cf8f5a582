"""Nearest chunks per question, and reranking of the candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.config import RetrieveSettings
from attesta.functions import text as tx
from attesta.operators.topk import scored_top_k, top_k

QUERY_BLOCK = 1024


def query_blocks(queries: DataFrame, key: str, value: str, size: int):
    """The queries in key order, a bounded number at a time."""
    last = None
    while True:
        rest = queries.select(key, value) if last is None else queries.select(key, value).filter(F.col(key) > last)
        rows = rest.orderBy(key).limit(size).collect()
        if rows:
            yield rows
            last = rows[-1][key]
        if len(rows) < size:
            return


def with_keys(part: DataFrame, key: str, rows: list, key_type: str) -> DataFrame:
    """Put the query keys back in place of their numbers."""
    keys = F.array(*[F.lit(r[key]) for r in rows]).cast(f"array<{key_type}>")
    return part.withColumn(key, F.get(keys, F.col("query_no"))).drop("query_no")


def nearest_chunks(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    chunk_id: str = "chunk_id",
    vector: str = "vector",
    query_id: str = "sub_question_id",
    query_vector: str = "vector",
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` chunks with the smallest squared Euclidean distance per question:
    ``(query_id, chunk_id, distance, ann_rank)``, ties to the smaller chunk id.

    Exact: every chunk is scored. Up to ``block`` question vectors travel to the
    tasks at a time, and each task returns its own best ``k`` only.
    """
    key_type = queries.schema[query_id].dataType.simpleString()
    out: DataFrame | None = None
    for rows in query_blocks(queries, query_id, query_vector, block):
        q = np.asarray([r[query_vector] for r in rows], dtype=np.float64)
        q_sq = (q * q).sum(axis=1)

        def closeness(column, q=q, q_sq=q_sq) -> np.ndarray:
            flat = column.flatten().to_numpy(zero_copy_only=False)
            m = flat.reshape(len(column), -1).astype(np.float64)
            return 2 * (m @ q.T) - (m * m).sum(axis=1)[:, None] - q_sq[None, :]

        part = scored_top_k(chunks, chunk_id, vector, closeness, len(rows), k)
        part = with_keys(part, query_id, rows, key_type).select(
            query_id, F.col("id").alias(chunk_id), (-F.col("score")).alias("distance"), F.col("rn").alias("ann_rank")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        id_type = chunks.schema[chunk_id].dataType.simpleString()
        schema = f"{query_id} {key_type}, {chunk_id} {id_type}, distance double, ann_rank int"
        out = chunks.sparkSession.createDataFrame([], schema)
    return out


def lexical_top_k(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    doc_id: str,
    text: str,
    query_id: str,
    query_text: str,
    block: int = QUERY_BLOCK,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` texts with the largest lexical overlap per query:
    ``(query_id, doc_id, score, rn)``, ties to the smaller document id. ``carry``
    names further columns of the texts to return.

    The score is the share of the query's distinct words that occur in the text.
    Each text is split once for all queries of a block.
    """
    key_type = queries.schema[query_id].dataType.simpleString()
    out: DataFrame | None = None
    for rows in query_blocks(queries, query_id, query_text, block):
        terms = [set((r[query_text] or "").lower().split()) for r in rows]
        sizes = np.array([max(1, len(t)) for t in terms], dtype=np.float64)
        where: dict[str, list[int]] = {}
        for n, words in enumerate(terms):
            for w in words:
                where.setdefault(w, []).append(n)
        posts = {w: np.array(ns) for w, ns in where.items()}
        asked = set(posts)

        def overlap(column, posts=posts, asked=asked, sizes=sizes) -> np.ndarray:
            hits = np.zeros((len(column), len(sizes)))
            for i, body in enumerate(column.to_pylist()):
                shared = asked.intersection((body or "").lower().split())
                if shared:
                    hits[i] = np.bincount(np.concatenate([posts[w] for w in shared]), minlength=len(sizes))
            return hits / sizes

        part = scored_top_k(docs, doc_id, text, overlap, len(rows), k, carry)
        part = with_keys(part, query_id, rows, key_type).select(
            query_id, F.col("id").alias(doc_id), "score", "rn", *carry
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        types = dict(docs.dtypes)
        more = "".join(f", {c} {types[c]}" for c in carry)
        out = docs.sparkSession.createDataFrame(
            [], f"{query_id} {key_type}, {doc_id} {types[doc_id]}, score double, rn int{more}"
        )
    return out


def rerank(
    candidates: DataFrame,
    k: int | None = None,
    score: Callable[[Column, Column], Column] = tx.lexical_overlap,
    query_id: str = "sub_question_id",
    question: str = "question",
    text: str = "text",
    tie: str = "ann_rank",
) -> DataFrame:
    """Score each candidate against its question and keep the best ``k`` per
    question; equal scores keep the candidates' order.

    ``score`` makes a column of two columns: an expression, or a pandas UDF that
    calls a model.
    """
    k = RetrieveSettings.rerank_top_k if k is None else k
    scored = candidates.withColumn("score", F.round(score(F.col(question), F.col(text)).cast("double"), 9))
    return top_k(scored, [query_id], [F.col("score").desc(), F.col(tie)], k, out="rerank_rank")


def ndcg(ranked: DataFrame, key: str, position: str, grade: str, k: int) -> DataFrame:
    """nDCG at ``k`` per ``key``: 0 where no row has a positive grade.

    ``ranked`` holds a ranking with 1-based positions; the ideal order is that of
    the grades in it.
    """
    gain = F.col(grade) / F.log2(F.col(position) + F.lit(1))
    got = ranked.filter(F.col(position) <= k).groupBy(key).agg(F.sum(gain).alias("dcg"))
    ideal = top_k(ranked.select(key, grade, position), [key], [F.col(grade).desc(), F.col(position)], k,
                  out="_best", salt_on=[position])
    best = ideal.groupBy(key).agg(F.sum(F.col(grade) / F.log2(F.col("_best") + F.lit(1))).alias("idcg"))
    score = F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0))
    return best.join(got, key, "left").select(key, score.alias("ndcg"))


def mean_ndcg(ranked: DataFrame, key: str, position: str, grade: str, k: int) -> DataFrame:
    """One row: how many keys there are and the mean of their nDCG at ``k``, NULL without keys."""
    each = ndcg(ranked, key, position, grade, k)
    return each.agg(F.count("*").alias("n_queries"), F.avg("ndcg").alias("mean_ndcg"))
