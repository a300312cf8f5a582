"""Search hits: per-query dedup and cap, then one merged list of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.topk import top_k

_FIELDS = ["url", "title", "snippet", "engine", "score"]


def query_hits(raw: DataFrame, per_query: int = 10) -> DataFrame:
    """First ``per_query`` distinct URLs of every query, in rank order.

    Items without a URL are skipped, a URL counts where it is first seen and as
    written, and missing texts and scores become empty and 0.
    """
    usable = raw.filter(F.coalesce("url", F.lit("")) != "").select(
        "query_idx",
        "query",
        "rank",
        "url",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "snippet", "engine")],
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    row = F.struct("rank", "query", *[c for c in _FIELDS if c != "url"])
    first = usable.groupBy("query_idx", "url").agg(F.min(row).alias("h")).select("query_idx", "url", "h.*")
    return top_k(first, ["query_idx"], [F.col("rank")], per_query, out="pos", salt_on=["url"])


def merge_hits(raw: DataFrame, per_query: int = 10) -> DataFrame:
    """All queries' hits, every URL once, from the first query that found it."""
    hits = query_hits(raw, per_query)
    row = F.struct("query_idx", "rank", "query", "title", "snippet", "engine", "score")
    return hits.groupBy("url").agg(F.min(row).alias("h")).select("h.query_idx", "h.rank", "url", "h.query", "h.title",
                                                                   "h.snippet", "h.engine", "h.score")


def all_queries(plan: DataFrame) -> DataFrame:
    """Every query of a plan in plan order: ``(sub_question_id, sq_ord, pos, query)``."""
    return plan.select("sub_question_id", "sq_ord", F.posexplode("queries").alias("pos", "query"))
