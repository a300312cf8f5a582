"""Gap analyses: what a model says about the coverage of sub-questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import strip_code_fences
from attesta.operators.triage import lenient_boolean

_RAW = "saturated string, assessments array<struct<sub_question_id:string,covered:string,missing:string>>, new_queries array<string>, rationale string"


def parse_gap(reply: Column | str) -> Column:
    """A model's JSON reply as (saturated, assessments, new_queries, rationale), NULL where it is malformed: no JSON, no ``saturated``, or an
    assessment without its sub-question or without ``covered``. Lists that are missing are empty; a missing or null text is empty."""
    parsed = F.from_json(strip_code_fences(reply), _RAW, {"mode": "PERMISSIVE"})
    given = F.coalesce(parsed["assessments"], F.array().cast("array<struct<sub_question_id:string,covered:string,missing:string>>"))
    assessments = F.transform(
        given,
        lambda a: F.struct(
            a["sub_question_id"].alias("sub_question_id"),
            lenient_boolean(a["covered"]).alias("covered"),
            F.coalesce(a["missing"], F.lit("")).alias("missing"),
        ),
    )
    whole = F.forall(assessments, lambda a: a["sub_question_id"].isNotNull() & a["covered"].isNotNull())
    saturated = lenient_boolean(parsed["saturated"])
    return F.when(
        saturated.isNotNull() & whole,
        F.struct(
            saturated.alias("saturated"),
            assessments.alias("assessments"),
            F.coalesce(parsed["new_queries"], F.array().cast("array<string>")).alias("new_queries"),
            F.coalesce(parsed["rationale"], F.lit("")).alias("rationale"),
        ),
    )


def gap_summary(analyses: DataFrame, key: str, gap: str = "gap") -> DataFrame:
    """``key``, saturated, n_new_queries, n_uncovered of each analysis; malformed ones are left out."""
    g = F.col(gap)
    return analyses.filter(g.isNotNull()).select(
        key,
        g["saturated"].alias("saturated"),
        F.size(g["new_queries"]).cast("bigint").alias("n_new_queries"),
        F.size(F.filter(g["assessments"], lambda a: ~a["covered"])).cast("bigint").alias("n_uncovered"),
    )


def open_questions(analyses: DataFrame, key: str, gap: str = "gap") -> DataFrame:
    """``key``, sub_question_id, missing: the sub-questions that are not covered, with what is missing."""
    rows = analyses.filter(F.col(gap).isNotNull()).select(key, F.inline(F.col(f"{gap}.assessments")))
    return rows.filter(~F.col("covered")).drop("covered")
