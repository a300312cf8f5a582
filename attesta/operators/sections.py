"""The sections of a report: planning, cleaning and guarding their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import citations as ct
from attesta.functions import text as tx
from attesta.operators.scan import row_rank

# Titles and instructions of the sections around the body.
OVERVIEW = (
    "Overview",
    "Write a compact overview of the topic and the report's key findings. Cite the strongest evidence.",
)
CONCLUSIONS = (
    "Conclusions",
    "Synthesize the overall answer, note open questions and conflicting evidence explicitly.",
)


def plan_sections(plan: DataFrame, max_sections: int = 12) -> DataFrame:
    """``(section_ord, title, instructions, sub_question_ids)``.

    Overview and conclusions span all sub-questions. Between them stands one
    section per sub-question, or, where there are more than ``max_sections - 2``,
    one per run of consecutive sub-questions.
    """
    body_max = max(max_sections - 2, 1)
    ordered = row_rank(plan, [F.col("sq_ord")], out="n")
    per = max(1, -(-plan.count() // body_max))
    placed = ordered.withColumn("section", F.floor((F.col("n") - 1) / per))
    items = F.sort_array(F.collect_list(F.struct("n", "sub_question_id", "question")))
    groups = placed.groupBy("section").agg(items.alias("q"))
    ids = F.transform("q", lambda q: q["sub_question_id"])
    body = groups.select(
        (F.col("section") + 1).alias("section_ord"),
        tx.section_title(F.col("q")[0]["question"]).alias("title"),
        F.concat(F.lit("Answer in depth: "), F.array_join(F.transform("q", lambda q: q["question"]), "; ")).alias("instructions"),
        ids.alias("sub_question_ids"),
    )
    everything = ordered.agg(items.alias("q")).select(ids.alias("sub_question_ids"), F.size("q").alias("total"))
    ends = F.array(
        F.struct(F.lit(0).cast("bigint").alias("o"), F.lit(OVERVIEW[0]).alias("t"), F.lit(OVERVIEW[1]).alias("i")),
        F.struct((F.col("total") + 1).cast("bigint").alias("o"), F.lit(CONCLUSIONS[0]).alias("t"), F.lit(CONCLUSIONS[1]).alias("i")),
    )
    around = everything.select("sub_question_ids", F.explode(ends).alias("e")).select(
        F.col("e.o").alias("section_ord"), F.col("e.t").alias("title"), F.col("e.i").alias("instructions"), "sub_question_ids"
    )
    return around.unionByName(body)


def clean_sections(draft: DataFrame, n_citations: int) -> DataFrame:
    """Drop an opening heading and the markers that no citation answers to."""
    return draft.withColumn(
        "markdown", ct.drop_unknown_markers(tx.strip_leading_heading(tx.strip("markdown")), n_citations)
    )


def guard_polish(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """``(key, accepted, reason)`` for polished drafts ``(key, text)``: the markers
    must be the same, the section marks must come back in order, and nothing may
    precede the first."""
    both = before.select(key, F.col("text").alias("b")).join(after.select(key, F.col("text").alias("a")), key)
    trimmed = tx.strip("a")
    reason = (
        F.when(~ct.same_markers("b", "a"), "other citations than before")
        .when(
            (tx.strip(F.get(ct.section_bodies(trimmed), F.lit(0))) != "")
            | (ct.section_titles("a") != ct.section_titles("b")),
            "other sections than before",
        )
    )
    return both.select(key, reason.isNull().alias("accepted"), reason.alias("reason"))


def polished_sections(text: DataFrame, key: str = "key") -> DataFrame:
    """Split an accepted polished draft: ``(key, section_ord, title, markdown)``."""
    bodies = F.slice(ct.section_bodies("text"), F.lit(2), F.greatest(F.size(ct.section_bodies("text")) - 1, F.lit(0)))
    pairs = F.arrays_zip(ct.section_titles("text").alias("title"), bodies.alias("markdown"))
    return text.select(key, F.posexplode(pairs).alias("section_ord", "s")).select(
        key, "section_ord", "s.title", tx.strip("s.markdown").alias("markdown")
    )


def check_plan(plan: DataFrame) -> DataFrame:
    """One row per broken rule: 8 to 15 sub-questions, unique ids, 2 to 4 queries."""
    total = plan.agg(F.count("*").alias("n"), F.count_distinct("sub_question_id").alias("ids"),
                     F.count_if(~F.size("queries").between(2, 4)).alias("bad"))
    problems = F.array_compact(
        F.array(
            F.when(~F.col("n").between(8, 15), "a plan has 8 to 15 sub-questions"),
            F.when(F.col("n") != F.col("ids"), "sub-question ids must be unique"),
            F.when(F.col("bad") > 0, "a sub-question has 2 to 4 queries"),
        )
    )
    return total.select(F.explode(problems).alias("problem"))
