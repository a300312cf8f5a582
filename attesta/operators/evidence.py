"""Evidence: budgeted selection, citation numbers, corpus and digests.

Evidence rows follow :data:`attesta.schemas.EVIDENCE`. Their global order is
(sub-question, rerank score from high to low, chunk id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions.citations import corpus_entry, reference_line
from attesta.functions.tokens import BY_LENGTH, TokenCounter
from attesta.operators.scan import row_rank
from attesta.operators.topk import top_k
from attesta.session import cut_lineage

# Claims per sub-question that a digest tries in turn, and the
# length of a claim in the last attempt.
DIGEST_STEPS = [40, 20, 10, 5, 3, 1]
LAST_CLAIM_CHARS = 160
# Characters an entry has besides its fields; an entry never costs fewer tokens.
_ENTRY_FRAME = len("[0] source:  | section: \nclaim: \nevidence: \ntext: ")
MIN_ENTRY_TOKENS = _ENTRY_FRAME // 4
EMPTY_CORPUS = "EVIDENCE CORPUS\n"


def global_order() -> list[Column]:
    return [F.col("sub_question_id"), -F.col("rerank_score"), F.col("chunk_id")]


def _entry(number: Column | str | int) -> Column:
    return corpus_entry(number, "url", "heading_path", "claim", "evidence_span", "text")


def select_evidence(evidence: DataFrame, budget_tokens: int, by: str | None = None, counter: TokenCounter = BY_LENGTH) -> DataFrame:
    """Trim evidence to a token budget, round-robin over the sub-questions. With
    ``by`` every value of that column has the budget to itself. Entries cost their tokens by ``counter``, one at least.

    Entries are visited by (rank within the sub-question, sub-question). One that
    no longer fits is skipped and the visit goes on.

    What was spent never shrinks, so once an entry of some cost is refused, every
    later entry of that cost is refused too: the kept ones of a cost are the first
    ones of that cost, and at most ``budget / cost`` of them. Keeping just those
    per cost loses nothing and leaves a number of rows that depends on the budget
    alone. Only they are walked through in sequence.
    """
    group = [by] if by else []
    ids = [*group, "sub_question_id", "chunk_id"]
    # Ids, scores and costs only: they are read several times, the texts once.
    cost = F.greatest(F.lit(1), counter.count(_entry(0)))
    priced = cut_lineage(evidence.select(*ids, "rerank_score", cost.alias("cost")))
    # No entry is cheaper than its frame by length; by another counter the cheapest one tells how many fit.
    least = MIN_ENTRY_TOKENS if counter is BY_LENGTH else priced.agg(F.min("cost")).first()[0] or 1
    ranked = row_rank(
        priced,
        [-F.col("rerank_score"), F.col("chunk_id")],
        out="rank",
        partition=[*group, "sub_question_id"],
    )
    fits = ranked.filter(F.col("cost") <= budget_tokens)
    most = max(1, budget_tokens // least)
    first = top_k(fits, [*group, "cost"], [F.col("rank"), F.col("sub_question_id")], most, salt_on=ids)
    first = first.filter(F.col("rn") <= F.floor(F.lit(budget_tokens) / F.col("cost")))
    visit = first.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("rank", "sub_question_id", "chunk_id", "cost"))).alias("v"))

    def step(acc: Column, e: Column) -> Column:
        item = F.struct(e["sub_question_id"].alias("sub_question_id"), e["chunk_id"].alias("chunk_id"))
        return F.when(
            acc["spent"] + e["cost"] <= budget_tokens,
            F.struct((acc["spent"] + e["cost"]).alias("spent"), F.array_append(acc["kept"], item).alias("kept")),
        ).otherwise(acc)

    types = dict(evidence.dtypes)
    kept_type = f"array<struct<sub_question_id:{types['sub_question_id']},chunk_id:{types['chunk_id']}>>"
    zero = F.struct(F.lit(0).alias("spent"), F.array().cast(kept_type).alias("kept"))
    walked = visit.select(*group, F.posexplode_outer(F.aggregate("v", zero, step)["kept"]).alias("visit_no", "k"))
    chosen = walked.filter(F.col("k").isNotNull()).select(*group, "visit_no", "k.*")
    # At most budget / least rows per budget, here and in the result.
    return cut_lineage(evidence.join(F.broadcast(chosen), ids))


def number_citations(evidence: DataFrame) -> DataFrame:
    """``(chunk_id, number)``: chunks numbered 1..n by where they first occur in
    the global order. A chunk that serves several sub-questions has one number.

    Number what was selected, not everything that was collected.
    """
    place = F.min(F.struct("sub_question_id", (-F.col("rerank_score")).alias("neg")))
    first = evidence.groupBy("chunk_id").agg(place.alias("p")).select("chunk_id", "p.*")
    numbered = row_rank(first, [F.col("sub_question_id"), F.col("neg"), F.col("chunk_id")], out="number")
    return numbered.select("chunk_id", "number")


def citation_table(evidence: DataFrame) -> DataFrame:
    """The citation index: number, chunk, source and offsets."""
    fields = ["url", "doc_title", "heading_path", "start_char", "end_char"]
    source = evidence.groupBy("chunk_id").agg(F.first(F.struct(*fields)).alias("s"))
    return number_citations(evidence).join(source, "chunk_id").select(
        "number", "chunk_id", "s.url", F.col("s.doc_title").alias("title"), "s.heading_path", "s.start_char", "s.end_char"
    )


def corpus_lines(selected: DataFrame) -> DataFrame:
    """Numbered corpus entries: ``(sub_question_id, chunk_id, pos, number, entry)``
    with ``pos`` counting in the global order."""
    numbered = selected.join(number_citations(selected), "chunk_id")
    placed = row_rank(numbered, global_order(), out="pos")
    return placed.select("sub_question_id", "chunk_id", "pos", "number", _entry("number").alias("entry"))


def corpora(lines: DataFrame, by: list[str]) -> DataFrame:
    """``(by.., corpus)``: the corpus of each group of numbered entries. For
    selected, hence bounded, sets."""
    items = F.sort_array(F.collect_list(F.struct("pos", "entry")))
    parts = lines.groupBy(*by, "sub_question_id").agg(items.alias("items")).select(
        *by,
        "sub_question_id",
        F.concat(
            F.lit("### Sub-question "), F.col("sub_question_id"), F.lit("\n\n"),
            F.array_join(F.transform("items", lambda i: F.concat(i["entry"], F.lit("\n"))), "\n"),
        ).alias("part"),
    )
    joined = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("sub_question_id", "part"))).alias("p"))
    body = F.array_join(F.transform("p", lambda p: p["part"]), "\n")
    # An empty corpus is its two opening lines.
    text = F.when(F.size("p") > 0, F.concat(F.lit("EVIDENCE CORPUS\n\n"), body)).otherwise(EMPTY_CORPUS)
    return joined.select(*by, text.alias("corpus"))


def corpus_text(selected: DataFrame) -> DataFrame:
    """One row with the whole corpus."""
    return corpora(corpus_lines(selected), [])


def section_corpora(selected: DataFrame, sections: DataFrame, budget_tokens: int) -> DataFrame:
    """``(section_ord, corpus)``: each section's own sub-questions within its own
    budget, numbered as in the whole."""
    own = sections.select("section_ord", F.explode("sub_question_ids").alias("sub_question_id"))
    kept = select_evidence(selected.drop("visit_no").join(own, "sub_question_id"), budget_tokens, by="section_ord")
    ids = ["sub_question_id", "chunk_id"]
    return corpora(corpus_lines(selected).join(kept.select("section_ord", *ids), ids), ["section_ord"])


def references(citations: DataFrame) -> DataFrame:
    """``(number, line)`` of the references section."""
    line = reference_line("number", "title", "url", "heading_path", "chunk_id", "start_char", "end_char")
    return citations.select("number", line.alias("line"))


def references_text(citations: DataFrame) -> DataFrame:
    """One row with the references section. For a selected, hence bounded, set."""
    rows = references(citations).agg(F.sort_array(F.collect_list(F.struct("number", "line"))).alias("r"))
    body = F.array_join(F.transform("r", lambda r: r["line"]), "\n")
    return rows.select(
        F.when(F.size("r") > 0, F.concat(F.lit("## References\n\n"), body)).otherwise("## References\n").alias("references")
    )


def top_claims(evidence: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``(sub_question_id, claims)``: the first ``n`` claims per sub-question."""
    first = top_k(evidence, ["sub_question_id"], order, n, salt_on=["chunk_id"])
    return first.groupBy("sub_question_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rn", "claim"))), lambda c: c["claim"]).alias("claims")
    )


def _digest_part(claims: Column) -> Column:
    lines = F.when(
        F.size(claims) > 0, F.transform(claims, lambda c: F.concat(F.lit("  claim: "), c))
    ).otherwise(F.array(F.lit("  (no evidence collected)")))
    head = F.array(
        F.concat(F.col("sub_question_id"), F.lit(": "), F.col("question")),
        F.concat(F.lit("  success criterion: "), F.col("success_criterion")),
    )
    return F.array_join(F.concat(head, lines, F.array(F.lit(""))), "\n")


def _opening(chars: int):
    return lambda c: F.substring(c, 1, chars)


def _digests(plan: DataFrame, evidence: DataFrame, steps: list[tuple[int, int | None]]) -> DataFrame:
    """``(step, digest)``: one digest of the plan per (claims, cut) step. A plan has
    at most 15 sub-questions, and a sub-question at most 40 claims here."""
    widest = max(n for n, _ in steps)
    claims = top_claims(evidence, [F.col("ord")], widest)
    rows = plan.join(claims, "sub_question_id", "left").withColumn(
        "claims", F.coalesce("claims", F.array().cast("array<string>"))
    )
    parts = []
    for i, (n, cut) in enumerate(steps):
        few = F.slice(F.col("claims"), 1, n)
        if cut is not None:
            few = F.transform(few, _opening(cut))
        parts.append(F.struct(F.lit(i).alias("step"), _digest_part(few).alias("part")))
    exploded = rows.select("sq_ord", F.explode(F.array(*parts)).alias("d")).select("sq_ord", "d.*")
    joined = exploded.groupBy("step").agg(F.sort_array(F.collect_list(F.struct("sq_ord", "part"))).alias("p"))
    return joined.select("step", F.array_join(F.transform("p", lambda p: p["part"]), "\n").alias("digest"))


def coverage_digest(plan: DataFrame, evidence: DataFrame, max_claims: int = 40, cut: int | None = None) -> DataFrame:
    """One row: per sub-question its criterion and its first claims in the order
    they were collected. Sub-questions without evidence are listed too."""
    return _digests(plan, evidence, [(max_claims, cut)]).select("digest")


def budgeted_digest(plan: DataFrame, evidence: DataFrame, budget_tokens: int) -> DataFrame:
    """The digest with the most claims that fits the budget; where none fits, one
    shortened claim per sub-question, whatever that costs."""
    steps = [(n, None) for n in DIGEST_STEPS] + [(1, LAST_CLAIM_CHARS)]
    tried = _digests(plan, evidence, steps)
    last = len(steps) - 1
    usable = tried.filter((tx.token_count("digest") <= budget_tokens) | (F.col("step") == last))
    return usable.agg(F.min_by("digest", "step").alias("digest"), F.min("step").alias("step"))


def section_digest(plan: DataFrame, selected: DataFrame, per_question: int = 3) -> DataFrame:
    """One row: the strongest claims per sub-question with their citation numbers,
    for the sections that span the whole plan."""
    numbered = selected.join(number_citations(selected), "chunk_id").withColumn(
        "claim", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("claim"))
    )
    best = top_claims(numbered, [-F.col("rerank_score"), F.col("chunk_id")], per_question)
    rows = plan.join(best, "sub_question_id", "left")
    claims = F.when(F.size(F.coalesce("claims", F.array().cast("array<string>"))) > 0, F.col("claims")).otherwise(
        F.array(F.lit("(no evidence collected)"))
    )
    head = F.array(F.concat(F.lit("### "), F.col("sub_question_id"), F.lit(": "), F.col("question")))
    part = F.array_join(F.concat(head, claims, F.array(F.lit(""))), "\n")
    joined = rows.select("sq_ord", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("sq_ord", "part"))).alias("p")
    )
    body = F.array_join(F.transform("p", lambda p: p["part"]), "\n")
    return joined.select(F.concat(F.lit("EVIDENCE DIGEST (key claims per sub-question)\n\n"), body).alias("digest"))
