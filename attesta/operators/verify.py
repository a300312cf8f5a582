"""Claims of a draft against the chunks they cite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.config import VerifySettings
from attesta.functions import citations as ct
from attesta.functions import text as tx
from attesta.session import spread_out

# Fixed value: how a list line begins.
_LIST_LINE = rf"^{tx.SPACE}*(?:[-*]|\p{{Nd}}+[.)]){tx.SPACE}+"


def split_pieces(draft: DataFrame, key: list[str], markdown: str = "markdown") -> DataFrame:
    """Markdown into blocks and their sentences or list lines:
    ``(key.., block_no, piece_no, passthrough, is_list, piece)``.

    Blocks are parted by blank lines. Headings, quotes, tables and code stay whole.
    A block whose lines all are list items is split by line, any other by sentence.
    """
    parts = F.transform(F.split(markdown, rf"\n{tx.SPACE}*\n", -1), tx.strip)
    # Outer explodes: the plain ones make the optimizer compute the arrays twice.
    blocks = draft.select(*key, F.posexplode_outer(parts).alias("block_no", "block"))
    whole = (F.col("block") == "") | F.col("block").rlike(r"^(?:#|>|\||```)")
    lines = F.filter(F.split("block", r"\r\n|\n|\r"), lambda ln: tx.strip(ln) != "")
    cut = chr(0xFFFF)
    prose = F.split(F.regexp_replace("block", f"([.!?]){tx.SPACE}+", f"$1{cut}"), cut, -1)

    def split_block(ls: Column) -> Column:
        listed = F.forall(ls, lambda ln: ln.rlike(_LIST_LINE))
        return F.when(listed, F.struct(F.lit(True).alias("is_list"), ls.alias("pieces"))).otherwise(
            F.struct(F.lit(False).alias("is_list"), prose.alias("pieces"))
        )

    as_is = F.struct(F.lit(False).alias("is_list"), F.array("block").alias("pieces"))
    split = blocks.withColumn("passthrough", whole).withColumn(
        "s", F.when(F.col("passthrough"), as_is).otherwise(tx.let(lines, split_block))
    )
    return split.select(
        *key, "block_no", "passthrough", F.col("s.is_list").alias("is_list"),
        F.posexplode_outer("s.pieces").alias("piece_no", "piece"),
    ).filter(F.col("piece_no").isNotNull())


def attach_evidence(
    pieces: DataFrame, key: list[str], citations: DataFrame, chunks: DataFrame, settings: VerifySettings | None = None
) -> DataFrame:
    """Add ``numbers`` and ``evidence``: the cited chunks' texts in marker order,
    each cut, joined by blank lines, and cut again. A marker that resolves to
    nothing is passed over; a repeated one repeats its text. ``evidence`` is empty
    where nothing resolves."""
    settings = settings or VerifySettings()
    pieces = pieces.withColumn("numbers", F.when(F.col("passthrough"), F.array().cast("array<bigint>"))
                               .otherwise(ct.markers("piece")))
    cited = citations.select("number", "chunk_id").join(
        chunks.select("chunk_id", F.substring("text", 1, settings.chars_per_chunk).alias("t")), "chunk_id"
    )
    # The text follows from the list of numbers alone, so it is put together once per list.
    lists = pieces.filter(F.size("numbers") > 0).select("numbers").distinct()
    found = lists.select("numbers", F.posexplode("numbers").alias("pos", "number")).join(cited.select("number", "t"), "number")
    found = found.groupBy("numbers").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("ts"))
    joined = F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n")
    text = found.select("numbers", F.substring(joined, 1, settings.chars_total).alias("evidence"))
    return pieces.join(text, "numbers", "left").select(*pieces.columns, F.coalesce("evidence", F.lit("")).alias("evidence"))


def judge(
    pieces: DataFrame,
    score: Callable[[Column, Column], Column],
    rewrites: Callable[[Column, Column], Column] | None = None,
    settings: VerifySettings | None = None,
) -> DataFrame:
    """Add ``entailment_score``, ``action``, ``rewrite_attempts`` and the final
    ``text`` to the pieces that carry evidence.

    ``score(text, evidence)`` is any column; ``rewrites(text, evidence)`` gives an
    array of attempts in order. The first attempt that is not empty, cites a
    non-empty subset of the original markers and scores at or above the floor
    replaces a failing piece; without one the piece is dropped.
    """
    settings = settings or VerifySettings()
    is_claim = F.col("evidence") != ""
    first = spread_out(pieces).withColumn(
        "_score", F.when(is_claim, score(F.col("piece"), F.col("evidence")).cast("double"))
    ).withColumn("_fails", is_claim & (F.col("_score") < settings.floor))
    tries = (
        F.array().cast("array<string>")
        if rewrites is None
        else F.slice(rewrites(F.col("piece"), F.col("evidence")), 1, settings.max_rewrites)
    )
    first = first.withColumn("_tries", F.when(F.col("_fails"), tries))

    def accepted(attempt: Column, n: int) -> Column:
        cites = ct.markers(attempt)
        allowed = (attempt != "") & (F.size(cites) > 0) & (F.size(F.array_except(cites, F.col("numbers"))) == 0)
        value = F.when(allowed, score(attempt, F.col("evidence")).cast("double"))
        return tx.let(
            value,
            lambda v: F.when(
                v >= settings.floor,
                F.struct(attempt.alias("text"), v.alias("score"), F.lit(n + 1).alias("n")),
            ),
        )

    for n in range(settings.max_rewrites):
        # A separate column, so that a score that is a model is called at top level.
        first = first.withColumn(f"_text{n}", tx.strip(F.get("_tries", F.lit(n))))
        first = first.withColumn(f"_try{n}", F.when(F.col("_fails"), accepted(F.col(f"_text{n}"), n)))
    taken = F.coalesce(*[F.col(f"_try{n}") for n in range(settings.max_rewrites)]) if settings.max_rewrites else F.lit(None)
    first = first.withColumn("_taken", taken) if settings.max_rewrites else first.withColumn(
        "_taken", F.lit(None).cast("struct<text:string,score:double,n:int>")
    )
    return first.select(
        *pieces.columns,
        F.when(F.col("_fails") & F.col("_taken").isNotNull(), F.col("_taken.score")).otherwise(F.col("_score")).alias("entailment_score"),
        F.when(~is_claim, F.lit(None).cast("string"))
        .when(~F.col("_fails"), "kept")
        .when(F.col("_taken").isNotNull(), "rewritten")
        .otherwise("dropped")
        .alias("action"),
        F.when(~F.col("_fails"), 0).otherwise(F.coalesce("_taken.n", F.lit(settings.max_rewrites))).alias("rewrite_attempts"),
        F.coalesce("_taken.text", "piece").alias("text"),
    )


def summarize(judged: DataFrame) -> DataFrame:
    """One row of counts; the mean score is over the survivors, 0 without any."""
    action = F.col("action")
    return judged.agg(
        F.count("action").alias("total_claims"),
        *[F.count_if(action == a).alias(a) for a in ("kept", "rewritten", "dropped")],
        F.coalesce(F.avg(F.when(action != "dropped", F.col("entailment_score"))), F.lit(0.0)).alias("mean_entailment_score"),
    )


def verification_bar(summary: DataFrame) -> DataFrame:
    """Counts for the chart; no row where nothing was checked."""
    kept = F.col("total_claims") - F.col("rewritten") - F.col("dropped")
    return summary.filter("total_claims > 0").select(kept.alias("kept"), "rewritten", "dropped")


def rebuild(judged: DataFrame, key: list[str]) -> DataFrame:
    """Put the surviving pieces together again: ``(key.., markdown)``. Sentences
    are joined by one blank, list lines by a line break, blocks by a blank line."""
    gone = F.col("action").eqNullSafe("dropped") | (F.col("passthrough") & (F.col("piece") == ""))
    left = judged.filter(~gone)
    items = F.sort_array(F.collect_list(F.struct("piece_no", "text")))
    blocks = left.groupBy(*key, "block_no").agg(items.alias("p"), F.bool_and("is_list").alias("is_list"))
    texts = F.transform("p", lambda p: p["text"])
    blocks = blocks.withColumn(
        "block", F.when(F.col("is_list"), F.array_join(texts, "\n")).otherwise(F.array_join(texts, " "))
    )
    whole = blocks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("block_no", "block"))).alias("b"))
    joined = whole.select(*key, tx.strip(F.array_join(F.transform("b", lambda b: b["block"]), "\n\n")).alias("markdown"))
    everyone = judged.select(*key).distinct()
    return everyone.join(joined, key, "left").withColumn("markdown", F.coalesce("markdown", F.lit("")))


def dangling(texts: DataFrame, key: list[str], markdown: str, citations: DataFrame) -> DataFrame:
    """``(key.., number)`` of the markers that no citation answers to."""
    cited = texts.select(*key, F.explode(ct.markers(markdown)).alias("number"))
    return cited.join(citations.select("number"), "number", "left_anti").select(*key, "number").distinct()
