"""Chat formatting with every speaker in the assistant's place, with DataFrame operations only.

For each participant of a conversation the whole dialogue is rendered once: the participant's turns as assistant,
all others as named users, system turns as system. The loss mask covers what the participant said, with the end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.scan import row_rank, running_sum
from attesta.session import cut_lineage

#: Marks of the chat format (fixed values).
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_SYSTEM = "system"
#: A piece of a conversation takes the turns that begin within so many code points.
SEGMENT_CHARS = 1 << 20


def _escaped(c: Column) -> Column:
    """Text that cannot be taken for a mark: a space parts ``<`` from ``|``."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def perspective_segments(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Conversations from every participant's side in pieces: the conversation, perspective, segment, n_turns, rendered, mask (array of start and
    end in code points of the whole text, end exclusive).

    Participants are the distinct speakers other than ``system``. Null texts are empty, null speakers are called
    ``unknown``, turns are ordered by number (null first), then speaker and text; repeated rows are repeated turns.
    Turns without a conversation form one of their own with a null id. A conversation with system turns
    only has no participant and no row. Marks inside texts and names are broken up, line ends in names too. Joined in the order of
    ``segment`` the pieces are the whole text. A piece takes turns of about ``SEGMENT_CHARS``, at least one; no task sees a conversation as a whole.
    """
    name = F.regexp_replace(_escaped(F.coalesce(F.col(speaker).cast("string"), F.lit("unknown"))), r"[\r\n]+", " ")
    rows = turns.select(
        F.col(conversation).alias("_conv"),
        F.col(turn).alias("_turn"),
        name.alias("_name"),
        _escaped(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_text"),
        # Tells equal turns apart; which of them comes first does not matter.
        F.monotonically_increasing_id().alias("_row"),
    )
    user_head = F.when(F.col("_name") == _SYSTEM, F.lit(OPEN + _SYSTEM)).otherwise(F.concat(F.lit(OPEN + "user name="), F.col("_name")))
    own_head = len(OPEN + "assistant")
    # Where a turn stands if its speaker is the assistant: all turns before at their length as a user, and the speaker's own
    # turns before by how much shorter or longer their head is. Both are running sums over ranges, however long a conversation is.
    as_user = F.char_length(user_head).cast("long") + F.char_length("_text") + len(CLOSE) + 2
    placed = running_sum(rows, as_user, [F.col("_turn"), F.col("_name"), F.col("_text"), F.col("_row")], "_upto", ["_conv"])
    placed = placed.select("_conv", "_name", "_text", (F.col("_upto") - as_user).alias("_all"))
    placed = row_rank(placed, [F.col("_all")], "_nth", ["_conv", "_name"])
    start = F.col("_all") + (F.col("_nth") - 1) * (F.lit(own_head).cast("long") - F.char_length(user_head)) + own_head + 1
    entry = F.struct("_all", "_name", "_text", start.alias("start"), (start + F.char_length("_text") + len(CLOSE)).alias("end"))
    # A null conversation is a key like any other.
    key = F.when(F.col("_conv").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("_conv").cast("string"))).alias("_key")
    pieces = placed.groupBy("_conv", F.floor(F.col("_all") / SEGMENT_CHARS).alias("segment")).agg(F.array_sort(F.collect_list(entry)).alias("t"))
    pieces = cut_lineage(pieces.select(key, "_conv", "segment", "t"))
    people = pieces.select("_key", F.explode("t._name").alias("perspective")).filter(F.col("perspective") != _SYSTEM).distinct()
    # Participants meet the numbers of the pieces first; the texts are then dealt out by piece, not by conversation.
    each = pieces.join(people.join(pieces.select("_key", "segment"), "_key"), ["_key", "segment"])
    head = lambda x: (
        F.when(x["_name"] == F.col("perspective"), F.lit(OPEN + "assistant"))
        .when(x["_name"] == _SYSTEM, F.lit(OPEN + _SYSTEM))
        .otherwise(F.concat(F.lit(OPEN + "user name="), x["_name"]))
    )
    rendered = F.array_join(F.transform("t", lambda x: F.concat(head(x), F.lit("\n"), x["_text"], F.lit(CLOSE + "\n"))), "")
    own = F.filter("t", lambda x: x["_name"] == F.col("perspective"))
    mask = F.transform(own, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return each.select(
        F.col("_conv").alias(conversation), "perspective", "segment", F.size("t").cast("long").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask")
    )


def rotate_perspectives(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation and participant: the conversation, perspective, n_turns, rendered, n_chars, mask
    (array of start and end in code points, end exclusive), mask_chars.

    The pieces of ``perspective_segments`` joined: here, and only here, a conversation has to fit in a row as a text.
    """
    pieces = perspective_segments(turns, conversation, turn, speaker, text)
    whole = pieces.groupBy(conversation, "perspective").agg(F.array_sort(F.collect_list(F.struct("segment", "n_turns", "rendered", "mask"))).alias("p"))
    out = whole.select(
        conversation, "perspective",
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n_turns"]).alias("n_turns"),
        F.array_join(F.col("p.rendered"), "").alias("rendered"), F.flatten("p.mask").alias("mask"),
    )
    total = F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(conversation, "perspective", "n_turns", "rendered", F.char_length("rendered").cast("long").alias("n_chars"), "mask", total.alias("mask_chars"))


def op8_perspectives(spark, sf_dir: str) -> DataFrame:
    """All conversations from every participant's side; spans as text, so that SQL can be held against it."""
    out = rotate_perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "n_turns", "rendered", "n_chars", spans.alias("mask_spans"), "mask_chars")


PERSPECTIVES_SQL = r"""
WITH t AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
parts AS (
  SELECT p.conv_id, p.perspective, t.turn, t.who, t.said,
         CASE WHEN t.who = p.perspective THEN '<|im_start|>assistant' WHEN t.who = 'system' THEN '<|im_start|>system'
              ELSE '<|im_start|>user name=' || t.who END AS head
  FROM people p JOIN t ON t.conv_id = p.conv_id),
placed AS (
  SELECT *, head || chr(10) || said || '<|im_end|>' || chr(10) AS part,
         coalesce(sum(length(head || said) + 12) OVER (PARTITION BY conv_id, perspective ORDER BY turn, who, said
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM parts)
SELECT conv_id, perspective, count(*) AS n_turns, string_agg(part, '' ORDER BY turn, who, said) AS rendered,
       CAST(sum(length(part)) AS BIGINT) AS n_chars,
       string_agg(CASE WHEN who = perspective THEN CAST(pos + length(head) + 1 AS BIGINT)::VARCHAR || '-' || CAST(pos + length(head) + 1 + length(said) + 10 AS BIGINT)::VARCHAR END,
                  ',' ORDER BY turn, who, said) AS mask_spans,
       CAST(sum(CASE WHEN who = perspective THEN length(said) + 10 ELSE 0 END) AS BIGINT) AS mask_chars
FROM placed GROUP BY conv_id, perspective
"""
