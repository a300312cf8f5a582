"""Documents to overlapping, token-aware chunks.

A document is one row with its blocks. Everything from sentence spans to packed
chunks is computed inside that row with array functions, so chunking is a
projection and an explode: no shuffle, no Python, and no group that could grow
hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.config import ChunkSettings
from attesta.functions import text as tx
from attesta.functions.tokens import BY_LENGTH, TokenCounter
from attesta.functions.urls import chunk_id

_WINDOW = "array<struct<i:int,b:int,t:int>>"
_RANGES = "array<struct<first:int,last:int,b:int,e:int>>"
_GROUPS = "array<struct<heading_path:array<string>,start:int,parts:array<string>>>"


def pack_sentences(
    lengths: Column, settings: ChunkSettings, counter: TokenCounter = BY_LENGTH, counts: Column | None = None, text: Column | None = None
) -> Column:
    """Greedy packing of sentences, given their lengths in characters, and their tokens (``counts``) and the whole ``text`` unless the
    counter goes by length.

    One pass over the sentences. The state is the open chunk (its sentences and
    where it ends) and the closed ones. A sentence that would push the open
    chunk over the target closes it; the next chunk opens with the shortest tail
    of the closed one that holds ``overlap_tokens``, never with all of it. A
    last chunk under ``min_tokens`` joins the one before. The result is an array
    of ``(first, last, b, e)``: sentence numbers and character offsets.
    """

    if counter.run == "length":
        items = F.transform(lengths, lambda n: F.struct(n.alias("n"), counter.of_length(n).alias("t")))
    else:
        items = F.zip_with(lengths, counts, lambda n, t: F.struct(n.alias("n"), t.cast("int").alias("t")))

    def tokens_of(win: Column, end: Column, more: Column) -> Column:
        """Tokens of the open chunk up to ``end``; ``more``: those of a sentence that the window does not hold yet."""
        if counter.run == "length":
            return counter.of_length(end - win[0]["b"])
        if counter.run == "sum":
            return F.aggregate(win, more, lambda total, s: total + s["t"])
        return counter.count(F.substring(text, win[0]["b"] + 1, end - win[0]["b"]))

    def overlap(win: Column) -> Column:
        if settings.overlap_tokens <= 0:
            return F.array().cast(_WINDOW)
        tail = F.slice(win, 2, F.greatest(F.size(win) - 1, F.lit(0)))
        need = F.aggregate(
            F.reverse(tail),
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")),
            lambda acc, s: F.when(acc["sum"] >= settings.overlap_tokens, acc).otherwise(
                F.struct((acc["sum"] + s["t"]).alias("sum"), (acc["n"] + 1).alias("n"))
            ),
        )["n"]
        return F.slice(tail, F.size(tail) - need + 1, need)

    def state(closed: Column, win: Column, e: Column, i: Column) -> Column:
        return F.struct(closed.alias("closed"), win.alias("win"), e.alias("e"), i.alias("i"))

    def closing(acc: Column) -> Column:
        win = acc["win"]
        return F.struct(
            win[0]["i"].alias("first"), (acc["i"] - 1).alias("last"), win[0]["b"].alias("b"), acc["e"].alias("e")
        )

    def step(acc: Column, s: Column) -> Column:
        end = acc["e"] + s["n"]
        item = F.struct(acc["i"].alias("i"), acc["e"].alias("b"), s["t"].alias("t"))
        fits = tokens_of(acc["win"], end, s["t"]) <= settings.target_tokens
        return F.when(
            (F.size(acc["win"]) == 0) | fits,
            state(acc["closed"], F.array_append(acc["win"], item), end, acc["i"] + 1),
        ).otherwise(
            state(
                F.array_append(acc["closed"], closing(acc)),
                F.array_append(overlap(acc["win"]), item),
                end,
                acc["i"] + 1,
            )
        )

    def finish(acc: Column) -> Column:
        last = closing(acc)
        tiny = tokens_of(acc["win"], last["e"], F.lit(0)) < settings.min_tokens
        n = F.size(acc["closed"])
        before = F.element_at(acc["closed"], -1)
        merged = F.struct(
            before["first"].alias("first"), last["last"].alias("last"), before["b"].alias("b"), last["e"].alias("e")
        )
        return F.when(
            (n > 0) & tiny, F.array_append(F.slice(acc["closed"], F.lit(1), n - 1), merged)
        ).otherwise(F.array_append(acc["closed"], last))

    zero = state(F.array().cast(_RANGES), F.array().cast(_WINDOW), F.lit(0), F.lit(0))
    return F.aggregate(items, zero, step, finish)


def heading_groups(blocks: Column) -> Column:
    """Runs of consecutive blocks under one heading path, with the offset of
    each run in the document text: ``array<struct<heading_path, start, text>>``."""
    at = F.sequence(F.lit(0), F.size(blocks) - 1)
    opens = F.filter(
        at, lambda i: (i == 0) | (blocks[i]["heading_path"] != blocks[F.greatest(i - 1, F.lit(0))]["heading_path"])
    )

    def run(starts: Column, s: Column, j: Column) -> Column:
        until = F.when(j + 1 < F.size(starts), F.get(starts, j + 1)).otherwise(F.size(blocks))
        texts = F.transform(F.slice(blocks, s + 1, until - s), lambda b: b["text"])
        return F.struct(
            blocks[s]["heading_path"].alias("heading_path"), F.array_join(texts, "\n\n").alias("text")
        )

    def placed(runs: Column) -> Column:
        ends = tx.running_total(F.transform(runs, lambda r: F.length(r["text"]) + 2))
        return F.zip_with(
            runs,
            ends,
            lambda r, e: F.struct(
                r["heading_path"].alias("heading_path"),
                (e - F.length(r["text"]) - 2).cast("int").alias("start"),
                r["text"].alias("text"),
            ),
        )

    runs = tx.let(opens, lambda starts: F.transform(starts, lambda s, j: run(starts, s, j)))
    return tx.let(runs, placed)


def _split(groups: Column) -> Column:
    return F.transform(
        groups,
        lambda g: F.struct(
            g["heading_path"].alias("heading_path"),
            g["start"].alias("start"),
            tx.sentences(g["text"]).alias("parts"),
        ),
    )


def _pieces(split: Column, settings: ChunkSettings, counter: TokenCounter, counted: Column | None) -> Column:
    """Chunks of all groups in order. Each step names its result in a struct, so
    that sentences, counts and ranges are computed once per group. ``counted``: tokens of each group's sentences, if they are known."""
    if counted is not None:
        split = F.arrays_zip(split.alias("g"), counted.alias("c"))
    elif counter.run == "length":
        split = F.transform(split, lambda g: F.struct(g.alias("g")))
    else:
        split = F.transform(split, lambda g: F.struct(g.alias("g"), F.transform(g["parts"], counter.count).alias("c")))

    def ranges(g: Column, counts: Column | None) -> Column:
        lengths = F.transform(g["parts"], lambda s: F.length(s))
        if counter.run == "text":
            return tx.let(F.array_join(g["parts"], ""), lambda text: pack_sentences(lengths, settings, counter, counts, text))
        return pack_sentences(lengths, settings, counter, counts)

    packed = F.transform(
        split,
        lambda x: F.struct(
            x["g"]["heading_path"].alias("heading_path"),
            x["g"]["start"].alias("start"),
            x["g"]["parts"].alias("parts"),
            ranges(x["g"], None if counter.run == "length" else x["c"]).alias("ranges"),
        ),
    )

    def cut(g: Column, r: Column) -> Column:
        return F.struct(
            g["heading_path"].alias("heading_path"),
            F.array_join(F.slice(g["parts"], r["first"] + 1, r["last"] - r["first"] + 1), "").alias("text"),
            (g["start"] + r["b"]).alias("start_char"),
            (g["start"] + r["e"]).alias("end_char"),
        )

    return F.flatten(F.transform(packed, lambda g: F.transform(g["ranges"], lambda r: cut(g, r))))


def chunk_documents(docs: DataFrame, settings: ChunkSettings | None = None, counter: TokenCounter = BY_LENGTH) -> DataFrame:
    """``(url, title, blocks)`` to chunks in :data:`attesta.schemas.CHUNK` form.

    ``blocks`` is ``array<struct<heading_path:array<string>,text:string>>``.
    Other columns of ``docs`` are passed through in front. Sizes in the settings are tokens of ``counter``.
    """
    settings = settings or ChunkSettings()
    extra = [c for c in docs.columns if c not in ("url", "title", "blocks")]
    groups = F.filter(F.when(F.size("blocks") > 0, heading_groups(F.col("blocks"))), lambda g: tx.strip(g["text"]) != "")
    # The outer form, then dropping the empty row: for the plain one the optimizer
    # adds a filter on the array's size that would compute all chunks twice.
    split, counted = _split(groups), None
    if counter.batch is not None:
        # Column names of the caller stay free.
        split_name, counted_name = (f"_{n}_{len(docs.columns)}_of_chunking" for n in ("split", "counted"))
        docs = docs.select("*", F.coalesce(split, F.array().cast(_GROUPS)).alias(split_name))
        docs = docs.withColumn(counted_name, counter.batch(F.transform(split_name, lambda g: g["parts"])))
        split, counted = F.col(split_name), F.col(counted_name)
    rows = docs.select(
        *extra, "url", "title", F.posexplode_outer(_pieces(split, settings, counter, counted)).alias("position", "c")
    ).filter(F.col("position").isNotNull())
    return rows.select(
        *extra,
        chunk_id("url", "position").alias("chunk_id"),
        "url",
        F.coalesce("title", F.lit("")).alias("doc_title"),
        "c.heading_path",
        "c.text",
        counter.count(F.col("c.text")).alias("token_count"),
        "position",
        "c.start_char",
        "c.end_char",
    )


def as_single_block(docs: DataFrame, url: Column, title: Column, text: Column, *extra: str) -> DataFrame:
    """Plain texts as documents of one block at the top level."""
    block = F.struct(F.array().cast("array<string>").alias("heading_path"), text.alias("text"))
    return docs.select(*extra, url.alias("url"), title.alias("title"), F.array(block).alias("blocks"))


def sentence_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, sentence_no, start_char, end_char)``, gap-free over each text."""
    lengths = F.transform(tx.sentences(text), lambda s: F.length(s))
    spans = tx.let(
        lengths,
        lambda ns: F.zip_with(
            ns, tx.running_total(ns), lambda n, e: F.struct(n.alias("n"), e.alias("e"))
        ),
    )
    return docs.select(key, F.posexplode(spans).alias("sentence_no", "s")).select(
        key,
        F.col("sentence_no").cast("bigint").alias("sentence_no"),
        (F.col("s.e") - F.col("s.n")).alias("start_char"),
        F.col("s.e").alias("end_char"),
    )
