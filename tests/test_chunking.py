from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attesta.config import ChunkSettings
from attesta.functions.tokens import WORDS, arrow_counter, column_counter
from attesta.operators import chunking

from test_text import spans


def tokens(n):
    return max(1, n // 4)


def pack(text, cfg, count=lambda t: tokens(len(t)), run=None):
    """Restatement in plain Python: offsets of the packed chunks of one text. ``run`` counts sentences a to b, else their text is counted."""
    ss = spans(text)
    t = [count(text[b:e]) for b, e in ss]
    run = run or (lambda a, b: count(text[ss[a][0] : ss[b][1]]))
    out, first, unseen = [], 0, 0
    while unseen < len(ss):
        last = unseen
        while last + 1 < len(ss) and run(first, last + 1) <= cfg.target_tokens:
            last += 1
        out.append((first, last))
        unseen = last + 1
        if cfg.overlap_tokens <= 0 or last == first:
            first = last + 1
        else:
            fits = [k for k in range(first + 1, last + 1) if sum(t[k : last + 1]) >= cfg.overlap_tokens]
            first = max(fits) if fits else first + 1
    if len(out) > 1 and run(*out[-1]) < cfg.min_tokens:
        tail = out.pop()
        out[-1] = (out[-1][0], tail[1])
    return [(ss[a][0], ss[b][1]) for a, b in out]


def text_of(rng, n):
    parts = []
    for _ in range(n):
        parts.append("w" * rng.choice([1, 5, 20, 60, 200]) + rng.choice([". ", "! ", "?\n", ". \n ", " "]))
    return "".join(parts)


CONFIGS = [ChunkSettings(), ChunkSettings(30, 8, 5), ChunkSettings(16, 0, 4), ChunkSettings(20, 15, 10), ChunkSettings(5, 50, 2)]


@pytest.mark.parametrize("cfg", CONFIGS)
def test_packing_equals_restatement(spark, cfg):
    rng = random.Random(cfg.target_tokens)
    texts = [text_of(rng, rng.randint(1, 60)) for _ in range(40)] + ["x" * 3000 + ".", "One. " * 400]
    docs = chunking.as_single_block(
        spark.createDataFrame(list(enumerate(texts)), "n int, text string"), F.col("n").cast("string"), F.lit("t"), F.col("text"), "n"
    )
    rows = chunking.chunk_documents(docs, cfg).orderBy("n", "position").collect()
    for n, text in enumerate(texts):
        own = [r for r in rows if r.n == n]
        if not text.strip():
            assert own == []
            continue
        assert [(r.start_char, r.end_char) for r in own] == pack(text, cfg)
        for i, r in enumerate(own):
            assert r.text == text[r.start_char : r.end_char]
            assert r.position == i and r.token_count == tokens(len(r.text))
            assert r.chunk_id == hashlib.sha256(f"{n}|{i}".encode()).hexdigest()[:16]


def test_groups_are_never_crossed(spark):
    cfg = ChunkSettings(30, 8, 5)
    blocks = [(["A"], "First. " * 9), (["A"], "Second. " * 9), (["B", "C"], "Third. " * 20), (["A"], "Tail."), (["D"], "  ")]
    docs = spark.createDataFrame(
        [("u", "T", blocks), ("empty", "T", [])],
        "url string, title string, blocks array<struct<heading_path:array<string>,text:string>>",
    )
    full = "\n\n".join(t for _, t in blocks)
    groups = [(["A"], 0, blocks[0][1] + "\n\n" + blocks[1][1])]
    at = len(groups[0][2]) + 2
    for path, text in blocks[2:4]:
        groups.append((path, at, text))
        at += len(text) + 2
    want = [(path, start + b, start + e) for path, start, text in groups for b, e in pack(text, cfg)]
    rows = chunking.chunk_documents(docs, cfg).orderBy("position").collect()
    assert [(r.heading_path, r.start_char, r.end_char) for r in rows] == want
    assert all(r.text == full[r.start_char : r.end_char] and r.url == "u" and r.doc_title == "T" for r in rows)


def odd(text):
    """Not additive: a run of sentences is no sum of theirs."""
    return len(text) // 7 + 1


@pytest.mark.parametrize("name", ["words", "odd", "arrow"])
def test_other_counters(spark, name):
    """Words add up, another column is counted run by run, a Python tokenizer once per sentence."""
    counter, count = {
        "words": (WORDS, lambda t: len(t.split())),
        "odd": (column_counter(lambda t: F.floor(F.length(t) / 7) + 1), odd),
        "arrow": (arrow_counter(lambda texts: [len(t) // 5 + 1 for t in texts]), lambda t: len(t) // 5 + 1),
    }[name]
    rng, cfg = random.Random(3), ChunkSettings(12, 4, 3)
    texts = [text_of(rng, rng.randint(1, 40)).replace("www", "w w") for _ in range(30)] + ["", "  ", "One. " * 200]
    docs = chunking.as_single_block(
        spark.createDataFrame(list(enumerate(texts)), "n int, text string"), F.col("n").cast("string"), F.lit("t"), F.col("text"), "n"
    )
    rows = chunking.chunk_documents(docs, cfg, counter).orderBy("n", "position").collect()
    for n, text in enumerate(texts):
        ss = spans(text)
        run = None if name == "odd" else lambda a, b: sum(count(text[x:y]) for x, y in ss[a : b + 1])  # noqa: B023
        own = [r for r in rows if r.n == n]
        assert [(r.start_char, r.end_char) for r in own] == (pack(text, cfg, count, run) if text.strip() else [])
        assert all(r.token_count == count(r.text) for r in own)
