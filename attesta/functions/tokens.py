"""Token counters: how long a text is for whoever reads it.

Chunking counts runs of sentences, evidence selection whole entries. A counter says how to do both. ``BY_LENGTH`` needs no more than a length;
``additive`` counters count each sentence once and add up; others count every run that is tried. A tokenizer in Python counts
batches of sentences, once each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import text as tx


@dataclass(frozen=True)
class TokenCounter:
    """``count`` gives the tokens of a text column.

    ``run`` says how a run of sentences is counted: by its "length" in characters (``of_length``), as the "sum" of its sentences, or as a "text" of
    its own. ``batch`` counts the sentences of an ``array<array<string>>`` column where ``count`` cannot be used inside array functions.
    """

    count: Callable[[Column], Column]
    run: str = "text"
    of_length: Callable[[Column], Column] | None = None
    batch: Callable[[Column], Column] | None = None


BY_LENGTH = TokenCounter(tx.token_count, "length", of_length=tx.tokens_of_length)


def column_counter(count: Callable[[Column], Column], additive: bool = False) -> TokenCounter:
    """A counter made of column functions. ``additive``: a run of sentences has as many tokens as they have together."""
    return TokenCounter(lambda text: count(text).cast("int"), "sum" if additive else "text")


#: Words as tokens. White space ends sentences, so words add up.
WORDS = column_counter(lambda text: F.size(tx.words(text)), additive=True)


def arrow_counter(count: Callable[[list[str]], Sequence[int]]) -> TokenCounter:
    """A counter over a Python tokenizer: ``count`` takes a list of texts and gives their numbers of tokens. A run of sentences counts as the sum of
    its sentences, which are counted once each in Arrow batches; entries and chunks are counted as whole texts. Null texts have no tokens."""

    def numbers(texts: pa.Array) -> pa.Array:
        return pa.array(count([t or "" for t in texts.to_pylist()]), pa.int32())

    @F.arrow_udf("int")
    def whole(texts: pa.Array) -> pa.Array:
        return numbers(texts)

    @F.arrow_udf("array<array<int>>")
    def nested(groups: pa.Array) -> pa.Array:
        inner = groups.flatten()
        first, second = (a.offsets.to_numpy() - a.offsets[0].as_py() for a in (groups, inner))
        counted = pa.ListArray.from_arrays(pa.array(second), numbers(inner.flatten()))
        return pa.ListArray.from_arrays(pa.array(first), counted)

    return TokenCounter(lambda text: whole(text), "sum", batch=lambda groups: nested(groups))
