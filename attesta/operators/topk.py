"""Top-k that prunes before it shuffles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
#: Scores below this one, minus infinity, are of rows that a query does not ask for.
LEAST = float(np.finfo(np.float64).min)


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    out: str = "rn",
    salt_on: Sequence[str] = (),
) -> DataFrame:
    """The first ``k`` rows per key, ranked 1..k in ``out``.

    With ``salt_on`` a hot key is cut into salted parts that keep ``k`` rows
    each, so the last stage sees at most ``SALTS * k`` rows of any key.
    """
    if salt_on:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn(out, F.row_number().over(part)).filter(F.col(out) <= k).drop(out, "_salt")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(whole)).filter(F.col(out) <= k)


def scored_top_k(
    df: DataFrame,
    id_col: str,
    value_col: str,
    score: Callable[[pa.ChunkedArray | pa.Array], np.ndarray],
    n_queries: int,
    k: int,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Score every row against a bounded set of queries and keep the best ``k``
    per query: ``(query_no, id, score, carry.., rn)``, ties to the smaller id.

    ``score`` maps a batch of the value column to a ``rows x n_queries`` matrix, minus infinity where a query leaves a row out;
    ``carry`` names further columns of the rows that are kept.
    Every task carries only its own ``n_queries * k`` best rows, so neither the
    scores of all pairs nor a group per query is ever shuffled. Scores are
    rounded to nine places, so that summing order cannot change the ranking.
    """

    names = ["query_no", "id", "score", *carry]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        floor = np.full(n_queries, LEAST)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            batch = batch.take(pc.sort_indices(batch.column(0)))
            scores = np.round(score(batch.column(1)), 9)
            row, query = _best_rows(scores, k, floor)
            kept = [batch.column(i).take(pa.array(row)) for i in (0, *range(2, 2 + len(carry)))]
            numbers, values = pa.array(query.astype(np.int32)), pa.array(scores[row, query])
            held.append(pa.table([numbers, kept[0], values, *kept[1:]], names=names))
            if sum(t.num_rows for t in held) > 2 * n_queries * k:
                rows, floor = _first_k(pa.concat_tables(held), k, n_queries)
                held = [rows]
        if held:
            yield from _first_k(pa.concat_tables(held), k, n_queries)[0].combine_chunks().to_batches()

    types = dict(df.dtypes)
    more_types = "".join(f", {c} {types[c]}" for c in carry)
    partial = df.select(id_col, value_col, *carry).mapInArrow(
        best, f"query_no int, id {types[id_col]}, score double{more_types}"
    )
    order = [F.col("score").desc(), F.col("id")]
    return top_k(partial, ["query_no"], order, k, salt_on=["id"])


def _best_rows(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and query number of the best ``k`` rows of each query, ties to the earlier row, without what is below ``floor``."""
    if len(scores) <= k:
        return np.nonzero(scores >= floor)
    last = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k]
    above, level = scores > last, scores == last
    taken = above | (level & (np.cumsum(level, axis=0) <= k - above.sum(axis=0)))
    return np.nonzero(taken & (scores >= floor))


def _first_k(rows: pa.Table, k: int, n_queries: int) -> tuple[pa.Table, np.ndarray]:
    """The ``k`` rows of each query with the highest score, ties to the smaller id, and the score that a further row has to reach."""
    rows = rows.sort_by([("query_no", "ascending"), ("score", "descending"), ("id", "ascending")])
    query = rows["query_no"].to_numpy()
    place = np.arange(len(query)) - np.searchsorted(query, np.arange(n_queries))[query]
    floor = np.full(n_queries, LEAST)
    full = place == k - 1
    floor[query[full]] = rows["score"].to_numpy()[full]
    return rows.filter(pa.array(place < k)), floor
