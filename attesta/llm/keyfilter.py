"""Bit tables of a fixed size that tell which 64-bit keys can be skipped.

A table has ``BITS`` bits however many keys there are. It may say yes to a key that is not in it, never no to one that is, so
what is skipped by it cannot matter. With very many keys it only skips less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 8 MB: what reaches the driver, and what is broadcast.
BITS = 1 << 26
#: Bits of one bitmap of the functions bitmap_*.
_PART = 32_768


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """The table of all values (null: none) of a long column, as bytes."""
    slot = F.col(column).bitwiseAND(F.lit(BITS - 1))
    parts = (
        keys.filter(F.col(column).isNotNull())
        .groupBy(F.floor(slot / _PART).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg((slot % _PART)).alias("bits"))
    )
    table = np.zeros(BITS // 8, dtype=np.uint8)
    for row in parts.collect():
        at = row.part * (_PART // 8)
        table[at : at + _PART // 8] = np.frombuffer(row.bits, dtype=np.uint8)
    return table


def possible(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit keys the table may hold."""
    slot = keys & np.uint64(BITS - 1)
    return (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
