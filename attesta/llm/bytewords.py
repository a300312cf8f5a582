"""Words, shingles and their hashes for many texts at once, on Arrow string buffers.

The bytes of a few texts form one flat array. Word borders come from a lookup table, word hashes
from one running polynomial over the bytes, so nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once. A longer text forms a block of its own.
BLOCK_BYTES = 1 << 20

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64((seed * 0xD1342543DE82EF95) & _M64))


_BYTE = salts(256, 1)
_WORD = salts(6, 2)

#: Bytes of a word when words end at ASCII white space: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a term: ASCII letters and digits, and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = np.ones(1, dtype=np.uint64)
_inverse_powers = np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse_powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverse_powers", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverse_powers


@dataclass
class Block:
    """Some texts of a batch. ``data`` holds their bytes; text i is data[offsets[i]:offsets[i+1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column (null: empty) in blocks of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        end = min(end, n)
        yield Block(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a block in text order: byte span, owning text, hash; text i has words[bounds[i]:bounds[i+1]]."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def words(block: Block, table: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    """Split every text of a block into words and hash them."""
    data = LOWER[block.data] if lower else block.data
    n = len(data)
    inside = table[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    owner = np.searchsorted(block.offsets, starts, side="right") - 1
    bounds = np.searchsorted(starts, block.offsets, side="left")
    return Words(starts, ends, owner, span_hashes(data, starts, ends), bounds)


def running_sums(data: np.ndarray) -> np.ndarray:
    """The polynomial over the first 0, 1, ... bytes."""
    power, _ = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=prefix[1:])
    return prefix


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands. ``prefix``: the running sums of ``data``, if they are at hand."""
    prefix = running_sums(data) if prefix is None else prefix
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(prefix: np.ndarray, start: int, end: int, width: int) -> np.ndarray:
    """The hashes of the spans of ``width`` bytes that begin at ``start``, ``start`` + 1, ... before ``end``."""
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[start + width : end + width] - prefix[start:end]) * inverse[start:end] + np.uint64(width))


def hash_words(words_: list[str]) -> np.ndarray:
    """Hashes as ``words`` gives them, for words that are known already."""
    if not words_:
        return np.zeros(0, dtype=np.uint64)
    raw = [w.encode() for w in words_]
    ends = np.cumsum([len(w) for w in raw])
    return span_hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - np.array([len(w) for w in raw]), ends)


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` (at most 5) words, with the owning text. A text with fewer words has its
    whole sequence as its only shingle; a text without words has none."""
    n = len(w.hashes)
    counts = np.diff(w.bounds)
    full = max(0, n - size + 1)
    out = np.full(full, size, dtype=np.uint64)
    for k in range(size):
        out += w.hashes[k : k + full] * _WORD[k]
    inside = w.owner[:full] == w.owner[size - 1 :] if full else np.zeros(0, dtype=bool)
    value, owner = [out[inside]], [w.owner[:full][inside]]
    for length in range(1, size):
        texts = np.flatnonzero(counts == length)
        short = np.full(len(texts), length, dtype=np.uint64)
        for k in range(length):
            short += w.hashes[w.bounds[texts] + k] * _WORD[k]
        value.append(short)
        owner.append(texts)
    value, owner = mix(np.concatenate(value)), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return value[order], owner[order]


def distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each of ``n`` texts, flat, and the bounds of each text."""
    edges = np.searchsorted(owner, np.arange(n + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else values[:0]), bounds


def shingle_sets(column: pa.Array, size: int = 5) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """Distinct shingles of whole texts, block by block."""
    for block in blocks(column):
        values, owner = shingles(words(block), size)
        yield (block, *distinct(values, owner, len(block)))
