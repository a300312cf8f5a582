"""64-bit SimHash of word shingles, and Hamming distance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.arrays import pieces


# A copy of a fresh hash is made faster than a new one.
_BLAKE2B, _MD5 = hashlib.blake2b(digest_size=8), hashlib.md5(usedforsecurity=False)


def _blake2b(data: bytes) -> bytes:
    h = _BLAKE2B.copy()
    h.update(data)
    return h.digest()


def _md5(data: bytes) -> bytes:
    h = _MD5.copy()
    h.update(data)
    return h.digest()[:8]


_HASHES: dict[str, Callable[[bytes], bytes]] = {"blake2b": _blake2b, "md5": _md5}
_BATCH = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _votes(words: list[str], size: int, digest: Callable[[bytes], bytes]) -> int:
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    # No word holds white space, so the spaces are the borders.
    whole = " ".join(words).encode("utf-8")
    spaces = np.flatnonzero(np.frombuffer(whole, dtype=np.uint8) == 0x20)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(whole))[min(size, len(words)) - 1 :]
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, _BATCH):
        some = slice(lo, min(n, lo + _BATCH))
        block = b"".join([digest(whole[a:b]) for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        # How often each byte value stands at each place, times its bits.
        columns = np.frombuffer(block, dtype=np.uint8).reshape(-1, 8).T
        ones += np.concatenate([np.bincount(c, minlength=256) @ _BITS for c in columns])
    packed = np.packbits((2 * ones > n).astype(np.uint8)).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def simhash64(col: Column | str, shingle: int = 5, hash_name: str = "blake2b") -> Column:
    """SimHash as a signed bigint; 0 for a text without words.

    Neither BLAKE2b nor a vote over bits exists as a Spark function, so the
    column is computed in Arrow batches, some texts at a time. Each row is one text; nothing is grouped.
    """
    digest = _HASHES[hash_name]

    @F.arrow_udf("bigint")
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in pieces(texts):
                votes = [None if t is None else _votes(t.lower().split(), shingle, digest) for t in some.to_pylist()]
                yield pa.array(votes, pa.int64())

    return column(F.col(col) if isinstance(col, str) else col)


def hamming(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))
