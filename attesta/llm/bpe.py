"""Byte-pair encoding and decoding with batched numpy merge rounds.

The distinct words of a block of texts form one flat symbol array. Each round looks up the ranks of all
neighbouring pairs by binary search over sorted pair keys, merges in every word all places of its
lowest-ranked pair, and goes on with the words that changed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokenizer pattern of byte-level BPE vocabularies (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters of text encoded together, and words whose encodings a task remembers.
BLOCK_CHARS, REMEMBERED = 1 << 20, 200_000


def _byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself if visible in Latin-1, else the next free one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + rest.index(b)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a byte-level BPE vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self._split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        characters = _byte_characters()
        self.byte_ids = np.array([vocab[c] for c in characters], dtype=np.int64)
        size = max([*vocab.values(), *special.values()]) + 1
        self.base = size
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        value = {c: b for b, c in enumerate(characters)}
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(value[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self._known: dict[str, tuple[int, str, bytes]] = {}

    def merge(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word."""
        if not words:
            return []
        raw = [w.encode("utf-8", "replace") for w in words]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        none = np.int64(len(self.keys))
        while len(symbols) > 1:
            pair = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank, at = np.append(rank, none), np.append(at, 0)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            per_word = np.diff(np.r_[starts, len(symbols)])
            least = np.repeat(least, per_word)
            active = least < none
            if not active.all():
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                symbols, owner, rank, at, least = symbols[active], owner[active], rank[active], at[active], least[active]
                if not len(symbols):
                    break
            hit = rank == least
            # Of places in a row (aa in aaa) every second one, from the left.
            index = np.arange(len(hit))
            start = hit & ~np.r_[False, hit[:-1]]
            run = np.maximum.accumulate(np.where(start, index, 0))
            hit &= (index - run) % 2 == 0
            symbols[hit] = self.made[at[hit]]
            keep = ~np.r_[False, hit[:-1]]
            symbols, owner = symbols[keep], owner[keep]
        done_symbols.append(symbols)
        done_owner.append(owner)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        flat = symbols[order].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens stay whole."""
        if self._split is None:
            return PATTERN.findall(text)
        out: list[str] = []
        for part in self._split.split(text):
            out += [part] if part in self.special else PATTERN.findall(part)
        return out

    def encode_block(self, texts: list[str]) -> list[list[tuple[int, str, bytes]]]:
        """For each text its words as (number of ids, ids in decimal, bytes decoded from the ids). A word is encoded and
        decoded once, however often it occurs."""
        split = [self.pieces(t) for t in texts]
        if len(self._known) > REMEMBERED:
            self._known = {}
        known = self._known
        rows = [list(map(known.get, s)) for s in split]
        gaps = [i for i, r in enumerate(rows) if None in r]
        new = {w for i in gaps for w, x in zip(split[i], rows[i], strict=True) if x is None}
        plain = [w for w in new if w not in self.special]
        for w, ids in zip(plain, self.merge(plain), strict=True):
            known[w] = (len(ids), ",".join(map(str, ids)), self.decode_bytes(ids))
        for w in new.intersection(self.special):
            known[w] = (1, str(self.special[w]), self.decode_bytes([self.special[w]]))
        for i in gaps:
            rows[i] = list(map(known.__getitem__, split[i]))
        return rows

    def encode(self, text: str) -> list[int]:
        return [int(i) for word in self.encode_block([text])[0] for i in word[1].split(",")]

    def decode(self, ids: list[int]) -> str:
        """Text of token ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def forget(self) -> None:
        self._known = {}

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """The encoder of a vocabulary file, once per worker process."""
    return Bpe(path)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > BLOCK_CHARS:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def bpe_round_trip(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: the key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of
    the text decoded from the ids), and the ids themselves if asked for.

    A null text counts as empty and has no tokens. Texts that spell a special token get its id. The vocabulary
    path must be readable on every executor. No shuffle: rows are independent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _blocks(texts):
                counts, hashes, decoded, all_ids = [], [], [], []
                for found in bpe.encode_block(texts[a:b]):
                    sizes, decimal, raw = zip(*found, strict=True) if found else ((), (), ())
                    listed = ",".join(decimal)
                    counts.append(sum(sizes))
                    hashes.append(hashlib.sha256(listed.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest())
                    if with_ids:
                        all_ids.append([int(i) for i in listed.split(",")] if listed else [])
                columns = [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        bpe.forget()  # the worker process lives on

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return slim.mapInArrow(run, schema).withColumnRenamed("key", key)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
