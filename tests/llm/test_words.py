"""Phrases, spelling variants and repeated passages against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import bytewords, collocations, passages, spelling
from attesta.llm.queries import ORACLES, QUERIES
from attesta.llm.suffix_groups import suffix_orders
from compare import compare, connect

SMALL = "/root/testdata/sf0.001"
EDGE = [(1, None, None), (2, "", "en"), (2, "", "en"), (None, "a b. a b", "en"), (3, "x", None)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_phrases(rows, least, inside, top):
    count, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    count[lang or "und"][tuple(w[i : i + size])] += 1
    out = []
    for lang, f in count.items():
        found = []
        for p, a in f.items():
            longer = max((b for q, b in f.items() if len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(len(q)))), default=0)
            if len(p) > 1 and a >= least and 100 * longer < inside * a:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, l, g, n[lang], -s) for r, (s, a, p, l, g) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [64, 6])
def test_collocations(spark, bits):
    """Overlaps, ties, pieces, blanks and tabs, several languages; with few bits nearly all fingerprints are shared."""
    rng = random.Random(bits)
    words = ["Tea", "tea", "milk", "é", "a", "b\tb", " "]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(60)) for _ in range(25)] + ["z z z z z z"]
    rows = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)] + EDGE
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("fp", F.lit("x")).repartition(3)
    got = collocations.collocations(df, least=3, inside=50, top=12, bits=bits)
    assert sorted(map(tuple, got.collect())) == brute_phrases([(r[2], r[1]) for r in rows], 3, 50, 12)
    assert collocations.collocations(df.filter("doc_id < 0")).count() == 0


def test_collocations_next_to_sql(spark):
    name = "op11_collocations"
    assert compare(spark, connect(SMALL), SMALL, name, QUERIES[name], ORACLES[name]).startswith("SAME")


def test_scores_beyond_64_bits(spark):
    """a * a * 1000000 passes 64 bits from about 4.3 million occurrences on."""
    f = 5_000_000_000
    counts = spark.createDataFrame(
        [(1, "en", 1, 1, f + 7, 0), (1, "en", 2, 2, f, 0), (2, "en", 3, 3, f - 1, 0), (0, "en", None, None, 3 * f, None)],
        "size int, lang string, fp long, check long, n long, doc long",
    )
    part = "size int, fp bigint, check bigint"
    found = spark.createDataFrame([("en", 2, 3, 3, f - 1, "x y", [(1, 1, 1), (1, 2, 2)])], f"lang string, size int, fp long, check long, a long, phrase string, parts array<struct<{part.replace(' ', ':').replace(',:', ',')}>>")
    row = collocations._ranked(collocations.Workspace(spark), found, counts, 50, 10).first()
    assert (row.l, row.r, row.score) == (f + 7, f, 1_000_000 * (f - 1) ** 2 // (f * (f + 7)))


def brute_variants(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    w = {a: b for a, b in n.items() if len(a) >= 7 and b >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {a: [b for b in w if near(a, b)] for a in w}
    best = {a: min(bs, key=lambda b: (-w[b], b)) for a, bs in close.items() if bs}
    form = {a: b for a, b in best.items() if w[b] >= 10 * w[a]}
    out = []
    for a in w:
        root = a
        while root in form:
            root = form[root]
        out.append((a, form.get(a), root, w[a], len(close[a]), w[form[a]] if a in form else None))
    return sorted(out)


@pytest.mark.parametrize("crowded", [1_024, 3])
def test_spelling_variants(spark, crowded):
    """Edits at the borders of the free ranges, runs of one letter, ties, chains of forms, accents, very long words; also with blocks that are cut down to one code point."""
    rng = random.Random(crowded)
    bases = ["aaaaaaaa", "abcdefgh", "Straßenée", "ÿ×÷àbcdef", "x" * 300, "abcdabcdabcd"]
    words = []
    for base in bases:
        words += [base] * 400
        for _ in range(40):
            k, c = rng.randrange(len(base)), rng.choice("abé")
            word = rng.choice([base[:k] + base[k + 1 :], base[:k] + c + base[k:], base[:k] + c + base[k + 1 :]])
            words += [word] * rng.choice([1, 2, 2, 30])
            words += [word + "a"] * rng.choice([1, 2])
    rng.shuffle(words)
    rows = [(i, "1 ".join(words[i::50])) for i in range(50)] + [(None, "straßenée straßenée"), (7, None), (8, ""), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(4)
    assert sorted(map(tuple, spelling.variant_groups(df, crowded=crowded).collect())) == brute_variants(rows)
    assert spelling.variant_groups(df.filter("doc_id < 0")).count() == 0


def brute_passages(rows, length=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def passages_of(df, crowded=16):
    rows = passages.remove_repeated_passages(df, crowded=crowded).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows), key=str)


@pytest.mark.parametrize("crowded", [16, 1])
def test_repeated_passages(spark, crowded):
    """Copies with edits, repeats in one text, runs of one letter, texts about as long as a passage; also with keys split down to single windows."""
    rng = random.Random(crowded)
    base = "".join(rng.choice("abc \n") for _ in range(400))
    rows = [(900, "a" * 700), (901, "a" * 350), (902, "ab" * 300), (903, None), (904, ""), (905, "x" * 99), (906, "x" * 100), (907, "x" * 101), (908, base * 3), (None, base)]
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(400)] = rng.choice("abcdé")
        rows.append((i, "".join(copy)[rng.randint(0, 100) : rng.randint(250, 400)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.lit(1)).repartition(5)
    assert passages_of(df, crowded) == brute_passages(rows)


def test_repeated_passages_of_equal_rows(spark):
    """Rows with one id and one text are one document; the empty table has no rows."""
    rng = random.Random(1)
    text = "".join(rng.choice("abcdef ") for _ in range(300))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (2, text)], "doc_id long, text string").repartition(2)
    assert [r[:3] for r in passages_of(df)] == [(1, 300, 0), (1, 300, 0), (2, 300, 300), (2, 300, 300)]
    assert passages_of(df.filter("doc_id > 5")) == []


def test_stretches_by_single_windows(monkeypatch):
    """Runs of windows with one anchor, though anchors are looked for a few windows at a time; the bytes of a block are summed up once."""
    calls, sums = [], bytewords.running_sums
    monkeypatch.setattr(passages, "_CACHED", 7)
    monkeypatch.setattr(bytewords, "running_sums", lambda data: calls.append(len(data)) or sums(data))
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(n)) for n in (0, 200, 9, 10, 0, 11, 300, 3)]
    (block,) = bytewords.blocks(pa.array(texts))
    prefix = bytewords.running_sums(block.data)
    found = passages.stretches(block, 10, 4, prefix)
    passages._content(block, *found[:3], 10, prefix)
    assert calls == [len(block.data)]
    at, want = 0, []
    for text in texts:
        last = None
        for w in range(at, at + len(text) - 9):
            spots = np.arange(w, w + 7)
            h = bytewords.span_hashes(block.data, spots, spots + 4)
            best = int(np.argmin(h >> np.uint64(21)))
            if last != w + best:
                want.append([w, 0, w + best, int(h[best])])
                last = w + best
            want[-1][1] += 1
        at += len(text)
    assert np.stack([c.astype(np.uint64) for c in found], axis=1).tolist() == want


def test_suffix_orders():
    rng = np.random.default_rng(0)
    for _ in range(100):
        letters, strings, borders = rng.integers(1, 5), [], [0]
        for _ in range(rng.integers(1, 5)):
            for _ in range(rng.integers(0, 4)):
                s = rng.integers(0, letters, rng.integers(0, 30)).astype(np.uint8)
                strings.append(np.tile(s[:3], 8) if rng.random() < 0.3 else s)
            borders.append(sum(map(len, strings)))
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        data = np.concatenate([*strings, np.zeros(0, dtype=np.uint8)])
        expected = []
        for a, b in zip(borders[:-1], borders[1:]):
            inside = [(data[p:e].tobytes(), p) for o, e in zip(offsets[:-1], offsets[1:]) if a <= o and e <= b for p in range(o, e)]
            expected += [p for _, p in sorted(inside)]
        assert suffix_orders(data, offsets, np.array(borders)).tolist() == expected
