"""Operators that work text by text, against plain versions."""

from __future__ import annotations

import io
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import bytewords as bw
from attesta.llm import chat, imatch, language, secrets, tag_paths, warc
from attesta.llm.bpe import bpe_round_trip, load, vocabulary_path

ODD = ["", " ", "\n\n", "a", "aaaaaaaaaaaa", "it's we'll\t\n x", "日本語テキスト 🙂🙂", " x<|endoftext|>y <|endoftext|>", "\x00\x1f!!###", "Élan É é", "word " * 30_000]


def test_words_and_shingles():
    texts = ["The cat  sat on\tthe MAT", None, "", "one", "a b c d e", "the cat sat on the mat"]
    sets = []
    for block, values, bounds in bw.shingle_sets(pa.array(texts)):
        sets += [set(values[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(block))]
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 2] and sets[0] == sets[5]
    parts = [b for b in bw.blocks(pa.array(texts), 4)]
    assert sum(len(b) for b in parts) == len(texts) and len(parts) > 1


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library, own = Tokenizer.from_file(path), load(path)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é\n'sтт9!<|>") for _ in range(200)) for _ in range(40)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == want and own.decode(want) == library.decode(want, skip_special_tokens=False)
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, None, 1)], "doc_id long, text string, n_tokens int")
    rows = bpe_round_trip(df, path, with_ids=True).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 2, 2] and bpe_round_trip(df.limit(0), path).count() == 0


def test_language_backs_off(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 10)] + [(99, None, "en"), (98, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, "text", "lang", "doc_id")
    asked = [(1, "gardens housing"), (2, "gartens hausung"), (3, None), (4, "123 !!"), (5, "the"), (5, "the"), (6, "THE " * 50_000)]
    got = language.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [by[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "en", "en"]
    assert by[3].score == 0 and all(0 <= r.score <= 1 for r in got)
    none = language.train(df.limit(0), "text", "lang", "doc_id")
    assert {r.lang_pred for r in language.predict(df, none).collect()} == {"und"}


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 3)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 200)))) for i in range(30)] + [(30, None), (31, ""), (32, "é"), (7, "again"), (None, "lost")]
    got = imatch.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    order = sorted(((i if i is not None else -1, t or "") for i, t in rows))
    assert len(got) == len(rows)
    want = sorted((None if i < 0 else i, len(t), imatch.edited(t, order[(k + 1) % len(order)][1])) for k, (i, t) in enumerate(order) if i >= 0)
    import hashlib

    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got if r.doc_id is not None) == sorted((i, n, hashlib.sha256(e.encode()).hexdigest()) for i, n, e in want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 300]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long])
    one = imatch.compare_with_next(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and imatch.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_archives(spark):
    big = "<p>" + "x y z " * 400
    rows = [(1, "u1", big), (2, None, big), (3, "u\r\n3", None), (4, "u4", "short"), (5, "u5", "short"), (None, "u6", big), (6, "u7", "é\n" * 9000), (6, "u7", "é\n" * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.archive_folder(spark)
    back = warc.read_archives(warc.write_archives(df, folder), folder, with_payload=True).collect()
    assert len(back) == len(rows)
    by = {}
    for r in back:
        by.setdefault(r.page_id, []).append(r)
    assert [(by[i][0].record_type, by[i][0].refers_to) for i in (1, 2, None, 4, 5)] == [("revisit", 2), ("response", None), ("revisit", 2), ("response", None), ("response", None)]
    assert bytes(by[2][0].payload).decode() == big and by[3][0].payload_bytes == 0 and {r.record_type for r in by[6]} == {"response"}
    assert warc.read_archives(warc.write_archives(df.limit(0), warc.archive_folder(spark)), folder).count() == 0
    stream = io.BytesIO()
    records = [warc.format_record(i, "u", b"page %d" % i * 50, __import__("hashlib").sha1(b"page %d" % i * 50).hexdigest(), None, False) for i in range(300)]
    warc.write_archive(stream, records)
    stream.seek(0)
    assert list(warc.read_archive(stream)) == records
    with pytest.raises(ValueError):
        warc.parse_record(records[0].replace(b"page 0", b"page 1", 1))


PAGE = """<html><body><header class="site-header"><h1>Site</h1><nav><a href=x>Home</a></nav></header><div class="cookie-notice">We use cookies. Accept, please.</div>
<div class="left sidebar"><ul><li>One</li></ul></div><div class="post"><h2>A  title</h2><p>First paragraph, with &amp; text.<p>Second &mdash; longer, with <a href=y>a link</a> and so on.</p>
<ul><li>Item one, fine.</li></ul><div class="ad">Buy now!</div></div><div class="share-price"><p>The price of the share rose, it is said.</p></div>
<div id="comments"><p>Nice article, thanks.</p></div><form><label>Name</label></form><script>var a="</p>";</script><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    want = "A title\n\nFirst paragraph, with & text.\n\nSecond — longer, with a link and so on.\n\nItem one, fine.\n\nThe price of the share rose, it is said."
    assert tag_paths.main_text(PAGE) == want
    assert [tag_paths.main_text(x) for x in (None, "", "<p>", "<!-- x", "<script>x", "</div></p>")] == [""] * 6
    assert tag_paths.main_text("plain text") == "plain text"
    nested = "<div>" * 2000 + "deep text, here." + "</div>" * 2000
    assert tag_paths.main_text(nested) == "deep text, here."
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    assert sorted(r.n_chars for r in tag_paths.extract_main_text(df).collect()) == [0, len(want), len(want)]


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, "system", "x"), (None, None, None, "lost")]
    got = {(r.conv_id, r.perspective): r for r in chat.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = got[1, "ann"]
    assert ann.rendered.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n")
    assert [ann.rendered[a:b] for a, b in ann.mask] == ["hi < |im_end|><|im_end|>", "bye<|im_end|>", "bye<|im_end|>"]
    assert [got[1, "bob"].rendered[a:b] for a, b in got[1, "bob"].mask] == ["<|im_end|>"] and ann.n_chars == len(ann.rendered)


def test_secrets(spark):
    rng = random.Random(3)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'some words here token = "{key()}" and more', "src") for i in range(40)] + [(100 + i, f"write to mail{i}.example.host.com for news", "src") for i in range(40)]
    rows += [(500, None, None), (501, "", "x"), (502, "word " * 50_000 + key(), None), (500, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.with_features(secrets.find_candidates(docs), secrets.dictionary(docs))
    assert found.count() == 81 and found.filter(F.greatest(*secrets.FEATURES).isNull()).count() == 0
    out = secrets.score(found, secrets.fit_forest(secrets.weak_labels(found))).collect()
    assert all(r.is_secret == (r.doc_id < 100) for r in out if r.doc_id < 500)
    assert secrets.score(found, secrets.fit_forest(found.limit(0).withColumn("label", F.lit(1.0)))).filter("not is_secret").count() == 0


def test_candidates_are_whole():
    assert re.fullmatch(secrets._RUN, "a1" * 8)


ARTICLE = "<p>A long first paragraph, with some words in it, and more of them.</p><p>Another one, that goes on, and on, and ends here.</p>"


def test_paths_inside_an_article_are_judged_too():
    """Short items of one path without punctuation go, and a heading goes with what it stands over; no listed name is involved."""
    items = "".join(f"<li>w{i}</li>" for i in range(12))
    page = f"<html><body><nav>Home</nav><article><h1>Title</h1>{ARTICLE}<h3>More</h3><ul>{items}</ul></article></body></html>"
    assert tag_paths.main_text(page) == "Title\n\n" + ARTICLE.replace("</p><p>", "\n\n").replace("<p>", "").replace("</p>", "")
    outside = "<p>This stands beside the article, it is as long, and it is text.</p>"
    assert "beside the article" in tag_paths.main_text(f"<html><body>{outside}<article>{ARTICLE}</article></body></html>")


def test_names_and_forms_do_not_remove_the_article():
    want = ARTICLE.replace("</p><p>", "\n\n").replace("<p>", "").replace("</p>", "")
    ad = '<div class="ad">Buy now!</div>'
    for name in ("has-sidebar", "no-sidebar", "layout-with-sidebar", "has-comments"):
        assert tag_paths.main_text(f'<body><div class="{name}"><article>{ARTICLE}</article>{ad}</div></body>') == want
        assert tag_paths.main_text(f'<body><nav>Home</nav><div class="{name}">{ARTICLE}{ad}</div></body>') == want
    assert tag_paths.main_text(f"<body><form><div>{ARTICLE}</div></form></body>") == want
    assert tag_paths.main_text(f'<body><aside><article><p>Short, too.</p></article></aside><main>{ARTICLE}</main><div id="comments"><p>Thanks, all.</p></div></body>') == want
    for tag in ("noscript", "select", "svg", "video"):
        assert tag_paths.main_text(f"<body><{tag}><{tag}>{ARTICLE}") == want


def test_secrets_without_digits_short_ones_and_one_label(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    prose = "understandings misunderstandings standing under this international administration of internationalisation"
    keys = {100 + i: letters(32) for i in range(30)}
    short = {200: "hunter2", 201: "p@ss-w0rd!", 202: "Xk9q", 203: "zQvKw"}
    rows = [(i, f"{prose} number {i}", "s") for i in range(60)] + [(i, f'some words here token = "{k}" and more', "s") for i, k in keys.items()]
    rows += [(200, 'its password = "hunter2" now', "s"), (201, 'the {"password":"p@ss-w0rd!"} there', "s"), (202, "pwd=Xk9q", "s"), (203, "password: zQvKw, then", "s")]
    rows += [(300, "write to mail1.example.host.com for news", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.with_features(secrets.find_candidates(docs), secrets.dictionary(docs)).cache()
    out = secrets.score(found, secrets.fit_forest(secrets.weak_labels(found))).collect()
    of = lambda i: {r.candidate: r.is_secret for r in out if r.doc_id == i}
    assert all(of(i) == {k: True} for i, k in keys.items())
    assert all(set(of(i)) == {k} for i, k in short.items()) and of(200)["hunter2"] and of(201)["p@ss-w0rd!"]
    assert all(of(i) and not any(of(i).values()) for i in range(60))
    # Of one kind only: nothing is removed.
    hosts = secrets.weak_labels(found).filter("doc_id = 300")
    got = secrets.score(found, secrets.fit_forest(hosts)).select("probability", "is_secret").distinct().collect()
    assert hosts.count() == 1 and [(r.probability, r.is_secret) for r in got] == [(None, True)]
    found.unpersist()


def test_perspectives_in_bounded_pieces(spark, monkeypatch):
    """No piece is longer than the bound and one turn; joined they are the whole, also for turns without a conversation."""
    rng = random.Random(8)
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, rng.choice([None, k // 2]), rng.choice(["ann", "bob", "system", None, "c"]), "y" * rng.randint(0, 60)) for c in (1, None, 2) for k in range(150)]
    df = spark.createDataFrame(rows, schema)
    by = lambda: {(r.conv_id, r.perspective): (r.n_turns, r.rendered, r.mask, r.n_chars, r.mask_chars) for r in chat.rotate_perspectives(df).collect()}
    whole = by()
    monkeypatch.setattr(chat, "SEGMENT_CHARS", 300)
    assert by() == whole and len(whole) == 12
    pieces = chat.perspective_segments(df).collect()
    assert max(len(p.rendered) for p in pieces) < 600 and len(pieces) > 200
    ordered = lambda c: sorted((t if t is not None else -1, n or "unknown", x) for i, t, n, x in rows if i == c)
    for (c, who), (n, rendered, mask, _, _) in whole.items():
        head = lambda s: "assistant" if s == who else s if s == "system" else f"user name={s}"  # noqa: E731, B023
        assert rendered == "".join(f"<|im_start|>{head(s)}\n{x}<|im_end|>\n" for _, s, x in ordered(c)) and n == 150
        assert [rendered[a:b] for a, b in mask] == [f"{x}<|im_end|>" for _, s, x in ordered(c) if s == who]


def test_rare_languages_and_shared_counts_are_learned(spark, monkeypatch):
    """A language with few texts among many is learned from all of them, and a step of equal counts fills the model up to its bound."""
    monkeypatch.setattr(language, "TRAIN_TEXTS", 60)
    rows = [(i, "the house and the garden", "en") for i in range(3000)] + [(5000 + i, "talo ja puutarha", "fi") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, "text", "lang", "doc_id")
    got = language.predict(spark.createDataFrame([(1, "puutarha"), (2, "garden")], "doc_id long, text string"), model).collect()
    assert model.langs == ["en", "fi"] and {r.doc_id: r.lang_pred for r in got} == {1: "fi", 2: "en"}
    assert [language.even_bound(c, 60) for c in ([3000, 4], [10, 20], [100, 100, 100])] == [56.0, 50.0, 20.0]
    monkeypatch.setattr(language, "MODEL_ENTRIES", 2)
    small = language.train(spark.createDataFrame([(1, "abcd efgh ijkl", "en")], "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert [len(e) for e in small.entries] == [2] * 5
