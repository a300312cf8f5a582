"""The queries this engine answers on the input tables, by name.

Every entry takes ``(spark, folder)`` and returns a DataFrame over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.config import ChunkSettings, DedupSettings
from attesta.functions import audit
from attesta.functions import citations as ct
from attesta.functions import simhash as sh
from attesta.functions import text as tx
from attesta.functions import urls
from attesta.functions import vectors as vec
from attesta.functions.tokens import WORDS
from attesta.operators import chunking, dedup, evidence, extract, gap, ledger, neardup, quantile, report, retrieve, sections
from attesta.operators import triage, verify
from attesta.operators.cells import VectorCells
from attesta.operators.topk import top_k
from attesta.plans import inputs as src
from attesta.plans.flagship import cited_evidence
from attesta.session import cut_lineage, ensure_checkpoint_dir, spread_out
from attesta.sources import fetch, index, runs, search
from attesta.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

COSINE = DedupSettings(cosine_threshold=0.40)
SMALL_CHUNKS = ChunkSettings(target_tokens=64, overlap_tokens=12, min_tokens=8)
MAX_BYTES = 20_000
COST_CAP = 50.0


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def catalogue() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- text functions


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    return d.select("doc_id", tx.token_count("text").cast("bigint").alias("n_tokens"))


@query
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sentence_spans(src.document_rows(spark, sf), "doc_id", "text")


@query
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    return d.select("doc_id", tx.redact("text").alias("text"))


@query
def squeezed_text(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.squeeze_space("text").alias("text"))


@query
def section_titles(spark: SparkSession, sf: str) -> DataFrame:
    b = read_table(spark, sf, "benchmark")
    return b.select("item_id", tx.section_title(F.concat("text", F.lit("??"))).alias("title"))


@query
def strip_heading(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    hashes = F.repeat(F.lit("#"), (F.col("turn") % 4).cast("int"))
    md = F.concat(F.lit("\n "), hashes, F.lit(" Title\n\n"), F.col("text"))
    return c.select("conv_id", "turn", tx.strip_leading_heading(md).alias("markdown"))


@query
def strip_fences(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    fenced = F.concat(F.lit(" ```json\n"), F.col("text"), F.lit("\n```\n"))
    reply = F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.col("text"))
    return c.select("conv_id", "turn", tx.strip_code_fences(reply).alias("reply"))


@query
def triage_passages(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    return d.select("doc_id", tx.passage("text").alias("passage"))


@query
def corpus_hashes(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    return d.select("doc_id", tx.sha256_hex("text").alias("corpus_hash"))


@query
def secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    # Secrets of the input have other shapes; give some lines the one looked for.
    shaped = F.regexp_replace("text", r'token = "([0-9a-f]+)"', r"sk-ant-$1 /home/user$1/x")
    return audit.scan_lines(d.select("doc_id", shaped.alias("text")), "doc_id")


@query
def nested_url_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    doc = F.to_json(
        F.struct(
            F.array(F.struct(F.col("url"), F.struct((F.col("page_id") + 1).cast("string").alias("url")).alias("inner"))).alias("docs"),
            F.lit("x").alias("other"),
        )
    )
    return audit.nested_urls(p.select("page_id", doc.alias("body")), "page_id", "body").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "url"
    )


# ---- URLs and fetching


@query
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    loud = F.regexp_replace("url", r"^(https?)://([^/]*)", "$1://Ab:cD@$2:80")
    return p.select(
        "page_id", urls.normalize_url("url").alias("normalized"), urls.normalize_url(F.upper(loud)).alias("from_upper")
    )


@query
def url_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", urls.cache_key("url").alias("cache_key"))


@query
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", urls.chunk_id("url", "page_id").alias("chunk_id"))


@query
def url_host_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.source_mix(read_table(spark, sf, "pages"), "page_id")


@query
def fetch_classify(spark: SparkSession, sf: str) -> DataFrame:
    r = src.page_responses(spark, sf)
    status = fetch.fetch_status(
        F.col("http_status"), F.col("content_type"), F.col("content_length"), F.col("body_bytes"), F.col("failure"), MAX_BYTES
    )
    return r.select("page_id", status.alias("status"))


@query
def fetch_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fetch.status_counts(fetch_classify(spark, sf))


@query
def robots_allowed(spark: SparkSession, sf: str) -> DataFrame:
    rules = fetch.parse_robots(src.page_robots(spark, sf), "AttestaBot/0.1")
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    return fetch.robots_allowed(pages, rules).select("page_id", "allowed")


@query
def crawl_schedule(spark: SparkSession, sf: str) -> DataFrame:
    rules = fetch.parse_robots(src.page_robots(spark, sf), "AttestaBot/0.1")
    delays = rules.filter(F.col("crawl_delay").isNotNull()).select("host", "crawl_delay")
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    return fetch.crawl_schedule(pages, ["page_id"], delays).select("page_id", "host", "start_s")


@query
def search_merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    merged = search.merge_hits(src.page_hits(spark, sf))
    return merged.select("query_idx", "rank", "url")


@query
def search_query_hits(spark: SparkSession, sf: str) -> DataFrame:
    return search.query_hits(src.page_hits(spark, sf)).select("query_idx", "pos", "url")


# ---- extraction and chunking


@query
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", tx.title_from_html("html").alias("title"))


@query
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages", spread=True)
    docs = extract.extract_documents(pages)
    return docs.select("page_id", "title", "lang", F.posexplode("blocks").alias("block_no", "b")).select(
        "page_id", "title", "lang", "block_no", F.array_join("b.heading_path", " > ").alias("heading"), "b.text"
    )


@query
def html_chunks(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages", spread=True)
    docs = extract.extract_documents(pages).select("url", "title", "blocks")
    return chunking.chunk_documents(docs).withColumn("heading_path", F.array_join("heading_path", " > "))


def _chunk_view(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id",
        "chunk_id",
        F.col("position").cast("bigint").alias("position"),
        F.col("start_char").cast("bigint").alias("start_char"),
        F.col("end_char").cast("bigint").alias("end_char"),
        F.col("token_count").cast("bigint").alias("token_count"),
        F.array_join("heading_path", " > ").alias("heading"),
        F.md5("text").alias("text_md5"),
    )


@query
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_view(src.document_chunks(spark, sf))


def _line_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose lines are blocks, headed by the line's first letter."""
    lines = F.filter(F.split("text", "\n", -1), lambda ln: ln != "")
    blocks = F.transform(
        lines,
        lambda ln: F.struct(
            F.when(ln.rlike("^[A-M]"), F.array(F.lit("early"), F.substring(ln, 1, 1))).otherwise(F.array(F.lit("late"))).alias("heading_path"),
            ln.alias("text"),
        ),
    )
    return src.document_rows(spark, sf).select(
        "doc_id", src.document_url().alias("url"), F.lit("").alias("title"), blocks.alias("blocks")
    )


@query
def chunk_heading_islands(spark: SparkSession, sf: str) -> DataFrame:
    docs = _line_documents(spark, sf)
    groups = F.when(F.size("blocks") > 0, chunking.heading_groups(F.col("blocks")))
    return docs.select("doc_id", F.posexplode_outer(groups).alias("island", "g")).filter("island is not null").select(
        "doc_id",
        F.col("island").cast("bigint").alias("island"),
        F.array_join("g.heading_path", " > ").alias("heading"),
        F.col("g.start").cast("bigint").alias("start_char"),
        F.length("g.text").cast("bigint").alias("n_chars"),
    )


@query
def chunk_sectioned_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_view(chunking.chunk_documents(_line_documents(spark, sf), SMALL_CHUNKS))


@query
def chunk_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks measured in words instead of characters."""
    docs = src.document_rows(spark, sf)
    blocks = chunking.as_single_block(docs, src.document_url(), F.lit(""), F.col("text"), "doc_id", "source")
    return _chunk_view(chunking.chunk_documents(blocks, ChunkSettings(100, 20, 15), WORDS))


# ---- near duplicates


@query
def simhash_md5(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    return d.select("doc_id", sh.simhash64("text", hash_name="md5").alias("simhash"))


@query
def simhash_blake2b(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    return d.select("doc_id", sh.simhash64("text").alias("simhash"))


@query
def neardup_pairs_hamming(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.hamming_pairs(simhash_md5(spark, sf).select("simhash").distinct(), "simhash", 3)


@query
def dedup_greedy(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    return dedup.dedup(d, "doc_id", "text", hash_name="md5").withColumnRenamed("rank", "doc_id")


@query
def dedup_drop_rate(spark: SparkSession, sf: str) -> DataFrame:
    rate = dedup.drop_rate(dedup_greedy(spark, sf))
    return rate.withColumn("drop_rate", F.round("drop_rate", 9))


@query
def dedup_cosine_greedy(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    return dedup.dedup(e, "vec_id", None, "embedding", COSINE).withColumnRenamed("rank", "vec_id")


@query
def dedup_simhash_or_cosine(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf)
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    both = d.join(e, "doc_id", "left").select("doc_id", "text", "embedding")
    return dedup.dedup(both, "doc_id", "text", "embedding", COSINE, "md5").withColumnRenamed("rank", "doc_id")


# ---- index and retrieval


@query
def idempotent_insert(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that holds every document twice, into an index of the labelled ones."""
    d = src.document_rows(spark, sf).select(
        urls.chunk_id("source", "doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), "n_chars"
    )
    again = d.select("chunk_id", (F.col("ord") + 1_000_000_000).alias("ord"), (F.col("n_chars") + 1).alias("n_chars"))
    labelled = read_table(spark, sf, "labels").select("doc_id")
    held = src.document_rows(spark, sf).join(labelled, "doc_id", "left_semi").select(
        urls.chunk_id("source", "doc_id").alias("chunk_id")
    )
    return index.not_yet_indexed(d.unionByName(again), held)


@query
def lookup_semi(spark: SparkSession, sf: str) -> DataFrame:
    d = src.document_rows(spark, sf).select("doc_id", "source", "n_chars")
    return d.join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


@query
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2))
    unit = vec.normalize(scaled)
    return e.select(
        "vec_id",
        F.round(vec.norm(scaled), 6).alias("norm_before"),
        F.round(vec.dot(unit, "embedding"), 6).alias("cosine"),
        F.round(vec.squared_distance(unit, scaled), 6).alias("moved"),
    )


def _nearest(spark: SparkSession, sf: str, k: int) -> DataFrame:
    chunks = read_table(spark, sf, "embeddings", spread=True)
    return retrieve.nearest_chunks(
        chunks, src.label_questions(spark, sf), k, chunk_id="vec_id", vector="embedding", query_id="label"
    )


@query
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    near = _nearest(spark, sf, 200)
    return near.select("label", "vec_id", F.round("distance", 6).alias("distance"), F.col("ann_rank").cast("bigint").alias("ann_rank"))


@query
def knn_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The same neighbours as ``knn_topk``, from vectors laid out in cells."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/cells-{uuid.uuid4().hex}"
    cells = VectorCells.build(read_table(spark, sf, "embeddings", spread=True), folder, "vec_id", "embedding")
    near = cells.nearest(src.label_questions(spark, sf), 200, query_id="label")
    return near.select("label", "vec_id", F.round("distance", 6).alias("distance"), F.col("ann_rank").cast("bigint").alias("ann_rank"))


@query
def knn_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    """nDCG at 10 of each label's ranking, a vector of the label being relevant."""
    return retrieve.ndcg(_graded(spark, sf), "label", "ann_rank", "grade", 10).withColumn("ndcg", F.round("ndcg", 6))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    near = _nearest(spark, sf, 200)
    grades = read_table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("own"))
    return near.join(grades, "vec_id").select(
        "label", "ann_rank", F.when(F.col("own") == F.col("label"), 1.0).otherwise(0.0).alias("grade")
    )


@query
def knn_mean_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    """How good the rankings of all labels are on average."""
    return retrieve.mean_ndcg(_graded(spark, sf), "label", "ann_rank", "grade", 10).withColumn("mean_ndcg", F.round("mean_ndcg", 6))


@query
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    top = retrieve.lexical_top_k(
        src.document_rows(spark, sf), read_table(spark, sf, "benchmark"), 40, "doc_id", "text", "item_id", "text"
    )
    return top.select("item_id", "doc_id", F.round("score", 6).alias("score"), F.col("rn").cast("bigint").alias("rn"))


@query
def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """200 candidates per query by lexical overlap, reranked to 40 by word hits."""
    docs = src.document_rows(spark, sf)
    items = read_table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    found = retrieve.lexical_top_k(docs, items, 200, "doc_id", "text", "item_id", "question")
    found = cut_lineage(found.withColumnRenamed("rn", "ann_rank").drop("score"))
    # A text meets many questions; its terms are computed once.
    texts = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", tx.terms("text").alias("terms"))
    # Computed before the shuffle; a join right behind the projection would compute
    # the terms again for every match.
    texts = texts.repartition("doc_id")
    asked = items.select("item_id", tx.terms("question").alias("asked"))
    candidates = spread_out(found).join(texts, "doc_id").join(asked, "item_id")
    best = retrieve.rerank(candidates, 40, tx.term_hits, query_id="item_id", question="asked", text="terms")
    return best.select("item_id", "doc_id", "score", F.col("rerank_rank").cast("bigint").alias("rerank_rank"))


@query
def index_quantile(spark: SparkSession, sf: str) -> DataFrame:
    l = read_table(spark, sf, "lineitem")
    return quantile.index_quantiles(l, "l_extendedprice", [0.0, 0.05, 0.5, 0.95, 1.0])


# ---- triage and evidence


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """A model's reply per document: fenced, bare, out of range or no JSON."""
    labels = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    d = src.document_rows(spark, sf).select("doc_id", "n_chars").join(labels, "doc_id", "left")
    n = F.col("doc_id")
    body = F.to_json(
        F.struct(
            (F.coalesce(F.col("quality"), (n % 2).cast("int")) == 1).alias("relevant"),
            F.concat(F.lit("claim "), n.cast("string")).alias("claim"),
            ((n % 13) / 10).alias("confidence"),
        )
    )
    reply = F.when(n % 17 == 0, "not json").when(n % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return d.select("doc_id", triage.parse_verdict(reply).alias("verdict"))


@query
def triage_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = triage.keep_relevant(_replies(spark, sf))
    return kept.select("doc_id", "claim", F.round("confidence", 6).alias("confidence"))


@query
def triage_counters(spark: SparkSession, sf: str) -> DataFrame:
    return triage.triage_counts(_replies(spark, sf))


@query
def triage_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of models that quote numbers and write words or digits for booleans."""
    n = F.col("doc_id")
    words = F.array(*[F.lit(w) for w in ('"true"', '"Yes"', "1", "true", '"maybe"', '"no"', "0")])
    numbers = F.array(*[F.lit(w) for w in ('"0.9"', "0.9", '" 0.4 "', "1", "true", '"high"')])
    reply = F.concat(F.lit('{"relevant": '), F.get(words, (n % 7).cast("int")), F.lit(', "confidence": '), F.get(numbers, (n % 6).cast("int")), F.lit("}"))
    d = src.document_rows(spark, sf).select("doc_id", triage.outcome(triage.parse_verdict(reply)).alias("outcome"))
    return d.groupBy("outcome").agg(F.count("*").alias("n"))


def _gap_replies(spark: SparkSession, sf: str) -> DataFrame:
    """A gap analysis per language: a source is covered if it has at least ten documents of the language. Some replies are cut off."""
    d = read_table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    enough = F.when(F.col("n") >= 10, "true").otherwise("no")
    one = F.struct(F.col("source").alias("sub_question_id"), enough.alias("covered"), F.when(F.col("n") < 10, F.col("source")).alias("missing"))
    # A sub-question per source.
    per_lang = d.groupBy("lang").agg(F.collect_list(one).alias("assessments"), F.count_if(F.col("n") < 10).alias("few"))
    body = F.to_json(F.struct((F.col("few") == 0).alias("saturated"), "assessments", F.array("lang").alias("new_queries")))
    reply = F.when(F.col("lang") == "es", F.substring_index(body, "}", 1)).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return per_lang.select("lang", gap.parse_gap(reply).alias("gap"))


@query
def gap_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    return gap.gap_summary(_gap_replies(spark, sf), "lang")


@query
def gap_open_questions(spark: SparkSession, sf: str) -> DataFrame:
    return gap.open_questions(_gap_replies(spark, sf), "lang")


@query
def evidence_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return triage.accumulate(e, ["user_id", "event_type"], "event_id")


@query
def select_evidence(spark: SparkSession, sf: str) -> DataFrame:
    chosen = evidence.select_evidence(src.document_evidence(spark, sf), 45_000)
    return chosen.select("sub_question_id", "chunk_id", F.col("visit_no").cast("bigint").alias("visit_no"))


@query
def citation_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of a text are one chunk, whichever source they serve."""
    e = src.document_evidence(spark, sf).withColumn("chunk_id", F.substring(F.sha2("text", 256), 1, 16))
    return evidence.number_citations(e)


@query
def coverage_digest(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.coverage_digest(src.source_plan(spark, sf), src.document_evidence(spark, sf))


@query
def budgeted_digest(spark: SparkSession, sf: str) -> DataFrame:
    d = evidence.budgeted_digest(src.source_plan(spark, sf), src.document_evidence(spark, sf), 4734)
    return d.select("digest", F.col("step").cast("bigint").alias("step"))


@query
def corpus_text(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.corpus_text(evidence.select_evidence(src.document_evidence(spark, sf), 45_000))


@query
def references_text(spark: SparkSession, sf: str) -> DataFrame:
    chosen = evidence.select_evidence(src.document_evidence(spark, sf), 45_000)
    return evidence.references_text(evidence.citation_table(chosen))


@query
def section_digest(spark: SparkSession, sf: str) -> DataFrame:
    chosen = evidence.select_evidence(src.document_evidence(spark, sf), 45_000)
    return evidence.section_digest(src.source_plan(spark, sf), chosen)


@query
def plan_queries(spark: SparkSession, sf: str) -> DataFrame:
    q = search.all_queries(src.source_plan(spark, sf))
    return q.select("sq_ord", F.col("pos").cast("bigint").alias("pos"), "query")


@query
def plan_problems(spark: SparkSession, sf: str) -> DataFrame:
    return sections.check_plan(src.source_plan(spark, sf))


@query
def plan_sections(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "nation")
    plan = n.select(
        F.col("n_nationkey").alias("sq_ord"),
        F.col("n_name").alias("sub_question_id"),
        F.concat(F.lit("How is trade in "), F.col("n_name"), F.lit(" developing across the ports and regions it serves?")).alias("question"),
    )
    return sections.plan_sections(plan).select(
        F.col("section_ord").cast("bigint").alias("section_ord"), "title", "instructions",
        F.array_join("sub_question_ids", ",").alias("sub_question_ids"),
    )


# ---- citations and verification


def _citations(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered evidence of a budget; numbers 1..n."""
    return evidence.number_citations(evidence.select_evidence(src.document_evidence(spark, sf), 45_000))


@query
def citation_extract(spark: SparkSession, sf: str) -> DataFrame:
    t = src.cited_turns(spark, sf)
    return t.select("conv_id", "turn", F.array_join(ct.markers("markdown").cast("array<string>"), ",").alias("numbers"))


@query
def citation_dangling(spark: SparkSession, sf: str) -> DataFrame:
    return verify.dangling(src.cited_turns(spark, sf), ["conv_id", "turn"], "markdown", _citations(spark, sf))


@query
def strip_invalid_citations(spark: SparkSession, sf: str) -> DataFrame:
    t = src.cited_turns(spark, sf)
    return t.select("conv_id", "turn", ct.drop_unknown_markers("markdown", 20).alias("markdown"))


@query
def marker_multiset(spark: SparkSession, sf: str) -> DataFrame:
    t = src.cited_turns(spark, sf)
    swapped = F.regexp_replace("markdown", r"\[0", "[")
    lost = F.when(F.col("turn") % 2 == 0, swapped).otherwise(F.regexp_replace("markdown", r"\[[0-9]+\]", ""))
    return t.select("conv_id", "turn", ct.same_markers("markdown", lost).alias("same"))


@query
def polish_guard(spark: SparkSession, sf: str) -> DataFrame:
    t = src.cited_turns(spark, sf)
    key = F.concat_ws("-", "conv_id", "turn").alias("key")
    before = F.concat(F.lit("<!--Q-SECTION:A-->\n\n"), F.col("markdown"), F.lit("\n\n<!--Q-SECTION:B-->\n\nend"))
    after = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("\n"), F.regexp_replace(before, r"\. ", ".  ")))
        .when(F.col("turn") % 4 == 1, F.regexp_replace(before, r"\[[0-9]+\]", ""))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("Sure! "), before))
        .otherwise(F.regexp_replace(before, "SECTION:B", "SECTION:C"))
    )
    return sections.guard_polish(t.select(key, before.alias("text")), t.select(key, after.alias("text")))


@query
def unresolved_markers(spark: SparkSession, sf: str) -> DataFrame:
    t = src.cited_turns(spark, sf)
    whole = F.concat(F.col("markdown"), F.lit("\n## References\n\n[1] a\n[3] b\n[7] c"))
    return t.select("conv_id", "turn", F.array_join(ct.unresolved_in_report(whole).cast("array<string>"), ",").alias("missing"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as sections: every second one as a list, with a heading on top."""
    t = src.cited_turns(spark, sf)
    listed = F.concat(F.lit("- "), F.regexp_replace("markdown", "\n", "\n- "))
    md = F.concat(F.lit("### Part\n\n"), F.when(F.col("turn") % 2 == 0, listed).otherwise(F.col("markdown")))
    return verify.split_pieces(t.select("conv_id", "turn", md.alias("markdown")), ["conv_id", "turn"])


@query
def claim_units(spark: SparkSession, sf: str) -> DataFrame:
    p = _pieces(spark, sf)
    return p.select(
        "conv_id", "turn", F.col("block_no").cast("bigint").alias("block_no"),
        F.col("piece_no").cast("bigint").alias("piece_no"), "passthrough", "is_list", "piece",
    )


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    chunks = src.document_evidence(spark, sf).select("chunk_id", "text")
    with_text = verify.attach_evidence(cut_lineage(_pieces(spark, sf)), ["conv_id", "turn"], _citations(spark, sf), chunks)

    def score(text: Column, proof: Column) -> Column:
        return tx.lexical_overlap(text, proof) * 20 - 10

    def rewrites(text: Column, proof: Column) -> Column:
        marks = F.regexp_extract_all(text, F.lit(r"(\[\d+\])"), F.lit(1))
        return F.array(F.lit("no marker"), F.concat(tx.sentence(proof, 0), F.lit(" "), F.get(marks, F.lit(0))))

    # Written down without the texts it rests on; filters on the result would otherwise score the pieces again.
    return cut_lineage(verify.judge(with_text, score, rewrites).drop("numbers", "evidence"))


@query
def claim_evidence(spark: SparkSession, sf: str) -> DataFrame:
    chunks = src.document_evidence(spark, sf).select("chunk_id", "text")
    e = verify.attach_evidence(_pieces(spark, sf), ["conv_id", "turn"], _citations(spark, sf), chunks)
    return e.filter("evidence <> ''").select(
        "conv_id", "turn", F.col("block_no").cast("bigint").alias("block_no"),
        F.col("piece_no").cast("bigint").alias("piece_no"), F.md5("evidence").alias("evidence_md5"),
    )


@query
def claim_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    j = _judged(spark, sf)
    return j.filter("action is not null").select(
        "conv_id", "turn", F.col("block_no").cast("bigint").alias("block_no"),
        F.col("piece_no").cast("bigint").alias("piece_no"), F.round("entailment_score", 6).alias("entailment_score"),
        "action", F.col("rewrite_attempts").cast("bigint").alias("rewrite_attempts"),
    )


@query
def verify_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = verify.summarize(_judged(spark, sf))
    return s.withColumn("mean_entailment_score", F.round("mean_entailment_score", 6))


@query
def verify_bar(spark: SparkSession, sf: str) -> DataFrame:
    return verify.verification_bar(verify.summarize(_judged(spark, sf)))


@query
def verified_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return verify.rebuild(_judged(spark, sf), ["conv_id", "turn"])


# ---- ledger and run log


def _costs(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.ledger_costs(src.event_calls(spark, sf), ledger.price_table(spark))


@query
def pricing_asof(spark: SparkSession, sf: str) -> DataFrame:
    priced = ledger.with_prices(src.event_calls(spark, sf), ledger.price_table(spark))
    return priced.select("seq", "model", F.col("on_date").cast("string").alias("on_date"), "price_input", "price_output")


@query
def ledger_costs(spark: SparkSession, sf: str) -> DataFrame:
    return _costs(spark, sf).select("seq", F.round("cost_usd", 9).alias("cost_usd"))


@query
def ledger_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.ledger_rollup(_costs(spark, sf)).withColumn("cost_usd", F.round("cost_usd", 9))


@query
def running_cost(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.running_cost(_costs(spark, sf)).select("seq", F.round("spent", 9).alias("spent"))


@query
def cost_cap_breach(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.cap_breach(_costs(spark, sf), COST_CAP).select("seq", F.round("spent", 9).alias("spent"))


@query
def cost_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.cost_by_stage(_costs(spark, sf)).withColumn("cost_usd", F.round("cost_usd", 9))


@query
def stage_latest(spark: SparkSession, sf: str) -> DataFrame:
    s = runs.latest_stages(src.event_stages(spark, sf))
    return s.select("run_id", "stage", "seq", "status", "first_seq")


@query
def latest_completed_stage(spark: SparkSession, sf: str) -> DataFrame:
    return runs.latest_completed(runs.latest_stages(src.event_stages(spark, sf))).select("run_id", "stage", "seq")


@query
def stage_payloads(spark: SparkSession, sf: str) -> DataFrame:
    s = runs.latest_stages(src.event_stages(spark, sf))
    body = F.concat(F.lit('{"urls": [1, 2, 3], "nested": {"a": 1}, "n": '), F.get_json_object("payload", "$.k"), F.lit("}"))
    return runs.payload_summary(s.withColumn("payload", body)).select("run_id", "stage", "key", "summary")


@query
def run_list(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
    )
    return runs.list_runs(o)


# ---- report


@query
def funnel(spark: SparkSession, sf: str) -> DataFrame:
    e = src.document_evidence(spark, sf).filter("rerank_score > 0")
    return report.funnel(src.document_rows(spark, sf), dedup_greedy(spark, sf), e)


@query
def coverage_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.coverage_counts(src.document_evidence(spark, sf))


@query
def quality_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per source and language: the make-up of a corpus."""
    d = read_table(spark, sf, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query
def top_claims(spark: SparkSession, sf: str) -> DataFrame:
    e = src.document_evidence(spark, sf)
    best = top_k(e, ["sub_question_id"], evidence.global_order()[1:], 3, salt_on=["chunk_id"])
    return best.select("sub_question_id", "chunk_id", F.col("rn").cast("bigint").alias("rn"))


@query
def cited_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: documents to numbered evidence for the benchmark questions."""
    return cited_evidence(spark, sf)
