"""Fetched bodies: what may be fetched, when, with what outcome, and the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from attesta.config import FetchSettings
from attesta.functions import urls
from attesta.operators.scan import row_rank

# Media types that count as a readable page.
READABLE_TYPES = ["text/html", "application/xhtml+xml", "text/plain"]


def media_type(content_type: Column | str) -> Column:
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.lower(F.trim(F.substring_index(F.coalesce(c, F.lit("")), ";", 1)))


def fetch_status(
    http_status: Column,
    content_type: Column,
    content_length: Column,
    body_bytes: Column,
    failure: Column,
    max_bytes: int = FetchSettings.max_bytes,
) -> Column:
    """Outcome of one request. A failed request is ``timeout`` or ``error``; else
    the declared length, the status, the media type and the received length are
    looked at in this order. A length that is no number counts as not declared."""
    declared = content_length.cast("string").try_cast("bigint")
    return (
        F.when(failure == "timeout", "timeout")
        .when(failure.isNotNull(), "error")
        .when(declared > max_bytes, "too_large")
        .when(http_status >= 400, "http_error")
        .when(~media_type(content_type).isin(READABLE_TYPES), "non_html")
        .when(body_bytes > max_bytes, "too_large")
        .otherwise("ok")
    )


def status_counts(fetched: DataFrame) -> DataFrame:
    return fetched.groupBy("status").agg(F.count("*").alias("n"))


def parse_robots(robots: DataFrame, agent: str) -> DataFrame:
    """``(host, body)`` to the rules that apply to ``agent``.

    Returns ``(host, allow, rule, pattern, crawl_delay)`` with ``pattern`` a
    regular expression. Of the groups of lines that name a part of the agent's name, those
    with the longest name apply, the ``*`` groups where there is none; the case of names does
    not count. A rule comes back in one form of percent-encoding (``same_encoding``). A body
    is read line by line inside its row.
    """
    token = F.lit(agent.split("/")[0].lower())
    lines = F.filter(
        F.transform(
            F.split("body", r"\r\n|\n|\r"),
            lambda ln: F.struct(
                F.lower(F.trim(F.regexp_extract(ln, r"^\s*([A-Za-z-]+)\s*:", 1))).alias("k"),
                F.trim(F.regexp_replace(F.regexp_replace(ln, r"^[^:]*:", ""), r"#.*$", "")).alias("v"),
            ),
        ),
        lambda ln: ln["k"].isin("user-agent", "allow", "disallow", "crawl-delay"),
    )
    # Agents named in a row open one group; a rule line ends the naming.
    zero = F.struct(
        F.array().cast("array<string>").alias("agents"),
        F.lit(True).alias("naming"),
        F.array().cast("array<struct<agents:array<string>,k:string,v:string>>").alias("rules"),
    )

    def step(acc: Column, ln: Column) -> Column:
        name = F.lower(ln["v"])
        agents = F.when(acc["naming"], F.array_append(acc["agents"], name)).otherwise(F.array(name))
        rule = F.struct(acc["agents"].alias("agents"), ln["k"].alias("k"), ln["v"].alias("v"))
        return F.when(
            ln["k"] == "user-agent",
            F.struct(agents.alias("agents"), F.lit(True).alias("naming"), acc["rules"].alias("rules")),
        ).otherwise(
            F.struct(
                acc["agents"].alias("agents"),
                F.lit(False).alias("naming"),
                F.array_append(acc["rules"], rule).alias("rules"),
            )
        )

    rules = robots.select("host", F.aggregate(lines, zero, step)["rules"].alias("rules"))

    # A name fits if the agent's own name contains it; the longest one that fits decides, of equally long ones the first.
    def fits(a: Column) -> Column:
        return (a != "") & (a != "*") & F.contains(token, a)

    names = F.flatten(F.transform("rules", lambda r: F.filter(r["agents"], fits)))
    longest = F.array_max(F.transform(names, lambda a, i: F.struct(F.length(a).alias("n"), (-i).alias("i"), a.alias("a"))))["a"]
    rules = rules.withColumn("name", F.coalesce(longest, F.lit("*")))
    mine = F.filter("rules", lambda r: F.array_contains(r["agents"], F.col("name")))
    rules = rules.select("host", mine.alias("rules"))
    delays = F.filter("rules", lambda r: r["k"] == "crawl-delay")
    paths = F.filter("rules", lambda r: r["k"].isin("allow", "disallow") & (r["v"] != ""))
    flat = rules.select(
        "host",
        F.get(F.transform(delays, lambda r: r["v"].try_cast("double")), F.lit(0)).alias("crawl_delay"),
        F.explode_outer(paths).alias("r"),
    )
    return flat.select(
        "host",
        (F.col("r.k") == "allow").alias("allow"),
        same_encoding(F.col("r.v")).alias("rule"),
        path_pattern(same_encoding(F.col("r.v"))).alias("pattern"),
        "crawl_delay",
    )


def same_encoding(path: Column) -> Column:
    """A path as it is compared: letters, digits and ``-._~`` as they are, everything beyond ASCII as
    the percent codes of its UTF-8 bytes, other percent codes in upper case, the rest as written."""

    def one(part: Column) -> Column:
        plain = F.unhex(F.substring(part, 2, 2)).cast("string")
        coded = F.when(F.rlike(plain, F.lit(r"^[A-Za-z0-9._~-]$")), plain).otherwise(F.upper(part))
        beyond = F.regexp_replace(F.hex(F.encode(part, "UTF-8")), "(..)", r"%$1")
        return F.when(F.length(part) == 3, coded).when(F.octet_length(part) > 1, beyond).otherwise(part)

    parts = F.regexp_extract_all(path, F.lit(r"(%[0-9A-Fa-f]{2}|[\s\S])"), F.lit(1))
    return F.array_join(F.transform(parts, one), "")


def path_pattern(rule: Column) -> Column:
    """A robots path with ``*`` and a closing ``$`` as a regular expression."""
    quoted = F.regexp_replace(rule, r"([\\.\[\]{}()+?^|$])", r"\\$1")
    starred = F.regexp_replace(quoted, r"\*", ".*")
    return F.concat(F.lit("^"), F.regexp_replace(starred, r"\\\$$", r"\$"))


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``allowed``: the longest matching rule decides, allow wins a tie, and a
    host without rules, or a URL without a host, is allowed.

    ``pages`` needs a ``url``. The join is on the host; a host with very many URLs
    is split by the skew handling of the join, since its rules are few.
    """
    paged = pages.withColumn("_host", urls.host("url")).withColumn("_path", same_encoding(urls.path_query("url")))
    told = rules.filter(F.col("rule").isNotNull()).select(
        F.col("host").alias("_host"),
        F.struct(
            F.length("rule").alias("n"), F.col("allow").alias("allow"), F.col("pattern").alias("pattern")
        ).alias("_rule"),
    )
    per_host = told.groupBy("_host").agg(F.collect_set("_rule").alias("_rules"))
    joined = paged.join(per_host, "_host", "left")
    hits = F.filter("_rules", lambda r: F.rlike(F.col("_path"), r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_host", "_path", "_rules")


def crawl_schedule(pages: DataFrame, order: list[str], delays: DataFrame | None = None,
                   settings: FetchSettings | None = None) -> DataFrame:
    """Add ``host`` and ``start_s``: requests to one host are spaced by the larger
    of the rate limit's interval and the host's crawl delay."""
    settings = settings or FetchSettings()
    base = 1.0 / settings.per_domain_rps if settings.per_domain_rps > 0 else 0.0
    rows = pages.withColumn("host", urls.host("url"))
    ranked = row_rank(rows, [F.col(c) for c in order], out="_n", partition=["host"])
    interval = F.lit(base)
    if delays is not None:
        per_host = delays.groupBy("host").agg(F.max("crawl_delay").alias("_delay"))
        ranked = ranked.join(per_host, "host", "left")
        interval = F.greatest(F.lit(base), F.coalesce("_delay", F.lit(0.0)))
    return ranked.select(*pages.columns, "host", ((F.col("_n") - 1) * interval).alias("start_s"))


class BodyCache:
    """Bodies keyed by the hash of their canonical URL, in 256 folders by its
    first two digits. A URL is never fetched twice."""

    # Declared, because the two hex digits of a folder would be read as a number.
    SCHEMA = (
        "url string, final_url string, http_status int, content_type string, fetched_at timestamp, body binary,"
        " cache_key string, shard string"
    )

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:
            return None

    def missing(self, pages: DataFrame) -> DataFrame:
        """The rows of ``pages`` (by ``url``) that the cache does not hold."""
        held = self.read()
        if held is None:
            return pages
        keyed = pages.withColumn("_key", urls.cache_key("url")).withColumn("_shard", F.substring("_key", 1, 2))
        held = held.select(F.col("cache_key").alias("_key"), F.col("shard").alias("_shard"))
        return keyed.join(held, ["_shard", "_key"], "left_anti").drop("_key", "_shard")

    def add(self, fetched: DataFrame) -> None:
        """Append successful rows: ``url, final_url, http_status, content_type,
        fetched_at, body``."""
        keyed = fetched.withColumn("cache_key", urls.cache_key("url"))
        keyed = keyed.withColumn("shard", F.substring("cache_key", 1, 2))
        fresh = self._distinct(keyed)
        held = self.read()
        if held is not None:
            fresh = fresh.join(held.select("shard", "cache_key"), ["shard", "cache_key"], "left_anti")
        fresh = fresh.select("url", "final_url", "http_status", "content_type", "fetched_at", "body", "cache_key", "shard")
        # Rows of one folder meet in one task, or every task would write 256 files;
        # a large batch is cut further by the key.
        fresh = fresh.repartition("shard", F.pmod(F.xxhash64("cache_key"), F.lit(16)))
        fresh.write.mode("append").partitionBy("shard").parquet(self.path)

    @staticmethod
    def _distinct(keyed: DataFrame) -> DataFrame:
        return keyed.dropDuplicates(["shard", "cache_key"])

    def lookup(self, pages: DataFrame) -> DataFrame:
        """Cached bodies for the ``url`` of each row."""
        held = self.read()
        if held is None:
            raise FileNotFoundError(f"no cached bodies at {self.path}")
        keyed = pages.select("url").withColumn("cache_key", urls.cache_key("url"))
        keyed = keyed.withColumn("shard", F.substring("cache_key", 1, 2))
        return keyed.join(held.drop("url"), ["shard", "cache_key"]).drop("shard", "cache_key")
