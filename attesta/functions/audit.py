"""Detectors for secrets, private paths and nested URLs in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the detectors look for and what they let pass.
KEY_SHAPE = r"sk-ant-[A-Za-z0-9_-]{8,}"
REDACTED_KEY = "sk-ant-REDACTED"
PRIVATE_KEY_HEADERS = ["BEGIN RSA PRIVATE KEY", "BEGIN OPENSSH PRIVATE KEY"]
ALLOW_MARKS = ["not-a-real-key", "pragma: allowlist secret"]
WINDOWS_HOME = r"[A-Za-z]:\\Users\\"
UNIX_HOME = r"/home/[A-Za-z0-9_.-]+/"


def _has_any(line: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | (F.instr(line, needle) > 0)
    return found


def scan_lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per suspicious line: ``(key, line_no, finding)``.

    A finding is ``api_key``, ``private_key`` or ``home_path``. Lines that carry
    an allow mark are skipped for keys, and a key that is already redacted is no
    finding. The matched secret itself is never returned.
    """
    lines = files.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r", -1)).alias("pos", "line"))
    keys = F.filter(
        F.regexp_extract_all("line", F.lit(f"({KEY_SHAPE})"), F.lit(1)), lambda k: k != REDACTED_KEY
    )
    allowed = _has_any(F.col("line"), ALLOW_MARKS)
    found = F.array_compact(
        F.array(
            F.when(~allowed & (F.size(keys) > 0), "api_key"),
            F.when(~allowed & _has_any(F.col("line"), PRIVATE_KEY_HEADERS), "private_key"),
            F.when(F.col("line").rlike(WINDOWS_HOME) | F.col("line").rlike(UNIX_HOME), "home_path"),
        )
    )
    return lines.select(
        key, (F.col("pos") + 1).cast("bigint").alias("line_no"), F.explode(found).alias("finding")
    )


def nested_urls(docs: DataFrame, key: str, json_col: str) -> DataFrame:
    """Every string under a ``url`` key, at any depth of a JSON document."""
    pattern = r'"url"\s*:\s*"((?:[^"\\]|\\.)*)"'
    quoted = F.regexp_extract_all(F.col(json_col), F.lit(pattern), F.lit(1))
    decoded = F.transform(
        quoted,
        lambda u: F.from_json(F.concat(F.lit('{"u":"'), u, F.lit('"}')), "u string")["u"],
    )
    return docs.select(key, F.posexplode(decoded).alias("pos", "url"))
