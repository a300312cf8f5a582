"""Verdicts on chunks: parsing, filtering, counting, accumulating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.config import TriageSettings
from attesta.functions.text import strip_code_fences
from attesta.schemas import VERDICT


# What models write for yes and no, besides JSON's own.
YES = ["true", "t", "yes", "y", "on", "1", "1.0"]
NO = ["false", "f", "no", "n", "off", "0", "0.0"]


def lenient_boolean(value: Column) -> Column:
    """The text of a JSON value as a boolean: JSON's own, 0 and 1, or a word for yes or no; else NULL."""
    word = F.lower(value)
    return F.when(word.isin(YES), F.lit(True)).when(word.isin(NO), F.lit(False))


def lenient_number(value: Column) -> Column:
    """The text of a JSON value as a number: a number, quoted or not, or a boolean as 0 or 1; else NULL."""
    word = F.lower(F.trim(value))
    return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(word.try_cast("double"))


def parse_verdict(reply: Column | str) -> Column:
    """A model's JSON reply as a verdict, NULL where it is malformed: no JSON,
    ``relevant`` or ``confidence`` missing or not to be read as such, or a confidence outside 0..1."""
    # Values as the reply has them; their types are judged afterwards.
    raw = ", ".join(f"{f.name} string" for f in VERDICT.fields)
    parsed = F.from_json(strip_code_fences(reply), raw, {"mode": "PERMISSIVE"})
    relevant, confidence = lenient_boolean(parsed["relevant"]), lenient_number(parsed["confidence"])
    return F.when(
        relevant.isNotNull() & confidence.between(0.0, 1.0),
        F.struct(
            relevant.alias("relevant"),
            F.coalesce(parsed["claim"], F.lit("")).alias("claim"),
            F.coalesce(parsed["evidence_span"], F.lit("")).alias("evidence_span"),
            confidence.alias("confidence"),
        ),
    )


def outcome(verdict: Column | str, floor: float | None = None) -> Column:
    """``kept``, ``dropped_verdict`` or ``dropped_malformed``."""
    floor = TriageSettings.confidence_floor if floor is None else floor
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    return (
        F.when(v.isNull(), "dropped_malformed")
        .when(v["relevant"] & (v["confidence"] >= floor), "kept")
        .otherwise("dropped_verdict")
    )


def keep_relevant(judged: DataFrame, floor: float | None = None) -> DataFrame:
    """Rows with a relevant verdict at or above the floor, verdict unpacked."""
    kept = judged.filter(outcome("verdict", floor) == "kept")
    others = [c for c in judged.columns if c != "verdict"]
    return kept.select(*others, "verdict.claim", "verdict.evidence_span", "verdict.confidence")


def triage_counts(judged: DataFrame, floor: float | None = None) -> DataFrame:
    """One row: ``n_in, n_kept, n_dropped_verdict, n_dropped_malformed``."""
    o = outcome("verdict", floor)
    return judged.agg(
        F.count("*").alias("n_in"),
        *[F.count_if(o == name).alias(f"n_{name}") for name in ("kept", "dropped_verdict", "dropped_malformed")],
    )


def accumulate(evidence: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Evidence of all passes, one row per key: the value of the last pass at the
    position of the first. ``order`` grows with the passes and is unique."""
    others = [c for c in evidence.columns if c not in (*keys, order)]
    latest = F.max_by(F.struct(*others), order)
    merged = evidence.groupBy(*keys).agg(F.min(order).alias(order), latest.alias("_last"))
    return merged.select(*[F.col(f"_last.{c}").alias(c) if c in others else F.col(c) for c in evidence.columns])
