"""Declared schemas and the check that a table has one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

INDEX_VERSION = 1

_STR, _INT, _LONG, _DBL, _BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_STRS = T.ArrayType(_STR)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


HIT = _struct(
    ("query_idx", _INT), ("query", _STR), ("rank", _INT), ("url", _STR), ("title", _STR), ("snippet", _STR),
    ("engine", _STR), ("score", _DBL),
)
BLOCKS = T.ArrayType(_struct(("heading_path", _STRS), ("text", _STR)))
PAGE_CONTENT = _struct(("title", _STR), ("lang", _STR), ("published", _STR), ("blocks", BLOCKS))
CHUNK = _struct(
    ("chunk_id", _STR), ("url", _STR), ("doc_title", _STR), ("heading_path", _STRS), ("text", _STR),
    ("token_count", _INT), ("position", _INT), ("start_char", _INT), ("end_char", _INT),
)
INDEX = T.StructType(
    CHUNK.fields + _struct(("schema_version", _INT), ("vector", T.ArrayType(T.FloatType()))).fields
)
PLAN = _struct(
    ("sq_ord", _INT), ("sub_question_id", _STR), ("question", _STR), ("queries", _STRS), ("success_criterion", _STR)
)
VERDICT = _struct(("relevant", _BOOL), ("claim", _STR), ("evidence_span", _STR), ("confidence", _DBL))
EVIDENCE = _struct(
    ("ord", _LONG), ("sub_question_id", _STR), ("chunk_id", _STR), ("url", _STR), ("doc_title", _STR),
    ("heading_path", _STRS), ("text", _STR), ("start_char", _INT), ("end_char", _INT), ("claim", _STR),
    ("evidence_span", _STR), ("confidence", _DBL), ("rerank_score", _DBL),
)
LEDGER = _struct(
    ("seq", _LONG), ("on_date", T.DateType()), ("model", _STR), ("stage", _STR), ("iteration", _INT),
    ("batch", _BOOL), ("input_tokens", _LONG), ("output_tokens", _LONG), ("cache_creation_input_tokens", _LONG),
    ("cache_read_input_tokens", _LONG), ("context", _STR),
)


class SchemaMismatchError(Exception):
    """A stored table does not have the schema this build writes."""

    def __init__(self, found: int, expected: int, where: str) -> None:
        self.found, self.expected = found, expected
        super().__init__(
            f"table at {where} has schema v{found}, this build expects v{expected}; "
            "it can be rebuilt: remove it or name another folder"
        )


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def same_schema(found: T.StructType, expected: T.StructType) -> bool:
    """Same names in the same order with the same types; nullability aside."""
    return _shape(found) == _shape(expected)


def assert_schema(df: DataFrame, expected: T.StructType, where: str) -> DataFrame:
    """``df`` itself, or :class:`SchemaMismatchError` with the version found (-1
    where the table does not tell)."""
    if same_schema(df.schema, expected):
        return df
    found = -1
    if "schema_version" in df.columns:
        row = df.select("schema_version").head()
        if row is not None and row[0] is not None:
            found = int(row[0])
    raise SchemaMismatchError(found, INDEX_VERSION, where)
