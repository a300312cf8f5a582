"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.bpe import op9_bpe
from attesta.llm.chat import PERSPECTIVES_SQL, op8_perspectives
from attesta.llm.collocations import COLLOCATIONS_SQL, op11_collocations
from attesta.llm.decontaminate import op1_decontaminate
from attesta.llm.hyperminhash import op2_hyperminhash
from attesta.llm.imatch import op3_imatch
from attesta.llm.language import op7_language
from attesta.llm.line_windows import LINE_WINDOWS_SQL, op4_line_windows
from attesta.llm.passages import op13_passages
from attesta.llm.secrets import op6_secrets
from attesta.llm.spelling import op12_spelling
from attesta.llm.tag_paths import op10_tag_paths
from attesta.llm.warc import WARC_SQL, op5_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_hyperminhash": op2_hyperminhash,
    "op3_imatch": op3_imatch,
    "op4_line_windows": op4_line_windows,
    "op5_warc": op5_warc,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_perspectives": op8_perspectives,
    "op9_bpe": op9_bpe,
    "op10_tag_paths": op10_tag_paths,
    "op11_collocations": op11_collocations,
    "op12_spelling": op12_spelling,
    "op13_passages": op13_passages,
}

ORACLES: dict[str, str] = {
    "op4_line_windows": LINE_WINDOWS_SQL,
    "op5_warc": WARC_SQL,
    "op8_perspectives": PERSPECTIVES_SQL,
    "op11_collocations": COLLOCATIONS_SQL,
}
