from __future__ import annotations

import __spark_entry__ as entry
import pytest

from compare import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # Queries of the optional package are listed and tested there.
    names = set(entry.queries()) - set(entry.QUERIES) - {"pipeline"}
    assert names - set(entry.oracle_sql()) == {"html_blocks", "html_chunks", "simhash_blake2b"}
    out = entry.entry(spark)
    assert out.columns == ["number", "sub_question_id", "chunk_id", "rerank_score", "token_count"]
    numbers = sorted({r.number for r in out.collect()})
    assert numbers == list(range(1, len(numbers) + 1)) and numbers


@pytest.mark.parametrize(
    "name",
    ["chunk_documents", "chunk_sectioned_documents", "select_evidence", "knn_topk", "rerank_topk", "claim_verdicts",
     "ledger_grouping_sets", "robots_allowed", "index_quantile", "plan_sections", "dedup_cosine_greedy", "funnel"],
)
def test_query_equals_its_sql(spark, name):
    con = connect(SMALL)
    line = compare(spark, con, SMALL, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("SAME"), line
