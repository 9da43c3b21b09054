"""The queries with SQL against DuckDB on the smallest tables; the others run."""

import pytest
from oracle import compare, duck

from kgweave.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, sf, name):
    assert compare(llm.queries()[name](spark, sf), duck(sf), llm.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name, columns", [("p1_found", "id ref_id"), ("p6_ids", "doc_id ids"), ("p7_mix", "doc_id source size copies"), ("p8_found", "doc_id subject"), ("p1_unmatched", "name n_records"), ("p6_round_trip", "source n_documents n_tokens n_same")])
def test_runs(spark, sf, name, columns):
    df = llm.queries()[name](spark, sf)
    assert columns is None or df.columns == columns.split()
    assert df.count() > 0
