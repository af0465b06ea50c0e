"""The llm queries with SQL give DuckDB's rows; the others have the columns and distinct rows they should."""

import os

import oracle
import pytest

from weft.llm import queries, tokenizer

pytestmark = pytest.mark.skipif(not (os.path.isdir(oracle.DATA) and os.path.isdir(tokenizer.TOKENIZER_DIR)), reason="no test tables or tokenizer files here")
COLUMNS = {
    "p1_found": {"kind": "string", "key_a": "string", "key_b": "string"}, "p2_found": {"anchor_id": "string", "pos": "int", "candidate_id": "string"},
    "p3_found": {"source_file": "string", "row_id_in_file": "int", "field": "string"}, "p4_found": {"field": "string", "term": "string", "mark": "string"},
    "p5_found": {"group_id": "string", "node_id": "string"}, "p7_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"doc_id": "bigint", "seg_no": "int", "lang": "string"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    run, sql = queries.QUERIES[name]
    got = run(spark, oracle.DATA)
    if name in COLUMNS:
        assert dict(got.dtypes) == COLUMNS[name]
    names, rows = oracle.rows(got.toArrow())
    if sql:
        assert (names, rows) == oracle.rows(oracle.connect().execute(sql).to_arrow_table())
    if name.endswith("_found"):
        assert rows and len(set(rows)) == len(rows)
