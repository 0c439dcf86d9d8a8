import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import comparing
import pytest

from gavelspark.llm import queries

EXPECTED = {
    "p1_found": {"pair_id": "bigint", "defect": "string"},
    "p2_found": {"pair_id_a": "bigint", "pair_id_b": "bigint"},
    "p3_found": {"statement_id": "bigint", "en_start": "int", "fr_start": "int"},
    "p4_found": {"seq": "bigint", "group_key": "string"},
    "p5_found": {"table_name": "string", "first_seq": "bigint", "copy_seq": "bigint"},
    "p7_found": {"table_name": "string", "row_id": "bigint", "start_at": "int"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "kind": "string", "start_at": "int"},
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    names, rows = comparing.rows_of(queries.queries()[name](spark, comparing.DATA))
    expected_names, expected = comparing.sql_rows(comparing.connect(), queries.oracle_sql()[name])
    assert names == expected_names and rows == expected


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns_and_distinct_rows(spark, name):
    df = queries.queries()[name](spark, comparing.DATA)
    if name in EXPECTED:
        assert dict(df.dtypes) == EXPECTED[name]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))


def test_every_query_repeats(spark):
    for name in ("p1_found", "p2_found", "p3_found", "p8_containers"):
        query = queries.queries()[name]
        assert sorted(map(tuple, query(spark, comparing.DATA).collect()), key=str) == sorted(map(tuple, query(spark, comparing.DATA).collect()), key=str)
