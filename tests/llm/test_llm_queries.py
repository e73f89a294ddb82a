import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import compare

from inkstrata.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.SF), reason="needs the test tables")
COLUMNS = {
    "p1_found": ["mark", "term"], "p2_found": ["id_a", "id_b"], "p3_found": ["id_a", "id_b"], "p4_found": ["given_name"], "p5_found": ["id", "kind"],
    "p6_found": ["id"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "end_at", "start_at"],
}


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_queries_equal_their_sql(spark, name):
    assert compare.rows_of(queries.queries()[name], spark) == compare.rows_of_sql(queries.oracle_sql()[name])


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_distinct_rows(spark, name):
    columns, rows = compare.rows_of(queries.queries()[name], spark)
    assert columns == COLUMNS[name] and rows and len(set(map(repr, rows))) == len(rows)
    if name in ("p2_found", "p3_found"):
        assert all(a < b for a, b in rows)
