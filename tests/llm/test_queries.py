"""llm queries against their oracles on the smallest tables."""

import pytest

from lexforge.llm import queries, sql
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_oracle(spark, tiny, name):
    compare(spark, tiny, queries.queries()[name], sql.oracle_sql()[name])


@pytest.mark.parametrize(
    ("name", "columns"),
    [("p1_found", ["rec_id", "term"]), ("p2_found", ["rec_id", "field"]), ("p3_found", ["rec_id", "sent_no", "start_pos", "end_pos"]), ("p5_found", ["plan_id", "stratum_id"]), ("p6_found", ["field", "term", "mark"]), ("p7_found", ["capacity_id", "doc_id"]), ("p8_found", ["mix_id", "source"]), ("p9_found", ["doc_id"])],
)
def test_found_columns(spark, tiny, name, columns):
    assert queries.queries()[name](spark, tiny).columns == columns
