"""Every core query against its oracle, or, where SQL can't say it, for rows and schema."""

import pytest

from lexforge import queries as core
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_oracle(spark, tiny, name):
    compare(spark, tiny, core.QUERIES[name], core.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_rows(spark, tiny, name):
    df = core.QUERIES[name](spark, tiny)
    rows = df.collect()
    assert (rows or name == "p4_sections") and len(df.columns) == len(set(df.columns))  # no response has sections at this scale


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
