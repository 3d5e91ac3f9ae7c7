"""Every registered query against its SQL on the smallest stored tables."""

import compare as cmp
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return cmp.duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf, name):
    status, _, detail = cmp.compare(spark, con, sf, QUERIES[name], ORACLES.get(name))
    assert status in ("match", "rows-only"), detail


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["doc_id", "item_id"] or set(df.columns) >= {"doc_id", "item_id", "score"}


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
