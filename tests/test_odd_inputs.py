"""Registered queries against their SQL on inputs that the stored tables lack."""

import compare as cmp
import duckdb
import pytest

import __spark_entry__ as entry


def agrees(spark, folder, name, tables):
    """Write (table, column types, rows) as Parquet and compare one query with its SQL over them."""
    con = duckdb.connect()
    for table, columns, rows in tables:
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    status, n, detail = cmp.compare(spark, con, str(folder), entry.queries()[name], entry.oracle_sql()[name])
    assert status == "match", detail
    return n


CUSTOMER = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"


@pytest.mark.parametrize("balances", [[5.0, 7.0, -1.0, 2.0], [-5.0, 7.0, None, 2.0]])
def test_the_own_account_may_be_number_zero(spark, tmp_path, balances):
    rows = [(i, f"c{i}", 1, b, s) for i, (b, s) in enumerate(zip(balances, ["BUILDING", "BUILDING", "BUILDING", "MACHINERY"]))]
    assert agrees(spark, tmp_path, "counted_erasure_m2", [("customer", CUSTOMER, rows)]) == 4


def test_skills_of_texts_without_plain_words(spark, tmp_path):
    texts = [None, "", "12 ... 34", "здравствуйте", "İzmir İİ kiİwi Kelvin", "Word word other WORD", "x"]
    rows = list(enumerate(texts))
    assert agrees(spark, tmp_path, "text_skills_w17_w18_t31_t41", [("documents", "doc_id BIGINT, text STRING", rows)]) == len(texts)
