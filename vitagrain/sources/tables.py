"""Readers and writers. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Additive reads: a column named here but absent from the file reads as null.
SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "benchmark": "item_id BIGINT, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one stored table."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One document per text file, keyed by its file name."""
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("doc_id"),
        F.col("value").alias("text"),
    )


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested documents, one JSON object per file or per line."""
    return spark.read.schema(schema).json(path)


def write_json_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """Nested documents as line-delimited JSON."""
    df.write.mode(mode).json(path)


def append_activity(df: DataFrame, path: str, time_column: str = "created_at") -> None:
    """Append activity facts, one folder per day, so day ranges prune files."""
    (
        df.withColumn("day", F.to_date(time_column))
        .repartition("day", F.pmod(F.xxhash64(*df.columns), F.lit(8)))
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def export_csv(df: DataFrame, folder: str, prefix: str, day: str) -> str:
    """Headed CSV under a dated name; the writers stay parallel."""
    target = f"{folder}/{prefix}-{day}"
    df.write.mode("overwrite").option("header", True).csv(target)
    return target


def stage_map(payload: Column) -> Column:
    """Parse a stored stage-duration map."""
    return F.from_json(payload, "map<string,double>")


def owner_check(requests: DataFrame, owners: DataFrame, key: str = "file_id") -> DataFrame:
    """Access decision per request: the sidecar owner must be the caller."""
    sidecar = owners.select(key, F.col("user_id").alias("owner_id"))
    return requests.join(sidecar, key, "left").withColumn(
        "allowed", F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False))
    )
