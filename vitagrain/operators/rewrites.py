"""Rewrites of stored tables that are counted before they count.

A table is a folder of versions and a folder of commits. A rewrite writes a version
beside the old one, counts what it wrote while writing it, compares the counts with
what the step must leave, and only then adds its commit; readers take the version of
the newest commit. A step that fails, at any point, leaves the old table as it was.
One writer per table is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COMMIT = "number long, version string, n_rows long"


class RewriteRejected(ValueError):
    """The written rows are not what the step must leave."""


def _commits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMIT).parquet(f"{path}/commits")


def _newest(spark: SparkSession, path: str):
    return _commits(spark, path).orderBy(F.desc("number")).first()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of a table."""
    return spark.read.parquet(f"{path}/versions/{_newest(spark, path).version}")


def _write(df: DataFrame, path: str, number: int, check: Callable[[int], None]) -> int:
    version, seen = uuid.uuid4().hex, Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.parquet(f"{path}/versions/{version}")
    n_rows = df.sparkSession.read.parquet(f"{path}/versions/{version}").count()
    if n_rows != seen.get["n_rows"]:
        raise RewriteRejected(f"{seen.get['n_rows']} rows sent, {n_rows} stored")
    check(n_rows)
    df.sparkSession.createDataFrame([(number, version, n_rows)], COMMIT).write.mode("append").parquet(f"{path}/commits")
    return n_rows


def create(df: DataFrame, path: str) -> int:
    """Store a table's first version; returns its rows."""
    return _write(df, path, 0, lambda n: None)


def rewrite(spark: SparkSession, path: str, step: Callable[[DataFrame], DataFrame], change: int | None = None) -> tuple[int, int]:
    """Replace a table by a step over its rows; returns the rows before and after.

    ``change`` is how many rows the step must add (or, negative, remove); another number
    is refused.
    """
    newest = _newest(spark, path)
    current = spark.read.parquet(f"{path}/versions/{newest.version}")

    def check(n_rows: int) -> None:
        if change is not None and n_rows - newest.n_rows != change:
            raise RewriteRejected(f"{newest.n_rows} rows became {n_rows}, {newest.n_rows + change} expected")

    return newest.n_rows, _write(step(current), path, newest.number + 1, check)


def erasable(users: DataFrame, asked: DataFrame, actor: int | None) -> DataFrame:
    """Asked ids (id) with the reason against erasing them, blank where they may go.

    Nobody erases the own account, and of the active administrators one must be left:
    if all are asked for, the one with the smallest id stays. Without an actor no account
    is the own one; a role or state that is not known makes no administrator.
    """
    admin: Column = F.coalesce((F.col("role") == "admin") & F.col("is_active"), F.lit(False))
    known = users.select("id", admin.alias("admin")).join(asked.select("id", F.lit(True).alias("asked")).distinct(), "id", "left")
    left = known.agg(F.count_if(F.col("admin") & (F.col("asked").isNull() | (F.col("id") == actor))).alias("left")).scalar()
    keeper = known.where("admin").agg(F.min("id").alias("id")).scalar()
    last = F.coalesce(F.col("admin"), F.lit(False)) & (left == 0) & (F.col("id") == keeper)
    return asked.select("id").distinct().join(users.select("id", admin.alias("admin")), "id", "left").select(
        "id", F.when(F.col("admin").isNull(), "unknown").when(F.col("id") == actor, "own account")
        .when(last, "last administrator").otherwise("").alias("reason"))
