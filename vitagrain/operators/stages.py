"""Stage durations: totals, canonical order, slow stages, seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagrain.functions import lexicon as lx


def stage_dimension(spark) -> DataFrame:
    """(stage, stage_order, target): fixed size, one row per known stage."""
    rows = [(s, i, t) for i, (s, t) in enumerate(lx.STAGE_TARGETS.items(), 1)]
    return spark.createDataFrame(rows, "stage STRING, stage_order INT, target DOUBLE")


def stage_totals(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """Additive seconds per (key, stage) for known stages, in report order."""
    sums = rows.groupBy(key, "stage").agg(F.sum("seconds").alias("seconds"))
    return sums.join(F.broadcast(stage_dimension(rows.sparkSession)), "stage")


def stage_report(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """Stage totals plus one TOTAL line per key: grouping sets of one scan and one exchange."""
    known = rows.select(key, "stage", "seconds").join(F.broadcast(stage_dimension(rows.sparkSession)), "stage")
    sums = known.groupingSets([[key, "stage", "stage_order"], [key]], key, "stage", "stage_order").agg(
        F.sum("seconds").alias("seconds"), F.grouping("stage").alias("total"))
    return sums.select(
        key, F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("stage")).alias("stage"), "seconds",
        F.when(F.col("total") == 1, 99).otherwise(F.col("stage_order")).alias("stage_order"))


def slow_stages(totals: DataFrame) -> DataFrame:
    return totals.filter(F.col("seconds") > F.col("target"))


def seed(first: Column, earlier: Column) -> Column:
    """Merge two stage maps; the earlier one only fills absent keys."""
    return F.map_zip_with(first, earlier, lambda k, a, b: F.coalesce(a, b))
