"""Interval joins of month periods without a nested loop.

Periods are month numbers, both ends included; a null end is open. Each side is dealt
out over bins of ``width`` months that its periods touch, clipped to the months that
occur at all, and the sides meet by an equi-join on the bin. Two periods share several
bins but are paired in the first one they share only. As few bins may hold all rows,
the left side is dealt out over ``slots`` keys per bin and the right one repeated.
The months that occur are read ahead of the join, so hand in stored tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_number(day: str) -> str:
    """Months since year 0 of a date expression."""
    return f"(year({day}) * 12 + month({day}) - 1)"


def _domain(left: DataFrame, right: DataFrame) -> tuple[Column, Column]:
    ends = left.select("starts", "ends").unionByName(right.select("starts", "ends"))
    least = ends.agg(F.min(F.least("starts", "ends")).alias("low")).scalar()
    most = ends.agg(F.max(F.greatest("starts", "ends")).alias("high")).scalar()
    return least, most


def _dealt(df: DataFrame, low: Column, high: Column, width: int, name: str) -> DataFrame:
    """Rows once per bin they touch; an empty period (its end before its start) touches none."""
    held = df.withColumn(f"{name}_first", F.floor(F.greatest(F.coalesce("starts", low), low) / width))
    held = held.withColumn("last", F.floor(F.least(F.coalesce("ends", high), high) / width))
    held = held.where(f"last >= {name}_first AND (starts IS NULL OR ends IS NULL OR starts <= ends)")
    return held.withColumn("bin", F.explode(F.sequence(f"{name}_first", "last"))).drop("last").withColumnsRenamed(
        {"starts": f"{name}_starts", "ends": f"{name}_ends"})


def overlapping(left: DataFrame, right: DataFrame, width: int = 12, slots: int = 8) -> DataFrame:
    """Pairs of rows whose periods share a month. Both sides have ``starts`` and ``ends`` as month numbers."""
    low, high = _domain(left, right)
    slotted = left.withColumn("slot", F.pmod(F.xxhash64(*left.columns), F.lit(slots)))
    a = _dealt(slotted, low, high, width, "left")
    b = _dealt(right, low, high, width, "right").withColumn("slot", F.explode(F.expr(f"sequence(0L, {slots - 1}L)")))
    met = a.join(b, ["bin", "slot"]).where("bin = greatest(left_first, right_first)")
    met = met.where("coalesce(left_starts <= right_ends, true) AND coalesce(right_starts <= left_ends, true)")
    return met.drop("bin", "slot", "left_first", "right_first")


def forbidden(jobs: DataFrame, rules: DataFrame) -> DataFrame:
    """Jobs with the rules introduced after they ended; a job without a known end is allowed everything.

    ``jobs`` has an ``ends`` date, ``rules`` an ``introduced`` date: a rule forbids all
    months before its introduction, a period open to the left.
    """
    ended = jobs.where("ends IS NOT NULL").withColumn("ends", F.expr(month_number("ends"))).withColumn("starts", F.col("ends"))
    early = rules.withColumn("starts", F.expr("int(NULL)")).withColumn("ends", F.expr(f"{month_number('introduced')} - 1"))
    return overlapping(ended, early).drop("left_starts", "left_ends", "right_starts", "right_ends")
