"""Row numbers and deep pages without gathering what comes before.

Rows are counted in buckets of a whole-number order column; the buckets before one
give its offset. A bucket holds ``width`` values of the order column, so no task gets
more than one key's rows in one bucket, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.sources.scratch import stored

WIDTH = 4096


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "n", width: int = WIDTH) -> DataFrame:
    """Rows with their number (from 1) within their keys by a unique whole-number column."""
    bucketed = df.withColumn("bucket", F.floor(F.col(order) / width))
    counts = bucketed.groupBy(*keys, "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("skip", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    local = Window.partitionBy(*keys, "bucket").orderBy(order)
    met = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in [*keys, "bucket"]]
    rows = bucketed.withColumn("at", F.row_number().over(local)).alias("r").join(offsets.alias("o"), met)
    return rows.select("r.*", (F.col("at") + F.col("skip")).alias(name)).drop("at", "bucket")


def deep_page(df: DataFrame, key: str, page: int, size: int, width: int = 1 << 18, clamp: bool = False) -> DataFrame:
    """One page, newest first, by a unique whole-number key.

    Counts per bucket of the key, a scan of that column alone, tell the few buckets that
    the page touches; the rows are read by a key range that file statistics can prune.
    ``clamp`` pulls a page behind the end back to the last one, in the plan.
    """
    counts = df.groupBy(F.floor(F.col(key) / width).alias("bucket")).agg(F.count("*").alias("held"))
    upto = Window.orderBy(F.col("bucket").desc())  # a row per bucket, not per row of the table
    counts = counts.withColumn("upto", F.sum("held").over(upto)).withColumn("before", F.col("upto") - F.col("held"))
    asked = counts.withColumn("every", F.max("upto").over(Window.partitionBy()))
    last = f"least({page}L, greatest(1L, bigint(ceil(every / {size}))))" if clamp else f"{page}L"
    asked = asked.withColumn("skip", F.expr(f"({last} - 1) * {size}"))
    asked = asked.where(f"upto > skip AND before < skip + {size}").agg(
        F.min("bucket").alias("low"), F.max("bucket").alias("high"), (F.min("skip") - F.min("before")).alias("skip"))
    low, high, skip = (asked.select(c).scalar() for c in ("low", "high", "skip"))
    near = df.where((F.col(key) >= low * width) & (F.col(key) < (high + 1) * width))
    place = F.row_number().over(Window.orderBy(F.col(key).desc()))  # the rows of the touched buckets
    near = near.withColumn("place", place).withColumn("skip", skip)
    return near.where(f"place > skip AND place <= skip + {size}").drop("place", "skip")


def positions(df: DataFrame, *order, within: str | None = None, name: str = "position") -> DataFrame:
    """Rows with their place (from 1) in an order over any columns, which should tell all rows apart.

    Rows are dealt out by ranges of the order, sorted inside their range and stored once;
    the rows of earlier ranges are counted, not read. ``within`` restarts the places for
    each value of a column, the first one of the order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()  # range number, then place in the range
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("range", F.shiftright(row, 33)).withColumn("row", row.bitwiseAND((1 << 33) - 1)))
    counts = ranged.groupBy("range").agg(F.count("*").alias("held"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = counts.select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("skip"))
    placed = ranged.join(offsets, "range").withColumn(name, F.col("row") + F.col("skip") + 1).drop("range", "row", "skip")
    if within is None:
        return placed
    first = placed.groupBy(within).agg(F.min(name).alias("least"))
    met = F.col(f"p.{within}").eqNullSafe(F.col(f"f.{within}"))
    return placed.alias("p").join(first.alias("f"), met).select("p.*", "f.least").withColumn(
        name, F.col(name) - F.col("least") + 1).drop("least")
