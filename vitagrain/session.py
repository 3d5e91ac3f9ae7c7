"""Session defaults. A cluster's own settings win; these fill the gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


READ_PARTS = "spark.vitagrain.readParts"


def build_session(cores: str = "*", app: str = "vitagrain", memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config(READ_PARTS, cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def read_parts(df: DataFrame, key: str) -> DataFrame:
    """Deal a scan out by key into as many parts as the session setting READ_PARTS names.

    Unset, as on a cluster, the scan's own splits stay. Local sessions set it, since a
    small file of one row group is one split.
    """
    parts = df.sparkSession.conf.get(READ_PARTS, None)
    return df.repartition(int(parts), key) if parts else df
