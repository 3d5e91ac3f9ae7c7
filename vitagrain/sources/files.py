"""File sources and sinks that tolerate spoilt input and may be run again.

Nested JSON splits into what parsed and what did not, both with their file; activity is
appended in batches that a rerun replaces; small files are listed as rows and only read
where they are accepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Holds a line that does not parse; no field of a schema may have this name.
SPOILT = "_spoilt"


def read_json_checked(spark: SparkSession, path: str, schema: str, required: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nested documents, one JSON object per line: those that parse, and (file, line) of those that don't.

    A document whose ``required`` field is null is rejected as well.
    """
    read = spark.read.schema(f"{schema}, {SPOILT} STRING").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", SPOILT).json(path)
    fields = [c for c in read.columns if c != SPOILT]
    whole = F.to_json(F.struct(*fields))
    read = read.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    bad = F.col(SPOILT).isNotNull()
    if required:
        bad = bad | F.col(required).isNull()
    return (read.where(~bad).select(*fields, "file"),
            read.where(bad).select("file", F.coalesce(F.col(SPOILT), whole).alias("line")))


def append_batch(df: DataFrame, path: str, batch: str, time_column: str = "created_at") -> None:
    """Append activity under day and batch folders; the same batch again replaces itself and adds nothing.

    Days are rebalanced by size, so a large day is many files and small ones are few.
    """
    dated = df.withColumn("day", F.to_date(time_column)).withColumn("batch", F.lit(batch))
    (dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("day", "batch").parquet(path))


def read_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Appended activity of an inclusive range of days; only their folders are read."""
    return spark.read.parquet(path).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, extension, length) of every file below a folder; contents are not read. Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return files.withColumn("extension", F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1)))


def file_reason(extensions: list[str], limit: int) -> F.Column:
    """Why a listed file is not accepted, blank if it is."""
    return (F.when(~F.col("extension").isin(extensions), "extension").when(F.col("length") == 0, "empty")
            .when(F.col("length") > limit, "too large").otherwise(""))


def accepted_files(spark: SparkSession, path: str, extensions: list[str], limit: int) -> DataFrame:
    """(path, length, text) of accepted files: a name filter and pushed length bounds keep the others unread."""
    names = "*{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(path)
    return files.where(f"length > 0 AND length <= {limit}").select(
        "path", "length", F.decode("content", "UTF-8").alias("text"))
