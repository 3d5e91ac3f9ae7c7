"""Shared helpers: reading tables, fresh column names, shared storage, Arrow slices."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task turns into numpy arrays at a time; a longer text is taken whole.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key as a long and the text with null read as empty; other columns are left out."""
    return docs.select(docs[key].cast("long").alias("doc_id"),
                       F.coalesce(docs[text], F.lit("")).alias("text"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Where the setting is empty a local master gets a folder of its own; a
    cluster without the setting is an error, since no machine-local folder
    would be seen by all executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="vitagrain-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vitagrain-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: cuts lineage."""
    path = f"{folder}/{re.sub(r'[^A-Za-z0-9_-]', '_', name)}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark removes the shuffle files of jobs whose rows were written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The string array in runs of about `limit` bytes, at least one element each."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset: array.offset + len(array) + 1]
    at = 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield array.slice(at, min(end, len(array)) - at)
        at = min(end, len(array))


def flat_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_binary array without nulls, and the offset of each element."""
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset: array.offset + len(array) + 1]
    data = array.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), for uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_table(keys: DataFrame, slots: int = 1 << 23) -> np.ndarray:
    """A bit for the slot of each key (xxhash64 modulo slots): a fixed amount of memory for any number of keys."""
    slot = F.pmod(F.xxhash64(*keys.columns), F.lit(slots))
    words = keys.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits")).toPandas()  # at most slots / 64 rows
    out = np.zeros(slots // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def slot_column(*columns: str, slots: int = 1 << 23):
    """The slot of a row in a bit table over the same columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots))


def held_bits(table_bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Whether the slots' bits are set."""
    return (table_bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
