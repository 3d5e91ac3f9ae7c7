"""Harmonic packing of token ids into sequences of a fixed capacity.

Piece lengths fall into reciprocal-capacity classes: class j holds lengths in
(C/(j+1), C/j] and its bins take exactly j pieces. A document longer than C
gives whole bins first; a rest that would leave more than `slack` of its slot
empty is cut at a reciprocal C/k, chosen so that the remainder (of `least` ids
or more) nearly fills a slot too. Workers number the pieces of each class on their own; a
count for each (part, class) turns that into global ranks, so piece r of class
j lies in bin r // j and no bin needs a worker to know another's pieces.

What does not fill a bin of its class (under one bin for each class, so a
constant amount whatever the input) is laid end to end and cut at C, which
leaves one padded sequence in all.

Ids are written once with the pieces in the shared folder; only lengths travel.

Defined cases: null or empty text is just the end id; repeated rows and ids are
packed as often as they come; null keys are carried; an empty table gives no
pieces; extra columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.llm.common import id_text, shared_folder, written
from vitagrain.llm.tokens import codec

CAPACITY = 4096
SLACK = 0.02
LEAST = 32
PIECES = ("doc_id long, start long, length long, doc_tokens long, class int, part long, number long, "
          "ids binary")  # number counts the pieces of its part and class


@lru_cache(maxsize=1 << 16)
def _rest_cuts(n: int, capacity: int, least: int, more: int) -> tuple[int, tuple[int, ...]]:
    """Slots left empty and lengths for a rest of n ids, with up to `more` cuts."""
    best = (capacity // (capacity // n) - n, (n,))
    if not more:
        return best
    for k in range(capacity // n + 1, capacity // least + 1):
        at = capacity // k
        if best[0] and n - at >= least:
            empty, held = _rest_cuts(n - at, capacity, least, more - 1)
            if empty < best[0]:
                best = (empty, (at, *held))
    return best


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK, least: int = LEAST) -> list[int]:
    """Lengths of the pieces of a document with n ids, in order.

    A rest is cut no more often than needed (twice at most) to leave slots emptier
    than slack; cuts lie at reciprocals C/k, where a piece fills its slot.
    """
    out = [capacity] * (n // capacity)
    n %= capacity
    if not n:
        return out
    for more in range(3):
        empty, held = _rest_cuts(n, capacity, least, more)
        if empty <= slack * n:
            break
    return [*out, *held]


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """One row for each piece with its ids (little-endian unsigned 32-bit) and its class."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 2 + [pa.binary()]
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), Counter()
        encode = codec(vocabulary).encode
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = []
                for key, text in zip(batch.column(0)[low: low + 256], batch.column(1)[low: low + 256]):
                    ids = encode(text.as_py()) + tail
                    n, start = len(ids) // 4, 0
                    for length in cuts(n, capacity, slack):
                        kind = capacity // length
                        rows.append((key.as_py(), start, length, n, kind, part, number[kind],
                                     ids[4 * start: 4 * (start + length)]))
                        start += length
                        number[kind] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return id_text(docs).mapInArrow(run, PIECES)


def place(made: DataFrame, carry: Callable[[Column], Column], capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece; `carry` is what is kept of a piece's ids."""
    counts = made.groupBy("part", "class").agg(F.count("*").alias("n"))
    ahead = counts.select("part", "class", F.coalesce(F.sum("n").over(
        Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    # classes are distinct values of capacity // length: at most 2 * sqrt(capacity) rows
    full = counts.groupBy("class").agg(F.floor(F.sum("n") / F.col("class")).alias("bins"))
    full = full.withColumn("base", F.coalesce(F.sum("bins").over(
        Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    full = full.withColumn("first", F.sum("bins").over(Window.partitionBy()))
    at_piece = ["part", "class", "number"]
    numbered = made.select("doc_id", "start", "length", "doc_tokens", *at_piece, carry(F.col("ids")).alias("carried"))
    ranked = numbered.join(ahead, ["part", "class"]).join(F.broadcast(full), "class").withColumn(
        "rank", F.col("ahead") + F.col("number"))
    inside = F.col("rank") < F.col("bins") * F.col("class")
    kept = ["doc_id", "start", "length", "doc_tokens"]
    bins = ranked.where(inside).select(*kept, "carried", "rank", (
        F.col("base") + F.floor(F.col("rank") / F.col("class"))).alias("sequence_id"))
    before = F.sum("length").over(
        Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.select(*kept, "carried", "sequence_id", F.coalesce(before, F.lit(0)).alias("offset"))

    # under one bin for each class: a constant number of rows and ids, whatever the input
    rest = ranked.where(~inside).select(*at_piece, "first", F.coalesce(F.sum("length").over(
        Window.orderBy("class", "rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    rest = made.join(F.broadcast(rest), at_piece).withColumn("bin", F.explode(F.sequence(
        F.floor(F.col("at") / capacity), F.floor((F.col("at") + F.col("length") - 1) / capacity))))
    low = F.greatest(F.col("at"), F.col("bin") * capacity)
    high = F.least(F.col("at") + F.col("length"), (F.col("bin") + 1) * capacity)
    rest = rest.withColumn("low", low).withColumn("size", (high - low).cast("long"))
    skipped = F.col("low") - F.col("at")
    rest = rest.select(
        "doc_id", (F.col("start") + skipped).alias("start"), F.col("size").alias("length"), "doc_tokens",
        carry(F.col("ids").substr((skipped * 4 + 1).cast("int"), (F.col("size") * 4).cast("int"))).alias("carried"),
        (F.col("first") + F.col("bin")).alias("sequence_id"), (F.col("low") - F.col("bin") * capacity).alias("offset"))
    return bins.unionByName(rest)


def pack(docs: DataFrame, vocabulary: str, end_id: int, carry: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset and `carried` (the ids, or what carry makes of them)."""
    spark = docs.sparkSession
    return place(written(pieces(docs, vocabulary, end_id), shared_folder(spark), "pieces"), carry)


def digest(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """The packed pieces with a crc32 in place of their ids."""
    return pack(docs, vocabulary, end_id, F.crc32).select(
        "doc_id", "start", "length", F.col("carried").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
