"""Token-id shards with a minimal perfect hash index over document keys.

Documents are range partitioned by key and sorted; every task cuts its sorted
run into shards. A shard is one row of a Parquet table (Spark's writers reach
any store and a lost task is simply run again) and holds

- `before`: the ids of earlier shards of its part;
- `payload`: the ids of all its documents as raw little-endian integers, two
  bytes each if the vocabulary allows it, else four;
- `seeds`, `prints`, `ends`: a minimal perfect hash over its keys (hash and
  displace: every bucket of about four keys has the first seed that sends its
  keys to free slots), a 32-bit fingerprint of the key in each slot and the
  slot's end in the payload by slot rank, so a key is found in constant time
  and a foreign key is refused by its fingerprint;
- `keys`: the keys in order, for sequential reading.

A key is a document id and its occurrence (0, 1, ...), so repeated ids are all
stored and addressable. A shard knows the ids before it in its part, so global
starts need the totals of parts only, which are as many as shuffle partitions.

Defined cases: null or empty text has just the end id; rows with a null id are
stored ahead of all others under the null key; ties of the id are ordered by
text; an empty table gives an empty store; extra columns are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitagrain.llm.common import id_text, mix
from vitagrain.llm.tokens import codec

SHARD_DOCS = 4096
SHARD_IDS = 1 << 20
SHARD = ("part long, shard long, before long, low long, high long, n_docs long, n_ids long, width int, keys binary, "
         "seeds binary, slots binary, prints binary, ends binary, payload binary")
NULL_KEY = -(1 << 63)


def key_hash(keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """One 64-bit hash of (document id, occurrence)."""
    return mix(keys.astype(np.int64).view(np.uint64) + mix(turns.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))


def slot_of(hashes: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Slot of each hash when its bucket displaces by a seed."""
    return (mix(hashes ^ mix(seeds.astype(np.uint64) + np.uint64(1))) % np.uint64(size)).astype(np.int64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def build_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds by bucket, key number by slot and fingerprint by slot, for distinct hashes.

    Buckets are placed from the largest down; each tries seeds until its keys
    fall into free and different slots. Every slot is filled in the end.
    """
    n = len(hashes)
    buckets = max(1, -(-n // 4))
    seeds = np.zeros(buckets, np.uint32)
    slots = np.full(n, -1, np.int64)
    of = bucket_of(hashes, buckets)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in np.argsort(starts[:-1] - starts[1:], kind="stable"):
        mine = order[starts[b]: starts[b + 1]]
        if not len(mine):
            break
        seed = 0
        while True:
            tried = np.arange(seed, seed + 64, dtype=np.uint64)
            at = slot_of(hashes[mine][None, :], tried[:, None], n)
            fits = (slots[at] < 0).all(axis=1)
            if len(mine) > 1:
                spread = np.sort(at, axis=1)
                fits &= (spread[:, 1:] != spread[:, :-1]).all(axis=1)
            if fits.any():
                hit = int(np.argmax(fits))
                seeds[b] = seed + hit
                slots[at[hit]] = mine
                break
            seed += 64
    return seeds, slots, (hashes[slots] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def find(shard: dict, keys: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Position in the shard of each key, or -1 where the fingerprint differs."""
    hashes = key_hash(keys, turns)
    seeds = np.frombuffer(shard["seeds"], "<u4")
    slots = np.frombuffer(shard["slots"], "<u4")
    prints = np.frombuffer(shard["prints"], "<u4")
    at = slot_of(hashes, seeds[bucket_of(hashes, len(seeds))], len(slots))
    return np.where(prints[at] == (hashes & np.uint64(0xFFFFFFFF)), slots[at].astype(np.int64), -1)


def take(shard: dict, at: int) -> bytes:
    """The ids at a position, as little-endian unsigned 32-bit integers."""
    ends = np.frombuffer(shard["ends"], "<u8")
    low, high = (int(ends[at - 1]) if at else 0), int(ends[at])
    kind = "<u2" if shard["width"] == 2 else "<u4"
    return np.frombuffer(shard["payload"], kind, high - low, low * shard["width"]).astype("<u4").tobytes()


def _shards(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    held: list[tuple[int, int, bytes]] = []
    size, last, turn, before = 0, None, 0, 0
    tail = np.array([end_id], "<u4").tobytes()
    kind = "<u2" if width == 2 else "<u4"
    names = [f.split()[0] for f in SHARD.split(", ")]

    def close() -> pa.RecordBatch:
        nonlocal held, size, number, before
        keys = np.array([h[0] for h in held], "<i8")
        turns = np.array([h[1] for h in held], "<u4")
        seeds, slots, prints = build_index(key_hash(keys, turns))
        ends = np.cumsum([len(h[2]) // 4 for h in held], dtype="<u8")
        ids = np.frombuffer(b"".join(h[2] for h in held), "<u4")
        if width == 2 and ids.max(initial=0) > 0xFFFF:
            raise ValueError(f"id {ids.max()} does not fit into 2 bytes; write with width=4")
        row = [part, number, before, int(keys[0]), int(keys[-1]), len(held), int(ends[-1]), width,
               keys.tobytes() + turns.tobytes(), seeds.tobytes(), slots.astype("<u4").tobytes(), prints.tobytes(),
               ends.tobytes(), ids.astype(kind).tobytes()]
        kinds = [pa.int64()] * 7 + [pa.int32()] + [pa.binary()] * 6
        held, size, number, before = [], 0, number + 1, before + int(ends[-1])
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    encode = codec(vocabulary).encode
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            key = key.as_py()
            key = NULL_KEY if key is None else key
            turn = turn + 1 if key == last else 0
            last = key
            ids = encode(text.as_py()) + tail
            held.append((key, turn, ids))
            size += len(ids) // 4
            if len(held) >= SHARD_DOCS or size >= SHARD_IDS:
                yield close()
    if held:
        yield close()


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, width: int = 2) -> None:
    """Encode every document, append the end id and write the shards in ascending key order.

    width is the bytes of an id: 2 holds ids under 65,536 and raises an error on others.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = id_text(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(lambda batches: _shards(batches, vocabulary, end_id, width), SHARD)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The stored shards with the number of ids ahead of each (`start`)."""
    held = spark.read.schema(SHARD).parquet(path)
    # one row for each part that holds documents, that is at most one for each shuffle partition
    ahead = held.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    return held.join(F.broadcast(ahead), "part").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead", "before")


READ = "doc_id long, occurrence long, start long, n_tokens long, ids binary"


def _rows(keys, turns, starts, ids) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    columns = [[None if k == NULL_KEY else int(k) for k in keys], [int(t) for t in turns], starts,
               [len(x) // 4 for x in ids], ids]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=[f.split()[0] for f in READ.split(", ")])


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document, each found through the index of its shard: no shuffle of payloads."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                n = shard["n_docs"]
                keys = np.frombuffer(shard["keys"], "<i8", n)
                turns = np.frombuffer(shard["keys"], "<u4", n, 8 * n)
                at = find(shard, keys, turns)
                ends = np.frombuffer(shard["ends"], "<u8")
                for low in range(0, n, 512):
                    some = at[low: low + 512]
                    starts = [shard["start"] + (int(ends[a - 1]) if a else 0) for a in some]
                    yield _rows(keys[low: low + 512], turns[low: low + 512], starts, [take(shard, int(a)) for a in some])

    return shards(spark, path).mapInArrow(run, READ)


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The stored documents of `keys` (doc_id): only shards whose key range holds one are opened."""
    held = shards(spark, path)
    wanted = keys.select(F.coalesce(keys["doc_id"].cast("long"), F.lit(NULL_KEY)).alias("key")).distinct()
    spans = held.groupBy("part").agg(F.min("low").alias("low_"), F.max("high").alias("high_"))
    # one row for each part: bounded by the number of shuffle partitions
    wanted = wanted.join(F.broadcast(spans), (F.col("key") >= F.col("low_")) & (F.col("key") <= F.col("high_")))
    wanted = wanted.select("key", "part")
    near = wanted.join(held.select("part", "shard", "low", "high"), "part")
    near = near.where("key between low and high").selectExpr("part AS in_part", "shard AS in_shard", "key")
    opened = shards(spark, path).join(near.select("in_part", "in_shard").distinct(), F.expr(
        "part = in_part AND shard = in_shard"), "left_semi")

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        shard = {n: right.column(n)[0].as_py() for n in right.column_names}
        ends = np.frombuffer(shard["ends"], "<u8")
        found = []
        for key in left.column("key").to_pylist():
            for turn in range(shard["n_docs"]):
                at = int(find(shard, np.array([key]), np.array([turn]))[0])
                if at < 0 and turn == 0:  # the first occurrences may lie in the shard before
                    held_keys = np.frombuffer(shard["keys"], "<i8", shard["n_docs"])
                    held_turns = np.frombuffer(shard["keys"], "<u4", shard["n_docs"], 8 * shard["n_docs"])
                    found += [(key, int(held_turns[i]), int(i)) for i in np.flatnonzero(held_keys == key)]
                if at < 0:
                    break
                found.append((key, turn, at))
        starts = [shard["start"] + (int(ends[a - 1]) if a else 0) for _, _, a in found]
        return pa.Table.from_batches([_rows([f[0] for f in found], [f[1] for f in found], starts,
                                            [take(shard, f[2]) for f in found])])

    groups = near.groupBy("in_part", "in_shard").cogroup(opened.groupBy("part", "shard"))
    return groups.applyInArrow(run, READ)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids, read from the files."""
    return scan(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["build_index", "digest", "find", "lookup", "scan", "shards", "take", "write"]
