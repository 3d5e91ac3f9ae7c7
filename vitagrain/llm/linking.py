"""Components of similar sets, from postings of candidate keys to a distributed union-find.

Sets (by node) meet under keys: prefix n-grams or signature bands. A key shared
by many nodes must not yield all their pairs, so linking goes in rounds:

1. Leader rounds. Each key names up to LEADERS leaders, of different components:
   nodes with few keys of their own, hence near the middle of their group. Every
   node is compared with the LEADERS leaders of other components that it shares
   most keys with, so a group of any size costs a fixed number of comparisons
   for each of its nodes. Links join components.
2. Last round. Nodes that still share a key but no component are compared in
   full: those outside a key's largest component against all others of the key.
   Jaccard distance is a metric: where both were measured against the same
   leader and the distances differ by more than a link may be long, the pair
   cannot link and is left out, as is one whose sets, given `parity`, differ in too
   many parts of the hash range. No candidate is capped or dropped.

Where sets come with bits for a test (`SKETCH`), all pairs under a key are tested by bits and
sizes where its postings meet, in numpy. Pairs that pass are compared at once, but for parts of large keys in
which most pairs pass (groups of copies): only their postings go on to the rounds.

Pairs inside a component are not compared in the last round, since they cannot change it;
no pair is compared twice. Joins are equi-joins that adaptive execution may split;
everything reused is written to the shared folder.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.llm.common import held_bits, mix, shared_folder, swept, written

LEADERS = 3
#: The bit table of shared keys has two to this power bits: 2 MB.
SLOT_BITS = 24
#: The hash range has two to this power parts, whose counts are bytes; a set with more than FULL_MARK in one has no marks.
MARK_BITS, FULL_MARK = 8, 127
#: Parts whose counts are held as odd or even, one bit each: thin enough to travel with the postings of the last round.
PARITY_BITS = 9
#: Longs that go along with a posting: whether the number of a set's hashes in each part of the hash range is odd. Sets of up to
#: SMALL items have these 256 parts, those of up to twice as many (a level more) twice as many parts, and so on for LEVELS levels.
#: How far a pair may stray from the number of unequal parts expected at the threshold, in standard deviations.
SKETCH = ["bits_0", "bits_1", "bits_2", "bits_3"]
SMALL, LEVELS, STRAY = 320, 5, 4.5
#: Bits of n below the key of a packed posting.
SIZE_BITS = 27
#: Postings are packed into two to this power buckets by their keys, so many longs at a time.
BUCKET_BITS, GATHER = 9, 1 << 20
#: The bands are taken in so many turns, so that only one turn's postings are on disk.
TURNS = 4
#: Keys of so many nodes have all their pairs that the bits allow compared; of larger ones only parts with at most DENSE pairs a node.
LIGHT, DENSE = 48, 8
#: Pairs of one key that are held before its dense parts shrink to one edge a node.
HELD = 1 << 20
#: Edges that a task joins at a time in the union-find.
EDGES = 1 << 20
#: The table of keys that occur again has two to this power bits (16 MB), made and sent in RANGES parts.
AGAIN_BITS, RANGES = 27, 256


def _labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's component."""
    label = np.arange(size)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        np.minimum.at(label, before, label.copy())
        label = label[label]
        if (label == before).all():
            return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (low, high) that join what a task's edges (a, b) join: one from each node to the smallest of its component there."""
    def out(held: list[np.ndarray]) -> np.ndarray:
        nodes, place = np.unique(np.concatenate(held), return_inverse=True)
        place = place.reshape(-1, 2)
        label = _labels(len(nodes), place[:, 0], place[:, 1])
        more = np.flatnonzero(label < np.arange(len(nodes)))
        return np.stack([nodes[label[more]], nodes[more]], axis=1)

    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(k).to_numpy() for k in range(2)], axis=1))
        size += batch.num_rows
        if size >= EDGES:
            held = [out(held)]
            size = len(held[0])
            if size >= EDGES // 2:  # more nodes than are held
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in held[0].T], names=["low", "high"])
                held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out(held).T], names=["low", "high"])


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """node and component (its smallest node) of every node on an edge (a, b).

    Each task first makes stars of its edges, so that a group of any size is left with one edge a node and task; few tasks
    leave little to join. Then alternating large and small stars: both replace edges by edges to the
    smallest neighbour, as an aggregate and a join by node, until nothing changes.
    """
    stars = written(edges.select("a", "b").mapInArrow(_stars, "low long, high long"), folder, f"{name}_stars")
    count = stars.count()
    if not count:
        return stars.selectExpr("high AS node", "low AS component")
    now = written(stars.repartition(1 + count // EDGES).mapInArrow(_stars, "low long, high long"), folder, f"{name}_edges")
    if count < EDGES:  # one task has made the components
        return now.selectExpr("high AS node", "low AS component").unionAll(now.selectExpr("low AS node", "low AS component").distinct())
    before = None
    for turn in itertools.count():  # the number of turns grows with the logarithm of the nodes
        mark = now.agg(F.count("*"), F.sum(F.hash("low", "high").cast("long")), F.bit_xor("low")).first()
        if mark == before:
            break
        before = mark
        # large star: the larger neighbours of a node move to its smallest one
        both = now.selectExpr("low AS u", "high AS v").unionAll(now.selectExpr("high AS u", "low AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").selectExpr("m AS low", "v AS high")
        large = large.where("low < high").distinct()
        # small star: the smaller neighbours of a node and itself move to the smallest one
        floor = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(floor, "high").select(F.explode(F.array(
            F.struct(F.col("m").alias("low"), F.col("low").alias("high")),
            F.struct(F.col("m").alias("low"), F.col("high").alias("high")))).alias("e")).select("e.low", "e.high")
        now = written(small.where("low < high").distinct(), folder, f"{name}_{turn}")
    return now.selectExpr("high AS node", "low AS component").unionAll(
        now.selectExpr("low AS node", "low AS component").distinct())


Measure = Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray]]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Items that two sorted distinct arrays share."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def marks_of(items: np.ndarray) -> np.ndarray | None:
    """How many of a set's hashes fall into each part of the hash range, null if one count is too large for a byte."""
    counts = np.bincount((items >> np.uint64(64 - MARK_BITS)).astype(np.int64), minlength=1 << MARK_BITS)
    return counts.astype(np.int8) if counts.max(initial=0) <= FULL_MARK else None


def parity_of(items: np.ndarray) -> np.ndarray:
    """Whether the number of a set's hashes in each of many parts of the hash range is odd, 64 parts a long."""
    counts = np.bincount((items >> np.uint64(64 - PARITY_BITS)).astype(np.int64), minlength=1 << PARITY_BITS)
    return np.packbits(counts & 1, bitorder="little").view("<i8")


def may_differ(num: int, den: int) -> Column:
    """Whether sets of n and other_n items with a_parity and b_parity differ in few enough items.

    Every part that is odd in one set only holds an item that one set only has.
    """
    return F.expr("aggregate(zip_with(a_parity, b_parity, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x) "
                  f"* {num + den} <= (n + other_n) * {den - num}")


def _bound(total: np.ndarray, parts: int, num: int, den: int) -> np.ndarray:
    """Most unequal parts of two sets with `total` items in all that may link.

    Sets at the threshold differ in total * (den - num) / (den + num) items. An unequal part holds one of
    them, so there are no more; where parts are crowded there are fewer, up to chance.
    """
    most = total * (den - num) / (den + num)
    odds = (1 - (1 - 2 / parts) ** most) / 2
    return np.minimum(most + 1e-6, parts * odds + STRAY * np.sqrt(parts * odds * (1 - odds)))


@functools.lru_cache
def _bounds(parts: int, num: int, den: int) -> np.ndarray:
    """`_bound` of all totals below 16,384."""
    return np.floor(_bound(np.arange(1 << 14), parts, num, den)).astype(np.int16)


def alike(num: int, den: int) -> Column:
    """Whether the SKETCH parts of sets of n and other_n items differ no more often than those of sets at the threshold."""
    parts = 64 * len(SKETCH)
    differ = " + ".join(f"bit_count({c} ^ other_{c})" for c in SKETCH)
    most = f"((n + other_n) * {(den - num) / (den + num)}D)"
    odds = f"((1 - pow({1 - 2 / parts}D, {most})) / 2)"
    return F.expr(f"{differ} <= least({most} + 1e-6D, {parts} * {odds} + {STRAY}D * sqrt({parts} * {odds} * (1 - {odds})))")


def _alike(rows: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """`alike` and the test of sizes for pairs of rows (key, node, n, own, longs of parts)."""
    one, two = rows[a, 2], rows[b, 2]
    able, parts = np.minimum(one, two) * den >= np.maximum(one, two) * num, 64 * (rows.shape[1] - 4)
    at = np.flatnonzero(able)
    a, b, total = a[at], b[at], one[at] + two[at]
    differ = np.bitwise_count((rows[a, 4] ^ rows[b, 4]).view(np.uint64)).astype(np.int16)
    for k in range(5, rows.shape[1]):
        differ += np.bitwise_count((rows[a, k] ^ rows[b, k]).view(np.uint64))
    known = _bounds(parts, num, den)
    able[at] = differ <= (known[total] if total.max(initial=0) < len(known) else _bound(total, parts, num, den))
    return able


def level_of(n: np.ndarray) -> np.ndarray:
    """The level of sets of n items."""
    return np.searchsorted(SMALL << np.arange(LEVELS - 1), n)


def width_of(level: int) -> int:
    """Longs of a packed node or posting: two and those of the parts."""
    return 2 + (len(SKETCH) << level)


def folded(words: np.ndarray) -> np.ndarray:
    """The longs of half as many parts."""
    return words[:, ::2] ^ words[:, 1::2]


def may_reach(num: int, den: int) -> Column:
    """Suffix filter by partitions: whether sets of n and other_n items with a_marks and b_marks could share enough.

    Two sets share at most the smaller count of each part, so the sum of these bounds the
    intersection; what stays below the needed overlap cannot link.
    """
    return F.expr("coalesce(aggregate(zip_with(a_marks, b_marks, (x, y) -> least(x, y)), 0, (s, x) -> s + x) "
                  f"* {num + den} >= (n + other_n) * {num}, true)")


def measure_sets(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of sorted distinct lists."""
    lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
    lv, rv = left.values.to_numpy(), right.values.to_numpy()
    shared = np.array([common(lv[lo[i]: lo[i + 1]], rv[ro[i]: ro[i + 1]]) for i in range(len(left))], np.int64)
    return shared, np.diff(lo) + np.diff(ro) - shared


def measured(pairs: DataFrame, nodes: DataFrame, items: DataFrame, measure: Measure, num: int, den: int) -> DataFrame:
    """pairs (a, b) with `shared` (intersection size), `united` and `linked`; items are found by node or else by the nodes' h1, h2."""

    @F.arrow_udf("struct<shared: long, united: long>")
    def sizes(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in columns:
            yield pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in measure(left, right)],
                                             names=["shared", "united"])

    named = pairs
    if "node" in items.columns:
        for side in "ab":
            named = named.join(items.selectExpr(f"node AS {side}", f"items AS {side}_items"), side)
    else:
        for side in "ab":
            named = named.join(nodes.selectExpr(f"node AS {side}", f"h1 AS {side}1", f"h2 AS {side}2"), side)
        for side in "ab":
            named = named.join(items.selectExpr(f"h1 AS {side}1", f"h2 AS {side}2", f"items AS {side}_items"), [f"{side}1", f"{side}2"])
    met = named.select("a", "b", sizes("a_items", "b_items").alias("sizes")).dropDuplicates(["a", "b"])
    return met.selectExpr("a", "b", "sizes.shared AS shared", "sizes.united AS united",
                          f"sizes.shared > 0 AND sizes.shared * {den} >= sizes.united * {num} AS linked")


def _spread(batches: Iterator[pa.RecordBatch], asked) -> Iterator[pa.RecordBatch]:
    """Postings of the keys whose slot is in the bit table."""
    for batch in batches:
        keys = batch.column("keys")
        offsets = keys.offsets.to_numpy()
        values = keys.values.to_numpy()[offsets[0]: offsets[-1]]
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        start = (offsets[:-1] - offsets[0])[row]
        held = held_bits(asked.value, key_slot(values))
        ahead = np.concatenate([[0], np.cumsum(held)])
        pos = np.arange(len(values)) - start
        met = ahead[:-1] - ahead[start]
        ends = (offsets[1:] - offsets[0])[row]
        own = ends - start - (ahead[ends] - ahead[start])
        carried = [c for c in batch.schema.names if c != "keys"]
        columns = [values, *(batch.column(c).to_numpy()[row] for c in carried), pos, met, own]
        yield pa.RecordBatch.from_arrays([pa.array(c[held].astype(np.int64)) for c in columns],
                                         names=["key", *carried, "pos", "met", "own"])


def key_slot(keys: np.ndarray, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """Slot of a key in the bit table: its top bits, mixed."""
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - slot_bits)).astype(np.int64)


def _key_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the bit table that the keys of a task set."""
    bits = np.zeros(1 << SLOT_BITS, bool)
    for batch in batches:
        bits[key_slot(batch.column(0).to_numpy())] = True
    words = np.packbits(bits, bitorder="little").view(np.int64)
    at = np.flatnonzero(words)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["word", "bits"])


def bits_of(keys: DataFrame) -> np.ndarray:
    """The bit table of one column of longs, built by tasks and joined word by word: fixed size for any number of keys."""
    words = keys.mapInArrow(_key_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros((1 << SLOT_BITS) // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.view(np.uint8)


def shared_postings(nodes: DataFrame) -> DataFrame:
    """key, node, n, pos, met and own of every key that two nodes or more hold.

    pos counts the node's keys before this one, met those of them that are shared, own
    all keys of the node that no other node holds.

    Keys are counted first; a bit table of the shared ones (fixed size, broadcast) then
    keeps most other postings from being shuffled, and a join removes the rest.
    """
    spark = nodes.sparkSession
    counts = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    counts = written(counts.select("key"), shared_folder(spark), "keys")
    asked = spark.sparkContext.broadcast(bits_of(counts))
    postings = nodes.select("node", "n", "keys").mapInArrow(
        lambda b: _spread(b, asked), "key long, node long, n long, pos long, met long, own long")
    return postings.join(counts, "key")


def _longs(packed: pa.Scalar, width: int) -> np.ndarray:
    """Rows of `width` longs from their bytes."""
    return np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, width)


def _banded(packed: pa.Scalar, bands: int, turn: int) -> np.ndarray:
    """A row of keys for each node of one turn: the number of the band and 32 bits."""
    keys = np.frombuffer(packed.as_buffer(), np.uint32).reshape(-1, bands).astype(np.int64)
    return keys | np.arange(turn * bands, (turn + 1) * bands, dtype=np.int64) << 32


def _dealt(values: np.ndarray, part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has values, and these."""
    order = np.argsort(part.astype(np.uint16), kind="stable")
    values, ends = values[order], np.cumsum(np.bincount(part, minlength=parts))
    for k in range(parts):
        low = ends[k - 1] if k else 0
        if low < ends[k]:
            yield k, values[low: ends[k]]


def _packed(values: np.ndarray, part: np.ndarray, parts: int) -> pa.RecordBatch:
    """The values as bytes, a row for each part."""
    dealt = list(_dealt(values, part, parts))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int64()), pa.array([x.tobytes() for _, x in dealt], pa.binary())],
                                      names=["part", "packed"])


def _slots(batches: Iterator[pa.RecordBatch], values: Callable[[pa.Scalar], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The slots of all values of a task within their parts of the table, many to a row."""
    width = AGAIN_BITS - RANGES.bit_length() + 1

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        slot = np.concatenate(held)
        return _packed((slot & ((1 << width) - 1)).astype(np.uint32), slot >> width, RANGES)

    held, size = [], 0
    for batch in batches:
        for packed in batch.column(0):
            held.append(key_slot(np.ascontiguousarray(values(packed)).reshape(-1), AGAIN_BITS))
            size += len(held[-1])
            if size >= 1 << 21:
                yield out(held)
                held, size = [], 0
    if size:
        yield out(held)


def _again(part: pa.Table) -> pa.Table:
    """Bits of the slots of one part that were met twice or more."""
    count = np.zeros((1 << AGAIN_BITS) // RANGES, np.uint8)
    for packed in part.column("packed"):
        slot = np.sort(np.frombuffer(packed.as_buffer(), np.uint32))
        twice = slot[1:][slot[1:] == slot[:-1]]
        count[slot] = np.minimum(count[slot] + 1, 2)
        count[twice] = 2
    bits = np.packbits(count > 1, bitorder="little").tobytes()
    return pa.table({"part": part.column("part").slice(0, 1), "bits": pa.array([bits], pa.binary())})


def again_bits(packed: DataFrame, values: Callable[[pa.Scalar], np.ndarray]) -> np.ndarray:
    """The bit table of values that occur twice or more (and others in their slots): fixed size for any number of values."""
    parts = packed.mapInArrow(lambda b: _slots(b, values), "part long, packed binary").groupBy("part").applyInArrow(
        _again, "part long, bits binary")
    table = np.zeros((RANGES, (1 << AGAIN_BITS) // 8 // RANGES), np.uint8)
    for row in parts.collect():  # at most RANGES rows
        table[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def _postings(batches: Iterator[pa.RecordBatch], asked, bands: int, turn: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Packed postings of the keys that are in the bit table: key and n in one long, node, longs of parts.

    Each level meets by itself. A set that may link with one of the level below is there as well, with folded parts.
    """
    def out(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for level, found in enumerate(held):
            if found:
                rows = np.concatenate(found)
                made = _packed(rows, key_slot(rows[:, 0] >> SIZE_BITS, BUCKET_BITS), 1 << BUCKET_BITS)
                yield made.set_column(0, "part", pa.array(made.column(0).to_numpy() + (level << BUCKET_BITS)))

    held, size = [[] for _ in range(LEVELS)], 0
    for batch in batches:
        for level, nodes, keys in zip(batch.column("level").to_pylist(), batch.column("nodes"), batch.column("keys")):
            nodes, keys = _longs(nodes, width_of(level)), _banded(keys, bands, turn)
            row, band = np.nonzero(held_bits(asked.value, key_slot(keys.reshape(-1), AGAIN_BITS)).reshape(keys.shape))
            rows, n = nodes[row], nodes[row, 1]
            rows[:, 1] = rows[:, 0]
            rows[:, 0] = keys[row, band] << SIZE_BITS | np.minimum(n, (1 << SIZE_BITS) - 1)
            held[level].append(rows)
            if level:
                guests = rows[n * num <= (SMALL << level - 1) * den]
                held[level - 1].append(np.concatenate([guests[:, :2], folded(guests[:, 2:])], axis=1))
            size += rows.size
            if size >= GATHER:
                yield from out(held)
                held, size = [[] for _ in range(LEVELS)], 0
    yield from out(held)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed postings in order of their parts: those of some whole parts in order of key and n, without repeated ones and keys of one node."""
    def out(held: list[pa.Scalar], width: int) -> pa.RecordBatch:
        rows = np.concatenate([_longs(x, width) for x in held])
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
        key = rows[:, 0] >> SIZE_BITS
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        kept = np.flatnonzero(same[1:] | same[:-1])
        rows = rows[kept]
        columns = [key[kept], rows[:, 1], rows[:, 0] & ((1 << SIZE_BITS) - 1), np.zeros(len(rows), np.int64), *rows[:, 2:].T]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns],
                                          names=["key", "node", "n", "own", *(f"bits_{k}" for k in range(width - 2))])

    held, size, last = [], 0, 0
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed")):
            # parts of one level go on together while they are small
            if held and part != last and (size >= GATHER or part >> BUCKET_BITS != last >> BUCKET_BITS):
                yield out(held, width_of(last >> BUCKET_BITS))
                held, size = [], 0
            last = part
            held.append(packed)
            size += len(packed.as_buffer()) // 8
    if held:
        yield out(held, width_of(last >> BUCKET_BITS))


def _crowd(rows: np.ndarray, most: int, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Of one key's rows, in order of n: pairs (places) of its parts with few, the label of each place, its degree or 0 outside dense parts.

    The first of a pair has at most `most` items.
    """
    n, size, own = rows[:, 2], len(rows), int(np.searchsorted(rows[:, 2], most, "right"))
    words = [np.ascontiguousarray(rows[:, k]).view(np.uint64) for k in range(4, rows.shape[1])]
    reach = np.searchsorted(n * num, n * den, "right")
    dense = np.zeros(size, bool)

    def shrunk(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        label = _labels(size, a, b)
        held = np.bincount(label[a], minlength=size) > DENSE * np.bincount(label, minlength=size)
        held[label[dense]] = True
        dense[held] = True
        degree = (np.bincount(a, minlength=size) + np.bincount(b, minlength=size)) * held[label]
        sparse = ~held[label[a]]
        return a[sparse], b[sparse], label, degree

    a, b, found, top = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    while top < own:
        # as many rows as make a table of 2^18 pairs
        end = min(own, top + max(1, min(64, (1 << 18) // max(1, int(reach[top]) - top))))
        right = int(reach[end - 1])
        differ = np.zeros((end - top, right - top), np.int16)
        for word in words:
            differ += np.bitwise_count(word[top:end, None] ^ word[None, top:right])
        x, y = np.nonzero(differ <= _bound(n[end - 1] + n[right - 1], 64 * len(words), num, den))
        x, y = x[x < y] + top, y[x < y] + top
        able = _alike(rows, x, y, num, den)
        a.append(x[able])
        b.append(y[able])
        found, top = found + len(a[-1]), end
        if found > HELD:
            x, y, label, _ = shrunk(np.concatenate(a), np.concatenate(b))
            rest = np.flatnonzero(dense[label] & (label < np.arange(size)))
            a, b = [x, label[rest]], [y, rest]
            found = len(x)
    return shrunk(np.concatenate(a), np.concatenate(b))


def _met(rows: np.ndarray, num: int, den: int) -> pa.RecordBatch:
    """Pairs (node, other) that the bits allow under whole keys, and the postings of the dense parts of large keys, each part a key.

    Of a pair one set at least is of the level that the longs of the rows tell.
    """
    level = ((rows.shape[1] - 4) // len(SKETCH)).bit_length() - 1
    most = SMALL << level if level < LEVELS - 1 else np.iinfo(np.int64).max
    key, node = rows[:, 0].copy(), rows[:, 1]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size, end = np.repeat(np.diff(edges), np.diff(edges)), np.repeat(edges[1:], np.diff(edges))
    a, pairs, many = np.flatnonzero((size <= LIGHT) & (rows[:, 2] <= most)), [], np.zeros(len(rows), bool)
    for step in range(1, LIGHT):
        a = a[a + step < end[a]]
        if not len(a):
            break
        able = a[_alike(rows, a, a + step, num, den)]
        pairs.append((able, able + step))
    rows = rows.copy()
    for low, high in zip(edges[:-1], edges[1:]):
        if high - low > LIGHT:
            x, y, label, degree = _crowd(rows[low:high], most, num, den)
            pairs.append((x + low, y + low))
            many[low:high] = degree > 0
            rows[low:high, 3] = -degree
            if len(np.unique(label)) > 1:
                key[low:high] = mix((key[low:high] * 31 + node[low:high][label]).view(np.uint64)).view(np.int64)
    rows[:, 0] = key
    pairs = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs)] if pairs else [np.zeros(0, np.int64)] * 2
    one, two = (node[x] for x in pairs)
    pairs = np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    pairs = pairs[np.flatnonzero((np.diff(pairs, axis=0, prepend=pairs[:1] + 1) != 0).any(axis=1))]
    kept = rows[many]
    while kept.shape[1] > 4 + len(SKETCH):
        kept = np.concatenate([kept[:, :4], folded(kept[:, 4:])], axis=1)
    columns = [pa.array(np.concatenate([kept[:, k], pairs[:, 0] if k == 1 else np.zeros(len(pairs), np.int64)])) for k in range(kept.shape[1])]
    other = np.concatenate([np.zeros(len(kept), np.int64), pairs[:, 1]])
    columns.append(pa.array(other, mask=np.arange(len(other)) < len(kept)))
    return pa.RecordBatch.from_arrays(columns, names=["key", "node", "n", "own", *SKETCH, "other"])


def _meet(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """`_met` for postings in order of key and n, those of a level together."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        if held and (rows.shape[1] != held[-1].shape[1] or rows[0, 0] != held[-1][-1, 0]):
            yield _met(np.concatenate(held), num, den)
            held = []
        start = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if start:
            yield _met(np.concatenate([*held, rows[:start]]), num, den)
            held = []
        held.append(rows[start:])
    if held:
        yield _met(np.concatenate(held), num, den)


def met_pairs(nodes: DataFrame, bands: int, num: int, den: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), repeated, that keys and the bits allow, and the postings of the dense parts of large keys."""
    names, spark, found = ["key", "node", "n", "own", *SKETCH], nodes.sparkSession, None
    for turn in range(TURNS):
        part = nodes.select("level", "nodes", F.col(f"keys_{turn}").alias("keys"))
        asked = spark.sparkContext.broadcast(again_bits(part.select("keys"), lambda x: _banded(x, bands, turn)))
        met = part.mapInArrow(lambda b: _postings(b, asked, bands, turn, num, den), "part long, packed binary").repartition("part").sortWithinPartitions(
            "part").mapInArrow(lambda b: _meet(_unpacked(b), num, den), ", ".join(f"{c} long" for c in (*names, "other")))
        met = written(met, folder, f"met_{turn}")
        found = met if found is None else found.unionAll(met)
        asked.destroy()  # the driver would keep every turn's table
        swept(spark)
    many = written(found.where("other IS NULL").selectExpr(*names, "0L AS pos", "0L AS met"), folder, "many")
    return found.where("other IS NOT NULL").selectExpr("node AS a", "other AS b"), many


def link(nodes: DataFrame, fetch: Callable[[DataFrame, str], DataFrame], measure: Measure, num: int, den: int, folder: str,
         positional: bool, rounds: int = 1, bands: int = 0) -> DataFrame:
    """node and component of all nodes in a component of two or more, after `rounds` leader rounds and the last one.

    nodes: node, h1 and h2 (the set's hash), n (set size), keys (distinct; in the global
    order if positional) and, if there are any, marks and parity. fetch(nodes, name) gives h1, h2 and
    items of each asked node (more than those does no harm), which measure compares. Sets
    link when shared / united >= num / den.

    With `bands`, nodes are packed instead, those of a level together: `nodes` holds node, n and the longs of its parts, `keys_0`
    and so on 32 bits of each of that turn's `bands` keys; a node may be there more than once. fetch then gives node and items, each node once.
    """
    marked, bits, light = "marks" in nodes.columns, SKETCH if bands else [], None
    if bands:
        light, shared = met_pairs(nodes, bands, num, den, folder)
    else:
        shared = written(shared_postings(nodes), folder, "shared")

    had = []

    def items_of(asked: DataFrame, name: str) -> DataFrame:
        """The items of all asked nodes; packed nodes' are fetched once."""
        if not bands:
            return written(fetch(asked, name), folder, f"{name}_items")
        for items in had:
            asked = asked.join(items, "node", "left_anti")
        if not had or asked.take(1):
            had.append(written(fetch(asked, name), folder, f"{name}_items"))
        return functools.reduce(DataFrame.unionAll, had)

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        """All pairs, measured where the marks allow a link; the others are not linked."""
        pairs = written(pairs, folder, f"{name}_pairs")
        near = pairs
        if marked:
            a, b = (nodes.selectExpr(f"node AS {x}", f"marks AS {x}_marks", f"n AS {n}") for x, n in (("a", "n"), ("b", "other_n")))
            near = written(pairs.join(a, "a").join(b, "b").where(may_reach(num, den)).select("a", "b"), folder, f"{name}_near")
        asked = near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))).distinct()
        found = measured(near, nodes, items_of(asked, name), measure, num, den)
        return written(pairs.join(found, ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False))),
                       folder, name)

    reach = (den - num) / den + 1e-9
    checked, labels, first = None, None, None
    fits = F.expr(f"least(n, other_n) * {den} >= greatest(n, other_n) * {num}")
    if positional:
        # keys before this one that no other node holds are in neither intersection
        fits &= F.expr(f"(least(met, other_met) + least(n - pos, other_n - other_pos)) * {num + den} >= (n + other_n) * {num}")
    if bits:
        fits &= alike(num, den)

    for turn in range(rounds):
        held = shared.join(labels, "node", "left") if labels is not None else shared.withColumn(
            "component", F.lit(None).cast("long"))
        held = held.withColumn("component", F.coalesce("component", "node"))
        # the most typical node of each component under a key, and of these the LEADERS most typical
        ends = F.struct("own", "node", "component", "n", "pos", "met", *bits)
        # (at first every node is a component of its own and the limit alone works ahead of the shuffle)
        typical = held.select("key", ends.alias("head")) if labels is None else held.groupBy("key", "component").agg(
            F.min(ends).alias("head"))
        heads = typical.withColumn("place", F.row_number().over(
            Window.partitionBy("key").orderBy("head"))).where(F.col("place") <= LEADERS).select("key", "head")
        tries = held.join(heads, "key").where("component <> head.component").selectExpr(
            "node AS a", "head.node AS b", "n", "pos", "met", "head.n AS other_n", "head.pos AS other_pos",
            "head.met AS other_met", *bits, *(f"head.{c} AS other_{c}" for c in bits)).where(fits)
        tries = tries.groupBy("a", "b").agg(F.count("*").alias("keys"))
        if checked is not None:
            known = checked.select("a", "b").unionAll(checked.selectExpr("b AS a", "a AS b"))
            tries = tries.join(known, ["a", "b"], "left_anti")
        best = Window.partitionBy("a").orderBy(F.desc("keys"), "b")
        pairs = tries.withColumn("place", F.row_number().over(best)).where(F.col("place") <= LEADERS).selectExpr(
            "least(a, b) AS a", "greatest(a, b) AS b")
        if turn == 0 and light is not None:
            pairs = pairs.unionAll(light)
        pairs = pairs.distinct()
        found = compared(pairs, f"round_{turn}")
        if turn == 0:
            # distance of each node to one of the nodes that it was first compared with
            gap = found.where("united > 0").selectExpr("a", "b", "1 - shared / united AS gap")
            sides = gap.selectExpr("a AS node", "b AS leader", "gap").unionAll(gap.selectExpr("b AS node", "a AS leader", "gap"))
            first = sides.groupBy("node").agg(F.min(F.struct("leader", "gap")).alias("near"))
        checked = found if checked is None else checked.unionAll(found)
        if not found.where("linked").take(1):
            break
        labels = written(components(checked.where("linked"), folder, f"labels_{turn}"), folder, f"components_{turn}")

    held = shared.join(labels, "node", "left") if labels is not None else shared.withColumn(
        "component", F.lit(None).cast("long"))
    held = held.withColumn("component", F.coalesce("component", "node"))
    weights = held.groupBy("key", "component").agg(F.count("*").alias("size"))
    major = weights.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("kinds"))
    # only postings of keys with several components are left, and only they meet the distances
    mixed = held.join(major.where("kinds > 1").selectExpr("key", "top.component AS major"), "key")
    mixed = written(mixed, folder, "mixed").join(first, "node", "left")
    mixed = mixed.join(nodes.select("node", "parity"), "node") if marked else mixed.withColumn("parity", F.lit(None))
    few = mixed.where("component <> major").selectExpr(
        "key", "node AS a", "component AS a_component", "n", "pos", "met", "near AS a_near", "parity AS a_parity", *bits)
    rest = mixed.selectExpr("key", "node AS b", "component AS b_component", "n AS other_n", "pos AS other_pos",
                            "met AS other_met", "near AS b_near", "component = major AS in_major", "parity AS b_parity",
                            *(f"{c} AS other_{c}" for c in bits))
    far = F.expr(f"a_near.leader = b_near.leader AND abs(a_near.gap - b_near.gap) > {reach}")
    able = (F.col("a_component") != F.col("b_component")) & (
        F.col("in_major") | (F.col("a") < F.col("b"))) & fits & ~F.coalesce(far, F.lit(False))
    if marked:
        able &= may_differ(num, den)
    pairs = few.join(rest, "key").where(able)
    pairs = pairs.selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    last = compared(pairs, "last")
    if last.where("linked").take(1) or labels is None:
        labels = written(components(checked.unionAll(last).where("linked"), folder, "labels_last"), folder, "components_last")
    return labels
