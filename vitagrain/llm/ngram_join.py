"""N-gram Jaccard self-join of documents by rare-first prefix filtering.

A document is the set of its word shingles. Sets of n shingles that reach
Jaccard num/den share one of the first n - ceil(n * num / den) + 1 shingles of
each in any common order; the order here puts rare shingles first. It comes
from document frequencies over all documents: every task counts its shingles,
those it saw more than once are summed over tasks, and the FREQUENT (at most) most
frequent ones (a bounded list, broadcast) go last, by frequency; all others are
rarer and go by hash. The order only steers cost, never the result.

Equal sets are one class from the start, so copies are never compared. Classes
meet on prefix shingles; length and positional filters hold there, a partition
bound on the whole sets (suffix filter) ahead of each exact comparison, and each
pair is verified once. Components come from rounds of links (`linking`), which
compare no pair that could not change them.

Defined cases: null text is empty, empty documents have no shingles and are
their own component; fewer words than a shingle are one shingle; repeated rows
stay as rows; a row with a null id takes part and gets the smallest id of its
component (null if that has none); an empty table gives no rows; extra columns
are left out by `classes` and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.llm.common import (
    bit_table,
    flat_bytes,
    fresh,
    held_bits,
    id_text,
    shared_folder,
    slices,
    slot_column,
    written,
)
from vitagrain.llm.linking import link, marks_of, measure_sets, parity_of
from vitagrain.llm.shingles import set_hash, word_shingles

FREQUENT = 1 << 19
#: Counts are told apart in this many steps an octave where the list of frequent shingles ends.
STEPS = 16
#: Leader rounds ahead of the comparison in full: the second one takes what the first left of large groups.
ROUNDS = 2
#: Shingle counts that a task holds before it passes the repeated ones on.
HELD = 1 << 22


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for part in slices(column):
        yield from word_shingles(*flat_bytes(part), size)


def _repeated(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Shingles that occur in more than one document of the task (of each HELD shingles), with that number."""

    held, n = np.empty(HELD, np.uint64), 0

    def out(run: np.ndarray) -> pa.RecordBatch:
        run.sort()
        same = np.zeros(len(run) + 1, bool)
        same[1:-1] = run[1:] == run[:-1]
        begins = np.flatnonzero(~same[:-1] & same[1:])
        ends = np.flatnonzero(same[:-1] & ~same[1:])
        return pa.RecordBatch.from_arrays([pa.array(run[begins].view(np.int64)), pa.array(ends - begins + 1)],
                                          names=["shingle", "n"])

    for batch in batches:
        for items in _sets(batch.column(0), size):
            while len(items):
                some = items[: HELD - n]
                held[n: n + len(some)] = some
                n, items = n + len(some), items[len(some):]
                if n == HELD:
                    yield out(held)
                    n = 0
    if n:
        yield out(held[:n])


def frequent(texts: DataFrame, size: int, folder: str, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and their document counts: `most` at the most.

    Steps of counts are counted first (a few hundred rows for any input), then the shingles of
    the highest steps that fit are fetched, so neither a sort nor more than the list meets the driver.
    """
    counts = texts.select("text").mapInArrow(lambda b: _repeated(b, size), "shingle long, n long")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2").withColumn(
        "step", F.floor(F.log2("n") * STEPS).cast("int"))
    counts = written(counts, folder, "frequent")
    least, fit = None, 0
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        fit += row["count"]
        if fit > most:
            break
        least = row["step"]
    top = counts.where(F.col("step") >= F.lit(least).cast("int")).select("shingle", "n").toArrow()
    keys = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top.column("n").to_numpy()[order]


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1 if n else 0


def _prefixed(batches: Iterator[pa.RecordBatch], size: int, num: int, den: int, order) -> Iterator[pa.RecordBatch]:
    keys, counts = order.value
    for batch in batches:
        rows = []
        for items in _sets(batch.column(1), size):
            n = len(items)
            first = items
            if n and len(keys):
                at = np.minimum(np.searchsorted(keys, items), len(keys) - 1)
                often = np.where(keys[at] == items, counts[at], 0)
                if often.any():
                    first = items[np.argsort(often, kind="stable")]
            rows.append((n, *set_hash(items), marks_of(items), parity_of(items), first[: prefix_length(n, num, den)].view(np.int64)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds))],
            names=["doc_id", "n", "h1", "h2", "marks", "parity", "prefix"])


def _items(batches: Iterator[pa.RecordBatch], size: int, asked) -> Iterator[pa.RecordBatch]:
    """Sets of the rows whose slot is in the bit table, each once a task."""
    given = set()
    for batch in batches:
        batch = batch.filter(pa.array(held_bits(asked.value, batch.column(0).to_numpy())))
        for low in range(0, batch.num_rows, 500):
            rows = []
            for items in _sets(batch.column(1).slice(low, 500), size):
                if (mark := set_hash(items)) not in given:
                    given.add(mark)
                    rows.append((*mark, np.sort(items.view(np.int64))))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, kinds)],
                                             names=["h1", "h2", "items"])


def _labelled(docs: DataFrame, size: int, num: int, den: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, n, h1, h2, prefix), and the component of each class (h1, h2, doc_id, component)."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    texts = id_text(docs)
    order = spark.sparkContext.broadcast(frequent(texts, size, folder, most))
    signed = written(texts.mapInArrow(lambda b: _prefixed(b, size, num, den, order),
                                      "doc_id long, n long, h1 long, h2 long, marks array<tinyint>, parity array<long>, prefix array<long>"), folder, "signed")
    # rows of classes of one (the bit table tells most of them) are nodes as they are; only the others are shuffled whole
    filled = signed.where("n > 0")
    repeated = filled.groupBy("h1", "h2").agg(F.count("*").alias("held")).where("held > 1").select("h1", "h2")
    bits = spark.sparkContext.broadcast(bit_table(repeated))

    @F.arrow_udf("boolean")
    def may_repeat(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(held_bits(bits.value, column.to_numpy()))

    filled = filled.withColumn("may_repeat", may_repeat(slot_column("h1", "h2")))
    kept = ["doc_id", "n", "marks", "parity", "prefix"]
    nodes = filled.where("may_repeat").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in kept[1:]))
    nodes = nodes.unionAll(filled.where("NOT may_repeat").select("h1", "h2", *kept)).withColumnRenamed("prefix", "keys")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), folder, "nodes")
    def fetch(asked: DataFrame, name: str) -> DataFrame:
        """Shingle sets of the asked classes, from the text of the class's first document.

        The bit table spares most other texts; what else it lets through is not asked for later.
        """
        wanted = nodes.join(asked, "node", "left_semi").select("doc_id")
        bits = spark.sparkContext.broadcast(bit_table(wanted))
        return texts.select(slot_column("doc_id").alias("slot"), "text").mapInArrow(
            lambda b: _items(b, size, bits), "h1 long, h2 long, items array<long>")

    labels = link(nodes, fetch, measure_sets, num, den, folder, positional=True, rounds=ROUNDS)
    named = nodes.select("node", "h1", "h2", "doc_id").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    return signed, named


def classes(docs: DataFrame, size: int, num: int, den: int, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id of the component) of every row."""
    signed, named = _labelled(docs, size, num, den, most)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("h1", "h2", "component_id")
    held = signed.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2"], "left")
    return held.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(
        F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, most: int = FREQUENT) -> DataFrame:
    """The documents with one row left of each component, with their own columns.

    The row with the smallest id stays (a null id counts as the largest); of repeated rows one
    stays. Documents without words are linked with nothing and all stay.
    """
    _, named = _labelled(docs, size, num, den, most)
    by_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    chosen = named.groupBy("component").agg(F.min(by_id).alias("row")).selectExpr(
        "row.doc_id AS chosen_id", "row.h1 AS h1", "row.h2 AS h2")

    @F.arrow_udf("struct<n: long, h1: long, h2: long>")
    def sign(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = [(len(items), *set_hash(items)) for items in _sets(column, size)]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else
                                             [pa.array([], pa.int64())] * 3, names=["n", "h1", "h2"])

    held, place = fresh(docs, "sign_of_set"), fresh(docs, "place_of_row")
    signed = docs.withColumn(held, sign(F.coalesce(docs["text"], F.lit(""))))
    of, key = signed[held], signed["doc_id"].cast("long")
    ready = chosen.select(*(F.col(c).alias(f"{held}_{c}") for c in chosen.columns))
    met = signed.join(ready, key.eqNullSafe(ready[f"{held}_chosen_id"]) & (of["h1"] == ready[f"{held}_h1"])
                      & (of["h2"] == ready[f"{held}_h2"]), "left")
    kept = met.where((F.col(held)["n"] == 0) | F.col(f"{held}_h1").isNotNull())
    same = Window.partitionBy(F.col("doc_id"), F.col(held)["h1"], F.col(held)["h2"]).orderBy(F.col("text"))
    kept = kept.withColumn(place, F.row_number().over(same)).where((F.col(held)["n"] == 0) | (F.col(place) == 1))
    return kept.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM texts),
held AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM held x JOIN held y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id
FROM sets s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) m ON m.a = s.doc_id
"""
