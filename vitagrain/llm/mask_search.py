"""Ranked lexical search by presence-mask grouping.

Terms are hashed once per text into postings: for each document its number of terms and
the counts of those terms that any query holds. From them come the corpus counts over
all documents. Then a task takes its documents in blocks. For each query the presence of
its terms in the block is a bitmap per term; read across, the bits of a document are its
mask, and documents group by mask. The largest share that each term has in any document
of the block bounds the score of a mask, so masks are scored by falling bound until the
bound is below the k-th best score found so far: no document behind it can enter, and
equal bounds are still scored since ties go to the smaller id. A task hands on k rows per
query; these are ranked in two steps, first in slots of documents, so one query never
meets all tasks' rows in one place.

Queries with equal terms are scored once. They are taken in blocks of about BLOCK_TERMS
terms, which bounds what a task and the driver hold for any number of queries; one query
is never cut. All documents are scanned for each block.

Terms stand for themselves as 64-bit hashes. Whole texts count, very long ones alone in
their slice of memory. Null and empty texts and texts without terms are in no count and
never ranked. Documents with a null id count and rank, behind equal scores with an id.
Repeated rows are documents of their own. Queries of null or empty text give no rows;
repeated queries each get their rows. Empty tables give no rows. Extra columns are left
out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.llm.common import flat_bytes, id_text, shared_folder, slices, written
from vitagrain.llm.shingles import words

BLOCK_TERMS = 1 << 14
#: Cells of a block of documents by terms that a task holds (4 bytes each).
CELLS = 1 << 23
SLOTS = 32
#: Bytes that belong to terms stay, all others become blanks.
_PLAIN = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PLAIN[_low:_high] = np.arange(_low, _high)

Batches = Iterator[pa.RecordBatch]


def _terms(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of texts laid end to end, and where each text's terms begin."""
    data, offsets = flat_bytes(part)
    return words(_PLAIN[data], offsets)


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _query_terms(batches: Batches) -> Batches:
    for batch in batches:
        at = 0
        for part in slices(batch.column("text")):
            hashes, begin = _terms(part)
            rows = [np.sort(hashes[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(at, len(part)), _lists(flat.view(np.int64), np.diff(begin), pa.int64())],
                ["item_id", "terms"])
            at += len(part)


def _postings(vocabulary: np.ndarray) -> Callable[[Batches], Batches]:
    size = len(vocabulary)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            at = 0
            for part in slices(batch.column("text")):
                hashes, begin = _terms(part)
                n = np.diff(begin)
                slot = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
                known = vocabulary[slot] == hashes
                doc = np.repeat(np.arange(len(part)), n)
                pair, tf = np.unique(doc[known] * size + slot[known], return_counts=True)
                counts = np.bincount(pair // size, minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), pa.array(n, pa.int64()),
                     _lists(pair % size, counts, pa.int32()), _lists(tf, counts, pa.int32())],
                    ["doc_id", "n", "terms", "tf"])
                at += len(part)

    return run


class _Best:
    """The k best (score, id) of a query so far, best first; rows without id behind equal scores."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, np.zeros((3, 0), np.int64)

    def floor(self) -> int:
        """A score below this can't enter any more."""
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else 1

    def add(self, scores: np.ndarray, lost: np.ndarray, ids: np.ndarray) -> None:
        take = scores >= self.floor()
        every = np.concatenate([self.rows, np.stack([scores[take], lost[take], ids[take]])], axis=1)
        self.rows = every[:, np.lexsort((every[2], every[1], -every[0]))[: self.k]]


def _groups(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document of each distinct mask, and the mask of each document; rows are terms, columns documents."""
    packed = np.packbits(present, axis=0).T
    bits = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    bits[:, : packed.shape[1]] = packed
    masks = bits.view(np.uint64)
    one = masks.shape[1] == 1
    _, first, mask = np.unique(masks[:, 0] if one else masks, axis=None if one else 0, return_index=True, return_inverse=True)
    return first, mask.reshape(-1)


def _score(share: np.ndarray, largest: np.ndarray, weight: np.ndarray, lost: np.ndarray, ids: np.ndarray, best: _Best) -> None:
    """Scores the documents of a block for one query, mask by mask; share is terms by documents."""
    if int(weight @ largest) < best.floor():
        return
    present = share > 0
    first, mask = _groups(present)
    bound = (weight * largest) @ present[:, first]
    order = np.argsort(-bound, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    docs = np.argsort(place[mask], kind="stable")
    ends = np.cumsum(np.bincount(place[mask], minlength=len(order)))
    at, step = 0, 16
    while at < len(order) and bound[order[at]] >= best.floor():
        high = min(at + step, len(order))
        chosen = docs[ends[at - 1] if at else 0: ends[high - 1]]
        best.add(weight @ share[:, chosen].astype(np.int64), lost[chosen], ids[chosen])
        at, step = high, step * 2


def _rank(queries: list[tuple[np.ndarray, np.ndarray]], size: int, every: int, length: int, k: int) -> Callable[[Batches], Batches]:
    """k best documents of a task for each query; every and length: documents and terms of the corpus."""
    block = max(1, CELLS // size)

    def run(batches: Batches) -> Batches:
        best = [_Best(k) for _ in queries]
        cells = np.zeros((size, block), np.uint32)
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                ids = part.column("doc_id")
                lost = np.asarray(ids.is_null()).astype(np.int64)
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
                terms = part.column("terms").flatten().to_numpy(zero_copy_only=False)
                tf = part.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(len(ids)), np.asarray(part.column("terms").value_lengths()))
                m = 100 - 75 + 75 * part.column("n").to_numpy(zero_copy_only=False) * every // length
                share = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
                cells[terms, doc] = share
                largest = np.zeros(size, np.int64)
                np.maximum.at(largest, terms, share)
                for (own, weight), b in zip(queries, best):
                    _score(cells[own, : len(ids)], largest[own], weight, lost, ids, b)
                cells[terms, doc] = 0
        sizes = [b.rows.shape[1] for b in best]
        rows = np.concatenate([np.zeros((3, 0), np.int64), *[b.rows for b in best]], axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array(rows[0]),
             pa.array(rows[2], pa.int64(), mask=rows[1] == 1)], ["query", "score", "doc_id"])

    return run


def _block(postings: DataFrame, queries: list[np.ndarray], vocabulary: np.ndarray, k: int) -> DataFrame:
    """The k best documents of each query of one block: query, rank, doc_id, score."""
    totals = postings.agg(F.count("*").alias("every"), F.sum("n").alias("length")).first()
    found = np.zeros(len(vocabulary), np.int64)
    for row in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the block's terms
        found[row.t] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * totals.every + 2) / (2 * df + 1))) for df in found.tolist()], np.int64)
    plan = []
    for terms in queries:
        own, repeats = np.unique(np.searchsorted(vocabulary, terms), return_counts=True)
        useful = (weights[own] > 0) & (found[own] > 0)
        plan.append((own[useful], weights[own[useful]] * repeats[useful]))
    ranked = postings.mapInArrow(_rank(plan, len(vocabulary), totals.every, totals.length or 1, k),
                                 "query int, score long, doc_id long")
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    near = ranked.withColumn("slot", slot).withColumn("rank", F.row_number().over(Window.partitionBy("query", "slot").orderBy(*order)))
    near = near.where(F.col("rank") <= k)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score."""
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession)
    asked = id_text(items, item_key, item_text).mapInArrow(_query_terms, "item_id long, terms array<long>")
    asked = written(asked.where("size(terms) > 0").withColumn("form", F.md5(F.array_join(F.col("terms").cast("array<string>"), " "))),
                    folder, "asked")
    forms = asked.groupBy("form").agg(F.first("terms").alias("terms"))
    total = forms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // block_terms)
    out = spark.createDataFrame([], "form string, rank int, doc_id long, score long")
    for b in range(blocks):
        held = forms.where(F.pmod(F.xxhash64("form"), F.lit(blocks)) == b).collect()  # about block_terms terms
        if not held:
            continue
        queries = [np.array(r.terms, np.int64).view(np.uint64) for r in held]
        vocabulary = np.unique(np.concatenate(queries))
        postings = id_text(docs, key, text).mapInArrow(_postings(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>")
        postings = written(postings.where("n > 0"), folder, f"postings{b}")
        names = spark.createDataFrame([(i, r.form) for i, r in enumerate(held)], "query int, form string")
        ranked = _block(postings, queries, vocabulary, k)
        out = out.unionByName(ranked.join(names, "query").select("form", "rank", "doc_id", "score"))
    return asked.select("item_id", "form").join(out, "form").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM d GROUP BY r, doc_id, t),
n AS (SELECT r, count(*) AS n FROM d GROUP BY r),
s AS (SELECT count(*) AS every, sum(n)::BIGINT AS length FROM n),
w AS (SELECT t, floor(1000 * ln((2 * any_value(every) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY t),
m AS (SELECT r, 100 - 75 + (75 * n * every) // length AS m FROM n, s),
qt AS (SELECT i, item_id, t, count(*) AS times FROM q GROUP BY i, item_id, t),
p AS (SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM qt JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM p
WHERE score > 0 QUALIFY rank <= 10
"""
