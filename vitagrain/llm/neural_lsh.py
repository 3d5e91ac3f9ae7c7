"""Approximate nearest neighbours by learned partitions of a neighbour graph.

Fitting works on a bounded sample: an exact neighbour graph of the sample is cut
into equal parts (capacity-bound label moves that lower the number of cut edges)
and a linear soft-max classifier learns, from each point, how its neighbours
spread over the parts. The number of parts to probe is the least that covers
TARGET of the sample's neighbours that were not learnt from.

Every row of the table is indexed: it lies in its most probable part. A query is
sent to its `probes` most probable parts and ranked exactly there: parts are cut
into blocks of BLOCK rows and chunks of CHUNK queries, so that neither a part
that holds a third of all rows nor a popular one becomes one task, and each
block keeps no more than k rows of a query. Scores are cosines in double
precision of the original vectors, summed in one fixed order for every pair, so
equal vectors tie exactly and ties go to the smaller id.

Only the classifier (parts x dimensions numbers) is broadcast.

Defined cases: vectors that are null, zero, of another length than most (the
smaller length, if two are as common), or hold null or non-finite components take no part; rows repeated under
one id count once; a null id takes no part; with fewer than k other rows, all are
returned; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitagrain.llm.common import shared_folder, written

SAMPLE = 6000
NEIGHBOURS = 10
TARGET = 0.95
BLOCK, CHUNK = 4096, 1024
#: Scores this close to the last kept one are compared exactly.
CLOSE = 1e-9


@dataclass(frozen=True)
class Router:
    weights: np.ndarray  # dimensions + 1 by parts
    probes: int

    def order(self, unit: np.ndarray, most: int) -> np.ndarray:
        """The `most` most probable parts of each unit vector, best first."""
        scores = np.column_stack([unit, np.ones(len(unit))]) @ self.weights
        return np.argsort(-scores, axis=1, kind="stable")[:, :most]


def _levelled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: no digit changes, no square leaves the range."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=-1, keepdims=True))[1])


def _units(rows: np.ndarray) -> np.ndarray:
    rows = _levelled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def parts_for(rows: int) -> int:
    """Number of parts: grows with the square root of the rows, up to what the sample can teach."""
    return min(SAMPLE // 16, max(2, math.ceil(math.sqrt(max(rows, 1)) / 8)))


def neighbour_graph(unit: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each unit vector, by blocks."""
    out = np.empty((len(unit), k), np.int64)
    for low in range(0, len(unit), 1000):
        scores = unit[low: low + 1000] @ unit.T
        scores[np.arange(len(scores)), low + np.arange(len(scores))] = -2
        out[low: low + 1000] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, unit: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each vertex, none above its share by more than a tenth, with few edges between parts.

    Starts from seeds far from each other, then moves vertices to the part of most of
    their neighbours (in both directions of an edge) while there is room.
    """
    n = len(graph)
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(n, parts, replace=False)]
    room = math.ceil(1.1 * n / parts)
    rows, columns = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    part = np.zeros(n, np.int64)
    pull = np.zeros((n, parts))
    for turn in range(24):
        if turn < 8:
            wish = unit @ centres.T
        else:
            pull[:] = 0
            np.add.at(pull, (rows, part[columns]), 1)
            np.add.at(pull, (columns, part[rows]), 1)
            wish = pull + 0.2 * (unit @ centres.T)
        part = _with_room(wish, room)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, unit)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return part


def _with_room(wish: np.ndarray, room: int) -> np.ndarray:
    """Each row's most wished column that has room; rows that would lose most by waiting go first."""
    order = np.argsort(-wish, axis=1)
    best = np.take_along_axis(wish, order[:, :2], axis=1)
    left = np.full(wish.shape[1], room)
    part = np.empty(len(wish), np.int64)
    for i in np.argsort(best[:, 1] - best[:, 0], kind="stable"):
        for p in order[i]:
            if left[p]:
                left[p] -= 1
                part[i] = p
                break
    return part


def soft_max_fit(unit: np.ndarray, wanted: np.ndarray, steps: int = 300, rate: float = 4.0) -> np.ndarray:
    """Weights of a linear soft-max for the wanted shares, by gradient steps with momentum."""
    x = np.column_stack([unit, np.ones(len(unit))])
    w = np.zeros((x.shape[1], wanted.shape[1]))
    speed = np.zeros_like(w)
    for _ in range(steps):
        scores = x @ w
        p = np.exp(scores - scores.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - rate * (x.T @ (p - wanted) / len(x) + 1e-5 * w)
        w += speed
    return w


def train(vectors: np.ndarray, parts: int, target: float = TARGET, k: int = NEIGHBOURS) -> Router:
    """Graph, parts and classifier of a sample; the last fifth chooses the number of probes."""
    unit = _units(vectors)
    k = min(k, len(unit) - 1)
    if parts < 2 or k < 1 or len(unit) < 4 * parts:
        return Router(np.zeros((vectors.shape[1] + 1, 1)), 1)
    graph = neighbour_graph(unit, k)
    part = balanced_parts(graph, unit, parts)
    wanted = np.zeros((len(unit), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(unit)), k), part[graph.reshape(-1)]), 0.5 / k)
    wanted[np.arange(len(unit)), part] += 0.5
    held = len(unit) - max(1, len(unit) // 5)
    router = Router(soft_max_fit(unit[:held], wanted[:held]), parts)
    order = router.order(unit, parts)
    home = order[:, 0]
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    near = rank[np.arange(held, len(unit))[:, None], home[graph[held:, :5]]]
    covered = np.array([(near < p).mean() for p in range(1, parts + 1)])
    return Router(router.weights, int(np.argmax(covered >= target)) + 1 if covered[-1] >= target else parts)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and the vector as doubles, for rows that can have a cosine."""
    held = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"))
    return held.where("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) "
                      "AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.values.to_numpy()
    offsets = column.offsets.to_numpy()
    return values[offsets[0]: offsets[-1]].reshape(len(column), -1)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one vector and many, each summed in the same order."""
    query, rows = _levelled(query), _levelled(rows)
    return (rows * query).sum(axis=1) / (np.sqrt((query * query).sum()) * np.sqrt((rows * rows).sum(axis=1)))


def nearest_in_block(query_ids, queries, ids, rows, k: int) -> list[tuple[int, int, float]]:
    """The k best other ids of each query in a block, by exact score, then id."""
    found: list[tuple[int, int, float]] = []
    most = k * int(np.unique(ids, return_counts=True)[1].max())
    rough = _units(queries) @ _units(rows).T
    for i, query_id in enumerate(query_ids):
        score = np.where(ids == query_id, -np.inf, rough[i])
        worst = np.partition(score, -most)[-most] if most < len(score) else -np.inf
        near = np.flatnonzero((score >= worst - CLOSE) & (score > -np.inf))
        exact = cosines(queries[i], rows[near])
        kept: dict[int, float] = {}
        for j in np.lexsort((ids[near], -exact)):
            kept.setdefault(int(ids[near[j]]), float(exact[j]))
            if len(kept) == k:
                break
        found += [(int(query_id), v, s) for v, s in kept.items()]
    return found


def search(vectors: DataFrame, asked: str, k: int = 5, key: str = "vec_id", vector: str = "embedding",
           sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row that `asked` (SQL over vec_id) selects."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    held = usable(vectors, key, vector)
    lengths = held.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"))
    shape = lengths.orderBy(F.desc("n"), "size").first() or {"size": 0, "n": 0}
    held = held.where(F.size("v") == shape["size"])
    taught = held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()  # at most `sample` vectors
    router = train(np.array(taught["v"].tolist()).reshape(len(taught), -1), parts_for(shape["n"])) if len(taught) else Router(
        np.zeros((1, 1)), 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = router.order(_units(_matrix(batch.column(1))), 1)[:, 0] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int64)), *batch.columns], names=["part", "vec_id", "v"])

    indexed = written(held.mapInArrow(index, "part long, vec_id long, v array<double>"), folder, "index")
    sizes = {r.part: r.n for r in indexed.groupBy("part").agg(F.count_distinct("vec_id").alias("n")).collect()}  # one row a part
    counts = np.array([sizes.get(p, 0) for p in range(router.weights.shape[1])])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            order = router.order(_units(_matrix(batch.column(1))), len(counts))
            enough = np.argmax(np.cumsum(counts[order], axis=1) >= min(k + 1, counts.sum()), axis=1) + 1
            probes = np.maximum(router.probes, enough)
            lists = [order[i, :p] for i, p in enumerate(probes)]
            offsets = np.concatenate([[0], np.cumsum(probes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).astype(np.int64)))],
                names=["query_id", "q", "parts"])

    queries = indexed.where(asked).groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = queries.mapInArrow(route, "query_id long, q array<double>, parts array<long>")
    routed = written(routed.select("query_id", "q", F.explode("parts").alias("part")), folder, "routed")
    blocks = indexed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    chunks = routed.groupBy("part").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    plan = F.broadcast(blocks.join(chunks, "part"))  # one row for each part, SAMPLE / 16 at most
    left = routed.join(plan, "part").select(
        "part", F.expr("pmod(xxhash64(query_id), chunks)").alias("chunk"),
        F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "query_id", "q")
    right = indexed.join(plan, "part").select(
        "part", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("chunk"),
        F.expr("pmod(xxhash64(vec_id), blocks)").alias("block"), "vec_id", "v")

    def meet(_, ours: pa.Table, theirs: pa.Table) -> pa.Table:
        rows = []
        if ours.num_rows and theirs.num_rows:
            q, v = (t.column(n).combine_chunks() for t, n in ((ours, "q"), (theirs, "v")))
            rows = nearest_in_block(ours.column("query_id").to_numpy(), _matrix(q), theirs.column("vec_id").to_numpy(),
                                    _matrix(v), k)
        columns = list(zip(*rows)) or [()] * 3
        return pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()))})

    keys = ["part", "chunk", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
