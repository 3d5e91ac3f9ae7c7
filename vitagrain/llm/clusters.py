"""Centroid clustering by an incremental distance matrix.

Vectors become integers once. Beside each vector its squared length and its exact
integer dot products with all centroids are persisted; a round changes a dot product
only by the components of that centroid that moved since the round before, so settled
centroids cost nothing. Squared distance is |v|^2 - 2 v.c + |c|^2 in 64-bit integers,
and the smallest one, ties to the smaller number, names the cluster.

A round is one pass in Arrow batches that writes the new matrix and one that sums the
components of every cluster: a task hands on one row per cluster, whatever it read.
The matrix lies in the shared folder in two places that take turns, so a round never
depends on the lineage of earlier ones and a lost executor costs its own tasks only.
When no component of any centroid moved, the remaining rounds would change nothing and
are left out.

Exact range: components below 2^27 in size after scaling, so that dot products fit 64
bits; a larger one ends the job with an error instead of a wrong sum.

Defined cases: a null vector, another length, and null or non-finite components take no
part; a vector without id is clustered but never a first centroid, and where no vector
has an id the results are null; repeated rows count each, and of first centroids with
equal hashes the one with smaller components comes first; with fewer vectors than
clusters each is one; an empty table gives no rows; texts are not read; extra columns
are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitagrain.llm.common import shared_folder, written

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
LIMIT = 1 << 27
STATE = "vec_id long, v array<int>, square long, dots array<long>, cluster int, distance long"


def integers(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, key: str = "vec_id",
             vector: str = "embedding") -> DataFrame:
    """The usable vectors as floor(scale * x): vec_id, v."""
    whole = (f"size(raw) = {dimensions} AND forall(raw, x -> x IS NOT NULL AND NOT isnan(x) "
             "AND abs(cast(x AS double)) < double('Infinity'))")
    fits = f"abs(x * {scale}) < {LIMIT}"
    number = f"CASE WHEN {fits} THEN int(floor({scale} * x)) ELSE int(raise_error('component beyond the exact range')) END"
    return (df.select(df[key].cast("long").alias("vec_id"), df[vector].alias("raw")).where(whole)
            .selectExpr("vec_id", f"transform(transform(raw, x -> double(x)), x -> {number}) AS v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def _move(old: np.ndarray, new: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Dot products follow the centroids from old to new; every vector gets its nearest one."""
    count, width = new.shape
    change = new - old
    moved = [(j, np.flatnonzero(change[j])) for j in range(count) if change[j].any()]
    lengths = (new * new).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, dots = _matrix(batch.column("v"), width), _matrix(batch.column("dots"), count)
            square = batch.column("square").to_numpy(zero_copy_only=False)
            for j, places in moved:
                dots[:, j] += v[:, places] @ change[j, places]
            distances = square[:, None] - 2 * dots + lengths
            cluster = distances.argmin(axis=1)  # the first of equal ones
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), batch.column("square"), _lists(dots, pa.int64()),
                 pa.array(cluster, pa.int32()), pa.array(distances[np.arange(len(v)), cluster], pa.int64())],
                ["vec_id", "v", "square", "dots", "cluster", "distance"])

    return run


def _sums(count: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per cluster and task: vectors and component sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(count, np.int64), np.zeros((count, width), np.int64)
        for batch in batches:
            v, cluster = _matrix(batch.column("v"), width), batch.column("cluster").to_numpy(zero_copy_only=False)
            n += np.bincount(cluster, minlength=count)
            for j in np.unique(cluster):
                total[j] += v[cluster == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count), pa.int32()), pa.array(n), _lists(total, pa.int64())],
                                         ["cluster", "n", "sums"])

    return run


def _means(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Centroids as exact floors of their vectors' means; one without vectors stays."""
    count, width = old.shape
    parts = state.select("v", "cluster").mapInArrow(_sums(count, width), "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()  # one row per cluster
    new = old.copy()
    for row in rows:
        if row.n:
            new[row.cluster] = [s // row.n for s in row.sums]
    return new


def fit(df: DataFrame, dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
        seed: str = SEED, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Vectors with vec_id, v, cluster and distance after the last round, and the final centroids."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    vectors = written(integers(df, dimensions, scale, key, vector), folder, "vectors")
    first = (vectors.where("vec_id IS NOT NULL")
             .orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "v")
             .limit(clusters).collect())  # a row per cluster at most
    if not first:
        lost = vectors.selectExpr("vec_id", "v", "int(NULL) AS cluster", "bigint(NULL) AS distance")
        return lost, np.zeros((0, dimensions), np.int64)
    new = np.array([r.v for r in first], np.int64)
    old = np.zeros_like(new)
    state = vectors.selectExpr("vec_id", "v", "aggregate(v, 0L, (s, x) -> s + bigint(x) * x) AS square",
                               f"array_repeat(0L, {len(new)}) AS dots")
    for turn in range(rounds + 1):
        state = written(state.mapInArrow(_move(old, new), STATE), folder, f"matrix{turn % 2}")
        old = new
        if turn < rounds:
            new = _means(state, old)
            if (new == old).all():
                break
    return state.select("vec_id", "v", "cluster", "distance"), old


def clustered(df: DataFrame, **settings) -> DataFrame:
    """A row per vector: cluster, distance, and the inertia and digest of its cluster."""
    vectors, centroids = fit(df, **settings)
    rows = vectors.where("cluster IS NOT NULL").groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()
    held = {r.cluster: r.inertia for r in rows}  # a row per cluster
    digest = [(j, held.get(j, 0), sum(held.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
              for j, c in enumerate(centroids)]
    named = df.sparkSession.createDataFrame(digest, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return vectors.drop("v").join(F.broadcast(named), "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE,
           seed: str = SEED) -> str:
    """SQL for `clustered` over the stored vectors: one step after another, in long form."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) = {dimensions} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {dimensions}),
vectors AS MATERIALIZED (
  SELECT r, vec_id, i, floor({scale} * e[i])::BIGINT AS x FROM kept, range(1, {dimensions + 1}) AS g(i)),
first AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept
  WHERE vec_id IS NOT NULL QUALIFY c < {clusters}),
c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN vectors USING (r))"""]
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT r, c, sum((v.x - m.x) * (v.x - m.x))::BIGINT AS d FROM vectors v JOIN c{k} m USING (i) GROUP BY r, c),
a{k} AS MATERIALIZED (SELECT r, c, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN vectors USING (r) GROUP BY c, i),
c{k + 1} AS MATERIALIZED (
  SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} LEFT JOIN s{k} USING (c, i))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN kept USING (r)
JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) m ON m.c = a.c"""
