"""Centroid clustering of integer vectors, exact, with Hamerly's bounds.

A stored table holds each vector with its centroid, an upper bound of the distance to it and a lower bound of the
distance to any other. A round loosens the bounds by what the centroids moved; only vectors whose bounds then meet are
measured against all centroids, in integers. A round reads one table and writes the next, which carries the sums that
the new centroids need: of each Arrow batch on its first row, so they cost no further pass over vectors.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ship, stored

VECTOR_SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"

#: Bounds are doubles; they are loosened by this share of themselves whenever they are made or moved.
SLACK = 2.0**-40

STATE = "key long, vector array<long>, cluster int, upper double, lower double, scans int, distance long, sums array<long>"


@dataclass
class Clustering:
    """members: key, cluster, distance, scans for each kept vector. inertia[c]: the distances in cluster c, summed."""

    members: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", size: int = VECTOR_SIZE, scale: int = SCALE) -> DataFrame:
    """key, vector: floor(scale * x) of each component, for rows whose vector has ``size`` components, all finite."""
    number = lambda x: x.cast("double")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(number(x)) < F.lit(math.inf)))
    kept = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{vector}`").alias(vector)).where((F.size(vector) == size) & whole)
    return kept.select("key", F.transform(vector, lambda x: F.floor(number(x) * scale)).alias("vector"))


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of each vector to each centroid, in integers."""
    return np.stack([np.square(vectors - c).sum(axis=1) for c in centroids], axis=1)


def gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the nearest other one, never too large. Infinite for a lone centroid."""
    apart = np.sqrt(distances(centroids, centroids).astype(np.float64))
    np.fill_diagonal(apart, np.inf)
    return apart.min(axis=1) / 2 * (1 - SLACK)


def scan(vectors: np.ndarray, centroids: np.ndarray):
    """cluster, upper, lower from measuring vectors against all centroids; of equal distances the lowest number counts."""
    found = distances(vectors, centroids)
    cluster = found.argmin(axis=1)
    rows = np.arange(len(vectors))
    upper = np.sqrt(found[rows, cluster].astype(np.float64)) * (1 + SLACK)
    found[rows, cluster] = np.iinfo(np.int64).max
    lower = np.sqrt(found.min(axis=1).astype(np.float64)) * (1 - SLACK) if len(centroids) > 1 else np.full(len(vectors), np.inf)
    return cluster.astype(np.int32), upper, lower


def _assign(centroids: list[list[int]], drift: list[float] | None, size: int):
    """A function over batches of STATE (of key and vector alone while drift is None) that assigns every vector anew."""
    at = np.array(centroids, dtype=np.int64).reshape(len(centroids), size)
    largest = math.isqrt((1 << 62) // max(size, 1)) // 2  # so that a squared distance fits a long

    def run(batches):
        half = gaps(at)
        moved = None if drift is None else np.array(drift) * (1 + SLACK)
        # what the others moved at most, as seen from each centroid
        others = None if drift is None else np.array([max([*moved[:c], *moved[c + 1 :], 0.0]) for c in range(len(at))])
        for batch in batches:
            n = batch.num_rows
            column = batch.column(1)
            vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(n, size)
            if n and max(-int(vectors.min()), int(vectors.max())) > largest:
                raise ValueError(f"a component is beyond {largest} after scaling: its distances wouldn't fit a long")
            if moved is None:
                cluster, upper, lower = scan(vectors, at)
                scans = np.ones(n, dtype=np.int32)
            else:
                cluster, upper, lower, scans = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4, 5))
                upper = (upper + moved[cluster]) * (1 + SLACK)
                lower = (lower - others[cluster]) * (1 - np.copysign(SLACK, lower - others[cluster]))
                bound = np.maximum(lower, half[cluster])
                close = np.flatnonzero(upper >= bound)
                # the true distance to its own centroid settles most of these
                upper[close] = np.sqrt(np.square(vectors[close] - at[cluster[close]]).sum(axis=1).astype(np.float64)) * (1 + SLACK)
                open_ = close[upper[close] >= bound[close]]
                cluster[open_], upper[open_], lower[open_] = scan(vectors[open_], at)
                scans[open_] += 1
            distance = np.square(vectors - at[cluster]).sum(axis=1)
            sums = np.zeros((len(at), size + 2), dtype=np.int64)
            np.add.at(sums[:, 0], cluster, 1)
            for c in range(len(at)):
                sums[c, 1], sums[c, 2:] = distance[cluster == c].sum(), vectors[cluster == c].sum(axis=0)
            first = pa.array([sums.ravel().tolist()] + [None] * (n - 1) if n else [], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, *map(pa.array, (cluster, upper, lower, scans, distance)), first], [f.split()[0] for f in STATE.split(", ")])

    return run


def _sums(table: DataFrame, k: int, size: int) -> list[list[int]]:
    """For each centroid: members, summed distance, summed components. k * (size + 2) numbers, whatever the input."""
    part = table.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n"))
    out = [0] * (k * (size + 2))
    for at, n in part.groupBy("at").agg(F.sum(F.col("n").cast("decimal(20,0)"))).collect():
        out[at] = int(n)
    return [out[c * (size + 2) : (c + 1) * (size + 2)] for c in range(k)]


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED, size: int = VECTOR_SIZE) -> Clustering:
    """Exact k-means over key, vector (``size`` longs each; see integer_vectors).

    Centroids start as the k vectors with the smallest sha256 of ``seed:key``; of equal ones the smaller vector comes
    first, and null keys hash as an empty text. If there are fewer vectors than k, there are so many centroids; an empty
    table gives an empty one. Each round assigns all vectors, ties to the smaller number, and moves every centroid that
    has members to the floor of their mean; then all are assigned once more. Repeated vectors and keys are rows of
    their own. Rows are never dealt out by cluster, so one that holds nearly all is no burden.
    """
    spark = vectors.sparkSession
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
    centroids = [list(r["vector"]) for r in vectors.select(order.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()]
    if not centroids:
        return Clustering(spark.createDataFrame([], "key long, cluster int, distance long, scans int"), [], [])
    ship(spark)
    table, drift = None, None
    for r in range(rounds + 1):
        before = table
        source = vectors if before is None else before.select("key", "vector", "cluster", "upper", "lower", "scans")
        table = stored(source.mapInArrow(_assign(centroids, drift, size), STATE), f"assigned-{r}")
        if before is not None:
            forget(before)
        sums = _sums(table, len(centroids), size)
        if r < rounds:
            moved = [[x // n for x in total] if n else c for c, (n, _, *total) in zip(centroids, sums, strict=True)]
            drift = [math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True))) for a, b in zip(centroids, moved, strict=True)]
            centroids = moved
    return Clustering(table.select("key", "cluster", "distance", "scans"), centroids, [s[1] for s in sums])


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept row of embeddings."""
    got = cluster(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    at = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1).cast(kind) if values else F.lit(None).cast(kind)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in got.centroids]
    return got.members.select(F.col("key").alias("vec_id"), "cluster", "distance", at(got.inertia, "long").alias("cluster_inertia"), F.lit(sum(got.inertia)).cast("long").alias("inertia"), at(digests, "string").alias("centroid_sha256"))


def _sql() -> str:
    """The same by comparing every vector with every centroid in every round."""
    assigned = lambda r: f"""d{r} AS MATERIALIZED (
    SELECT v.*, arg_min(c.cluster, {{'d': list_sum(list_transform(list_zip(v.vector, c.at), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c.cluster}}) AS cluster
    FROM v CROSS JOIN c{r} c GROUP BY ALL)"""  # noqa: E731
    moved = lambda r: f"""c{r + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.at, c.at) AS at FROM c{r} c LEFT JOIN (
        SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS at
        FROM (SELECT cluster, i, sum(vector[i])::BIGINT AS s, count(*) AS n FROM d{r}, range(1, {VECTOR_SIZE + 1}) t(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))"""  # noqa: E731
    steps = ",\n".join(f"{assigned(r)},\n{moved(r)}" for r in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS vector FROM embeddings
    WHERE len(embedding) = {VECTOR_SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {VECTOR_SIZE}),
c0 AS MATERIALIZED (
    SELECT (row_number() OVER (ORDER BY h, vector) - 1)::INTEGER AS cluster, vector AS at
    FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, vector FROM v ORDER BY h, vector LIMIT {CENTROIDS})),
{steps},
{assigned(ROUNDS)},
e AS (SELECT d.vec_id, d.cluster, list_sum(list_transform(list_zip(d.vector, c.at), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance, sha256(array_to_string(c.at, ',')) AS centroid_sha256
    FROM d{ROUNDS} d JOIN c{ROUNDS} c USING (cluster))
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM e
"""


OP11_SQL = _sql()
