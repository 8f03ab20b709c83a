"""Clustering of vectors by cosine similarity: seeds, assignment, merging of centres, assignment again.

Points are never gathered: what the driver holds is the centres, ``count`` of them at most. Sums over members are made
in the tasks, one row a task and centre. Similarities are doubles; of equal ones the lowest centre counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .faces import keys_of
from .ordinals import numbered

COUNT, THRESHOLD, ROUNDS = 256, 0.65, 64
MOST_RANGES = 256


def seeds(points: DataFrame, count: int, rows_a_range: int = 200_000) -> DataFrame:
    """seed, face_id, vector: every (n div k)-th point by face_id (nulls last), k = min(count, n).

    Ids alone are ranked, by ranges of about so many rows; the ``count`` that are seeds then meet their vectors. Of points that share an id the
    least vector counts.
    """
    n = points.count()
    k = min(count, n)
    if not k:
        return points.select(F.lit(0).cast("long").alias("seed"), "face_id", "vector").limit(0)
    step = n // k
    ranked = numbered(points.select("face_id"), [F.col("face_id").isNull(), "face_id"], "_rank", min(MOST_RANGES, n // rows_a_range + 1)).withColumn("_rank", F.col("_rank") - 1)
    some = ranked.where((F.col("_rank") % step == 0) & (F.col("_rank") < step * k)).select((F.col("_rank") / step).cast("long").alias("seed"), F.col("face_id").alias("_id"))
    met = points.join(F.broadcast(some), F.col("face_id").eqNullSafe(F.col("_id")))  # count rows at most
    return met.groupBy("seed", "face_id").agg(F.min("vector").alias("vector"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=x.copy(), where=size > 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """face_id, centre, similarity: each point's nearest centre. The centres travel with the task: count x width doubles."""
    own = unit_rows(np.asarray(centres, dtype=np.float64))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sim = unit_rows(_matrix(batch.column(1))) @ own.T
            best = sim.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int64)), pa.array(sim[np.arange(len(best)), best])], ["face_id", "centre", "similarity"])

    ship(points.sparkSession)
    return points.select(F.col("face_id").cast("long").alias("face_id"), "vector").mapInArrow(run, "face_id long, centre long, similarity double")


def sums(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of members, number of members) of each centre; summed in the tasks."""
    own = unit_rows(np.asarray(centres, dtype=np.float64))
    k, width = own.shape

    def run(batches):
        total, size = np.zeros((k, width)), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            best = (unit_rows(x) @ own.T).argmax(axis=1)
            np.add.at(total, best, x)
            size += np.bincount(best, minlength=k)
        at = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64())), pa.array(size[at])], ["centre", "total", "size"])

    ship(points.sparkSession)
    each = points.select("vector").mapInArrow(run, "centre long, total array<double>, size long")
    parts = each.select("centre", "size", F.posexplode("total").alias("i", "x")).groupBy("centre", "i").agg(F.sum("x").alias("x"), F.sum("size").alias("size"))
    total, size = np.zeros((k, width)), np.zeros(k, dtype=np.int64)
    for r in parts.collect():  # centres times width numbers
        total[r["centre"], r["i"]], size[r["centre"]] = r["x"], r["size"]
    return total, size


def merged(total: np.ndarray, size: np.ndarray, threshold: float, rounds: int = ROUNDS) -> np.ndarray:
    """Means of the groups of centres that greedy merging leaves; centres without members are left out.

    A round goes through the centres in order; one gathers each later free centre that is at least ``threshold`` like
    the plain mean of the centres gathered so far. The next round's centres are the means of the members.
    """
    live = np.flatnonzero(size)
    total, size = total[live], size[live]
    for _ in range(rounds):
        centre = total / size[:, None]
        group = np.full(len(size), -1)
        n = 0
        for i in range(len(size)):
            if group[i] >= 0:
                continue
            group[i] = n
            gathered, members = centre[i].copy(), 1
            for j in range(i + 1, len(size)):
                if group[j] >= 0:
                    continue
                mean = gathered / members
                length = np.linalg.norm(mean) * np.linalg.norm(centre[j])
                if (mean @ centre[j] / length if length else 0.0) >= threshold:
                    group[j] = n
                    gathered += centre[j]
                    members += 1
            n += 1
        if n == len(size):
            break
        fresh, count = np.zeros((n, total.shape[1])), np.zeros(n, dtype=np.int64)
        np.add.at(fresh, group, total)
        np.add.at(count, group, size)
        total, size = fresh, count
    return total / size[:, None]


def clusters(points: DataFrame, count: int = COUNT, threshold: float = THRESHOLD) -> DataFrame:
    """cluster_id, size of points (face_id, vector). No points, no clusters; vectors must have one width."""
    return keys_of(grouped(points, count, threshold))


def grouped(points: DataFrame, count: int = COUNT, threshold: float = THRESHOLD) -> DataFrame:
    """group, face_id: each point with the number of its cluster's centre."""
    if count <= 0 or not -1 <= threshold <= 1:
        raise ValueError(f"count must be positive and threshold within -1 .. 1: {count}, {threshold}")
    first = seeds(points, count).orderBy("seed").collect()  # count rows at most
    if not first:
        return points.select(F.lit(0).cast("long").alias("group"), "face_id").limit(0)
    centres = merged(*sums(points, np.array([r["vector"] for r in first], dtype=np.float64)), threshold)
    return assigned(points, centres).select(F.col("centre").alias("group"), "face_id")


def listed(found: DataFrame) -> DataFrame:
    """Clusters, the largest first; of equal sizes by key, as text."""
    return found.orderBy(F.desc("size"), "cluster_id")
