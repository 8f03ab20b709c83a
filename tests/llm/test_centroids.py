import hashlib
import math
import os

import numpy as np
import pytest

from framewright.llm import centroids
from framewright.llm.common import shared_dir

from ..compare import differences, duck


def test_same_as_sql(spark, sf_dir):
    assert differences(centroids.op11_centroids(spark, sf_dir), duck(sf_dir), centroids.OP11_SQL) == []


def brute(rows, k, rounds, scale, size, seed="3"):
    """(key, vector) rows: assignment, distances and centroids by plain integers."""
    kept = [(key, [math.floor(scale * x) for x in v]) for key, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda key: hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    at = [v for _, v in sorted((name(key), v) for key, v in kept)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [min(range(len(at)), key=lambda c: (apart(v, at[c]), c)) for _, v in kept]
        if r < rounds:
            for c in range(len(at)):
                own = [v for (_, v), n in zip(kept, near, strict=True) if n == c]
                if own:
                    at[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((key, c, apart(v, at[c])) for (key, v), c in zip(kept, near, strict=True)), key=str), at


@pytest.mark.parametrize("k,spread", [(3, 0.01), (5, 1.0), (1, 1.0), (8, 0.0)])
def test_same_as_plain_rounds(spark, k, spread):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in np.float32(rng.normal(i % 4, spread, 3))]) for i in range(300)]
    rows += [(7, [0.0, 0.0, 0.0]), (None, [1.0, -2.0, 0.5]), (None, [1.0, -2.0, 0.5]), (8, None), (9, [1.0]), (10, [1.0, None, 2.0]), (11, [1.0, math.nan, 2.0]), (12, [1.0, -math.inf, 2.0]), (13, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, key int").repartition(3)
    got = centroids.cluster(centroids.integer_vectors(df, size=3), k=k, rounds=6, size=3)
    want, at = brute(rows, k, 6, 1024, 3)
    assert sorted(((r["key"], r["cluster"], r["distance"]) for r in got.members.collect()), key=str) == want
    assert got.centroids == at and sum(got.inertia) == sum(d for *_, d in want)


def test_bounds_spare_scans(spark):
    """Vectors far from all borders are measured in full once."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(10 * (i % 3), 0.01, 4)]) for i in range(600)]
    got = centroids.cluster(centroids.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), size=4), k=3, rounds=8, size=4).members
    counts = [r["scans"] for r in got.collect()]
    assert len(counts) == 600 and sum(counts) < 600 * 4 and max(counts) <= 9


def test_few_vectors_and_none(spark, tmp_path):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 64)], schema)
    few.write.parquet(str(tmp_path / "few" / "embeddings.parquet"))
    got = {r["vec_id"]: r for r in centroids.op11_centroids(spark, str(tmp_path / "few")).collect()}
    assert {got[1]["cluster"], got[2]["cluster"]} == {0, 1} and got[1]["inertia"] == 0
    assert got[2]["centroid_sha256"] == hashlib.sha256(",".join(["2048"] * 64).encode()).hexdigest()
    few.limit(0).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert centroids.op11_centroids(spark, str(tmp_path / "none")).collect() == []


def test_values_whose_distances_fit_no_long_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="wouldn't fit a long"):
        centroids.cluster(centroids.integer_vectors(df, size=2), size=2)


def test_rounds_leave_one_table(spark):
    """Each round's table goes when the next is written."""
    held = lambda: sum(name.startswith("assigned-") for name in os.listdir(shared_dir(spark).removeprefix("file:")))
    before = held()
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    got = centroids.cluster(centroids.integer_vectors(df, size=2), k=2, rounds=3, size=2)
    assert held() == before + 1 and got.members.count() == 20
