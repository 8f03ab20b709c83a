"""Ranks over whole tables without a task that sees all rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from framewright.operators import jobs
from framewright.operators.ordinals import numbered


@pytest.mark.parametrize("rows,ranges,sample", [(5000, 16, 200), (5000, 1, 200), (3, 64, 4096), (1, 64, 4096), (0, 64, 4096), (400, 8, 1)])
def test_ranks(spark, rows, ranges, sample):
    rng = random.Random(rows)
    data = [(rng.choice(["a", "b", None]), rng.randrange(50) if rng.random() < 0.9 else None, i, {"m": i}) for i in range(rows)]
    df = spark.createDataFrame(data, "kind string, n long, i long, m map<string,long>").repartition(3)
    got = [(r["kind"], r["n"], r["place"]) for r in numbered(df, ["kind", -F.col("n")], "place", ranges, sample).orderBy("place").collect()]
    assert [p for *_, p in got] == list(range(1, rows + 1))
    key = lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, -(r[1] or 0)))
    assert [key(r) for r in got] == sorted(map(key, data))


def test_equal_keys_are_spread(spark):
    """Most rows share a key: they still lie in many ranges, and each rank is given once."""
    df = spark.range(4000).select(F.lit(7).alias("key"), "id")
    out = numbered(df, ["key"], "place", 16, 500)
    assert out.agg(F.countDistinct("place"), F.min("place"), F.max("place")).first()[:] == (4000, 1, 4000)


def test_no_window_over_a_whole_table(spark):
    wanted = spark.createDataFrame([("FACES", 2, "x"), ("FACES", 1, "y")], "kind string, subject_id long, params_hash string")
    table = spark.createDataFrame([(5, "ANALYZE", 1, "h", "DONE", "then")], "job_id long, kind string, subject_id long, params_hash string, state string, created_at string")
    out = jobs.enqueue(table, wanted, F.lit("now"))
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(5, "ANALYZE", 1, "h"), (6, "FACES", 1, "y"), (7, "FACES", 2, "x")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", plan)
    assert windows and all(w.startswith("range") for w in windows)
