"""Streams against plain versions over the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators.jobs import ALLOWED
from framewright.plans import QUERIES
from framewright.plans.views import JOB_KINDS
from framewright.streaming import queue


def files(spark, path, batches, schema):
    """A stream of one file for each batch, in order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{n}")
    (path / "in").mkdir()
    for n in range(len(batches)):
        (part,) = (path / f"{n}").glob("*.parquet")
        part.rename(path / "in" / f"{n}.parquet")
    return queue.source(spark, str(path / "in"), spark.read.parquet(str(path / "in")).schema)


@pytest.fixture
def hot():
    """Two batches; a job of 25 000 rows a batch, delivered out of order, and some small ones."""
    rng = random.Random(9)
    batches = []
    for b in range(2):
        rows = [(1 if n % 5 else 2 + n % 3, b * 31_250 + n) for n in range(31_250)]
        rng.shuffle(rows)
        batches.append(rows)
    return batches


def test_progress_of_a_hot_job(spark, tmp_path, hot):
    batches = [[(j, s, s // 2 + s * 7919 % 1000) for j, s in rows] for rows in hot]
    stream = files(spark, tmp_path, batches, "job_id long, seq long, done long")
    got = queue.judged(stream, queue.progress, queue.peaks, queue.PEAKS, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    peak, want = {}, set()
    for j, s, d in sorted((r for rows in batches for r in rows), key=lambda r: r[1]):
        if d > peak.get(j, -1):
            peak[j] = d
            want.add((j, s, d))
    assert {tuple(r) for r in got.select("job_id", "seq", "done").collect()} == want and got.count() == len(want)


def test_transitions_of_a_hot_job(spark, tmp_path, hot):
    names = ("WAITING", "CREATING", "WORKING", "DONE", "ERROR")
    batches = [[(j, s, names[s * 7919 % 3 if s < 60_000 else s * 7919 % 5]) for j, s in rows] for rows in hot]
    stream = files(spark, tmp_path, batches, "job_id long, seq long, state string")
    got = queue.judged(stream, queue.transitions, queue.states, queue.STATES, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    now, want = {}, []
    for j, s, to in sorted((r for rows in batches for r in rows), key=lambda r: r[1]):
        ok = to in ALLOWED.get(now[j], ()) if j in now else to == "WAITING"
        want.append((s, j, to, now.get(j), ok))
        if ok:
            now[j] = to
    assert [tuple(r) for r in got.select("seq", "job_id", "state", "from_state", "allowed").orderBy("seq").collect()] == want


def plain_events(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for kv in JOB_KINDS.items() for x in kv])
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("kind", kinds[F.col("event_type")]).withColumn("ts", F.col("ts").cast("timestamp"))


def as_text(moment):
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def test_windows_hold_all_events(spark, sf_dir):
    w = F.window("ts", "1 day")
    want = plain_events(spark, sf_dir).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    got = QUERIES["stream_windows"](spark, sf_dir)
    order = lambda df, at: sorted((str(r[at]), str(r["kind"]), r["events"], r["total"]) for r in df.collect())
    ours, theirs = order(got, "window_start"), order(want.withColumn("at", as_text("w.start")), "at")
    assert [r[:3] for r in ours] == [r[:3] for r in theirs] and all(abs(a[3] - b[3]) <= 0.0051 for a, b in zip(ours, theirs, strict=True))


def test_sessions_hold_all_beats(spark, sf_dir):
    w = F.session_window("ts", "6 hours")
    want = plain_events(spark, sf_dir).groupBy(w.alias("w"), F.col("user_id").alias("client")).agg(F.count("*").alias("beats")).select("client", as_text("w.start").alias("first_beat"), as_text("w.end").alias("end"), "beats")
    got = QUERIES["stream_sessions"](spark, sf_dir)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_states_of_finished_jobs_end(spark, tmp_path):
    """Ten batches in which jobs begin and finish: only open and lately finished ones keep a row, and two tables of states are left."""
    names = ("WAITING", "CREATING", "WORKING", "DONE")
    batches = [[(job, b * 100 + job, names[b - job]) for job in range(10) if 0 <= b - job < 4] + ([(0, b * 100 + 50, "ERROR")] if b in (4, 8) else []) for b in range(10)]
    stream = files(spark, tmp_path, batches, "job_id long, seq long, state string")
    got = queue.judged(stream, queue.transitions, queue.states, queue.STATES, f"{tmp_path}/out", f"{tmp_path}/checkpoint", lifetime=2)
    wrong = [(r["job_id"], r["seq"], r["from_state"]) for r in got.where("NOT allowed").orderBy("seq").collect()]
    assert wrong == [(0, 450, "DONE"), (0, 850, None)] and got.where("allowed").count() == sum(map(len, batches)) - 2
    kept = {r["job_id"]: r["now"] for r in spark.read.parquet(f"{tmp_path}/out/state=000009").collect()}
    assert kept == {5: "DONE", 6: "DONE", 7: "WORKING", 8: "CREATING", 9: "WAITING"}
    assert sorted(p.name for p in (tmp_path / "out").glob("state=*")) == ["state=000008", "state=000009"]


def test_peaks_of_jobs_at_rest_end(spark, tmp_path):
    batches = [[(1, 1, 50), (2, 2, 10)], [(2, 3, 20)], [(2, 4, 30)], [(1, 5, 40), (2, 6, 25)]]
    stream = files(spark, tmp_path, batches, "job_id long, seq long, done long")
    run = lambda name, lifetime: {r["seq"] for r in queue.judged(stream, queue.progress, queue.peaks, queue.PEAKS, f"{tmp_path}/{name}", f"{tmp_path}/{name}-checkpoint", lifetime).collect()}
    assert run("for ever", None) == {1, 2, 3, 4} and run("two", 2) == {1, 2, 3, 4, 5}
