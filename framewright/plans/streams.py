"""Streaming queries, run over all there is and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import blocks, snapshots
from ..streaming import heartbeats, queue
from .registry import query
from .views import JOB_KINDS, Views


def _place(v: Views) -> str:
    """A folder of our own in the shared one; only a local session, whose executors are the driver, may do without."""
    base = v.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not v.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="streams-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(v: Views) -> DataFrame:
    """The events table as a stream."""
    table = v.table("events")
    kinds = F.create_map(*[F.lit(x) for kv in JOB_KINDS.items() for x in kv])
    stream = v.spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    return stream.withColumn("kind", kinds[F.col("event_type")]).withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(v: Views, stream: DataFrame, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    place = _place(v)
    return queue.drained(stream, f"{place}/out", f"{place}/checkpoint", mode, key)


def _judged(v: Views, stream: DataFrame, judge, after, state: str):
    place = _place(v)
    return queue.judged(stream, judge, after, state, f"{place}/out", f"{place}/checkpoint")


@query("stream_queue_state", "SELECT kind, state, count(*) AS jobs FROM jobs GROUP BY 1, 2")
def _(v: Views):
    states = F.array(*[F.lit(s) for s in ("WAITING", "CREATING", "WORKING", "DONE", "ERROR")])
    jobs = _events(v).withColumn("state", F.get(states, (F.col("event_id") % 5).cast("int")))
    return _drained(v, queue.state_counts(jobs), "complete")


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in JOB_KINDS.items()) + " END"


def _moment(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


@query("stream_sessions", """
, e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
SELECT user_id AS client, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_beat, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS beats FROM s GROUP BY user_id, run""")
def _(v: Views):
    beats = _events(v).withColumnRenamed("user_id", "client")
    out = _drained(v, queue.sessions(beats, "6 hours", "1 hour"), "complete")  # with those still open
    return out.select("client", _moment("first_beat"), _moment("end"), "beats")


@query("stream_windows", f"""
SELECT strftime(date_trunc('day', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f') AS window_start, {_KIND} AS kind, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2""")
def _(v: Views):
    out = _drained(v, queue.windowed(_events(v), "1 day", None, "1 hour"), "update", ["window_start", "kind"])
    return out.select(_moment("window_start"), "kind", "events", F.round("total", 2).alias("total"))


@query("stream_without_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def _(v: Views):
    return _drained(v, queue.without_repeats(_events(v), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"))


@query("stream_subscriptions", "SELECT user_id AS tab, arg_max(event_id, (ts, event_id)) AS subscription FROM events GROUP BY 1")
def _(v: Views):
    return _drained(v, queue.last_subscription(_events(v).select(F.col("user_id").alias("tab"), F.col("event_id").alias("subscription"), "ts")), "complete")


@query("stream_progress", """
, p AS (SELECT event_id AS seq, user_id AS job_id, CAST(floor(value) AS BIGINT) AS done FROM events)
SELECT job_id, seq, done FROM (SELECT *, coalesce(max(done) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS peak FROM p) WHERE done > peak""")
def _(v: Views):
    reports = _events(v).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("done"))
    return _judged(v, reports, queue.progress, queue.peaks, queue.PEAKS)


@query("stream_transitions", """
, e AS (SELECT event_id AS seq, user_id AS job_id, ['WAITING', 'CREATING', 'WORKING', 'DONE', 'ERROR'][event_id % 5 + 1] AS state FROM events),
h AS (SELECT *, coalesce(list(state) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before FROM e),
n AS (SELECT job_id, seq, state, list_reduce(list_prepend('', before), lambda a, b: CASE WHEN (a = '' AND b = 'WAITING') OR (a = 'WAITING' AND b IN ('CREATING', 'ERROR')) OR (a = 'CREATING' AND b IN ('WORKING', 'ERROR')) OR (a = 'WORKING' AND b IN ('DONE', 'ERROR')) THEN b ELSE a END) AS a FROM h)
SELECT job_id, seq, state, nullif(a, '') AS from_state, (a = '' AND state = 'WAITING') OR (a = 'WAITING' AND state IN ('CREATING', 'ERROR')) OR (a = 'CREATING' AND state IN ('WORKING', 'ERROR')) OR (a = 'WORKING' AND state IN ('DONE', 'ERROR')) AS allowed FROM n""")
def _(v: Views):
    states = F.array(*[F.lit(s) for s in ("WAITING", "CREATING", "WORKING", "DONE", "ERROR")])
    steps = _events(v).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.get(states, (F.col("event_id") % 5).cast("int")).alias("state"))
    return _judged(v, steps, queue.transitions, queue.states, queue.STATES)


@query("stream_heartbeats", """
, w AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS w FROM events),
e AS (SELECT user_id AS client, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS back FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
p(hours, event, attempt) AS (VALUES (6, 'lost', 0), (7, 'retry', 1), (9, 'retry', 2), (13, 'retry', 3), (17, 'given_up', 3)),
told AS (
    SELECT client, ts + to_hours(hours) AS moment, event, attempt FROM e, p WHERE back IS NULL OR (back > ts + INTERVAL 6 HOUR AND ts + to_hours(hours) < back)
    UNION ALL
    SELECT client, back, 'back', CASE WHEN back > ts + INTERVAL 13 HOUR THEN 3 WHEN back > ts + INTERVAL 9 HOUR THEN 2 WHEN back > ts + INTERVAL 7 HOUR THEN 1 ELSE 0 END
    FROM e WHERE back > ts + INTERVAL 6 HOUR AND back <= ts + INTERVAL 17 HOUR)
SELECT client, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS "at", event, attempt::INTEGER AS attempt FROM told, w WHERE moment <= w""")
def _(v: Views):
    beats = _events(v).select(F.col("user_id").alias("client"), "ts")
    patience = heartbeats.Patience(silence=6 * 3600, first_pause=3600, longest_pause=4 * 3600, attempts=3)
    return _drained(v, heartbeats.watched(beats, patience, "1 hour")).select("client", _moment("at"), "event", "attempt")


@query("stream_pushed", "SELECT event_id, user_id, event_type FROM events")
def _(v: Views):
    """Events pushed as batches to a folder of JSON lines, and what was committed there."""
    place = _place(v)
    blocks.register(v.spark)
    events = _events(v).select("event_id", "user_id", "event_type")
    events.writeStream.format("pushed").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return blocks.pushed(v.spark, f"{place}/out", "event_id long, user_id long, event_type string").drop("batch")


@query("tables_together", """
SELECT 'scenes' AS name, count(*) AS rows, sum(first_frame)::BIGINT AS total FROM scenes UNION ALL
SELECT 'shots', count(*), sum(first_frame)::BIGINT FROM shots UNION ALL
SELECT 'videofiles', count(*), sum(frame_count)::BIGINT FROM videofiles""")
def _(v: Views):
    """Structure and files published as one set, read back by its manifest."""
    path = f"{_place(v)}/set"
    snapshots.publish_together({"scenes": v.scenes, "shots": v.shots, "videofiles": v.videofiles}, path)
    found = snapshots.together(v.spark, path)
    sums = [df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.sum("frame_count" if name == "videofiles" else "first_frame").cast("long").alias("total")) for name, df in found.items()]
    return sums[0].union(sums[1]).union(sums[2])


@query("frame_fan_out", """
, f AS (SELECT l_orderkey * 10 + l_linenumber AS id_videofile, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS frame_number, l_quantity FROM lineitem)
SELECT 'sizes' AS sink, count(*) AS rows FROM f UNION ALL SELECT 'faces', sum(1 + l_quantity::BIGINT % 3)::BIGINT FROM f""")
def _(v: Views):
    """One pass over frames (lines of orders) to two sinks: one row a frame, and one to three faces a frame."""
    place = _place(v)
    lines = v.table("lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    frames = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_videofile"), nth.alias("frame_number"), "l_quantity")
    boxes = lambda df: df.select("id_videofile", "frame_number", F.posexplode(F.sequence(F.lit(0), F.col("l_quantity").cast("int") % 3)).alias("face_index", "box")).withColumn("_first", F.col("face_index") == 0)
    sizes = lambda df: df.select("id_videofile", "frame_number", F.col("l_quantity").alias("size"))
    to = lambda name: lambda df: df.write.parquet(f"{place}/{name}")
    sinks = {"sizes": (sizes, to("sizes")), "faces": (boxes, to("faces"))}
    snapshots.fan_out(frames, sinks, f"{place}/frames", ["id_videofile", "frame_number"])
    count = lambda name: v.spark.read.parquet(f"{place}/{name}").agg(F.lit(name).alias("sink"), F.count("*").alias("rows"))
    return count("sizes").union(count("faces"))
