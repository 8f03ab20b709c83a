"""The queue and its clients as streams: states, progress, heartbeats, subscriptions, sinks.

State is kept by key: a job's last state and progress, a client's last heartbeat. A client's ends with the watermark; those of
jobs are tables that are written after each batch, of which two are kept. A finished job's row ends some batches later.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.jobs import ALLOWED
from ..sources.snapshots import delete

SILENCE = "30 seconds"


def source(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def state_counts(jobs: DataFrame) -> DataFrame:
    """kind, state, jobs: counts so far; for output mode complete or update."""
    return jobs.groupBy("kind", "state").agg(F.count("*").alias("jobs"))


def windowed(events: DataFrame, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, kind, events, total in tumbling or sliding windows; events later than ``late`` are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "kind").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "kind", "events", "total")


def sessions(beats: DataFrame, silence: str = SILENCE, late: str = "10 minutes") -> DataFrame:
    """client, first_beat, end, beats: runs of heartbeats of a client without a silence of that length."""
    w = F.session_window("ts", silence)
    out = beats.withWatermark("ts", late).groupBy(w.alias("w"), "client").agg(F.count("*").alias("beats"))
    return out.select("client", F.col("w.start").alias("first_beat"), F.col("w.end").alias("end"), "beats")


def without_repeats(events: DataFrame, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Events whose key hasn't come within the watermark yet."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def last_subscription(events: DataFrame) -> DataFrame:
    """tab, subscription: the last one of each tab so far; for output mode complete or update."""
    return events.groupBy("tab").agg(F.max_by("subscription", F.struct("ts", "subscription")).alias("subscription"))


def progress(reports: DataFrame, before: DataFrame) -> DataFrame:
    """Reports (job_id, seq, done, total) of a batch that move a job on: done larger than any before. Others are dropped.

    before: job_id, peak of earlier batches. A batch is judged in the order of seq, in whatever order it comes.
    """
    earlier = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    met = reports.join(before, "job_id", "left").withColumn("_best", F.coalesce(F.greatest(F.max("done").over(earlier), "peak"), F.lit(-1)))
    return met.where("done > _best").select(*reports.columns)


#: States of earlier batches, as the functions below keep them: since is the number of the batch that last touched a row.
PEAKS = "job_id long, peak long, since long"
STATES = "job_id long, now string, since long"


def peaks(before: DataFrame, moved: DataFrame, number: int = 0, lifetime: int | None = None) -> DataFrame:
    """PEAKS after batch ``number``, from those before it and the reports that moved jobs on.

    With a lifetime, jobs that moved on in none of so many batches are forgotten.
    """
    fresh = moved.select("job_id", F.col("done").alias("peak"), F.lit(number).cast("long").alias("since"))
    out = before.select("job_id", "peak", "since").union(fresh).groupBy("job_id").agg(F.max("peak").alias("peak"), F.max("since").alias("since"))
    return out if lifetime is None else out.where(F.col("since") > number - lifetime)


def transitions(steps: DataFrame, before: DataFrame) -> DataFrame:
    """Steps (job_id, seq, state) of a batch with from_state and allowed, by the table of transitions. Refused steps change nothing.

    A job begins with WAITING. before: job_id, now: states after earlier batches. A batch is judged in the order of
    seq, in whatever order it comes; Spark sorts it, so a task holds no more of a job than a piece.
    """

    def run(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, now, n = None, None, 0
        for pdf in pieces:
            froms, allowed = [], []
            for own, to, stored in zip(pdf["job_id"], pdf["state"], pdf["now"], strict=True):
                if not n or own != job:
                    job, now = own, stored
                ok = to == "WAITING" if now is None else to in ALLOWED.get(now, ())
                froms.append(now)
                allowed.append(ok)
                now = to if ok else now
                n += 1
            yield pdf.drop(columns="now").assign(from_state=froms, allowed=allowed)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in steps.schema.fields) + ", from_state string, allowed boolean"
    met = steps.join(before, "job_id", "left").select(*steps.columns, "now")
    return met.repartition("job_id").sortWithinPartitions("job_id", "seq").mapInPandas(run, schema)


def states(before: DataFrame, judged: DataFrame, number: int = 0, lifetime: int | None = None) -> DataFrame:
    """STATES after batch ``number``, from those before it and its judged steps: an allowed step is later than any it follows.

    With a lifetime, a job is forgotten so many batches after it has come to a final state; until then its late steps are
    refused as such, after that as steps of a job that never began.
    """
    last = judged.where("allowed").groupBy("job_id").agg(F.max_by("state", "seq").alias("_last"))
    now, since = F.coalesce("_last", "now"), F.when(F.col("_last").isNotNull(), F.lit(number).cast("long")).otherwise(F.col("since"))
    out = before.join(last, "job_id", "full").select("job_id", now.alias("now"), since.alias("since"))
    final = F.col("now").isin(*[s for s, after in ALLOWED.items() if not after])
    return out if lifetime is None else out.where(~final | (F.col("since") > number - lifetime))


def push(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", every: str | None = None):
    """Start pushing each batch to a sink; with ``every``, batches begin at that interval, else once over what there is."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Run a stream over all there is now, and read what it wrote. In complete mode the last batch counts, in update mode the last row of each key.

    Each batch is written to a folder of its own, so a batch that is run again replaces itself.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")

    push(df, write, checkpoint, mode).awaitTermination()
    out = spark.read.parquet(f"{path}/batch=*")
    if mode == "complete":
        last = out.agg(F.max("_batch")).first()[0]
        out = out.where(F.col("_batch") == last)
    if mode == "update":
        rest = [c for c in df.columns if c not in key]
        out = out.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("_row")).select(*[F.col(c) if c in key else F.col(f"_row.{c}") for c in df.columns])
    return out.drop("_batch", "batch")


def judged(df: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame], after: Callable[..., DataFrame], state: str, path: str, checkpoint: str, lifetime: int | None = None) -> DataFrame:
    """Run a stream over all there is now, each batch whole by ``judge(batch, before)``, and read what it wrote.

    The table of states (schema ``state``) is written after each batch by ``after(before, judged, number, lifetime)``; a
    batch that is run again finds the states before it as they were. No older ones are kept.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        before = own.read.schema(state).parquet(f"{path}/state={number - 1:06d}") if number else own.createDataFrame([], state)
        judge(batch, before).write.mode("overwrite").parquet(f"{path}/batch={number:06d}")
        done = own.read.parquet(f"{path}/batch={number:06d}")
        after(before, done, number, lifetime).write.mode("overwrite").parquet(f"{path}/state={number:06d}")
        delete(own, f"{path}/state={number - 2:06d}")

    push(df, write, checkpoint).awaitTermination()
    return spark.read.parquet(f"{path}/batch=*").drop("batch")
