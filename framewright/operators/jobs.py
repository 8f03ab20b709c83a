"""The job queue as a table: states, eligibility, transitions, progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import framed_hash
from ..functions.timebase import percent
from .ordinals import numbered

# Fixed values.
STATES = ("WAITING", "CREATING", "WORKING", "DONE", "ERROR")
ALLOWED = {"WAITING": ("CREATING", "ERROR"), "CREATING": ("WORKING", "ERROR"), "WORKING": ("DONE", "ERROR"), "DONE": (), "ERROR": ()}
UNFINISHED = ("WAITING", "CREATING", "WORKING")
TITLES = {"WAITING": "waiting", "CREATING": "starting", "WORKING": "running", "DONE": "finished", "ERROR": "failed"}


def enqueue(jobs: DataFrame, wanted: DataFrame, now) -> DataFrame:
    """jobs with the wanted ones (kind, subject_id, params_hash) as WAITING rows of their own, numbered on by kind and subject.

    Columns that wanted lacks are null. Numbers follow the largest job_id there is.
    """
    last = jobs.agg(F.coalesce(F.max("job_id"), F.lit(0)).alias("_last"))
    new = {"job_id": (F.col("_last") + F.col("_nth")).cast("long"), "state": F.lit("WAITING"), "created_at": now}
    fresh = numbered(wanted, ["kind", "subject_id", "params_hash"], "_nth").crossJoin(F.broadcast(last))  # one row
    return jobs.unionByName(fresh.select(*[new[c].alias(c) if c in new else F.col(c) if c in wanted.columns else F.lit(None).alias(c) for c in jobs.columns]))


def queue_state(jobs: DataFrame) -> DataFrame:
    """One row: working (starting or running), waiting, failed, done."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return jobs.agg(n("CREATING", "WORKING").alias("working"), n("WAITING").alias("waiting"), n("ERROR").alias("failed"), n("DONE").alias("done"))


def claimable(jobs: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Waiting jobs that may start: a FACES job waits while its own subject has an unfinished ANALYZE job."""
    waiting = jobs.where("state = 'WAITING'")
    if kinds is not None:
        waiting = waiting.where(F.col("kind").isin(*kinds))
    busy = jobs.where((F.col("kind") == "ANALYZE") & F.col("state").isin(*UNFINISHED)).select("subject_id", F.lit("FACES").alias("kind")).distinct()
    return waiting.join(busy, ["subject_id", "kind"], "left_anti").select(*jobs.columns)


def next_jobs(jobs: DataFrame, slots: int, kinds: Sequence[str] | None = None) -> DataFrame:
    """The first claimable jobs by (created_at, job_id)."""
    return claimable(jobs, kinds).orderBy("created_at", "job_id").limit(slots)


def apply_transitions(jobs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs after them, wanted with error_code). wanted: job_id (once), to_state, at. A finish stamps finished_at only."""
    pairs = F.create_map(*[x for a, bs in ALLOWED.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]).cast("array<string>"))])
    met = wanted.join(jobs.select("job_id", F.col("state").alias("from_state")), "job_id", "left")
    code = F.when(F.col("from_state").isNull(), "NOT_FOUND").when(~F.array_contains(pairs[F.col("from_state")], F.col("to_state")), "FORBIDDEN")
    verdict = met.withColumn("error_code", code)
    good = verdict.where("error_code IS NULL").select("job_id", F.col("to_state").alias("_to"), F.col("at").alias("_at"))
    both = jobs.join(good, "job_id", "left")
    new = {
        "state": F.coalesce("_to", "state"),
        "started_at": F.when(F.col("_to") == "CREATING", F.col("_at")).otherwise(F.col("started_at")),
        "finished_at": F.when(F.col("_to").isin("DONE", "ERROR"), F.col("_at")).otherwise(F.col("finished_at")),
    }
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns]), verdict


def check_log(log: DataFrame) -> DataFrame:
    """log (job_id, seq, state) with from_state and allowed: whether each step may follow the one before.

    A log starts with WAITING.
    """
    before = F.lag("state").over(Window.partitionBy("job_id").orderBy("seq"))
    ok = F.coalesce(*[F.when((F.col("from_state") == a) & F.col("state").isin(*bs), F.lit(True)) for a, bs in ALLOWED.items() if bs], F.lit(False))
    return log.withColumn("from_state", before).withColumn("allowed", F.when(F.col("from_state").isNull(), F.col("state") == "WAITING").otherwise(ok))


def monotone(reports: DataFrame) -> DataFrame:
    """reports (job_id, seq, done, total) with peak, the largest done so far, and accepted: not behind an earlier report.

    A total behind an earlier known one isn't accepted either; 0 means that it isn't known.
    """
    w = Window.partitionBy("job_id").orderBy("seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    behind = (F.col("done") < F.coalesce(F.max("done").over(past), F.lit(0))) | ((F.col("total") != 0) & (F.col("total") < F.coalesce(F.max("total").over(past), F.lit(0))))
    return reports.withColumn("peak", F.max("done").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("accepted", ~behind)


def cancel(jobs: DataFrame, ids: DataFrame, at, text: str = "cancelled") -> DataFrame:
    """jobs with the unfinished ones listed put to ERROR."""
    met = jobs.join(ids.select("job_id", F.lit(True).alias("_hit")).distinct(), "job_id", "left")
    hit = F.col("_hit").isNotNull() & F.col("state").isin(*UNFINISHED)
    new = {"state": F.when(hit, "ERROR").otherwise(F.col("state")), "finished_at": F.when(hit, at).otherwise(F.col("finished_at")), "error_text": F.when(hit, F.lit(text)).otherwise(F.col("error_text"))}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def requeue(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """jobs with those listed waiting again; their progress stays."""
    met = jobs.join(ids.select("job_id", F.lit(True).alias("_hit")).distinct(), "job_id", "left")
    return _waiting(met, F.col("_hit").isNotNull(), jobs.columns)


def recover_orphans(jobs: DataFrame) -> DataFrame:
    """jobs with started ones waiting again: what a new scheduler does first."""
    return _waiting(jobs, F.col("state").isin("CREATING", "WORKING"), jobs.columns)


def _waiting(jobs: DataFrame, hit, columns: list[str]) -> DataFrame:
    none = {"started_at", "finished_at", "error_text"}
    return jobs.select(*[F.when(hit, "WAITING").otherwise(F.col(c)).alias(c) if c == "state" else F.when(~hit, F.col(c)).alias(c) if c in none else F.col(c) for c in columns])


def memoised(wanted: DataFrame, jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """wanted (kind, params_hash) with the latest done job of the same kind and hash that has a READY artifact; null if none."""
    ready = artifacts.where("state = 'READY'").select("job_id").distinct()
    done = jobs.where("state = 'DONE'").join(ready, "job_id", "left_semi").groupBy("kind", "params_hash").agg(F.max("job_id").alias("job_id"))
    return wanted.join(done, ["kind", "params_hash"], "left")


def view(jobs: DataFrame) -> DataFrame:
    """job_id, kind, state, title, percent (null where the total isn't known), is_final, as lists show jobs."""
    title = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])[F.col("state")]
    return jobs.select("job_id", "kind", "state", title.alias("title"), percent(F.col("progress_done"), F.col("progress_total")).alias("percent"), F.col("state").isin("DONE", "ERROR").alias("is_final"))


def params_hash(*values):
    """Hash of a job's parameters, in their order."""
    return framed_hash(*values)


def complete_scan(processed: DataFrame, videofiles: DataFrame) -> DataFrame:
    """Videofiles whose frames weren't all seen once: id_videofile, expected, seen."""
    seen = processed.groupBy("id_videofile").agg(F.count_distinct("frame_number").alias("seen"))
    met = videofiles.select("id_videofile", F.col("frame_count").cast("long").alias("expected")).join(seen, "id_videofile", "left")
    return met.withColumn("seen", F.coalesce("seen", F.lit(0).cast("long"))).where("seen <> expected")
