"""Analysis runs, what they made stale, and checksums of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(runs: DataFrame, by: list[str], key: str) -> DataFrame:
    """The row with the largest key of each group, whole."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(key)))
    return runs.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def mark_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """runs with those marked stale whose hash isn't the current one (kind, current_hash). Kinds without one stay."""
    met = runs.join(F.broadcast(current), "kind", "left")  # a row a kind
    stale = F.col("is_stale") | F.coalesce(F.col("params_hash") != F.col("current_hash"), F.lit(False))
    return met.select(*[stale.alias(c) if c == "is_stale" else F.col(c) for c in runs.columns])


def propagate(structure: DataFrame, runs: DataFrame) -> DataFrame:
    """Scenes or shots with is_stale set where their run is stale. Rows without a run (an operator's) stay."""
    stale = runs.where("is_stale").select(F.col("run_id"), F.lit(True).alias("_stale"))
    met = structure.join(stale, "run_id", "left")
    return met.select(*[(F.col("is_stale") | F.col("_stale").isNotNull()).alias(c) if c == "is_stale" else F.col(c) for c in structure.columns])


def summary(runs: DataFrame, scenes: DataFrame, shots: DataFrame) -> DataFrame:
    """id_videofile, stale_runs, stale_scenes, stale_shots; videofiles with none aren't listed."""
    part = lambda df, name: df.where("is_stale").select("id_videofile", F.lit(name).alias("what"))
    every = part(runs, "run").unionByName(part(scenes, "scene")).unionByName(part(shots, "shot"))
    return every.groupBy("id_videofile").agg(*[F.count_if(F.col("what") == w).alias(f"stale_{w}s") for w in ("run", "scene", "shot")])


def status(videofiles: DataFrame, runs: DataFrame, current: DataFrame) -> DataFrame:
    """id_videofile, kind, run_id, is_absent, is_stale, reason (OTHER_INPUTS, MARKED or null) of each kind's latest run."""
    asked = videofiles.select("id_videofile").crossJoin(F.broadcast(current))  # a row a kind
    last = latest(runs, ["id_videofile", "kind"], "run_id").select("id_videofile", "kind", "run_id", "params_hash", "is_stale")
    met = asked.join(last, ["id_videofile", "kind"], "left")
    other = F.col("params_hash") != F.col("current_hash")
    reason = F.when(other, "OTHER_INPUTS").when(F.col("is_stale"), "MARKED")
    return met.select("id_videofile", "kind", "run_id", F.col("run_id").isNull().alias("is_absent"), F.coalesce(other | F.col("is_stale"), F.lit(False)).alias("is_stale"), reason.alias("reason"))


def current_checksums(checksums: DataFrame) -> DataFrame:
    """The usable checksum of each videofile: done and not stale; of several the latest."""
    return latest(checksums.where("state = 'DONE' AND NOT is_stale"), ["id_videofile"], "checksum_id")


def mark_changed_sources(checksums: DataFrame, videofiles: DataFrame) -> DataFrame:
    """checksums with usable ones marked stale whose source now has another size or time."""
    now = videofiles.select("id_videofile", F.col("file_size").alias("_size"), F.col("file_mtime").alias("_mtime"))
    met = checksums.join(now, "id_videofile", "left")
    changed = (F.col("state") == "DONE") & ((F.col("byte_size") != F.col("_size")) | (F.col("file_mtime") != F.col("_mtime")))
    return met.select(*[(F.col("is_stale") | F.coalesce(changed, F.lit(False))).alias(c) if c == "is_stale" else F.col(c) for c in checksums.columns])


def supersede(checksums: DataFrame) -> DataFrame:
    """checksums with all done ones but each videofile's latest marked stale."""
    w = Window.partitionBy("id_videofile")
    newest = F.max(F.when(F.col("state") == "DONE", F.col("checksum_id"))).over(w)
    old = (F.col("state") == "DONE") & (F.col("checksum_id") < newest)
    return checksums.select(*[(F.col("is_stale") | old).alias(c) if c == "is_stale" else F.col(c) for c in checksums.columns])


def running_twice(jobs: DataFrame, kind: str = "HASH") -> DataFrame:
    """subject_id, running of subjects with more than one unfinished job of a kind."""
    live = jobs.where((F.col("kind") == kind) & F.col("state").isin("WAITING", "CREATING", "WORKING"))
    return live.groupBy("subject_id").agg(F.count("*").alias("running")).where("running > 1")
