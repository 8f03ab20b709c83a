"""Edits of boundaries: move, split, merge.

Edits are rows. A plan joins them to the live intervals and judges each (error_code: null, NOT_FOUND,
BOUNDARY_CONFLICT or SEVERAL_EDITS); applying a plan gives the next snapshot of the intervals. A batch holds one edit
a videofile, for an edit's guards look at what the edit before left; several are refused, not reordered.

Scenes and shots differ in their guards: a scene boundary moves to shot boundaries only, and a shot boundary never so
that a scene would start inside a shot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import SIZE_THRESHOLDS, size_of_share
from .asof import with_last_before
from .intervals import bind, largest_share

NOT_FOUND, CONFLICT, SEVERAL = "NOT_FOUND", "BOUNDARY_CONFLICT", "SEVERAL_EDITS"


def _live(intervals: DataFrame) -> DataFrame:
    return intervals.where("NOT is_stale")


def _with_sides(edits: DataFrame, intervals: DataFrame, key: str, frame: str) -> DataFrame:
    """edits with left_id/left_first (ends before frame), right_id/right_last (starts at frame)."""
    live = _live(intervals)
    left = live.select("id_videofile", (F.col("last_frame") + 1).alias(frame), F.col(key).alias("left_id"), F.col("first_frame").alias("left_first"))
    right = live.select("id_videofile", F.col("first_frame").alias(frame), F.col(key).alias("right_id"), F.col("last_frame").alias("right_last"))
    several = F.count("*").over(Window.partitionBy("id_videofile")) > 1
    return edits.withColumn("several", several).join(left, ["id_videofile", frame], "left").join(right, ["id_videofile", frame], "left")


def _scene_inside(plan: DataFrame, scenes: DataFrame, first: str, last: str) -> DataFrame:
    """plan with crosses: whether a live scene starts in first + 1 .. last."""
    marks = _live(scenes).select("id_videofile", F.col("first_frame").alias("_start"))
    met = with_last_before(plan, marks, ["id_videofile"], last, "_start", [], "_scene")
    return met.withColumn("crosses", F.coalesce(F.col("_scene._at") > F.col(first), F.lit(False))).drop("_scene")


def plan_move(edits: DataFrame, intervals: DataFrame, key: str, shots: DataFrame | None = None, scenes: DataFrame | None = None) -> DataFrame:
    """edits (id_videofile, from_frame, to_frame) with left_id, right_id and error_code.

    ``shots`` are given when scenes move, ``scenes`` when shots do.
    """
    plan = _with_sides(edits, intervals, key, "from_frame")
    to = F.col("to_frame")
    conflict = (to == F.col("from_frame")) | (to <= F.col("left_first")) | (to > F.col("right_last"))
    if shots is not None:
        live = _live(shots)
        starts = live.select("id_videofile", F.col("first_frame").alias("to_frame"), F.lit(True).alias("_starts")).distinct()
        ends = live.select("id_videofile", (F.col("last_frame") + 1).alias("to_frame"), F.lit(True).alias("_ends")).distinct()
        any_ = live.select("id_videofile", F.lit(True).alias("_any")).distinct()
        plan = plan.join(starts, ["id_videofile", "to_frame"], "left").join(ends, ["id_videofile", "to_frame"], "left").join(any_, "id_videofile", "left")
        conflict = conflict | (F.col("_any").isNotNull() & (F.col("_starts").isNull() | F.col("_ends").isNull()))
    if scenes is not None:
        plan = plan.withColumn("_upto", to - 1)
        plan = _scene_inside(plan, scenes, "left_first", "_upto").withColumnRenamed("crosses", "_c1")
        plan = _scene_inside(plan, scenes, "to_frame", "right_last").withColumnRenamed("crosses", "_c2")
        conflict = conflict | F.col("_c1") | F.col("_c2")
    code = F.when(F.col("several"), SEVERAL).when(F.col("left_id").isNull() | F.col("right_id").isNull(), NOT_FOUND).when(conflict, CONFLICT)
    return plan.select("id_videofile", "from_frame", "to_frame", "left_id", "right_id", code.alias("error_code"))


def _operator_made(changed):
    """Columns that any rebuilt interval takes."""
    return {"origin": F.when(changed, F.lit("OPERATOR")).otherwise(F.col("origin")), "run_id": F.when(changed, F.lit(None)).otherwise(F.col("run_id"))}


def apply_move(plan: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """intervals after the accepted moves; all rows, same columns."""
    good = plan.where("error_code IS NULL")
    left = good.select(F.col("left_id").alias(key), (F.col("to_frame") - 1).alias("_last"), F.lit(None).cast("int").alias("_first"))
    right = good.select(F.col("right_id").alias(key), F.lit(None).cast("int").alias("_last"), F.col("to_frame").alias("_first"))
    met = intervals.join(left.unionByName(right), key, "left")
    changed = F.col("_first").isNotNull() | F.col("_last").isNotNull()
    new = {"first_frame": F.coalesce("_first", "first_frame"), "last_frame": F.coalesce("_last", "last_frame")} | _operator_made(changed)
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in intervals.columns])


def plan_split(edits: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """edits (id_videofile, frame) with source_id and error_code: the live interval that holds the frame."""
    several = F.count("*").over(Window.partitionBy("id_videofile")) > 1
    met = with_last_before(edits.withColumn("several", several), _live(intervals), ["id_videofile"], "frame", "first_frame", ["last_frame", key])
    inside = F.coalesce(F.col("found.last_frame") >= F.col("frame"), F.lit(False))
    code = F.when(F.col("several"), SEVERAL).when(~inside, NOT_FOUND).when(F.col("found._at") == F.col("frame"), CONFLICT)
    return met.select("id_videofile", "frame", F.when(inside, F.col(f"found.{key}")).alias("source_id"), code.alias("error_code"))


def apply_split(plan: DataFrame, intervals: DataFrame, key: str, new_id, loses: tuple[str, ...] = ()) -> DataFrame:
    """intervals after the accepted splits: the source turns stale, head and tail are new rows.

    ``new_id(first_frame column)`` makes ids of new rows from id_videofile and their first frame. The tail loses the
    columns in ``loses`` (a scene's title and location).
    """
    good = plan.where("error_code IS NULL").select(F.col("source_id").alias(key), F.col("frame").alias("_frame"))
    met = intervals.join(good, key, "left").withColumn("_part", F.explode(F.when(F.col("_frame").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))))
    part = F.col("_part")
    first = F.when(part == 3, F.col("_frame")).otherwise(F.col("first_frame"))
    new = {
        "first_frame": first,
        "last_frame": F.when(part == 2, F.col("_frame") - 1).otherwise(F.col("last_frame")),
        "is_stale": F.when(part == 1, F.lit(True)).otherwise(F.col("is_stale")),
        key: F.when(part >= 2, new_id(first)).otherwise(F.col(key)),
    } | _operator_made(part >= 2) | {c: F.when(part == 3, F.lit(None)).otherwise(F.col(c)) for c in loses}
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in intervals.columns])


def shots_to_align(plan: DataFrame, shots: DataFrame) -> DataFrame:
    """Shot edits (id_videofile, frame) that scene splits need: frames that fall strictly inside a live shot."""
    good = plan.where("error_code IS NULL").select("id_videofile", "frame")
    met = with_last_before(good, _live(shots), ["id_videofile"], "frame", "first_frame", ["last_frame"])
    return met.where((F.col("found._at") < F.col("frame")) & (F.col("frame") < F.col("found.last_frame"))).select("id_videofile", "frame")


def plan_merge(edits: DataFrame, intervals: DataFrame, key: str, scenes: DataFrame | None = None) -> DataFrame:
    """edits (id_videofile, frame) with left_id (stays), right_id (goes), right_last and error_code."""
    plan = _with_sides(edits, intervals, key, "frame")
    conflict = F.lit(False)
    if scenes is not None:
        plan = _scene_inside(plan, scenes, "left_first", "right_last")
        conflict = F.col("crosses")
    code = F.when(F.col("several"), SEVERAL).when(F.col("left_id").isNull() | F.col("right_id").isNull(), NOT_FOUND).when(conflict, CONFLICT)
    return plan.select("id_videofile", "frame", "left_id", "right_id", "right_last", code.alias("error_code"))


def apply_merge(plan: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """intervals after the accepted merges: the left one reaches on, the right one turns stale."""
    good = plan.where("error_code IS NULL")
    keep = good.select(F.col("left_id").alias(key), F.col("right_last").alias("_last"), F.lit(False).alias("_gone"))
    gone = good.select(F.col("right_id").alias(key), F.lit(None).cast("int").alias("_last"), F.lit(True).alias("_gone"))
    met = intervals.join(keep.unionByName(gone), key, "left")
    new = {"last_frame": F.coalesce("_last", "last_frame"), "is_stale": F.col("is_stale") | F.coalesce("_gone", F.lit(False))} | _operator_made(F.col("_last").isNotNull())
    return met.select(*[new[c].alias(c) if c in new else F.col(c) for c in intervals.columns])


def settle(shots: DataFrame, faces: DataFrame, videofiles: DataFrame, thresholds=SIZE_THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """(shots, faces) after an edit: faces bound to live shots, sizes of live AUTO shots worked out anew."""
    live = _live(shots)
    bound = bind(faces, live.select("id_videofile", "shot_id", "first_frame", "last_frame"), "shot_id")
    share = largest_share(live.select("id_videofile", "shot_id", "first_frame", "last_frame"), faces, videofiles).select("shot_id", "share", F.lit(True).alias("_live"))
    met = shots.join(share, "shot_id", "left")
    fresh = F.col("_live").isNotNull() & (F.col("size_origin") != "OPERATOR")
    size = F.when(fresh, size_of_share(F.col("share"), thresholds)).otherwise(F.col("size"))
    return met.select(*[size.alias(c) if c == "size" else F.col(c) for c in shots.columns]), bound
