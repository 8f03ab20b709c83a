"""Scenes and shots from score series, and audits of covers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import with_neighbours

SCENE_THRESHOLD, SHOT_THRESHOLD = 8.0, 4.0


def boundaries(scores: DataFrame, scene_t: float = SCENE_THRESHOLD, shot_t: float = SHOT_THRESHOLD) -> DataFrame:
    """id_videofile, level, frame_number: where a score reaches a level's threshold. One pass over the scores."""
    if not 0 < shot_t <= scene_t:
        raise ValueError(f"thresholds must satisfy 0 < shot <= scene: {shot_t}, {scene_t}")
    levels = F.array_compact(F.array(F.when(F.col("score") >= scene_t, F.lit("SCENE")), F.lit("SHOT")))
    return scores.where(F.col("score") >= shot_t).select("id_videofile", F.explode(levels).alias("level"), "frame_number")


def segments(bounds: DataFrame, videofiles: DataFrame) -> DataFrame:
    """id_videofile, level, first_frame, last_frame: closed ranges that cover 0 .. frame_count - 1 of every videofile.

    Every videofile starts both levels at frame 0. Boundaries outside 0 .. frame_count - 1 and of unknown videofiles
    are left out; repeated ones count once.
    """
    zero = videofiles.select("id_videofile", F.explode(F.array(F.lit("SCENE"), F.lit("SHOT"))).alias("level"), F.lit(0).alias("frame_number"), "frame_count")
    rest = bounds.where("frame_number > 0").select("id_videofile", "level", F.col("frame_number").cast("int"), F.lit(None).cast("int").alias("frame_count"))
    starts = zero.unionByName(rest).groupBy("id_videofile", "level", "frame_number").agg(F.max("frame_count").alias("frame_count"))
    # one partitioning by videofile serves the count's spread and the lead
    w = Window.partitionBy("id_videofile", "level").orderBy("frame_number")
    known = starts.withColumn("frame_count", F.max("frame_count").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = known.where(F.col("frame_number") < F.col("frame_count"))
    last = F.coalesce(F.lead("frame_number").over(w), F.col("frame_count")) - 1
    return known.select("id_videofile", "level", F.col("frame_number").alias("first_frame"), last.cast("int").alias("last_frame"))


def scene_starts_within_shots(bounds: DataFrame) -> DataFrame:
    """Scene boundaries that are no shot boundary; there should be none."""
    own = bounds.select("id_videofile", "frame_number", "level")
    return own.where("level = 'SCENE'").join(own.where("level = 'SHOT'"), ["id_videofile", "frame_number"], "left_anti").select("id_videofile", "frame_number")


def coverage(ranges: DataFrame, videofiles: DataFrame) -> DataFrame:
    """id_videofile, level, segments, gaps, overlaps, covered, complete: an audit of each cover.

    gaps and overlaps count neighbours, ends included; covered sums lengths. A level without segments isn't listed.
    """
    w = Window.partitionBy("id_videofile", "level").orderBy("first_frame", "last_frame")
    step = ranges.withColumn("_before", F.coalesce(F.lag("last_frame").over(w), F.lit(-1)))
    per = step.groupBy("id_videofile", "level").agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("first_frame") > F.col("_before") + 1).alias("gaps"),
        F.count_if(F.col("first_frame") <= F.col("_before")).alias("overlaps"),
        F.sum((F.col("last_frame") - F.col("first_frame") + 1).cast("long")).alias("covered"),
        F.max("last_frame").alias("_last"),
    )
    out = per.join(videofiles.select("id_videofile", "frame_count"), "id_videofile")
    short = (F.col("_last") < F.col("frame_count") - 1).cast("long")
    out = out.withColumn("gaps", F.col("gaps") + short)
    return out.select("id_videofile", "level", "segments", "gaps", "overlaps", "covered", ((F.col("gaps") == 0) & (F.col("overlaps") == 0) & (F.col("covered") == F.col("frame_count"))).alias("complete"))


def contiguous(ranges: DataFrame) -> DataFrame:
    """ranges with joins_next: whether the next segment starts right after; null for the last."""
    w = Window.partitionBy("id_videofile", "level").orderBy("first_frame")
    return ranges.withColumn("joins_next", F.col("last_frame") + 1 == F.lead("first_frame").over(w))


def lengths(ranges: DataFrame) -> DataFrame:
    """level, segments, shortest, median, longest segment length in frames."""
    n = F.col("last_frame") - F.col("first_frame") + 1
    return ranges.groupBy("level").agg(F.count("*").alias("segments"), F.min(n).alias("shortest"), F.percentile(n, 0.5).alias("median"), F.max(n).alias("longest"))


def nearest(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """id_videofile, frame_number of ours with the distance to the nearest reference boundary; null if there is none."""
    met = with_neighbours(ours.select("id_videofile", "frame_number"), reference, ["id_videofile"], "frame_number", "frame_number")
    return met.select("id_videofile", "frame_number", F.least(F.col("frame_number") - F.col("before"), F.col("after") - F.col("frame_number")).alias("distance"))


def sweep(scores: DataFrame, reference: DataFrame, thresholds: Sequence[float], within: int = 5) -> DataFrame:
    """threshold, boundaries, exact, near, missed, extra: agreement with the reference boundaries at each threshold.

    near counts ours at most ``within`` frames off, exact ones included; missed counts the reference's that no
    boundary of ours equals. Thresholds that nothing reaches give no row but for their missed ones.
    """
    each = F.array(*[F.lit(float(t)) for t in thresholds])
    ours = scores.select("id_videofile", "frame_number", F.explode(F.filter(each, lambda t: F.col("score") >= t)).alias("threshold"))
    wanted = reference.select("id_videofile", "frame_number").distinct().withColumn("threshold", F.explode(each))
    key = ["threshold", "id_videofile"]
    met = with_neighbours(ours, wanted, key, "frame_number", "frame_number")
    distance = F.least(F.col("frame_number") - F.col("before"), F.col("after") - F.col("frame_number"))
    hits = met.groupBy("threshold").agg(F.count("*").alias("boundaries"), F.count_if(distance == 0).alias("exact"), F.count_if(distance <= within).alias("near"))
    total = wanted.groupBy("threshold").agg(F.count("*").alias("_wanted"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return total.join(hits, "threshold", "left").select("threshold", zero("boundaries").alias("boundaries"), zero("exact").alias("exact"), zero("near").alias("near"), (F.col("_wanted") - zero("exact")).alias("missed"), (zero("boundaries") - zero("exact")).alias("extra"))


def by_level(bounds: DataFrame) -> DataFrame:
    """id_videofile, level, frames: the sorted boundaries of each level of a videofile."""
    return bounds.groupBy("id_videofile", "level").agg(F.array_sort(F.collect_set("frame_number")).alias("frames"))


def significant(frames: DataFrame) -> DataFrame:
    """Frames that carry anything: a boundary, a face or a size hint."""
    return frames.where("is_scene_boundary OR is_shot_boundary OR face_count > 0 OR size_hint IS NOT NULL")


def structure(scenes: DataFrame, shots: DataFrame, locations: DataFrame) -> DataFrame:
    """Live scenes with the shots inside them and the location's name."""
    from .intervals import contained

    live_scenes, live_shots = scenes.where("NOT is_stale"), shots.where("NOT is_stale")
    inside = contained(live_shots.select("id_videofile", "shot_id", "first_frame", "last_frame"), live_scenes.select("id_videofile", "scene_id", "first_frame", "last_frame"), "scene_id")
    nested = inside.groupBy("scene_id").agg(F.array_sort(F.collect_list("first_frame")).alias("shot_starts"), F.count("*").alias("shots"))
    out = live_scenes.join(nested, "scene_id", "left").join(locations.select("location_id", F.col("name").alias("location_name")), "location_id", "left")
    return out.select("scene_id", "id_videofile", "first_frame", "last_frame", "title", "location_name", F.coalesce("shots", F.lit(0).cast("long")).alias("shots"), "shot_starts")


def structure_page(scenes: DataFrame, shots: DataFrame, locations: DataFrame, states: DataFrame, page: int, size: int) -> DataFrame:
    """A page of each videofile's structure: so many live scenes from page * size on, how many there are, and the state (id_videofile, state) of their run."""
    whole = structure(scenes, shots, locations)
    w = Window.partitionBy("id_videofile")
    nth = F.row_number().over(w.orderBy("first_frame", "scene_id")) - 1
    met = whole.withColumn("nth", nth).withColumn("scenes_total", F.count("*").over(w)).where(F.col("nth").between(page * size, page * size + size - 1))
    return met.join(states.select("id_videofile", "state"), "id_videofile", "left").select("id_videofile", "nth", "scenes_total", "scene_id", "first_frame", "last_frame", "location_name", "shots", "state")
