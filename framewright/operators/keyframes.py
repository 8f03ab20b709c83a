"""Keyframes: rounding to them, reading and comparing their sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bitmaps import has_bit
from .asof import with_neighbours


def cut(ranges: DataFrame, keyframes: DataFrame) -> DataFrame:
    """ranges with cut_first and cut_last: the last keyframe at or before the start, the first at or after the end.

    Where there is none the range's own end stays. Both ends go through one pass as points.
    """
    keys = keyframes.select("id_videofile", "frame_number")
    plain = ranges.withColumn("_both", F.explode(F.array(F.lit(0), F.lit(1))))
    plain = plain.withColumn("_at", F.when(F.col("_both") == 0, F.col("first_frame")).otherwise(F.col("last_frame")))
    met = with_neighbours(plain, keys, ["id_videofile"], "_at", "frame_number", "_before", "_after")
    ends = met.groupBy(*ranges.columns).agg(F.max(F.when(F.col("_both") == 0, F.col("_before"))).alias("_f"), F.max(F.when(F.col("_both") == 1, F.col("_after"))).alias("_l"))
    return ends.select(*ranges.columns, F.coalesce("_f", "first_frame").alias("cut_first"), F.coalesce("_l", "last_frame").alias("cut_last"))


def require_maps(ranges: DataFrame, videofiles: DataFrame) -> DataFrame:
    """Ranges whose videofile has no keyframe bitmap: they can't be cut."""
    return ranges.join(videofiles.where("keyframe_bitmap IS NOT NULL"), "id_videofile", "left_anti")


def flags(frames: DataFrame, videofiles: DataFrame, from_frame: int, to_frame: int) -> DataFrame:
    """Frames of a range with is_keyframe from their videofile's bitmap; null without a bitmap."""
    part = frames.where(F.col("frame_number").between(from_frame, to_frame))
    maps = videofiles.select("id_videofile", "keyframe_bitmap")
    return part.join(maps, "id_videofile", "left").withColumn("is_keyframe", has_bit(F.col("keyframe_bitmap"), F.col("frame_number"))).drop("keyframe_bitmap")


def compare(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """id_videofile, both, only_ours, only_reference, equal: two frame sets by videofile."""
    a = ours.select("id_videofile", "frame_number").distinct().withColumn("_a", F.lit(1))
    b = reference.select("id_videofile", "frame_number").distinct().withColumn("_b", F.lit(1))
    met = a.join(b, ["id_videofile", "frame_number"], "full_outer")
    out = met.groupBy("id_videofile").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("only_ours"), F.count_if(F.col("_a").isNull()).alias("only_reference"))
    return out.withColumn("equal", (F.col("only_ours") == 0) & (F.col("only_reference") == 0))
