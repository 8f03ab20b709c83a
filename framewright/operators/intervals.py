"""Points in intervals, intervals in intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import with_last_before

BY = ["id_videofile"]


def bind(points: DataFrame, intervals: DataFrame, interval_id: str, at: str = "frame_number") -> DataFrame:
    """points with the id of the interval that holds them, null if none does.

    Intervals of one videofile mustn't overlap; ``ambiguous`` finds those that do. A point's interval is the last to
    start at or before it, if it reaches that far.
    """
    met = with_last_before(points.drop(interval_id), intervals, BY, at, "first_frame", ["last_frame", interval_id])
    return met.withColumn(interval_id, F.when(F.col("found.last_frame") >= F.col(at), F.col(f"found.{interval_id}"))).drop("found")


def ambiguous(intervals: DataFrame, interval_id: str) -> DataFrame:
    """Intervals that start before an earlier one of their videofile ends."""
    w = Window.partitionBy(*BY).orderBy("first_frame", "last_frame", interval_id).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("_end", F.max("last_frame").over(w)).where(F.col("first_frame") <= F.col("_end")).drop("_end")


def contained(inner: DataFrame, outer: DataFrame, outer_id: str) -> DataFrame:
    """Rows of inner whose both ends lie in one interval of outer, with its id."""
    met = with_last_before(inner, outer, BY, "first_frame", "first_frame", [F.col("last_frame").alias("_outer_last"), outer_id])
    return met.where(F.col("found._outer_last") >= F.col("last_frame")).withColumn(outer_id, F.col(f"found.{outer_id}")).drop("found")


def overlapping(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs of intervals of one videofile that share a frame, each pair once.

    Both sides may overlap among themselves. Pairs are found in blocks of frames; a pair belongs to the block where the
    later of the two starts.
    """
    block = 4096

    def blocks(df: DataFrame, key: str, side: str) -> DataFrame:
        spread = F.explode(F.sequence(F.floor(F.col("first_frame") / block), F.floor(F.col("last_frame") / block)))
        return df.select("id_videofile", F.col(key).alias(side), F.col("first_frame").alias(f"{side}_first"), F.col("last_frame").alias(f"{side}_last"), spread.alias("_block"))

    met = blocks(a, a_id, "_a").join(blocks(b, b_id, "_b"), ["id_videofile", "_block"])
    met = met.where((F.col("_a_last") >= F.col("_b_first")) & (F.col("_a_first") <= F.col("_b_last")) & (F.col("_block") == F.floor(F.greatest("_a_first", "_b_first") / block)))
    return met.select("id_videofile", F.col("_a").alias(a_id), F.col("_b").alias(b_id))


def persons_in(scenes: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """scene_id, person_names: sorted distinct names of real persons seen in each scene; an empty list without any."""
    named = faces.join(persons.where("kind = 'PERSON'").select("person_id", "name"), "person_id").select("id_videofile", "frame_number", "name")
    seen = bind(named, scenes, "scene_id").where("scene_id IS NOT NULL").groupBy("scene_id").agg(F.array_sort(F.collect_set("name")).alias("person_names"))
    return scenes.select("scene_id").join(seen, "scene_id", "left").select("scene_id", F.coalesce("person_names", F.array().cast("array<string>")).alias("person_names"))


def largest_share(shots: DataFrame, faces: DataFrame, videofiles: DataFrame) -> DataFrame:
    """shot_id, share: the largest face of each shot by its share of the frame; null without a face."""
    from ..functions.geometry import area

    bound = bind(faces.select("id_videofile", "frame_number", "x1", "y1", "x2", "y2"), shots, "shot_id")
    top = bound.where("shot_id IS NOT NULL").groupBy("shot_id").agg(F.max(area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("biggest"))
    sizes = videofiles.select("id_videofile", (F.col("width").cast("double") * F.col("height")).alias("frame_area"))
    return shots.select("id_videofile", "shot_id").join(top, "shot_id", "left").join(sizes, "id_videofile").select("shot_id", (F.col("biggest") / F.col("frame_area")).alias("share"))
