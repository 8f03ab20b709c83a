"""Bitmaps of frames: one bit a frame, the highest bit of a byte first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timebase import div


def bytes_needed(frames: Column) -> Column:
    return F.ceil(frames / 8).cast("int")


def fits(bitmap: Column, frames: Column) -> Column:
    """Whether a bitmap has just the bytes its frames need."""
    return F.octet_length(bitmap) == bytes_needed(frames)


def has_bit(bitmap: Column, frame: Column) -> Column:
    """Whether a frame's bit is set; false beyond either end."""
    at = div(frame.cast("long"), F.lit(8).cast("long")).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, at + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.call_function("shiftright", F.lit(128), (frame % 8).cast("int"))
    return F.when((frame < 0) | (at >= F.octet_length(bitmap)), F.lit(False)).otherwise(byte.bitwiseAND(mask) != 0)


def frames_in(bitmap: Column, frames: Column) -> Column:
    """array<int> of the frames whose bits are set. Bytes are looked at first, so sparse bitmaps cost little."""
    hexed = F.hex(bitmap)
    some = F.filter(F.sequence(F.lit(0), F.greatest(F.octet_length(bitmap) - 1, F.lit(0))), lambda i: F.substring(hexed, i * 2 + 1, F.lit(2)) != "00")
    each = F.flatten(F.transform(some, lambda i: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: i * 8 + j)))
    return F.when(F.octet_length(bitmap) > 0, F.filter(each, lambda f: (f < frames) & has_bit(bitmap, f))).otherwise(F.array().cast("array<int>"))


def count_bits(bitmap: Column) -> Column:
    """How many bits are set."""
    nibbles = F.split(F.hex(bitmap), "")
    return F.aggregate(nibbles, F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.bit_count(F.conv(x, 16, 10).cast("int"))))


def build(frames: DataFrame, sizes: DataFrame, key: str = "id_videofile", frame: str = "frame_number", count: str = "frame_count") -> DataFrame:
    """key and keyframe_bitmap of every row in sizes: a bit for each frame listed, which must lie in 0 .. count - 1.

    Bits meet in bytes by a partial aggregation (one row a byte at most), and bytes in one string a key. A key without
    frames has a bitmap of zeros. Frames listed twice count once; frames of unknown keys are left out.
    """
    every = sizes.select(key, F.explode(F.sequence(F.lit(0), bytes_needed(F.col(count)) - 1)).alias("_byte"), F.lit(0).alias("_mask"), F.col(count).alias("_count"))
    mask = F.call_function("shiftright", F.lit(128), (F.col(frame) % 8).cast("int"))
    set_ = frames.select(key, div(F.col(frame).cast("long"), F.lit(8).cast("long")).cast("int").alias("_byte"), mask.alias("_mask"), F.lit(None).cast("int").alias("_count"), F.col(frame).alias("_frame"))
    both = every.withColumn("_frame", F.lit(None).cast("int")).unionByName(set_)
    bytes_ = both.groupBy(key, "_byte").agg(F.bit_or("_mask").alias("_mask"), F.max("_count").alias("_count"), F.max("_frame").alias("_frame"))
    hexed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_byte", "_mask"))), lambda x: F.lpad(F.hex(x["_mask"]), 2, "0")), "")
    out = bytes_.groupBy(key).agg(F.unhex(hexed).alias("keyframe_bitmap"), F.max("_count").alias("_count"), F.max("_frame").alias("_last"))
    good = F.when(F.col("_last") >= F.col("_count"), F.raise_error(F.lit("a frame lies beyond the frame count"))).otherwise(F.col("keyframe_bitmap"))
    return out.where(F.col("_count").isNotNull()).select(key, good.alias("keyframe_bitmap"))


def from_flags(flags: DataFrame, sizes: DataFrame, key: str = "id_videofile", frame: str = "frame_number", flag: str = "is_key", count: str = "frame_count") -> DataFrame:
    """key and keyframe_bitmap from one flag a frame. A key whose flags aren't just as many as its frames is an error."""
    seen = flags.groupBy(key).agg(F.count("*").alias("_seen"), F.count_distinct(frame).alias("_frames"))
    met = build(flags.where(F.col(flag)).select(key, frame), sizes, key, frame, count).join(sizes.select(key, F.col(count).alias("_want")), key).join(seen, key, "left")
    whole = (F.coalesce("_seen", F.lit(0)) == F.col("_want")) & (F.coalesce("_frames", F.lit(0)) == F.col("_want"))
    return met.select(key, F.when(whole, F.col("keyframe_bitmap")).otherwise(F.raise_error(F.lit("flags and frames differ in number"))).alias("keyframe_bitmap"))
