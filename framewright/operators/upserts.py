"""Snapshots in, snapshots out: merges, keyed updates and deletes, change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import record_hash


def merge_flags(stored: DataFrame, new: DataFrame, key: Sequence[str] = ("id_videofile", "frame_number")) -> DataFrame:
    """Frame rows merged: flags or-ed, the larger face_count, the new size_hint unless it is null.

    One aggregation of both sides; rows of one side with the same key merge the same way, the hint of the largest value.
    """
    cols = ["is_scene_boundary", "is_shot_boundary", "face_count", "size_hint"]
    both = stored.select(*key, *cols, F.lit(0).alias("_new")).unionByName(new.select(*key, *cols, F.lit(1).alias("_new")))
    hint = F.max(F.when(F.col("size_hint").isNotNull(), F.struct("_new", "size_hint")))["size_hint"]
    return both.groupBy(*key).agg(F.bool_or(F.coalesce("is_scene_boundary", F.lit(False))).alias("is_scene_boundary"), F.bool_or(F.coalesce("is_shot_boundary", F.lit(False))).alias("is_shot_boundary"), F.coalesce(F.max("face_count"), F.lit(0)).alias("face_count"), hint.alias("size_hint"))


def mark_flag(stored: DataFrame, frames: DataFrame, flag: str) -> DataFrame:
    """stored with one flag set on the frames listed; frames not stored yet become rows with that flag alone."""
    if flag not in ("is_scene_boundary", "is_shot_boundary"):
        raise ValueError(f"no such flag: {flag}")
    new = frames.select("id_videofile", "frame_number", *[F.lit(flag == f).alias(f) for f in ("is_scene_boundary", "is_shot_boundary")], F.lit(0).alias("face_count"), F.lit(None).cast("string").alias("size_hint"))
    return merge_flags(stored, new)


def put(stored: DataFrame, new: DataFrame, key: Sequence[str], value: str = "property_value", ordinal: str = "ordinal") -> DataFrame:
    """Last writer wins on the value; a row stored keeps its ordinal, a new one goes after the owner's last.

    new: key columns and value. The owner is the key without its last column.
    """
    owner = list(key)[:-1]
    last = stored.groupBy(*owner).agg((F.max(ordinal) + 1).alias("_next"))
    a = stored.select(*key, F.col(value).alias("_old"), F.col(ordinal).alias("_ordinal"))
    b = new.select(*key, F.col(value).alias("_new"), F.lit(True).alias("_given"))
    met = a.join(b, list(key), "full_outer").join(last, owner, "left")
    place = F.row_number().over(Window.partitionBy(*owner, F.col("_ordinal").isNull()).orderBy(list(key)[-1])) - 1
    return met.select(*key, F.when(F.col("_given"), F.col("_new")).otherwise(F.col("_old")).alias(value), F.coalesce("_ordinal", F.coalesce("_next", F.lit(0)) + place).cast("int").alias(ordinal))


def replace_auto(stored: DataFrame, new: DataFrame, group: Sequence[str] = ("id_videofile", "frame_number")) -> DataFrame:
    """stored without the AUTO rows of the groups that new has rows of, and with new. OPERATOR rows stay."""
    touched = new.select(*group).distinct().withColumn("_touched", F.lit(True))
    kept = stored.join(touched, list(group), "left").where("origin <> 'AUTO' OR _touched IS NULL").drop("_touched")
    return kept.unionByName(new.select(*stored.columns))


def replace_groups(stored: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """stored with all rows of new's groups replaced."""
    return stored.join(new.select(*group).distinct(), list(group), "left_anti").unionByName(new.select(*stored.columns))


def insert_absent(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """stored with those rows of new whose key it lacks."""
    return stored.unionByName(new.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti").select(*stored.columns))


def update(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """stored with the other columns of new where keys meet; nulls in new leave what is stored. Keys of new are unique."""
    values = [c for c in new.columns if c not in key]
    met = stored.join(new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values]), list(key), "left")
    return met.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in stored.columns])


def delete(stored: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return stored.join(keys.select(*key), list(key), "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """new's rows, and stored ones whose key new lacks."""
    return new.select(*stored.columns).unionByName(stored.join(new.select(*key), list(key), "left_anti"))


def changes(stored: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key, change of every row in new: INSERT, UPDATE or UNCHANGED, by record hashes. A row is absent if its key is."""
    a = stored.select(*key, record_hash(stored, *columns).alias("_a"), F.lit(True).alias("_there"))
    b = new.select(*key, record_hash(new, *columns).alias("_b"))
    met = b.join(a, list(key), "left")
    return met.select(*key, F.when(F.col("_there").isNull(), "INSERT").when(F.col("_a") == F.col("_b"), "UNCHANGED").otherwise("UPDATE").alias("change"))


def first_of(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by order: repeats after it go."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_nth = 1").drop("_nth")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows of a not in b, rows of b not in a, rows in both; rows count by how often they occur."""
    each = a.withColumn("_w", F.lit(1)).unionByName(b.withColumn("_w", F.lit(-1)))
    n = each.groupBy(*a.columns).agg(F.count_if(F.col("_w") == 1).alias("_a"), F.count_if(F.col("_w") == -1).alias("_b"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return n.agg(zero(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("only_a"), zero(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("only_b"), zero(F.least("_a", "_b")).alias("both"))
