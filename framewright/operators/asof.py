"""Nearest marks before and after points, without a range join.

Points and marks meet in one shuffle on their key; two sorts in opposite directions carry the last mark seen along.
Work is n log n in a key's rows, where a join on the key alone would compare every point with every mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _met(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, carry: list[str]) -> DataFrame:
    payload = F.struct(F.col(mark).alias("_at"), *carry)
    here = points.select(*by, F.col(at).alias("_pos"), F.lit(1).alias("_side"), F.struct(*[c for c in points.columns if c not in by]).alias("_row"), F.lit(None).alias("_mark"))
    there = marks.where(F.col(mark).isNotNull()).select(*by, F.col(mark).alias("_pos"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), payload.alias("_mark"))
    return here.unionByName(there)


def _unpack(met: DataFrame, points: DataFrame, by: list[str], *extra) -> DataFrame:
    columns = [F.col(c) if c in by else F.col(f"_row.{c}").alias(c) for c in points.columns]
    return met.where("_side = 1").select(*columns, *extra)


def with_last_before(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, carry: list[str], name: str = "found") -> DataFrame:
    """points with struct ``name``: the mark at or before ``at`` (its place as _at, and ``carry``); null if there is none.

    Of several marks at one place the one with the largest carried values counts. Marks without a place are left out.
    """
    w = Window.partitionBy(*by).orderBy("_pos", "_side", "_mark").rowsBetween(Window.unboundedPreceding, 0)
    met = _met(points, marks, by, at, mark, carry).withColumn("_found", F.last("_mark", ignorenulls=True).over(w))
    return _unpack(met, points, by, F.col("_found").alias(name))


def with_neighbours(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, before: str = "before", after: str = "after") -> DataFrame:
    """points with the places of the nearest marks at or before, and at or after, ``at``."""
    back = Window.partitionBy(*by).orderBy("_pos", "_side").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_pos"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = _met(points, marks, by, at, mark, [])
    met = met.withColumn("_b", F.last("_mark", ignorenulls=True).over(back)).withColumn("_a", F.last("_mark", ignorenulls=True).over(ahead))
    return _unpack(met, points, by, F.col("_b._at").alias(before), F.col("_a._at").alias(after))
