"""Vectors as arrays of numbers, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def is_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def unit(a: Column) -> Column:
    """Length 1; zero vectors stay."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / n))


def mean_by(df: DataFrame, key: str, vector: str, name: str = "mean") -> DataFrame:
    """Mean vector and size of each key: sums by position are combined before the shuffle, a row for each key and position."""
    each = df.select(key, F.posexplode(vector).alias("_i", "_x"))
    means = each.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(name), F.max("_n").alias("size"))


def dimensions(df: DataFrame, vector: str) -> DataFrame:
    """One row: how many different sizes the vectors have, and whether they all have one."""
    return df.agg(F.count_distinct(F.size(vector)).alias("sizes")).withColumn("uniform", F.col("sizes") <= 1)


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Luma of a pixel. The weights of BT.601."""
    return red * 0.299 + green * 0.587 + blue * 0.114
