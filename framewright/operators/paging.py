"""Ordered lists in pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 2000


def page(df: DataFrame, order: Sequence[str | Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of a total order. limit is held within 1 .. MOST; both offset and limit count."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(MOST, max(1, limit)))


def page_after(df: DataFrame, key: str, least, limit: int = 100) -> DataFrame:
    """The first rows with key >= least: pages whose cost doesn't grow with their number."""
    return df.where(F.col(key) >= least).orderBy(key).limit(min(MOST, max(1, limit)))


def pages(n: Column, size: int) -> Column:
    """How many pages n rows fill."""
    return F.ceil(n / size).cast("long")


def page_ranges(counts: DataFrame, count: str, size: int) -> DataFrame:
    """counts with a row for each page: page, from_row, to_row (inclusive)."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), pages(F.col(count), size) - 1))
    return counts.where(F.col(count) > 0).withColumn("page", each).withColumn("from_row", F.col("page") * size).withColumn("to_row", F.least(F.col("from_row") + size, F.col(count)) - 1)


def service_first(persons: DataFrame) -> DataFrame:
    """Persons with the service rows first, then by name in binary order."""
    return persons.orderBy(F.col("kind") == "PERSON", "name")
