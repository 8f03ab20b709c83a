"""Ordinals over a whole table: ranges of the order, ranks within them, and where each range begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is numbered by, and rows whose keys tell where they are cut.
RANGES = 64
SAMPLE = 4096


def numbered(df: DataFrame, order: list[str | Column], name: str, ranges: int = RANGES, sample: int = SAMPLE) -> DataFrame:
    """df with ``name``: the rank of each row, from 1, in the order of these columns (ascending, nulls first). Of rows that tie, any comes first.

    Cuts are keys of a fixed number of rows chosen by their hash, so they follow the table and are the same in every
    run. Cuts and sizes of ranges are one row each; rows are shuffled once, by range, and no task sees all of them. Rows of
    equal keys are spread over further ranges by a hash of the whole row; only rows that are equal in all columns may not be.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])  # maps have no hash
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], whole.alias("tie"))
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"))
    few = row.select("key", F.xxhash64("key").alias("hash")).orderBy("hash").limit(sample).agg(F.sort_array(F.collect_list("key")).alias("some"))
    step = F.ceil(F.size("some") / F.lit(ranges))
    cuts = few.select(F.filter("some", lambda _, i: i % F.greatest(step, F.lit(1)) == 0).alias("cuts"))
    placed = row.crossJoin(F.broadcast(cuts)).select("row", "key", F.size(F.filter("cuts", lambda c: c <= F.col("key"))).alias("range"))
    sizes = placed.groupBy("range").count().agg(F.collect_list(F.struct("range", "count")).alias("sizes"))
    before = lambda own: F.aggregate(F.filter("sizes", lambda s: s["range"] < own), F.lit(0).cast("long"), lambda n, s: n + s["count"])
    nth = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    out = placed.withColumn("nth", nth).crossJoin(F.broadcast(sizes))
    return out.select("row.*", (before(F.col("range")) + F.col("nth")).alias(name))
