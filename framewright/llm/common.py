"""Helpers that the training-data operators share: shared storage, shipping, skew-safe lookups, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

__all__ = ["components", "forget", "new_path", "packed", "shared_dir", "ship", "stored", "text_of", "tidy", "unpacked", "with_class", "with_filter"]


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, whose executors are the driver, may do without: it gets a folder of our own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the tables that ``stored`` returned lie, while somebody holds them.
_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete stored tables. Only for those that no DataFrame still to be run reads."""
    for table in tables:
        if path := _places.pop(table, None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@cache
def _trim():
    """glibc's malloc_trim; where there is none, nothing to call."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def tidy(run):
    """A function for mapInArrow that gives what it has freed back to the system at the end of each task.

    Spark keeps its Python processes for later tasks, and what they hold, idle or not, counts beside the executor's JVM.
    """

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return tidied


def packed(df: DataFrame, without: str | None = None, **extra) -> DataFrame:
    """Each row of df in one struct column, ``row``, beside further columns: names of df can't clash with theirs."""
    columns = [F.col(f"`{c}`") for c in df.columns if c != without] or [F.lit(0).alias("nothing")]
    return df.select(F.struct(*columns).alias("row"), *[c.alias(name) for name, c in extra.items()])


def unpacked(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns of packed rows, some of them replaced."""
    return df.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in columns])


def text_of(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: Bits of a filter, whatever the input. Its table has a row for each 64 of them at most: 131 072 rows are broadcast.
FILTER_BITS = 1 << 23


def with_filter(df: DataFrame, value, ids: DataFrame, column: str, name: str) -> DataFrame:
    """df with a boolean column: false only where no row of ids has the value (a long) in ``column``.

    A hashed bitmap of a fixed size: as the input grows it errs more often on the side of true, never on that of false.
    It spares rows a shuffle that an exact join then needn't see.
    """
    place = lambda c: F.pmod(F.xxhash64(c, F.lit("filter")), F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    words = stored(ids.select(place(F.col(column)).alias("p")).groupBy(F.shiftright("p", 6).alias("filter_word")).agg(F.bit_or(bit).alias("filter_bits")), "filter")
    met = df.withColumn("filter_place", place(value)).join(F.broadcast(words), F.shiftright("filter_place", 6) == F.col("filter_word"), "left")
    held = F.call_function("shiftright", F.col("filter_bits"), (F.col("filter_place") % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) != 0
    return met.select(*df.columns, F.coalesce(held, F.lit(False)).alias(name))


#: A class counts as hot from this share of all rows, so there are at most 1/HOT_SHARE hot classes to broadcast.
HOT_SHARE = 0.001


def with_class(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int, spread) -> DataFrame:
    """Left join of rows with one row per class on ``key``, safe against classes that hold a large share of all rows.

    Classes of at least HOT_SHARE of the ``total`` rows are broadcast: there are at most 1/HOT_SHARE = 1000 of them,
    whatever the input. Their rows then take part in the shuffle join under a key of their own (``spread``, any
    evenly spread column), so no partition gathers a hot class. ``classes`` has unique keys and should be stored.
    """
    least = max(2, int(total * HOT_SHARE))
    values = [c for c in classes.columns if c != key]
    hot = classes.where(F.col(size) >= least).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = classes.where(F.col(size) < least).select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in values], F.lit(0).alias("_cs"))
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    # a hot row gets a salt of its own and finds no partner in the second join
    met = met.withColumn("_rs", F.when(F.col("_hk").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30)).cast("int")))
    out = met.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_rs") == F.col("_cs")), "left")
    return out.select(*rows.columns, *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in values])


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``edges``, stored; root is the smallest node of its connected component.

    Large-star / small-star rounds. Minima are combined before the shuffle. Each step is a stored table, so plans stay
    small, and edges meet their minima in plain joins of two scans, whose skewed partitions (hubs) Spark splits at runtime.
    A round's tables are deleted when its edges are written.
    """
    e = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "edges")
    sign = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    last = sign(e)
    for _ in range(most_rounds):
        if not last[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        up = e.select(F.col("b").alias("a"), F.col("a").alias("b"))  # the greater neighbours of each node
        large = stored(up.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before, e = e, stored(small.distinct(), "edges")
        forget(before, low, large, least)
        now = sign(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = stored(e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    forget(e)
    return out
