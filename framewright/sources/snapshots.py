"""Tables as snapshots in folders: parameterised scans, atomic publication, replacement of partitions, digests of files.

Nothing is changed in place. A snapshot is a folder of versions and a small file that names the current one. A new
version is written beside the old one and becomes visible when that file is replaced, so readers see one or the other, after
a crash at any moment too. Paths may be in any store that Spark reaches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file of a snapshot that names its current version, then the one before.
CURRENT = "_current"
STATE = "_state"
#: The file that names the versions of tables that are published together: the current set, then the one before.
MANIFEST = "_manifest"


def scan(spark: SparkSession, sql: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """A parameterised statement over named tables: parameters by :name, tables by {name}."""
    return spark.sql(sql, args=args, **tables)


def only(df: DataFrame):
    """The row of df, None without any; several are an error. Reads two rows at most."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("several rows where one was asked for")
    return rows[0] if rows else None


def as_floats(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("array<float>"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, p, _ = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()] if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename; a file at the target is replaced at once."""
    _, p, jvm = _fs(spark, source)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if p.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    context.rename(p, jvm.org.apache.hadoop.fs.Path(target), how)


def note(spark: SparkSession, path: str, text: str) -> None:
    """Make text the content of a small file, at once: readers see the old content or the new one."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    fs, p, _ = _fs(spark, temporary)
    out = fs.create(p)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    move(spark, temporary, path)


def noted(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, null without one."""
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(df: DataFrame, path: str, text_column: str | None = None) -> None:
    """Write df as the snapshot at path, complete or not at all: parquet, or the lines of one column.

    The version that was current stays until the next one is published, for readers who have begun with it; the one
    before it goes.
    """
    spark = df.sparkSession
    names = (noted(spark, f"{path}/{CURRENT}") or "").split()
    fresh = f"version-{uuid.uuid4().hex}"
    if text_column is None:
        df.write.parquet(f"{path}/{fresh}")
    else:
        df.select(text_column).write.text(f"{path}/{fresh}")
    note(spark, f"{path}/{CURRENT}", " ".join([fresh, *names[:1]]))
    for old in names[1:]:
        delete(spark, f"{path}/{old}")


def current(spark: SparkSession, path: str) -> str:
    """The folder of the snapshot's current version."""
    names = (noted(spark, f"{path}/{CURRENT}") or "").split()
    if not names:
        raise FileNotFoundError(f"no snapshot at {path}")
    return f"{path}/{names[0]}"


def publish_together(tables: dict[str, DataFrame], path: str) -> None:
    """Write several tables as one set: readers see all of them new or all of them old.

    Each table that is given gets a fresh version beside its old ones; then one manifest that names the versions of all is
    replaced at once. Tables that aren't given keep the version they have. A crash before that leaves the old set, and
    files that the next publication removes; the set before the current one stays for readers who have begun with it.
    """
    spark = next(iter(tables.values())).sparkSession
    known = json.loads(noted(spark, f"{path}/{MANIFEST}") or "[]")
    fresh = {name: f"{name}/version-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{fresh[name]}")
    sets = [{**(known[0] if known else {}), **fresh}, *known[:1]]
    note(spark, f"{path}/{MANIFEST}", json.dumps(sets))
    held = {version for one in sets for version in one.values()}
    for name in sets[0]:
        for version in folders(spark, f"{path}/{name}"):
            if version.startswith("version-") and f"{name}/{version}" not in held:
                delete(spark, f"{path}/{name}/{version}")


def together(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the current set, of versions that were published together."""
    known = json.loads(noted(spark, f"{path}/{MANIFEST}") or "[]")
    if not known:
        raise FileNotFoundError(f"no set of tables at {path}")
    return {name: spark.read.parquet(f"{path}/{version}") for name, version in known[0].items()}


def fan_out(frames: DataFrame, sinks: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], None]]], path: str, key: list[str]) -> dict[str, int]:
    """Give every frame to every sink: rows that each wrote. A sink is (what it makes of frames, how it is written).

    Frames are read once, into a table at ``path`` from which the sinks read. What a sink makes keeps the columns of
    ``key`` and at least one row a frame; the frames it wrote are held against those read, by their count and the sum of
    their hashes, as Spark observes them while they are written. A sink that skips a frame, or makes one up, fails the run.
    """
    from pyspark.sql import Observation

    spark = frames.sparkSession
    frames.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(frames.schema).parquet(path)
    mark = F.xxhash64(*[F.col(f"`{k}`") for k in key]).cast("decimal(38,0)")
    want = tuple(stored.agg(F.count("*"), F.coalesce(F.sum(mark), F.lit(0).cast("decimal(38,0)"))).first())
    out = {}
    for name, (make, write) in sinks.items():
        seen = Observation(f"frames of {name}")
        made = make(stored)
        first = F.col("_first") if "_first" in made.columns else F.lit(True)  # of several rows of a frame, one is marked
        told = made.observe(seen, F.count_if(first).alias("frames"), F.coalesce(F.sum(F.when(first, mark)), F.lit(0).cast("decimal(38,0)")).alias("marks"), F.count(F.lit(1)).alias("rows"))
        write(told.drop("_first"))
        got = seen.get
        if (got["frames"], got["marks"]) != want:
            raise RuntimeError(f"sink {name} saw {got['frames']} of {want[0]} frames" if got["frames"] != want[0] else f"sink {name} saw other frames than were read")
        out[name] = got["rows"]
    return out


def append(df: DataFrame, path: str) -> None:
    """Add rows to an append-only log."""
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write df into a table partitioned by a column: partitions that df has rows of are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, mtime, digest (SHA-256) of files, each below 2 GiB, in any store that Spark reaches; see blocks for larger ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("digest"))


def observed(df: DataFrame, changed, name: str = "update"):
    """(df, observation): the observation holds ``affected`` once df has been written."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return df.observe(watch, F.count_if(changed).alias("affected")), watch


class Artifacts:
    """Two-phase publication: begin (WRITING), write, then ready or failed. The state is kept in a file beside the versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, kind: str, key: str, text_column: str | None = None) -> dict:
        """Write df under kind and key; the row that says how it went. While it is written, ``state`` says WRITING to others.

        What stood there before is replaced at the end, and stays if the write fails.
        """
        final = f"{self.root}/{kind}/{key}"
        row = {"kind": kind, "object_key": key}
        note(self.spark, f"{final}/{STATE}", "WRITING")
        try:
            publish(df, final, text_column)
        except Exception as e:
            note(self.spark, f"{final}/{STATE}", "FAILED")
            return row | {"state": "FAILED", "error_text": str(e)[:500]}
        note(self.spark, f"{final}/{STATE}", "READY")
        return row | {"state": "READY"}

    def state(self, kind: str, key: str) -> str | None:
        """WRITING, READY or FAILED as last stored; null if nothing was ever written."""
        return noted(self.spark, f"{self.root}/{kind}/{key}/{STATE}")

    def read(self, kind: str, key: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, key))

    def path(self, kind: str, key: str) -> str:
        return current(self.spark, f"{self.root}/{kind}/{key}")

    def exists(self, kind: str, key: str) -> bool:
        return exists(self.spark, f"{self.root}/{kind}/{key}/{CURRENT}")

    def delete(self, kind: str, key: str) -> bool:
        return delete(self.spark, f"{self.root}/{kind}/{key}")
