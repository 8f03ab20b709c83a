"""Exact deduplication by Grace hashing.

Records are dealt to buckets by a hash of their content. A task fills an open-addressing table that compares
complete contents; copies are first combined inside each scan task, so a content shared by a third of all rows sends
one record a table, not one a row. A bucket whose distinct contents outgrow the table's byte limit keeps what it
holds and passes every record of other contents on to spill files (a table in the shared folder); these are dealt
again by the next level's hash, into as many buckets as their bytes need, and so on until no bucket spills. Every bucket
takes at least one content, so each level leaves fewer.
"""

from __future__ import annotations

import hashlib
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, ship, stored, text_of, unpacked, with_class, with_filter

#: Bytes of distinct content that one table may hold, and what an entry takes besides.
TABLE_BYTES = 96 << 20
ENTRY_BYTES = 150
#: Of the tables that combine copies in the scan tasks.
COMBINE_BYTES = 24 << 20


class ContentTable:
    """Open addressing with linear probing; keys are whole contents, values (largest id, number of rows)."""

    def __init__(self, limit: int):
        self.limit, self.used, self.full, self.slots, self.mask = limit, 0, False, [-1] * 1024, 1023
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[int | None] = []
        self.rows: list[int] = []

    def add(self, content: bytes, h: int, best: int | None, rows: int) -> bool:
        """False if the content is new and the table is full; the table never takes that content later."""
        at = h & self.mask
        while (i := self.slots[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                if best is not None and (self.best[i] is None or best > self.best[i]):
                    self.best[i] = best
                self.rows[i] += rows
                return True
            at = (at + 1) & self.mask
        if self.full or self.contents and self.used + len(content) + ENTRY_BYTES > self.limit:
            self.full = True  # from now on, for small contents too
            return False
        self.slots[at] = len(self.contents)
        self.used += len(content) + ENTRY_BYTES
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append(best)
        self.rows.append(rows)
        if len(self.contents) * 2 > len(self.slots):
            self.mask = len(self.slots) * 2 - 1
            self.slots = [-1] * (self.mask + 1)
            for i, x in enumerate(self.hashes):
                at = x & self.mask
                while self.slots[at] >= 0:
                    at = (at + 1) & self.mask
                self.slots[at] = i
        return True


RECORD = "h long, content binary, best long, n_rows long"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _combine(limit: int):
    """Scan side: one record for each distinct content of a table; a full table is sent on and a new one begun."""
    schema = pa.schema([("h", pa.int64()), ("content", pa.binary()), ("best", pa.int64()), ("n_rows", pa.int64())])

    def out(table: ContentTable):
        for at in range(0, len(table.contents), 2000):
            s = slice(at, at + 2000)
            yield pa.RecordBatch.from_arrays([pa.array([_signed(h) for h in table.hashes[s]], pa.int64()), pa.array(table.contents[s], pa.binary()), pa.array(table.best[s], pa.int64()), pa.array(table.rows[s], pa.int64())], schema=schema)

    def run(batches):
        table = ContentTable(limit)
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = xxhash.xxh3_64_intdigest(content)
                if not table.add(content, h, doc_id, 1):
                    yield from out(table)
                    table = ContentTable(limit)
                    table.add(content, h, doc_id, 1)
        yield from out(table)

    return run


def _bucket(limit: int):
    """Bucket side: a row for each content the table took (content null), and the records that must be spilled."""
    names = ["digest", "keep_id", "group_size", "h", "content", "best", "n_rows"]

    def batch_of(digest, keep, size, h, content, best, rows):
        return pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(keep, pa.int64()), pa.array(size, pa.int64()), pa.array(h, pa.int64()), pa.array(content, pa.binary()), pa.array(best, pa.int64()), pa.array(rows, pa.int64())], names)

    def run(batches):
        table = ContentTable(limit)
        for batch in batches:
            spilled = []
            for h, content, best, rows in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not table.add(content, h & ((1 << 64) - 1), best, rows):
                    spilled.append((h, content, best, rows))
            if spilled:
                none = [None] * len(spilled)
                yield batch_of(none, none, none, *zip(*spilled, strict=True))
        for at in range(0, len(table.contents), 5000):
            s = slice(at, at + 5000)
            none = [None] * len(table.contents[s])
            yield batch_of([hashlib.sha256(c).digest() for c in table.contents[s]], table.best[s], table.rows[s], none, none, none, none)

    return run


def content_classes(docs: DataFrame, table_bytes: int = TABLE_BYTES, combine_bytes: int = COMBINE_BYTES) -> DataFrame:
    """(digest, keep_id, group_size): one row for each distinct text; keep_id is the largest doc_id among its rows."""
    spark = docs.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("content")).mapInArrow(_combine(combine_bytes), RECORD)
    found = None
    for level in count():
        dealt = records.repartition(n, F.xxhash64("h", F.lit(level)))
        done = stored(dealt.mapInArrow(_bucket(table_bytes), "digest binary, keep_id long, group_size long, " + RECORD), f"grace-{level}")
        kept = done.where(F.col("digest").isNotNull()).select("digest", "keep_id", "group_size")
        found = kept if found is None else found.union(kept)
        records = done.where(F.col("digest").isNull()).select("h", "content", "best", "n_rows")
        spilled = records.agg(F.sum(F.octet_length("content") + ENTRY_BYTES)).first()[0]
        if not spilled:
            break
        n = max(n, 2 * spilled // table_bytes + 1)
    if not found.groupBy("digest").count().where("count > 1").isEmpty():
        raise RuntimeError("two different texts share a SHA-256 digest")
    return found


def exact_groups(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row for each row of docs.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id of equal texts stays. A null
    doc_id counts as the smallest. Of rows repeated with both doc_id and text equal, one is marked kept.
    """
    classes = content_classes(docs, **limits)
    total = classes.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest")).groupBy("doc_id", "digest").agg(F.count("*").alias("times"))
    out = with_class(rows, classes, "digest", "group_size", total, F.col("doc_id"))
    each = out.withColumn("nth", F.explode(F.expr("sequence(1L, times)")))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "digest")


def _hashable(field):
    """A column that xxhash64 takes: maps, and what holds maps, as JSON."""
    column = F.col(f"`{field.name}`")
    return F.to_json(F.struct(column)) if "map<" in field.dataType.simpleString() else column


def without_copies(docs: DataFrame, **limits: int) -> DataFrame:
    """docs with one row of each distinct text, that with the largest doc_id, columns unchanged. Rows repeated whole stay once.

    Null text counts as empty and stays null. Of rows that share doc_id and text and differ elsewhere one stays, chosen by a
    hash of the other columns. An empty table gives an empty table; texts may have any length up to Spark's for a string.
    Rows whose text surely has no copy stay where they are; only the others are shuffled to meet the row that stays.
    """
    classes = content_classes(docs, **limits)
    several = classes.where("group_size > 1").select(F.xxhash64("digest").alias("h"))
    others = [_hashable(f) for f in docs.schema.fields if f.name != "text"]
    marked = packed(docs, id=F.col("doc_id").cast("long"), digest=F.unhex(F.sha2(text_of().cast("binary"), 256)), tie=F.xxhash64(*others))
    marked = with_filter(marked, F.xxhash64("digest"), several, "h", "copied")
    stay = classes.select(F.col("keep_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    met = marked.where("copied").join(stay, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    nth = F.row_number().over(Window.partitionBy("kept_digest", "kept_id").orderBy("tie"))
    first = met.withColumn("nth", nth).where("nth = 1")
    return unpacked(marked.where("NOT copied").select("row").union(first.select("row")), docs.columns)


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents, dropped ones too."""
    out = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
