"""The corpus pipeline: toxic texts go, then exact copies, then near copies; personal data is masked; the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All stages but the last return the columns of
docs. What a stage returns is written as Parquet and read again for the next one.

In every stage null texts count as empty and stay null, texts are read whole whatever their length, columns beside the
known ones travel with their rows whatever their names and types, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framewright.llm.common import stored
from framewright.llm.grace import without_copies
from framewright.llm.neardup import without_near_copies
from framewright.llm.packing import pack
from framewright.llm.pii import without_personal_data
from framewright.llm.toxicity import learn, without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the severity model, learned from the labels table, doesn't reject. Repeated rows all stay or all go."""
    return without_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each distinct text, that with the largest doc_id; of rows that tie, one."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share at least 0.8 of their five-word shingles, that with the smallest doc_id. Texts without words all stay."""
    return without_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data masked in their texts; repeated rows are masked alike."""
    return without_personal_data(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for every piece of every text; repeated rows get places of their own."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack_documents),
]

#: SQL expresses neither the models nor the near copies; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
