"""Packing by optimal length buckets.

Texts are cut into pieces of at most MOST_WORDS words. Dynamic programming over the global histogram of piece lengths
chooses at most BUCKETS bucket lengths so that padding every piece to its bucket's length wastes as little as
possible. Inside each bucket, pieces fill batches of BUDGET words (padding included), each batch but a bucket's last.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of

MOST_WORDS = 4096
BUCKETS = 12
BUDGET = 65_536
#: Pieces that are ranked together at most, about.
GROUP = 20_000
SPACES = " \t\n\x0b\x0c\r"


def optimal_buckets(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths, ascending, that minimise sum(count * (bucket length - length)); the fewest of equal cost."""
    order = np.argsort(length)
    length, count = np.asarray(length, dtype=np.int64)[order], np.asarray(count, dtype=np.int64)[order]
    n = len(length)
    if not n:
        return []
    c, s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * length)])
    # one bucket over lengths i..j-1 costs length[j-1] * (c[j] - c[i]) - (s[j] - s[i])
    cost = np.concatenate([[0], length * c[1:] - s[1:]]).astype(np.float64)
    cost[0] = 0
    chosen = [np.zeros(n + 1, dtype=np.int64)]
    best_costs = [cost[n]]
    for _ in range(1, min(buckets, n)):
        fresh, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        fresh[0] = 0
        for j in range(1, n + 1):
            options = cost[:j] - length[j - 1] * c[:j] + s[:j]
            i = int(options.argmin())
            fresh[j], back[j] = options[i] + length[j - 1] * c[j] - s[j], i
        chosen.append(back)
        best_costs.append(fresh[n])
        cost = fresh
    k = int(np.argmin(best_costs))
    bounds, j = [], n
    while j > 0:
        bounds.append(int(length[j - 1]))
        j, k = int(chosen[k][j]), k - 1
    return bounds[::-1]


def count_words(text):
    """How many words a text has: runs of anything but ASCII white space. Each becomes one letter with the space after it, in one pass; no list of words is made."""
    return F.char_length(F.ltrim(F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x"), F.lit(SPACES)))


def pieces(docs: DataFrame, most_words: int) -> DataFrame:
    """doc_id, piece, first_word, n_words: every text cut into pieces; an empty or null text is one piece of 0 words."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count_words(text_of()).cast("long").alias("words"))
    last = F.greatest(F.lit(0), F.ceil(F.col("words") / most_words).cast("int") - 1)
    cut = sizes.select("doc_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    first = F.col("piece").cast("long") * most_words
    return cut.select("doc_id", "piece", first.alias("first_word"), F.least(F.lit(most_words).cast("long"), F.col("words") - first).alias("n_words"))


def pack(docs: DataFrame, most_words: int = MOST_WORDS, buckets: int = BUCKETS, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """doc_id, piece, first_word, n_words, bucket_words, batch, slot: a place for every piece of every row.

    batch counts from 0 in a bucket; slot from 0 in a batch of budget // bucket_words slots (1 at least). Repeated
    rows and null doc_ids get places of their own. Null texts count as empty, empty ones are a piece of no words, very long
    ones are cut into as many pieces as they need. An empty table gives no rows.
    """
    cut = stored(pieces(docs, most_words), "pieces")
    histogram = cut.groupBy("n_words").count().toPandas()  # most_words + 1 rows at most
    bounds = optimal_buckets(histogram["n_words"].to_numpy(), histogram["count"].to_numpy(), buckets)
    groups = max(1, int(histogram["count"].sum()) // group)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("n_words") <= b, F.lit(b).cast("long")).otherwise(bucket)
    # a rank in a bucket without gathering it: rank in a hash group, plus the sizes of the groups before
    placed = cut.withColumn("bucket_words", bucket).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    sizes = placed.groupBy("bucket_words", "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("bucket_words").orderBy("part")) - F.col("size")).drop("size")
    nth = F.row_number().over(Window.partitionBy("bucket_words", "part").orderBy("doc_id", "piece", "n_words")) - 1
    ranked = placed.withColumn("nth", nth).join(before, ["bucket_words", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.lit(1).cast("long"), F.col("bucket_words"))).cast("long"))
    return ranked.select("doc_id", "piece", "first_word", "n_words", "bucket_words", F.floor(F.col("rank") / room).cast("long").alias("batch"), F.pmod(F.col("rank"), room).alias("slot"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """A bucket, batch and slot for every piece of every row of documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
