"""SimHash near-duplicate search by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into two segments of 23 bits (A, B) and a tail of 18 bits. The (23, 12) Golay code is
perfect: every 23-bit word has one codeword within 3 bits. If two words differ in at most one bit, the codeword
nearest to the first is within 4 bits of the second; so the indices of *all* codewords within 4 bits (one index, or
six where the nearest is 3 bits away) make two words that differ in at most one bit share an index.

Pigeonhole for at most 3 differing bits: (a) tail equal: A or B differs in at most 1 bit -> keys (tail, index of A),
(tail, index of B); (b) tail differs: A and B differ in at most 2 bits together, so both in at most 1 -> keys
(index of A, index of B), or one of them not at all -> keys (A), (B). About 41 keys of 23 to 30 bits a fingerprint.

Buckets are joined on these keys and every link is verified by its Hamming distance. Rows with equal fingerprints
are merged first, so a group of near copies holds at most as many fingerprints as the Hamming ball around it; a
bucket returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, ship, stored, text_of, with_class

#: g(x) of the (23, 12) binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the low 12 bits, of the high 11 bits, error patterns of weight <= 4 by syndrome, how many)."""

    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
        return x

    low, high = remainder(np.arange(1 << 12)), remainder(np.arange(1 << 11) << 12)
    patterns: list[list[int]] = [[] for _ in range(2048)]
    one = 1 << np.arange(23)
    words = np.zeros(1, dtype=np.int64)
    for weight in range(5):
        if weight:
            words = np.unique((words[:, None] | one[None, :]).ravel())
            words = words[np.bitwise_count(words) == weight]
        for w, s in zip(words.tolist(), (low[words & 4095] ^ high[words >> 12]).tolist(), strict=True):
            patterns[s].append(w)
    count = np.array([len(p) for p in patterns])
    errors = np.zeros((2048, count.max()), dtype=np.int64)
    for s, p in enumerate(patterns):
        errors[s, : len(p)] = p
    return low, high, errors, count


def golay_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 23-bit words: (row, index) of every codeword within 4 bits; the index is the codeword's 12 message bits."""
    low, high, errors, count = golay_tables()
    s = low[x & 4095] ^ high[x >> 12]
    row = np.repeat(np.arange(len(x)), count[s])
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
    return row, (x[row] ^ errors[s[row], nth]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that two fingerprints within 3 bits share a key. The key's family stands in its top bits."""
    fp = fp.astype(np.uint64)
    a, b, tail = ((fp >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    (ra, ia), (rb, ib) = golay_indices(a), golay_indices(b)
    every = np.arange(len(fp))
    # all combinations of an index of A and an index of B of one fingerprint
    nb = np.bincount(rb, minlength=len(fp))
    first = np.cumsum(nb) - nb
    left = np.repeat(np.arange(len(ra)), nb[ra])
    right = first[ra[left]] + np.arange(len(left)) - np.repeat(np.cumsum(nb[ra]) - nb[ra], nb[ra])
    parts = [(ra, 1 << 40 | tail[ra] << 12 | ia), (rb, 2 << 40 | tail[rb] << 12 | ib), (ra[left], 3 << 40 | ia[left] << 12 | ib[right]), (every, 4 << 40 | a), (every, 5 << 40 | b)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included: A-Z lowered, words cut at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(whole, 42)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    ends = (starts + lengths - 1)[width - 1 :]
    return np.array([digest(whole[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=False)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of every whole text as a signed long. Null text counts as empty; no word gives 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([majority(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], ["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among these fingerprints: each one met is compared with those not met yet."""
    links, open_, queue = [], np.arange(len(fp)), []
    while len(open_):
        if not queue:
            queue.append(open_[0])
            open_ = open_[1:]
        i = queue.pop()
        near = np.bitwise_count(fp[open_] ^ fp[i]) <= distance
        for j in open_[near].tolist():
            links.append((int(i), j))
            queue.append(j)
        open_ = open_[~near]
    return links


#: Up to this size a bucket's links are found by shifted comparison of the whole partition; beyond, one bucket at a time.
SMALL_BUCKET = 16


def bucket_links(key: np.ndarray, fp: np.ndarray, distance: int) -> np.ndarray:
    """Links (pairs of fingerprints) found in the buckets of equal keys."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.concatenate([cut, [len(key)]]))
    own = np.repeat(size, size)
    found = []
    live = np.flatnonzero((own > 1) & (own <= SMALL_BUCKET))
    for d in range(1, SMALL_BUCKET):
        live = live[live + d < len(key)]
        live = live[key[live] == key[live + d]]
        if not len(live):
            break
        hit = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= distance]
        found.append(np.stack([fp[hit], fp[hit + d]], axis=1))
    for at, n in zip(cut[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist(), strict=True):
        own = np.unique(fp[at : at + n])
        if links := forest(own, distance):
            found.append(own[np.array(links)])
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), dtype=np.uint64)


def links(distinct: DataFrame, rows: int, distance: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp), enough of them to connect what is within ``distance`` bits."""
    if distance > 3:
        raise ValueError("the keys find pairs of at most 3 differing bits")

    def keys(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for at in range(0, len(fp), 20_000):
                row, key = fuzzy_keys(fp[at : at + 20_000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at : at + 20_000][row])], ["key", "fp"])

    def verify(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            pairs = bucket_links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].view(np.int64)) for i in (0, 1)] if len(pairs) else [pa.array([], pa.int64())] * 2, ["a", "b"])

    spark = distinct.sparkSession
    ship(spark)
    # partitions of about a million keys: 16 MB in a task whatever the input
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows * 42 // 1_000_000)
    return distinct.select("fp").mapInArrow(keys, "key long, fp long").repartition(n, "key").mapInArrow(verify, "a long, b long")


def near_groups(fps: DataFrame, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): transitive closure of links of at most ``distance`` bits.

    component_id is the smallest doc_id reachable, the row's own included. Rows whose doc_id is null link like
    others but never name a component (null only if no row of the component has an id). Repeated rows stay.
    """
    fps = stored(fps, "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("size")), "classes")
    rows, total = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    roots = components(links(classes, rows, distance).distinct())
    known = stored(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "size", F.coalesce("root", "fp").alias("root")), "roots")
    forget(roots, classes)
    least = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = known.join(least, "root").select("fp", "size", "component_id")
    # rows without an id are dealt by a seeded draw, the same whenever a task reads the stored rows again
    spread = F.coalesce(F.col("doc_id").cast("long"), (F.rand(7) * (1 << 40)).cast("long"))
    return with_class(fps, named, "fp", "size", total, spread).select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_groups(fingerprints(docs, 3), 3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
