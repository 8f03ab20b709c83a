"""Consistent weighted sampling: document fingerprints whose collision rate is the generalised Jaccard similarity.

For every term x with weight w and every sample k, three fixed random numbers of (x, k) are drawn: r, c from
Gamma(2, 1) and b from Uniform(0, 1). With t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r, sample k is the pair
(x, t) of the term with the least a. Two weighted sets agree in a sample with probability
sum(min) / sum(max) of their weights. Terms are words, weights their counts.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

#: Samples of a fingerprint; the standard error of a likeness is at most 0.5 / sqrt(SAMPLES).
SAMPLES = 128
#: (term, weight) pairs whose draws a worker keeps; 8 * SAMPLES bytes each.
MEMO = 120_000


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gamma2_quantiles(bits: int) -> np.ndarray:
    """Gamma(2, 1) at the middles of 2 ** bits equal shares: solves 1 - (1 + x) exp(-x) = u by bisection."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = -np.expm1(-x) - x * np.exp(-x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


class _Places(dict):
    """Row numbers of keys, given out in turn; fresh: the keys without draws so far."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n


class Sampler:
    """Signatures of weighted term sets.

    One 64-bit hash of (term, sample) gives r (16 bits), c (18 bits) by the quantiles of their distribution, and b (30
    bits). A draw is kept as one integer, ln a above 16 bits of the mark of (term, t), so the least of a column is the
    sample whatever the order of terms.
    """

    def __init__(self, samples: int = SAMPLES, memo: int = MEMO):
        self.samples, self.room = samples, memo
        self.place = _Places()
        self.drawn = np.empty((memo, samples), dtype=np.int64)
        self.salt = _mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.r = gamma2_quantiles(16).astype(np.float32)
        self.ln_c = np.log(gamma2_quantiles(18)).astype(np.float32)

    def draws(self, keys: list) -> np.ndarray:
        """A key is a word (weight 1) or a pair of word and weight."""
        single = [i for i, k in enumerate(keys) if isinstance(k, str)]
        more = [i for i, k in enumerate(keys) if not isinstance(k, str)]
        out = np.empty((len(keys), self.samples), dtype=np.int64)
        if single:
            out[single] = self._draw([keys[i] for i in single], None)
        if more:
            out[more] = self._draw([keys[i][0] for i in more], np.array([keys[i][1] for i in more]))
        return out

    def _draw(self, words: list[str], weight: np.ndarray | None) -> np.ndarray:
        term = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
        h = (term[:, None] ^ self.salt) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        r = self.r.take((h >> np.uint64(48)).view(np.int64))
        value = self.ln_c.take((h >> np.uint64(30) & np.uint64((1 << 18) - 1)).view(np.int64))
        b = (h & np.uint64((1 << 30) - 1)).astype(np.float32)
        b *= np.float32(2**-30)
        own = _mix(term + np.uint64(7))[:, None]
        if weight is None:  # ln 1 = 0, so t = 0 in every sample
            b -= np.float32(1)
            mark = _mix(own)
        else:
            t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
            b -= t
            b -= np.float32(1)
            mark = _mix(own ^ t.astype(np.int64).view(np.uint64))
        b *= r
        value += b
        # a fixed-point number above the 16 bits of the mark
        out = (value * np.float32(1 << 40)).astype(np.int64)
        out &= ~np.int64(0xFFFF)
        out |= (mark & np.uint64(0xFFFF)).astype(np.int64)
        return out

    def signature(self, counts: dict[str, int]) -> np.ndarray | None:
        """16-bit marks of the samples; None for the empty set. Independent of the order of terms."""
        keys = [w if n == 1 else (w, n) for w, n in counts.items()]
        least = None
        for at in range(0, len(keys), 4096):
            part = keys[at : at + 4096]
            if len(self.place) + len(part) > self.room:
                self.place = _Places()
            rows = list(map(self.place.__getitem__, part))
            if fresh := self.place.fresh:
                n = len(self.place)
                self.drawn[n - len(fresh) : n] = self.draws(fresh)
                fresh.clear()
            own = self.drawn[rows].min(axis=0)
            least = own if least is None else np.minimum(least, own)
        return None if least is None else (least & 0xFFFF).astype(np.uint16)


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of samples that agree; two empty sets are alike, an empty and another one are not."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.mean(a == b))


def as_hex(s: np.ndarray | None) -> str:
    return "" if s is None else s.astype(">u2").tobytes().hex()


_sampler: Sampler | None = None


def sampler() -> Sampler:
    """One for each Python worker, with the draws it remembers."""
    global _sampler
    if _sampler is None:
        _sampler = Sampler()
    return _sampler


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _along(batches):
    """Rows of a partition in the order bucket, guest, doc_id, text: fingerprints of every row that isn't a guest.

    A bucket holds documents that follow one another, then one guest, the document that follows its last.
    """
    s = sampler()
    out: list[tuple] = []
    held = None  # (bucket, guest, doc_id, text, signature) of the row before

    def finish(row, following):
        """following: (text, signature) of the next document."""
        _, _, doc_id, text, sign = row
        k = len(text) // 4
        edited = text[: len(text) - k] + following[0][:k]
        other = s.signature(Counter(edited.split()))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(sign), as_hex(other), likeness(sign, other), likeness(sign, following[1])))

    def batch_out():
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    for batch in batches:
        for bucket, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            row = (bucket, guest, doc_id, text, s.signature(Counter(text.split())))
            if held is not None and held[0] == bucket and not held[1]:
                finish(held, (text, row[4]))
            held = row
        yield batch_out()


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and how alike they and the next document's are.

    The next document is the one with the next doc_id (after the last: the first); ties in doc_id go by text, and
    rows repeated whole follow one another. Null text counts as empty. A text without words has the empty
    fingerprint. Rows without doc_id come first. A lone row is its own next document.

    One shuffle of the texts: buckets of consecutive doc_ids with bounds that are doc_ids; the first document of each
    bucket also goes to the bucket before, so every row finds its next one in its own bucket.
    """
    spark = docs.sparkSession
    ship(spark)
    # the bucket bounds: doc_ids at equal shares of the rows; 4 buckets a partition even out what hashing deals unevenly
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first, shares = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 100_000)).first()
    bounds = sorted(set(shares or []) - {first})
    last = len(bounds)
    array = np.array(bounds, dtype=np.int64)
    start = first if docs.where(F.col("doc_id").isNull()).isEmpty() else None

    def deal(batches):
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            key = np.where(known, batch.column(0).fill_null(0).to_numpy(), -(1 << 63))
            bucket = np.searchsorted(array, key, side="right")
            opens = np.flatnonzero((bucket > 0) & np.isin(key, array))
            turn = np.flatnonzero(~known if start is None else key == start)  # may follow the last document
            rows = np.concatenate([np.arange(len(key)), opens, turn])
            where = np.concatenate([bucket, bucket[opens] - 1, np.full(len(turn), last)])
            guest = np.arange(len(rows)) >= len(key)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(guest), batch.column(0).take(take), batch.column(1).take(take)], ["bucket", "guest", "doc_id", "text"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(deal, "bucket int, guest boolean, doc_id long, text string")
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")
    return ordered.mapInArrow(_along, FINGERPRINTS)


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and likenesses."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
