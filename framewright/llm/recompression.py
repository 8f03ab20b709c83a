"""Removal of repeated passages by recompression.

Rounds rewrite word sequences. A round names each maximal run of one symbol, then each pair of neighbours whose left
one falls in the round's left half of all symbols and whose right one in its right half. Names are digests of what
they stand for, so every task of every round gives the same name to the same run or pair, and halves are a bit of a
symbol's digest. Equal passages therefore get equal symbols but at their edges; each symbol knows the stretch of
words (its reach) that made it what it is.

A window is W consecutive words. Its anchor is, of the symbols of the highest level whose reach lies within the
window, the longest one (of equals the one with the largest name); at level 0, single words, there always is one.
Equal windows have equal anchors, so a window can only be repeated if its anchor's name occurs twice in the corpus:
shared high-level symbols reveal where repeats may be. The windows found so are verified by 96-bit digests of their
words.

Texts are dealt to chunks once. A chunk asks by sending its distinct anchors (then digests) to buckets by value; a
bucket answers each chunk with one bit for each value, set if another chunk sent it too. A name or window that is
very frequent thus takes a few bytes a chunk, not a row for each place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

WINDOW = 35
ROUNDS = 4
#: Bytes of text in a chunk and of asked values in a bucket, about.
CHUNK_BYTES = 3 << 20
BUCKET_BYTES = 6 << 20

_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K2
    x = (x ^ (x >> np.uint64(27))) * _K3
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Digests of words; starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


class Chunk:
    """The words of a chunk's texts in one array, a separator after each text."""

    def __init__(self, table: pa.Table):
        rows = list(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True))
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))  # the same order each time
        self.ids = [r[0] for r in rows]
        self.texts = [r[1].encode("utf-8", "surrogatepass").split() for r in rows]
        self.sizes = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1
        n = int((self.sizes + 1).sum())
        self.word = np.zeros(n, dtype=np.uint64)
        self.separator = np.zeros(n, dtype=bool)
        for at, text in zip(self.first.tolist(), self.texts, strict=True):
            self.word[at : at + len(text)] = np.fromiter(map(_words.__getitem__, text), dtype=np.uint64, count=len(text))
            self.separator[at + len(text)] = True

    def windows(self, w: int) -> np.ndarray:
        """Where a window of w words starts, all in one text."""
        n = np.maximum(0, self.sizes - w + 1)
        return np.repeat(self.first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _level(symbol, size, low, high, separator):
    return {"symbol": symbol, "size": size, "low": low, "high": high, "separator": separator}


def run_step(x: dict, salt: int) -> dict:
    """Name maximal runs. What a symbol becomes depends on its neighbours' being others, so its reach takes them in."""
    s, sep = x["symbol"], x["separator"]
    n = len(s)
    head = np.ones(n, dtype=bool)
    head[1:] = (s[1:] != s[:-1]) | sep[1:] | sep[:-1]
    at = np.flatnonzero(head)
    end = np.concatenate([at[1:], [n]])
    times = end - at
    symbol = s[at]
    many = np.flatnonzero(times > 1)
    symbol[many] = mix(symbol[many] + np.uint64(salt) + times[many].astype(np.uint64) * _K1)
    before, after = np.maximum(at - 1, 0), np.minimum(end, n - 1)
    own = sep[at]
    low = np.where(own | (at == 0), x["low"][at], x["low"][before])
    high = np.where(own, x["high"][end - 1], x["high"][after])
    low[0] -= not own[0] and at[0] == 0  # nothing stands before the first text: as if a separator did
    size = np.add.reduceat(x["size"], at)
    return _level(symbol, size, low, high, own)


def pair_step(x: dict, salt: int) -> dict:
    """Name pairs of a left and a right symbol. A symbol that stays single depends on the neighbour it might have joined."""
    s, sep = x["symbol"], x["separator"]
    half = (mix(s ^ np.uint64(salt)) & np.uint64(1)).astype(bool)
    left, right = ~half & ~sep, half & ~sep
    joins = np.zeros(len(s), dtype=bool)
    joins[:-1] = left[:-1] & right[1:]
    taken = np.zeros(len(s), dtype=bool)
    taken[1:] = joins[:-1]
    at = np.flatnonzero(~taken)
    pair = joins[at]
    after, before = np.minimum(at + 1, len(s) - 1), np.maximum(at - 1, 0)
    symbol, joined = s[at], np.flatnonzero(pair)
    symbol[joined] = mix(symbol[joined] * _K1 + mix(s[after[joined]] + np.uint64(salt)))
    low = np.where(right[at] & (at > 0), x["low"][before], x["low"][at])
    low = np.where(right[at] & (at == 0), x["low"][at] - 1, low)
    high = np.where(pair | left[at], x["high"][after], x["high"][at])
    size = x["size"][at]
    size[joined] += x["size"][after[joined]]
    return _level(symbol, size, low, high, sep[at])


def levels(c: Chunk, rounds: int) -> list[dict]:
    place = np.arange(len(c.word), dtype=np.int32)
    out = [_level(c.word, np.ones(len(c.word), dtype=np.int32), place, place + 1, c.separator)]
    for r in range(rounds if len(place) else 0):
        out.append(pair_step(run_step(out[-1], 2 * r + 1), 2 * r + 2))
    return out


def distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def anchors(c: Chunk, start: np.ndarray, w: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(the anchor of each window, names that occur at least twice in this chunk). An anchor's value holds its level and length."""
    n = len(c.word)
    value = np.zeros(len(start), dtype=np.uint64)
    open_ = np.arange(len(start))
    twice = []
    for level, x in reversed(list(enumerate(levels(c, rounds)))):
        if not len(open_):
            break
        key = (np.minimum(x["size"], 63).astype(np.uint64) << np.uint64(58)) | (mix(x["symbol"] + np.uint64(level)) >> np.uint64(6))
        key = np.where(x["separator"], np.uint64(0), key)
        p = start[open_]
        # reaches are in order at both ends, so those within a window are neighbours: from the first that begins at
        # or after p to the last that ends at or before p + w, found by counting beginnings and ends by place
        i = np.cumsum(np.bincount(np.maximum(x["low"], -1) + 1, minlength=n + 2))[p]
        j = np.cumsum(np.bincount(x["high"], minlength=n + 1))[p + w]
        met = j > i
        own, i, j = open_[met], i[met], j[met]
        best, step, power = key, 1, 0
        span = np.log2(np.maximum(1, j - i)).astype(np.int64)
        while len(own) and power <= span.max():
            if power:
                best = np.maximum(best[: len(best) - step // 2], best[step // 2 :])
            here = span == power
            value[own[here]] = np.maximum(best[i[here]], best[j[here] - step])
            step, power = step * 2, power + 1
        open_ = open_[~met]
        if len(own):
            s = np.sort(key[~x["separator"]])
            twice.append(distinct(s[1:][s[1:] == s[:-1]]))
    return value, distinct(np.sort(np.concatenate(twice))) if twice else np.zeros(0, dtype=np.uint64)


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 20)
        one = lambda b: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(b), dtype=np.uint64)]), dtype=np.uint64)
        known = _powers[base] = one(base), one(pow(base, -1, 1 << 64))
    return known


def window_digests(c: Chunk, start: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each window's words: two polynomials in the words' digests."""
    out = []
    for base, shift in ((0xD6E8FEB86659FD93, 0), (0xA0761D6478BD642F, 32)):
        up, down = powers(base, len(c.word) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(c.word * up[: len(c.word)], dtype=np.uint64)])
        out.append(mix((total[start + w] - total[start]) * down[start]) >> np.uint64(shift))
    return out[0], out[1].astype(np.uint32)


def order_of(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order by (high, low). high nearly always tells values apart, so low is looked at only where it must be."""
    order = np.argsort(high)
    h, lo = high[order], low[order]
    if ((h[1:] == h[:-1]) & (lo[1:] != lo[:-1])).any():
        order = np.lexsort((low, high))
    return order


class Ask:
    """A chunk's distinct values in the order in which they are sent: by value, so by bucket, for buckets are ranges."""

    def __init__(self, high: np.ndarray, low: np.ndarray, buckets: int):
        """high, low: value of each place; high is spread evenly over 64 bits."""
        order = order_of(high, low)
        h, lo = high[order], low[order]
        b = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])
        at = np.flatnonzero(new)
        self.high, self.low, self.bucket = h[at], lo[at], b[at].astype(np.int64)
        self.times = np.diff(np.concatenate([at, [len(h)]]))
        self.of = np.empty(len(h), dtype=np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.cut = np.flatnonzero(np.concatenate([[True], self.bucket[1:] != self.bucket[:-1]])) if len(at) else np.zeros(0, dtype=np.int64)
        self.end = np.concatenate([self.cut[1:], [len(at)]]) if len(at) else self.cut

    def blobs(self, wide: bool):
        """(bucket, values as bytes): 8 bytes a value, 12 if wide."""
        for a, e in zip(self.cut.tolist(), self.end.tolist(), strict=True):
            yield int(self.bucket[a]), self.high[a:e].tobytes() + (self.low[a:e].tobytes() if wide else b"")

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """Which values another chunk has too."""
        out = np.zeros(len(self.high), dtype=bool)
        for a, e in zip(self.cut.tolist(), self.end.tolist(), strict=True):
            out[a:e] = np.unpackbits(np.frombuffer(answers[int(self.bucket[a])], dtype=np.uint8), count=e - a).astype(bool)
        return out


MESSAGE = "bucket long, chunk long, body binary"


def _message(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table({"bucket": pa.array(columns[0], pa.int64()), "chunk": pa.array(columns[1], pa.int64()), "body": pa.array(columns[2], pa.binary())})


def _answer(width: int):
    """Bucket side: for each chunk's values, which of them come from at least two chunks. Notes to oneself (bucket < 0) pass."""

    def run(table: pa.Table) -> pa.Table:
        bucket, chunk, body = (table.column(c).to_pylist() for c in ("bucket", "chunk", "body"))
        if bucket[0] < 0:
            return _message(list(zip(bucket, chunk, body, strict=True)))
        sizes = np.array([len(b) // width for b in body])
        high = np.concatenate([np.frombuffer(b, dtype=np.uint64, count=n) for b, n in zip(body, sizes, strict=True)])
        low = np.concatenate([np.frombuffer(b, dtype=np.uint32, offset=8 * n) for b, n in zip(body, sizes, strict=True)]) if width > 8 else np.zeros(len(high), dtype=np.uint32)
        order = order_of(high, low)
        h, lo = high[order], low[order]
        same = (h[1:] == h[:-1]) & (lo[1:] == lo[:-1])  # a chunk sends a value once
        shared = np.zeros(len(h), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        flag = np.empty(len(h), dtype=bool)
        flag[order] = shared
        ends = np.cumsum(sizes)
        return _message([(b, c, np.packbits(flag[e - n : e]).tobytes()) for b, c, n, e in zip(bucket, chunk, sizes.tolist(), ends.tolist(), strict=True)])

    return run


REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (words joined by a space; null unless keep_text) of every row.

    A word goes if a window that covers it has the words of a window that starts elsewhere, in any row or the same.
    Null text counts as empty. Repeated rows repeat each other's windows. Texts shorter than a window stay whole. A text is
    never cut, so the longest one must fit a task (some 60 bytes a word). An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(2 * parts, total // chunk_bytes + 1)
    ask_anchors, ask_windows = (max(parts, int(total * share) // bucket_bytes + 1) for share in (0.1, 0.6))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(max(parts, chunks // 2), "chunk")

    def asked(c: Chunk):
        start = c.windows(window)
        value, twice = anchors(c, start, window, rounds)
        return start, Ask(mix(value), np.zeros(len(value), dtype=np.uint32), ask_anchors), mix(twice)

    def first(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, ask, _ = asked(Chunk(table))
        return _message([(b, chunk, body) for b, body in ask.blobs(False)])

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _message([])
        chunk, c = table.column("chunk")[0].as_py(), Chunk(table)
        start, ask, twice = asked(c)
        heard = dict(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True))
        maybe = (ask.answered(heard) | member(ask.high, np.sort(twice)))[ask.of]
        again = Ask(*window_digests(c, start[maybe], window), ask_windows)
        return _message([(b, chunk, body) for b, body in again.blobs(True)] + [(-1 - chunk, chunk, np.packbits(maybe).tobytes())])

    def third(table: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(table)
        heard = dict(zip(answers.column("bucket").to_pylist(), answers.column("body").to_pylist(), strict=True))
        start = c.windows(window)
        cover = np.zeros(len(c.word) + 1, dtype=np.int64)
        if table.num_rows:
            note = heard[-1 - table.column("chunk")[0].as_py()]
            at = start[np.unpackbits(np.frombuffer(note, dtype=np.uint8), count=len(start)).astype(bool)]
            ask = Ask(*window_digests(c, at, window), ask_windows)
            repeated = at[(ask.answered(heard) | (ask.times > 1))[ask.of]]
            cover[repeated] += 1
            cover[repeated + window] -= 1
        gone = np.cumsum(cover) > 0
        out = []
        for doc_id, text, a in zip(c.ids, c.texts, c.first.tolist(), strict=True):
            own = gone[a : a + len(text)]
            n = int(own.sum())
            kept = b" ".join(text) if not n else b" ".join([text[i] for i in np.flatnonzero(~own).tolist()])
            out.append((doc_id, len(text), n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    by_chunk = lambda df: df.groupBy("chunk")
    # a task answers about a bucket or two, however many there are
    by_bucket = lambda df, buckets: df.repartition(max(parts, buckets), "bucket").groupBy("bucket")
    anchors_heard = by_bucket(by_chunk(base).applyInArrow(first, MESSAGE), ask_anchors).applyInArrow(_answer(8), MESSAGE)
    windows_heard = by_bucket(by_chunk(base).cogroup(by_chunk(anchors_heard)).applyInArrow(second, MESSAGE), ask_windows).applyInArrow(_answer(12), MESSAGE)
    return by_chunk(base).cogroup(by_chunk(windows_heard)).applyInArrow(third, REMOVED)


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).drop("kept")
