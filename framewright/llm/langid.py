"""Language identification by n-gram filters that answer with a bitmask of languages.

Every slot of a bit-sliced Bloom filter holds one bit a language. An n-gram sets its languages' bits in HASHES slots;
the conjunction of these slots names all languages that contain the n-gram (and a few by accident: as many as the
language's fill to the power HASHES). A text's n-grams are counted by language, the counts are corrected for those
accidents, and the largest decides.

An n-gram belongs to a language if its rate there is at least LEAST_RATE and at least SHARE of its highest rate in any
language. Rates of one language and length sum to 1, so a language holds at most 1 / LEAST_RATE n-grams of a length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored, text_of

LENGTHS = (1, 2, 3, 4)
HASHES = 2
SLOT_BITS = 21
LEAST_RATE = 2e-5
SHARE = 0.3
#: Of each language's rows that may be learned from, about so many at most are (chosen by a hash of doc_id and text, so rows without an id are bounded as well).
ROWS_A_LANGUAGE = 2500
#: More languages than this are an error: each is a row that the driver sees, a bit of every n-gram's mask, and a share of the sample.
MOST_LANGUAGES = 1024

_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_STEP = np.uint64(0x2545F4914F6CDD1D)
_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether a code point is a letter; one for each worker."""
    global _letter
    if _letter is None:
        _letter = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letter


def grams(text: np.ndarray, letter: np.ndarray, n: int, h: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which are valid) of the n-grams starting at each position; h: those of n - 1. At most one place is no letter."""
    h = text.astype(np.uint64) + np.uint64(n) if h is None else h[: len(text) - n + 1] * _STEP + text[n - 1 :]
    m = len(text) - n + 1
    count = letter[:m].astype(np.int8)
    for i in range(1, n):
        count += letter[i : m + i]
    return h, count >= max(1, n - 1)


def prepare(texts: list[str]):
    """Blocks of whole texts: (first, number of texts, code points with 0 for what is no letter, which are letters, text of each)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < 1 << 18):
            size += len(texts[end]) + 2
            end += 1
        # breaks around each text: no n-gram with one place that is no letter reaches from a text into another
        joined = "".join(f"\n{t.lower()}\n\n\n" for t in texts[at:end])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = letters()[points]
        sizes = np.array([len(t.lower()) + 4 for t in texts[at:end]])
        yield at, end - at, np.where(letter, points, 0).astype(np.uint64), letter, np.repeat(np.arange(end - at), sizes)
        at = end


def slots(h: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - SLOT_BITS)
    return [((h ^ (h >> np.uint64(29))) * f) >> shift for f in _FACTORS[:HASHES]]


class LanguageFilter:
    """The bit-sliced filter and its languages. Languages beyond the eighth go to further bytes of a slot."""

    def __init__(self, languages: list[str], gram: np.ndarray, language: np.ndarray):
        self.languages = languages
        self.planes = [np.zeros(1 << SLOT_BITS, dtype=np.uint8) for _ in range((len(languages) + 7) // 8)]
        for p, plane in enumerate(self.planes):
            own = language // 8 == p
            for s in slots(gram[own]):
                np.bitwise_or.at(plane, s.astype(np.int64), (1 << (language[own] % 8)).astype(np.uint8))
        self.accident = np.array([np.mean(self.planes[i // 8] >> (i % 8) & 1) ** HASHES for i in range(len(languages))])

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams by text, n-grams by text and language, corrected)."""
        n, k = len(texts), len(self.languages)
        total, by = np.zeros(n), np.zeros((n, k))
        bit = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.float64)
        for first, m, points, letter, owner in prepare(texts):
            h = None
            for length in range(1, max(LENGTHS) + 1):
                if len(points) < length:
                    break
                h, valid = grams(points, letter, length, h)
                if length not in LENGTHS:
                    continue
                at = np.flatnonzero(valid)
                own, places = owner[at], slots(h[at])
                total[first : first + m] += np.bincount(own, minlength=m)
                for p, plane in enumerate(self.planes):
                    mask = plane[places[0]]
                    for s in places[1:]:
                        mask &= plane[s]
                    histogram = np.bincount(own * 256 + mask, minlength=m * 256).reshape(m, 256)
                    width = min(8, k - 8 * p)
                    by[first : first + m, 8 * p : 8 * p + width] += (histogram @ bit)[:, :width]
        return total, np.maximum(0, by - total[:, None] * self.accident) / (1 - self.accident)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text: und and 0 without a letter; the first in alphabetical order among equals."""
        total, by = self.counts(texts)
        best = by.argmax(axis=1) if by.size else np.zeros(len(texts), dtype=np.int64)
        sums = by.sum(axis=1)
        score = np.divide(by.max(axis=1, initial=0), sums, out=np.zeros(len(texts)), where=sums > 0)
        has = [any(map(str.isalpha, t)) for t in texts]
        return [self.languages[b] if ok and self.languages else "und" for b, ok in zip(best.tolist(), has, strict=True)], np.where(has, np.clip(score, 0, 1), 0.0)


def fit(docs: DataFrame) -> LanguageFilter:
    """Learn from docs with text and lang: a hash sample of about ROWS_A_LANGUAGE whole texts of each language, MOST_LANGUAGES at most."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}  # one row a language
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values: is it the language?")
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    place = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, ROWS_A_LANGUAGE / sizes[name])))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("language sample")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches):
        for batch in batches:
            language, texts = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            parts = []
            for first, m, points, letter, owner in prepare(texts):
                h = None
                for length in range(1, max(LENGTHS) + 1):
                    if len(points) < length:
                        break
                    h, valid = grams(points, letter, length, h)
                    if length in LENGTHS:
                        at = np.flatnonzero(valid)
                        pairs = np.stack([h[at], language[first + owner[at]].astype(np.uint64) << np.uint64(8) | np.uint64(length)])
                        order = np.lexsort(pairs)
                        pairs = pairs[:, order]
                        start = np.flatnonzero(np.concatenate([[True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)])) if pairs.shape[1] else np.zeros(0, dtype=np.int64)
                        parts.append((pairs[0, start], pairs[1, start], np.diff(np.concatenate([start, [pairs.shape[1]]]))))
            if parts:
                g, what, c = (np.concatenate([p[i] for p in parts]) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(what.astype(np.int64)), pa.array(c.astype(np.int64))], ["gram", "what", "n"])

    counted = sample.select(place[F.col("lang")].alias("i"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(count, "gram long, what long, n long")
    summed = stored(counted.groupBy("gram", "what").agg(F.sum("n").alias("n")), "grams")
    totals = F.broadcast(summed.groupBy("what").agg(F.sum("n").alias("all")))  # one row for each language and length
    rated = summed.join(totals, "what").select("gram", "what", (F.col("n") / F.col("all")).alias("rate"))
    top = F.max("rate").over(Window.partitionBy("gram", F.col("what") % 256))
    chosen = rated.where(F.col("rate") >= LEAST_RATE).withColumn("top", top).where(F.col("rate") >= SHARE * F.col("top")).select("gram", "what").toPandas()
    return LanguageFilter(languages, chosen["gram"].to_numpy().view(np.uint64), (chosen["what"].to_numpy() >> 8).astype(np.int64))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score of every row. Only the text is read. und: text is null or has no letter.

    Texts are read whole, whatever their length (some 80 bytes a code point in a task); equal texts get equal answers; of
    languages with equal counts the first in alphabetical order counts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    # the filter's size is fixed: 2 ** SLOT_BITS bytes for each eight languages
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, score = sent.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op10_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents; learned from rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id")))
    return identify(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def crc_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
