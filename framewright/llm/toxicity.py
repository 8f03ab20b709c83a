"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

P(grade <= k) = sigmoid(theta_k - w.x) for ordered thresholds theta_0 < theta_1 < ... and one weight vector w that
all thresholds share. x marks which features a text holds: its words, and the first letters of its words. The expected
severity is the sum over k of P(grade > k).

Most words are rare and tell nothing, so features are chosen first: those whose likelihood ratio with the label is so
large that fewer than one in all features would reach it by chance.

The tables label texts as toxic or not. Grades are made from that label: 0 where it is 0; a toxic text's grade is 1
to GRADES - 1 by how many different words it holds that stand for toxic texts. Which words do is learned from other
texts than those graded: the sample has two halves (copies in the same one), and each is graded by what the other tells.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, text_of, tidy

#: Severity grades, 0 (none) to GRADES - 1.
GRADES = 4
#: Lengths of the word beginnings that are features.
PREFIXES = (4, 5, 6)
#: Features chosen at most, those with the largest likelihood ratios.
MOST_FEATURES = 20_000
#: About so many labelled rows of each label are learned from at most (chosen by a hash of doc_id).
ROWS_A_LABEL = 5000
#: A text is rejected from this probability of a grade above 0.
REJECT = 0.5

_WORD = re.compile(r"\w+")
#: Remembered words of a task.
MEMO = 80_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> list[int]:
    """Digests of a word and of its beginnings, as signed longs."""
    data = word.encode("utf-8", "surrogatepass")
    out = [xxhash.xxh3_64_intdigest(data)]
    out += [xxhash.xxh3_64_intdigest(word[:n].encode("utf-8", "surrogatepass"), seed=1) for n in PREFIXES if len(word) > n]
    return [h - (1 << 64) if h >> 63 else h for h in out]


class _Known(dict):
    """What words stand for; starts anew when it is full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = self.make(word)
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class OrdinalModel:
    """Shared weights by feature digest, and ordered thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return _sigmoid(eta[:, None] - self.thresholds[None, :])

    def severity(self, eta: np.ndarray) -> np.ndarray:
        return self.above(eta).sum(axis=1)

    def scorer(self):
        """A function from texts to w.x; each feature of a text counts once. It remembers words within bounds."""
        weights = self.weights
        known = _Known(lambda word: tuple(f for f in features_of(word) if f in weights))

        def run(texts: list[str]) -> np.ndarray:
            out = []
            for text in texts:
                held: set[int] = set()
                for w in set(words_of(text)):
                    held.update(known[w])
                out.append(sum(weights[f] for f in sorted(held)))
            return np.array(out, dtype=np.float64)

        return run


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, features: int, grades: int = GRADES, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of maximum likelihood with L2 decay by Adam over all rows. rows, columns: the places of the ones, by row.

    Grades that no row has keep thresholds apart from their neighbours.
    """
    n = len(grade)
    w, base, gaps = np.zeros(features), np.zeros(1), np.zeros(grades - 2)
    parameters = [w, base, gaps]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for step in range(1, steps + 1 if n else 1):
        theta = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
        eta = np.bincount(rows, weights=w[columns], minlength=n)
        # cdf[:, k + 1] = P(grade <= k)
        cdf = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None, :] - eta[:, None]), np.ones((n, 1))], axis=1)
        upper, lower = cdf[np.arange(n), grade + 1], cdf[np.arange(n), grade]
        p = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        g_eta = (d_upper - d_lower) / n
        g_theta = np.zeros(grades + 1)
        np.add.at(g_theta, grade + 1, -d_upper / n)
        np.add.at(g_theta, grade, d_lower / n)
        g_theta = g_theta[1:-1]
        tails = np.cumsum(g_theta[::-1])[::-1]
        grads = [np.bincount(columns, weights=g_eta[rows], minlength=features) + decay * w, tails[:1], tails[1:] * np.exp(gaps)]
        for i, (q, g) in enumerate(zip(parameters, grads, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            q -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    return w, np.concatenate([base, base + np.cumsum(np.exp(gaps))])


def graded(toxic: np.ndarray, telling: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """0 where toxic is 0; else 1 .. grades - 1 by the number of telling words, cut at equal counts of toxic rows."""
    out = np.zeros(len(toxic), dtype=np.int64)
    own = np.flatnonzero(toxic == 1)
    if len(own):
        cuts = np.quantile(telling[own], np.arange(1, grades - 1) / (grades - 1))
        out[own] = 1 + np.searchsorted(cuts, telling[own], side="left")
    return out


def half_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=2) & 1


def chosen_features(sample: DataFrame) -> tuple[set[int], tuple[set[int], set[int]]]:
    """(the features that tell the labels apart, those that each half of the sample says stand for toxic texts).

    Counts are made in the tasks and summed by feature; only chosen features reach the driver.
    """

    def count(batches):
        counts = [Counter() for _ in range(4)]  # texts and toxic texts of either half
        known = _Known(features_of)
        sizes = [0] * 4
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held = {f for w in set(words_of(text)) for f in known[w]}
                half = 2 * half_of(text)
                for i in (half, half + 1)[: 1 + (label == 1)]:
                    counts[i].update(held)
                    sizes[i] += 1
        names = list(counts[0].keys() | counts[2].keys())
        rows = [pa.array([*[c[f] for f in names], size], pa.int64()) for c, size in zip(counts, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([*names, None], pa.int64()), *rows], ["feature", "n0", "t0", "n1", "t1"])

    parts = ("n0", "t0", "n1", "t1")
    counts = stored(sample.mapInArrow(count, "feature long, n0 long, t0 long, n1 long, t1 long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in parts]), "features")
    known = counts.where("feature IS NOT NULL")
    totals = counts.where("feature IS NULL").first()  # the row without a feature counts texts
    least = F.lit(2 * math.log(max(2, known.count())))
    part = lambda seen, wanted: F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(F.lit(0.0))

    def ratio(n, t, rows, toxic):
        """The likelihood ratio of a feature, 0 where there is only one label; and whether it leans to toxic texts."""
        n, t = n.cast("double"), t.cast("double")
        expected = n * (toxic / max(1, rows))
        return (2 * (part(t, expected) + part(n - t, n - expected)) if 0 < toxic < rows else F.lit(0.0)), t > expected

    best = lambda value: known.where(value >= least).orderBy(F.desc(value), "feature").limit(MOST_FEATURES)
    whole, _ = ratio(F.col("n0") + F.col("n1"), F.col("t0") + F.col("t1"), totals["n0"] + totals["n1"], totals["t0"] + totals["t1"])
    telling = []
    for half in ("0", "1"):
        value, up = ratio(F.col(f"n{half}"), F.col(f"t{half}"), totals[f"n{half}"], totals[f"t{half}"])
        telling.append({r[0] for r in best(value).where(up).select("feature").collect()})
    return {r[0] for r in best(whole).select("feature").collect()}, (telling[0], telling[1])


def learn(docs: DataFrame, labels: DataFrame) -> OrdinalModel:
    """Fit on a bounded hash sample of labelled whole texts. Without labels of both kinds every text gets severity near 0.

    Null texts count as empty; repeated rows and repeated labels count as often as they come; an empty table gives the
    model that rejects nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    nothing = OrdinalModel({}, 20.0 + np.arange(GRADES - 1))
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("labelled_id"), "toxic")
    sizes = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        return nothing
    share = F.when(F.col("toxic") == 1, min(1.0, ROWS_A_LABEL / sizes[1])).otherwise(min(1.0, ROWS_A_LABEL / sizes[0]))
    wanted = known.where(F.pmod(F.xxhash64("labelled_id", F.lit("toxicity sample")), F.lit(1_000_000)) < share * 1_000_000)
    # the sample has at most about 2 * ROWS_A_LABEL ids, so its broadcast is bounded
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sample = stored(texts.join(F.broadcast(wanted), F.col("doc_id") == F.col("labelled_id")).select("doc_id", F.col("toxic").cast("long").alias("toxic"), "text"), "sample")
    rows, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < rows:
        return nothing
    chosen, telling_of = chosen_features(sample)
    if not chosen:
        return nothing
    place = {f: i for i, f in enumerate(sorted(chosen))}

    def held(batches):
        known = _Known(lambda word: tuple(f for f in features_of(word) if f in chosen))
        tells = [_Known(lambda word, other=other: any(f in other for f in features_of(word))) for other in telling_of[::-1]]
        for batch in batches:
            columns, telling = [], []
            for text in batch.column(2).to_pylist():
                words = set(words_of(text))
                own = {f for w in words for f in known[w]}
                columns.append(sorted(place[f] for f in own))
                other = tells[half_of(text)]
                telling.append(sum(other[w] for w in words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns, pa.list_(pa.int32())), pa.array(telling, pa.int64())], ["doc_id", "toxic", "columns", "telling"])

    got = sample.mapInArrow(held, "doc_id long, toxic long, columns array<int>, telling long").toPandas().sort_values(["doc_id", "telling"], kind="stable")
    r = np.repeat(np.arange(len(got)), got["columns"].map(len))
    c = np.concatenate([np.asarray(x, dtype=np.int64) for x in got["columns"]])
    weights, thresholds = fit_ordinal(r, c, graded(got["toxic"].to_numpy(), got["telling"].to_numpy()), len(place))
    return OrdinalModel({f: float(weights[i]) for f, i in place.items()}, thresholds)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity (0 to GRADES - 1), grade (the likeliest), p_toxic = P(grade > 0), rejected; one row for each row.

    Null text counts as empty; a text without words has the severity of no feature at all. Texts of any length are read
    whole; equal texts get equal scores; of equally likely grades the lowest counts. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)  # MOST_FEATURES weights, whatever the input

    def run(batches):
        m = sent.value
        scores = m.scorer()
        for batch in batches:
            above = m.above(scores(batch.column(1).to_pylist()))
            cdf = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            grade = (cdf[:, :-1] - cdf[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] >= REJECT)], ["doc_id", "severity", "grade", "p_toxic", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, severity double, grade int, p_toxic double, rejected boolean")


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs without the rows that the model rejects; columns unchanged."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = sent.value
        scores = m.scorer()
        for batch in batches:
            eta = scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(m.above(eta)[:, 0] < REJECT))

    return docs.mapInArrow(tidy(run), docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of every row of documents, learned from labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
