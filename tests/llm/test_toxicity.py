import math
import re

import numpy as np
import xxhash

from framewright.llm import toxicity


def test_thresholds_are_ordered_and_severity_rises():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 400)
    # feature g is on in grades of at least g; noise features besides
    pairs = [(i, g) for i, y in enumerate(grade) for g in range(1, y + 1)] + [(i, 10 + int(rng.integers(0, 20))) for i in range(400)]
    r, c = (np.array(x) for x in zip(*sorted(pairs), strict=True))
    weights, thresholds = toxicity.fit_ordinal(r, c, grade, 32)
    m = toxicity.OrdinalModel(dict(enumerate(weights)), thresholds)
    assert (np.diff(m.thresholds) > 0).all()
    eta = np.bincount(r, weights=weights[c], minlength=400)
    severity = m.severity(eta)
    means = [severity[grade == g].mean() for g in range(4)]
    assert all(a < b for a, b in zip(means, means[1:], strict=False)) and np.corrcoef(severity, grade)[0, 1] > 0.9


def test_held_out_labels(spark, documents, sf_dir):
    """Learned from half of the labelled rows, tested on the other half."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    m = toxicity.learn(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, m).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = np.mean([r["rejected"] == (r["toxic"] == 1) for r in got])
    toxic = [r["rejected"] for r in got if r["toxic"] == 1]
    clean = [r["rejected"] for r in got if r["toxic"] == 0]
    assert right > 0.97 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.01
    assert all(0 <= r["severity"] <= toxicity.GRADES - 1 and 0 <= r["p_toxic"] <= 1 for r in got)


def test_scores_are_those_of_the_plain_formula(spark, documents, sf_dir, texts):
    """Every text's severity from its words and word beginnings, the weights and the thresholds."""
    m = toxicity.learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert m.weights
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    got = {r["doc_id"]: r for r in toxicity.score(documents, m).collect()}
    for i, text in texts.items():
        words = set(re.findall(r"\w+", text.lower()))
        names = {(w, 0) for w in words} | {(w[:n], 1) for w in words for n in (4, 5, 6) if len(w) > n}
        eta = sum(m.weights.get(signed(xxhash.xxh3_64_intdigest(w.encode(), seed=s)), 0.0) for w, s in names)
        above = [1 / (1 + math.exp(t - eta)) for t in m.thresholds]
        grades = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        assert abs(got[i]["severity"] - sum(above)) < 1e-9 and got[i]["grade"] == grades.index(max(grades)) and got[i]["rejected"] == (above[0] >= 0.5)


def test_grades_come_from_the_other_half(spark):
    """Halves by text: a word that only one half holds tells nothing about that half."""
    half = {0: [], 1: []}
    for i in range(400):
        text = f"filler{i} common words"
        half[toxicity.half_of(text)].append(text)
    rows = [(n, int(n % 2), f"{t}") for n, t in enumerate(half[0][:150] + half[1][:150])]
    marked = [(n, label, t) for n, label, t in rows]
    sample = spark.createDataFrame(marked, "doc_id long, toxic long, text string")
    whole, (zero, one) = toxicity.chosen_features(sample)
    assert not whole and not zero and not one  # nothing tells the labels apart
    bad = []
    for i in range(4000):
        text = f"nasty filler{i}"
        if toxicity.half_of(text) == 0 and len(bad) < 100:
            bad.append((1000 + i, 1, text))
    whole, (zero, one) = toxicity.chosen_features(sample.union(spark.createDataFrame(bad, sample.schema)))
    nasty = toxicity.features_of("nasty")[0]
    assert nasty in whole and nasty in zero and nasty not in one


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (6, 0)], "doc_id long, toxic int")
    m = toxicity.learn(odd, labels)
    assert toxicity.score(odd, m).count() == odd.count() and toxicity.score(empty, m).count() == 0
    assert toxicity.without_toxic(odd, m).columns == odd.columns
    none = toxicity.learn(empty, labels.limit(0))
    assert toxicity.without_toxic(odd, none).count() == odd.count()
