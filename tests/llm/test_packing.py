from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import packing


@pytest.mark.parametrize("seed", range(6))
def test_buckets_are_optimal(seed):
    rng = np.random.default_rng(seed)
    length = np.unique(rng.integers(0, 40, 9))
    count = rng.integers(1, 30, len(length))
    cost = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(length, count, strict=True))
    for k in (1, 2, 3, 4):
        got = packing.optimal_buckets(length, count, k)
        best = min(cost((*s, int(length[-1]))) for n in range(k) for s in combinations(map(int, length[:-1]), min(n, len(length) - 1)))
        assert len(got) <= k and got == sorted(got) and cost(got) == best
    assert packing.optimal_buckets(np.array([]), np.array([]), 3) == []


def check(out, docs, budget):
    """Every word has one place; every slot one piece; batches keep to the budget; all but a bucket's last are full."""
    rows = out.collect()
    assert len({(r["bucket_words"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    for b in {r["bucket_words"] for r in rows}:
        room = max(1, budget // max(1, b))
        own = [r for r in rows if r["bucket_words"] == b]
        assert all(r["n_words"] <= b and r["slot"] < room for r in own)
        assert sorted(r["batch"] * room + r["slot"] for r in own) == list(range(len(own)))
    words = sum(len((r["text"] or "").encode().split()) for r in docs.select("text").collect())
    assert sum(r["n_words"] for r in rows) == words


def test_documents(spark, sf_dir, documents):
    check(packing.op4_packing(spark, sf_dir), documents, packing.BUDGET)


def test_small_pieces_and_groups(documents):
    check(packing.pack(documents, most_words=50, buckets=4, budget=500, group=20), documents, 500)


def test_odd_rows(odd, empty):
    out = packing.pack(odd)
    check(out, odd, packing.BUDGET)
    assert out.where(F.col("piece") == 0).count() == odd.count() and packing.pack(empty).count() == 0


def test_words_without_python(spark, documents, odd):
    """Pieces are counted by Spark itself, so no Arrow batches or Python processes stand beside an executor's heap; words are those of bytes.split()."""
    texts = ["", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "a b", "a \n\tb\x0b", "a\x0cb\rc", "a\x1cb\x1db\x85c\xa0d e", "x\x00y z", "😀 ​ ü", "x x xx x", "\n\nx\n\n", "word " * 70_000, "w" * 200_000, " " * 200_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").union(documents.select("doc_id", "text")).union(odd.select("doc_id", "text"))
    got = sorted(tuple(r) for r in rows.select(packing.text_of().alias("text"), packing.count_words(packing.text_of())).collect())
    assert got == [(t, len(t.encode().split())) for t, _ in got] and len(got) == rows.count()
    cut = packing.pieces(rows, 50)
    assert "Arrow" not in (plan := cut._jdf.queryExecution().executedPlan().toString()) and "Python" not in plan
    assert cut.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("first_word", "bigint"), ("n_words", "bigint")]
