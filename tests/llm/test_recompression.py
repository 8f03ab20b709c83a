import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framewright.llm import recompression as rc


def brute(docs, w):
    """{position: (n_words, n_removed, kept)} of (id, text) rows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for _, t in docs]
    seen = Counter(tuple(x[i : i + w]) for x in words for i in range(len(x) - w + 1))
    out = []
    for (doc_id, _), x in zip(docs, words, strict=True):
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        kept = " ".join(a for a, g in zip(x, gone, strict=True) if not g)
        out.append((doc_id, len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def result(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect())


def test_documents(spark, sf_dir, texts):
    assert result(rc.op9_repeats(spark, sf_dir)) == brute(list(texts.items()), rc.WINDOW)


@pytest.mark.parametrize("seed", range(3))
def test_few_words(spark, seed):
    """A vocabulary so small that runs, periods and overlapping windows abound."""
    rng = random.Random(seed)
    docs = [(i, " ".join(rng.choice("aab") for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    docs += [(100, "x " * 40), (101, "y " * 7), (102, "p q " * 30), (103, docs[0][1]), (103, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(rc.remove_repeats(df, window=8, chunk_bytes=300, bucket_bytes=500)) == brute(docs, 8)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(11)
    middle = [rng.choice("abcdefgh") for _ in range(50)]
    docs = [" ".join([rng.choice("abcdefgh") for _ in range(rng.randrange(20))] + middle + [rng.choice("abcdefgh") for _ in range(rng.randrange(20))]) for _ in range(30)]
    c = rc.Chunk(pa.table({"doc_id": list(range(30)), "text": docs}))
    start = c.windows(20)
    value, _ = rc.anchors(c, start, 20, rc.ROUNDS)
    digest = rc.window_digests(c, start, 20)
    by_words = {}
    for d, v in zip(zip(*(x.tolist() for x in digest), strict=True), value.tolist(), strict=True):
        assert by_words.setdefault(d, v) == v
    assert len(by_words) < len(start) and (np.asarray(value) != 0).all()


def test_odd_rows(odd, empty):
    docs = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert result(rc.remove_repeats(odd)) == brute(docs, rc.WINDOW)
    assert rc.remove_repeats(empty).count() == 0
