import hashlib
from collections import Counter

import numpy as np

from framewright.llm import sampling


def test_collision_rate_is_generalised_jaccard():
    s = sampling.Sampler(samples=4096, memo=200)
    a, b = {"x": 3, "y": 1, "z": 5, "u": 1}, {"x": 1, "y": 4, "z": 5, "v": 2}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a | b) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a | b)
    assert abs(sampling.likeness(s.signature(a), s.signature(b)) - want) < 4 * np.sqrt(want * (1 - want) / 4096) + 0.001


def test_order_and_memory_make_no_difference():
    words = {f"w{i}": 1 + i % 5 for i in range(500)}
    small, large = sampling.Sampler(memo=4200), sampling.Sampler()
    again = dict(reversed(words.items()))
    assert (small.signature(words) == large.signature(again)).all()
    small.signature({f"q{i}": 1 for i in range(4100)})
    assert (small.signature(words) == large.signature(words)).all()
    assert large.signature({}) is None and sampling.likeness(None, None) == 1.0


def test_documents_against_plain_version(spark, sf_dir, texts):
    ids = sorted(texts)
    s = sampling.Sampler()
    sign = {i: s.signature(Counter(texts[i].split())) for i in ids}
    for r in sampling.op2_fingerprints(spark, sf_dir).collect():
        i = r["doc_id"]
        text, following = texts[i], ids[(ids.index(i) + 1) % len(ids)]
        k = len(text) // 4
        edited = text[: len(text) - k] + texts[following][:k]
        other = s.signature(Counter(edited.split()))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == sampling.as_hex(sign[i]) and r["edited_fingerprint"] == sampling.as_hex(other)
        assert r["near_edited"] == sampling.likeness(sign[i], other) and r["near_next"] == sampling.likeness(sign[i], sign[following])


def test_odd_rows(spark, odd, empty):
    got = sampling.fingerprint_documents(odd)
    assert got.count() == odd.count() and sampling.fingerprint_documents(empty).count() == 0
    one = sampling.fingerprint_documents(odd.where("doc_id = 5")).first()
    assert one["near_next"] == 1.0
