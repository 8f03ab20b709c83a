import re

import numpy as np
import pytest
import xxhash

from framewright.llm import common, simhash


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_documents(spark, sf_dir, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


@pytest.mark.parametrize("errors", [0, 1, 2, 3])
def test_keys_meet_within_three_bits(errors):
    rng = np.random.default_rng(errors)
    a = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, errors, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    keys = lambda x: [set(k) for k in _grouped(*simhash.fuzzy_keys(x), len(x))]
    assert all(p & q for p, q in zip(keys(a), keys(b), strict=True))


def _grouped(row, key, n):
    out = [[] for _ in range(n)]
    for r, k in zip(row.tolist(), key.tolist(), strict=True):
        out[r].append(k)
    return out


def test_golay_code_is_perfect():
    low, high, errors, count = simhash.golay_tables()
    lightest = np.bitwise_count(errors[:, 0])
    assert sorted(np.bincount(lightest).tolist()) == sorted([1, 23, 253, 1771]) and count.min() >= 1


def test_chains_and_hot_groups(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 63))
    chain = [base ^ ((1 << 3 * i) - 1) for i in range(12)]  # each 3 bits from the next
    far = [int(x) for x in rng.integers(0, 1 << 63, 50)]
    fps = {i: f for i, f in enumerate(chain + far + [far[0]] * 400 + [0, 0, 7, 15])}
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(df).collect()}
    assert got == plain_components(fps)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (9, 8)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert common.components(edges.limit(0)).count() == 0


def test_odd_rows(odd, empty):
    got = simhash.near_groups(simhash.fingerprints(odd))
    assert got.count() == odd.count() and simhash.near_groups(simhash.fingerprints(empty)).count() == 0
    zero = {r["component_id"] for r in got.where("fp = 0").collect()}
    assert zero == {1}


def test_components_with_hubs(spark):
    """A hub of a third of all edges that is its component's least node, one that is its largest, chains and pairs."""
    edges = [(0, i) for i in range(1, 900)] + [(100_000, i) for i in range(2_000, 2_900)] + [(i, i + 1) for i in range(5_000, 5_040)] + [(2_899, 899), (7, 7), (9_001, 9_000)]
    parent = {n: n for e in edges for n in e if e[0] != e[1]}

    def top(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r["node"], r["root"]) for r in found) == sorted((n, top(n)) for n in parent)


def test_many_equal_rows_without_ids(spark):
    fps = spark.createDataFrame([(None, 5)] * 3000 + [(8, 5), (9, 4), (10, -1)], "doc_id long, fp long")
    got = {}
    for r in simhash.near_groups(fps, 3).collect():
        got[r["doc_id"], r["fp"], r["component_id"]] = got.get((r["doc_id"], r["fp"], r["component_id"]), 0) + 1
    assert got == {(None, 5, 8): 3000, (8, 5, 8): 1, (9, 4, 8): 1, (10, -1, 10): 1}
