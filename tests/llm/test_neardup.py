import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import common, neardup


def shingles(text, w=neardup.SHINGLE):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + w]) for i in range(max(1, len(words) - w + 1))} if words else set()


def plain_groups(texts):
    ids = sorted(texts)
    sets = {i: shingles(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= neardup.SIMILARITY * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_documents(documents, texts):
    """All groups of the plain version are found (their links are verified, so none is found wrongly)."""
    want = plain_groups(texts)
    kept = {r["doc_id"] for r in neardup.without_near_copies(documents).collect()}
    wanted = {i for i, r in want.items() if i == r}
    assert wanted <= kept and len(kept - wanted) <= 0.02 * len(set(want) - wanted) + 1


def test_copies_with_edits(spark):
    """Groups around a text with changed words; recall of copies that are alike enough."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts, n = {}, 0
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(80, 300))]
        for _ in range(rng.randrange(1, 8)):
            copy = base[:]
            for _ in range(int(len(base) * rng.uniform(0, 0.015))):
                copy[rng.randrange(len(copy))] = word()
            texts[n] = " ".join(copy)
            n += 1
    want = plain_groups(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, node string")
    kept = {r["doc_id"] for r in neardup.without_near_copies(df).collect()}
    wanted = {i for i, r in want.items() if i == r}
    assert wanted <= kept and len(kept - wanted) <= 0.03 * (len(texts) - len(wanted)) + 1


def same_as_plain(spark, texts):
    want = plain_groups(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in neardup.without_near_copies(df).collect()} == {i for i, r in want.items() if i == r}


def test_families_of_one_template(spark):
    """Many texts of one long template: each is alike to one other, and all share about half of their words."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    template = [word() for _ in range(120)]
    texts = {}
    for n in range(0, 300, 2):
        own = [word() for _ in range(60)]
        texts[n] = " ".join(template + own)
        texts[n + 1] = " ".join(template + own[:50] + [word() for _ in range(10)])
    same_as_plain(spark, texts)


def test_copies_edited_in_blocks(spark):
    """Appended, truncated and part-replaced copies between 0.8 and 0.9, and short texts: all of them are found."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    texts = {}
    for n in range(240):
        base = words(rng.randrange(20, 40) if n % 4 == 3 else rng.randrange(100, 300))
        cut = int(len(base) * rng.uniform(0.1, 0.17))
        middle = len(base) // 2
        half = base[:middle] + words(cut // 2) + base[middle + cut // 2 :]
        copy = [base + words(cut), base[:-cut], half, base[: -(cut // 2)]][n % 4]
        texts[2 * n], texts[2 * n + 1] = " ".join(base), " ".join(copy)
    assert sum(r < i for i, r in plain_groups(texts).items()) > 200
    same_as_plain(spark, texts)


def test_windows_over_one_text(spark):
    """Each text is like the next one only, by a shift."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    words = [word() for _ in range(1200)]
    texts = {n: " ".join(words[6 * n : 6 * n + 100]) for n in range(180)}
    assert set(plain_groups(texts).values()) == {0}
    same_as_plain(spark, texts)


def template(n, changed, words=150):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, texts = [word() for _ in range(words)], {}
    for i in range(n):
        copy = base[:]
        for _ in range(changed):
            copy[rng.randrange(words)] = word()
        texts[i] = " ".join(copy)
    return texts


def test_template_at_the_threshold(spark):
    """300 texts of one template with 3 changed words each: few pairs are alike, all share shingles."""
    same_as_plain(spark, template(300, 3))


def without_first_search(monkeypatch):
    monkeypatch.setattr(neardup, "met_by_bits", lambda known, rows: known.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))


def test_large_group_by_the_second_search_alone(spark, monkeypatch):
    """Buckets of alike texts take several rounds, whole or dealt out by blocks."""
    without_first_search(monkeypatch)
    monkeypatch.setattr(neardup, "FIRST_PARTNERS", 1)
    monkeypatch.setattr(neardup, "PAIRS_A_ROW", 1)
    same_as_plain(spark, template(150, 2, 100))
    monkeypatch.setattr(neardup, "MOST_PAIRS", 400)
    same_as_plain(spark, template(120, 3, 150))


def test_hot_shingles_are_dealt_before_their_rows_meet(spark, monkeypatch):
    """Shingles of more than HOT_ROWS texts, with and without the first search, which joins most of a bucket beforehand."""
    monkeypatch.setattr(neardup, "HOT_ROWS", 20)
    monkeypatch.setattr(neardup, "MOST_PAIRS", 900)
    texts = template(160, 2, 100)
    other = template(40, 9, 100)
    same_as_plain(spark, texts | {1000 + i: t for i, t in other.items()})
    without_first_search(monkeypatch)
    monkeypatch.setattr(neardup, "FIRST_PARTNERS", 1)
    same_as_plain(spark, template(130, 3, 150))


def test_hot_shingles_are_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_ROWS", 10)
    monkeypatch.setattr(neardup, "PLACES", 4)
    keys = [[s << neardup.SIZE_BITS | n % 7 for s in range(n % 30, 30)] for n in range(45)]
    known = spark.createDataFrame([(n, k) for n, k in enumerate(keys)], "node long, keys array<long>")
    often = Counter(k >> neardup.SIZE_BITS for ks in keys for k in ks)
    assert 0 < sum(n > 10 for n in often.values()) < len(often)
    assert {r["bucket"] for r in neardup.hot_shingles(known).collect()} == {s for s, n in often.items() if n > 10}
    monkeypatch.setattr(neardup, "MOST_HOT", 20)
    least = sum(often.values()) // 20
    assert {r["bucket"] for r in neardup.hot_shingles(known).collect()} == {s for s, n in often.items() if n > least}
    assert neardup.hot_shingles(known.limit(0)).count() == 0


def test_cells_let_all_rows_of_different_components_meet(spark, monkeypatch):
    """In cells of a bounded size; a component that fills its bucket alone makes none."""
    monkeypatch.setattr(neardup, "MOST_PAIRS", 100)
    buckets = {1: [0] * 70 + list(range(1, 31)), 2: [5] * 50, 3: list(range(40)), 4: [0] * 90 + [1], 5: [0, 1]}
    rows = [(b, 1000 * b + n, r) for b, roots in buckets.items() for n, r in enumerate(roots)]
    root = {(b, n): r for b, n, r in rows}
    cells = defaultdict(set)
    for r in neardup.cells(spark.createDataFrame(rows, "bucket long, node long, root long")).collect():
        assert r["node"] not in cells[r["bucket"]] and r["cells"] > 0
        cells[r["bucket"]].add(r["node"])
    met = {(a, b) for own in cells.values() for a in own for b in own if a < b}
    assert max(map(len, cells.values())) <= 50 and not any(2000 <= n < 3000 for own in cells.values() for n in own)
    assert all((x, y) in met for b in buckets for x in range(1000 * b, 1000 * b + len(buckets[b])) for y in range(x + 1, 1000 * b + len(buckets[b])) if root[b, x] != root[b, y])


def test_only_what_the_result_reads_is_kept(spark, monkeypatch):
    """Tables of the search and its rounds are deleted; the result can be run twice."""
    left = []
    real = neardup.stored
    for module in (neardup, common):
        monkeypatch.setattr(module, "stored", lambda df, name: left.append((name, real(df, name))) or left[-1][1])
    df = spark.createDataFrame(list(template(60, 2, 100).items()), "doc_id long, text string")
    out = neardup.without_near_copies(df)
    there = [name for name, table in left if table in common._places]
    assert len(left) > 20 and set(there) <= {"filter", "near-copies"} and "near-copies" in there
    assert out.count() == out.count()


def test_parities_never_exclude_what_is_alike():
    rng = np.random.default_rng(7)
    for n in (1, 3, 60, 65, 130, 900):
        for _ in range(40):
            x = np.unique(rng.integers(-(2**63), 2**63, n, dtype=np.int64))
            drop = int(rng.integers(0, max(1, n // 8) + 1))
            y = np.unique(np.concatenate([x[drop:], rng.integers(-(2**63), 2**63, int(rng.integers(0, n // 9 + 1)), dtype=np.int64)]))
            both = len(np.intersect1d(x, y))
            alike = len(y) > 0 and both >= neardup.SIMILARITY * (len(x) + len(y) - both)
            got = neardup.alike_by_parity([neardup.parities(x)], np.array([len(x)]), [neardup.parities(y)], np.array([len(y)]))
            assert got[0] or not alike
    far = [rng.integers(-(2**63), 2**63, 200, dtype=np.int64) for _ in range(2)]
    assert not neardup.alike_by_parity([neardup.parities(far[0])], np.array([200]), [neardup.parities(far[1])], np.array([200]))[0]


def test_prefix_pairs_give_each_pair_or_the_whole_bucket(monkeypatch):
    rng = np.random.default_rng(6)
    packed, node = np.repeat(np.arange(4) << neardup.SIZE_BITS, 50), np.tile(np.arange(50), 4)
    root = np.where(node < 30, 0, node)
    o = rng.permutation(len(node))
    monkeypatch.setattr(neardup, "PAIRS_A_ROW", 100)
    found = list(neardup.prefix_pairs(packed[o], node[o], root[o]))
    assert {(a, b) for x, y, _ in found for a, b in zip(x.tolist(), y.tolist(), strict=True)} == {(a, b) for b in range(30, 50) for a in range(b)}
    monkeypatch.setattr(neardup, "PAIRS_A_ROW", 2)
    monkeypatch.setattr(neardup, "MOST_PAIRS", 100)
    ((nodes, buckets, blocks),) = neardup.prefix_pairs(packed[o], node[o], root[o])
    assert len(nodes) == 200 and len(set(buckets.tolist())) == 4 and (blocks > 2).all()


def test_same_rows_whatever_the_order(spark):
    """Extra columns with the names used inside, repeated rows, maps and structs."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "r", {"a": 1}, (1,)), (2, text + " more", "r", {}, (2,)), (2, text + " more", "r", {}, (2,)), (3, "other words", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, node map<string,int>, copied struct<root:int>")
    out = neardup.without_near_copies(df)
    assert out.schema == df.schema and sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_odd_rows(odd, empty):
    out = neardup.without_near_copies(odd)
    assert out.columns == odd.columns and neardup.without_near_copies(empty).count() == 0
    ids = sorted((r["doc_id"] or 0) for r in out.collect())
    assert 5 in ids and 6 not in ids and 3 in ids and 4 not in ids
