import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from framewright.llm import grace

from ..compare import differences, duck


def test_same_as_sql(spark, sf_dir):
    assert differences(grace.op5_exact_dedup(spark, sf_dir), duck(sf_dir), grace.OP5_SQL) == []


def test_spilling_changes_nothing(spark, sf_dir, documents, texts):
    """Tables so small that buckets spill over several levels."""
    classes = defaultdict(list)
    for i, t in texts.items():
        classes[t].append(i)
    got = grace.exact_groups(documents, table_bytes=20_000, combine_bytes=5_000).collect()
    assert len(got) == len(texts)
    for r in got:
        own = classes[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert bytes(r["digest"]) == hashlib.sha256(texts[r["doc_id"]].encode()).digest()


def test_table_refuses_once_full():
    t = grace.ContentTable(200)
    assert t.add(b"12345678", 1, 5, 1) and not t.add(b"abc", 2, 1, 1) and not t.add(b"", 3, 1, 1) and t.add(b"12345678", 1, 9, 2)
    assert t.best == [9] and t.rows == [3]
    same = grace.ContentTable(1000)
    assert same.add(b"a", 7, None, 1) and same.add(b"b", 7, 1, 1) and same.contents == [b"a", b"b"]


def test_buckets_follow_the_bytes(spark, monkeypatch):
    """Far more distinct texts than the first level's tables hold take three levels at most, whatever their number."""
    levels = []
    monkeypatch.setattr(grace, "stored", lambda df, name, keep=grace.stored: (levels.append(name), keep(df, name))[1])
    df = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = grace.content_classes(df, table_bytes=2000)
    assert got.count() == 700 and len([n for n in levels if n.startswith("grace-")]) <= 3


def test_maps_and_structs_beside_the_text(spark):
    rows = [(1, "a", {"x": 1}, ({"y": 2},)), (2, "a", {}, None), (2, "a", {}, None), (3, "b", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row map<string,int>, kept struct<m:map<string,int>>")
    out = grace.without_copies(df)
    assert out.schema == df.schema and sorted(r["doc_id"] for r in out.collect()) == [2, 3]


def test_odd_rows(odd, empty):
    got = grace.exact_groups(odd).collect()
    assert len(got) == odd.count()
    group = lambda text: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"], r["kept"]) for r in got if bytes(r["digest"]) == hashlib.sha256(text).digest())
    assert group(b"") == [(False, 1, 2, False), (False, 2, 2, True), (True, 0, 2, False)]
    same = b"same words here again and again for everyone"
    assert group(same) == [(False, 3, 4, False), (False, 4, 4, False), (False, 4, 4, True)]
    kept = grace.without_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert grace.exact_groups(empty).count() == 0 and grace.without_copies(empty).count() == 0
