import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.op10_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"] and lang[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert all(r["held_out"] == (langid.crc_of(r["doc_id"]) % 4 == 2) for r in got) and len(held) > 100
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_filter_names_every_language_of_a_gram():
    gram = np.array([5, 5, 9, 77], dtype=np.uint64)
    language = np.array([0, 9, 3, 9])
    f = langid.LanguageFilter([f"l{i}" for i in range(10)], gram, language)

    def named(g):
        mask = [p.copy() for p in f.planes]
        at = [int(s[0]) for s in langid.slots(np.array([g], dtype=np.uint64))]
        return [i for i in range(10) if all(mask[i // 8][s] >> (i % 8) & 1 for s in at)]

    assert named(5) == [0, 9] and named(9) == [3] and named(77) == [9] and named(1234) == []
    assert (f.accident < 1e-9).all()


def test_whole_texts_count_alike():
    """The counts of several texts in one block are those of each alone."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc é中 ."), 200)) for _ in range(20)] + ["", "...", "İstanbul"]
    model = langid.LanguageFilter(["a", "b"], rng.integers(0, 1 << 40, 50, dtype=np.uint64), rng.integers(0, 2, 50))
    total, by = model.counts(texts)
    for i, t in enumerate(texts):
        one, own = model.counts([t])
        assert one[0] == total[i] and np.allclose(own[0], by[i])


def test_odd_rows(odd, empty):
    model = langid.fit(odd)
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(odd, model).collect()}
    assert (1, "und") in out and (2, "und") in out and (7, "und") in out and not any(i == 5 and p == "und" for i, p in out)
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def plain_grams(text):
    """n-grams of a text as (n, code points with 0 for what is no letter), repeats included."""
    points = [ord(c) if c.isalpha() else 0 for c in f"\n{text.lower()}\n\n\n"]
    for n in langid.LENGTHS:
        for i in range(len(points) - n + 1):
            own = tuple(points[i : i + n])
            if sum(p > 0 for p in own) >= max(1, n - 1):
                yield n, own


def plain_hash(n, own):
    h = own[0] + 1
    for at, p in enumerate(own[1:], 2):
        h = (h * 0x2545F4914F6CDD1D + p) % (1 << 64)
    return h


def test_counts_are_those_of_a_plain_counter(texts):
    some = [t for _, t in sorted(texts.items())][:60] + ["", "a", "no. it, is; ünd 😀 x1y"]
    known = [set(plain_grams(" ".join(some[i::3]))) for i in range(3)]
    pairs = sorted({(plain_hash(*g), i) for i, own in enumerate(known) for g in own})
    model = langid.LanguageFilter(["a", "b", "c"], np.array([h for h, _ in pairs], dtype=np.uint64), np.array([i for _, i in pairs], dtype=np.int64))
    total, by = model.counts(some)
    for row, text in enumerate(some):
        own = list(plain_grams(text))
        assert total[row] == len(own)
        for i in range(3):
            exact = sum(g in known[i] for g in own)
            accidents = (len(own) - exact) * model.accident[i]
            assert abs(by[row, i] - exact) <= 5 * accidents**0.5 + 1 + 0.02 * len(own)


def test_many_languages_are_an_error(spark):
    """A column that isn't the language fails before anything is learned; a hundred languages are learned."""
    text = F.concat(F.lit("word "), F.col("id").cast("string"))
    with pytest.raises(ValueError, match="more than 1024 values"):
        langid.fit(spark.range(langid.MOST_LANGUAGES + 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.col("id").cast("string").alias("lang")))
    some = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.char(F.col("id") % 26 + 97), 20).alias("text"), F.col("id").cast("string").alias("lang"))
    assert len(langid.fit(some).languages) == 100
