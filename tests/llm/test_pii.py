import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from framewright.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, t):
    d = re.sub("[^0-9]", "", t)
    if kind == "ip":
        return all(int(p) <= 255 for p in t.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if passes(k, m[0])] for k, p in PATTERNS.items()}


HARD = [
    "a@b@c.com x@y.com_z@w.org .@-.- a@b.c. q@r",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.256 00001.2.3.4 999.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 5500000000000004 4111 1111 1111 1112 12345678901234567890 4111  1111",
    "+49 (30) 123-4567 +1 +12 +123456789012345 +1234567890123456 ++49.30.1234567- 5+49 3012345678",
    "😀 bob@example.org 😀😀 10.0.0.1 Ω+44 20 7946 0958",
    "a" * 3000 + "@" + "b" * 3000 + ".c" + " 1" * 4000,
    "x_" * 500 + "@" * 50,
]


@pytest.mark.parametrize("text", HARD)
def test_base_spans_of_hard_texts(spark, text):
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = brute(text)
    assert [r[f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS]
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k]).encode()).hexdigest()


def test_base_spans_of_documents(spark, sf_dir, texts):
    got = pii.op1_personal_data(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]])
        base = {f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k]}
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k]).encode()).hexdigest()
        listed = r["spans"].split(",") if r["spans"] else []
        assert base <= set(listed) and len(listed) == len(base) + r["n_added"]


def test_odd_rows(odd, empty):
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(empty).count() == 0
    masked = pii.without_personal_data(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    assert any("<email>" in (r["text"] or "") and "<phone>" in r["text"] for r in masked.collect())


def test_long_secrets_are_masked_whole(spark):
    rng = random.Random(7)
    token = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    long = token(300)
    texts = [f"use token: {token(32)} here" for _ in range(20)] + [f"use token: {long} here"]
    out = [r["text"] for r in pii.without_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out[-1] == "use token: <secret> here" and not any(long[i : i + 8] in out[-1] for i in range(len(long) - 7))


def test_estimation_tells_reliable_votes():
    n = len(pii.LABELERS)
    code = lambda votes: sum(v * 3 ** (n - 1 - i) for i, v in enumerate(votes))
    good, bad = code([2] * n), code([1] * n)
    p = pii.estimate({good: 100, bad: 100})
    assert p[good] > 0.9 and p[bad] < 0.1
    by_votes, by_look = pii.train({good * pii.LOOKS + 5: 100, bad * pii.LOOKS + 70: 100}, p)
    assert by_votes[good] + by_look[5] > 1 and by_votes[bad] + by_look[70] < -1
    assert by_look[5] > 0 > by_look[70], "looks tell as well"
    assert len(by_votes) == len(pii.KINDS) * 3**n and len(by_look) == len(pii.KINDS) * pii.LOOKS
    assert pii.estimate({}) == {} and not any(pii.train({}, {})[0])


def test_dense_text(spark):
    """Very many spans in one text, over several pieces: places and masking are those of the plain version."""
    parts = [f"mail user{i}@example.org or call +49 30 {1000000 + i} ünd 😀 {'x' * (i % 50)}" for i in range(4000)]
    text = ", ".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    want = brute(text)
    r = pii.find_personal_data(df).first()
    assert len(text) > 10 * pii.PIECE and r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k in PATTERNS for s, e in want[k]).encode()).hexdigest()
    plain = "".join(re.sub(r"user[0-9]+@example.org", "<email>", re.sub(r"\+49 30 [0-9]{7}", "<phone>", p)) + ", " for p in parts)[:-2]
    assert pii.without_personal_data(df).first()["text"] == plain


#: A text and its base spans.
LONG = {
    "local part": ("mail " + "a" * 300_000 + "@b.cc now", "email:5:300010"),
    "secret of pieces": ("token=" + "a-" * 20_000 + " x", ""),
    "labels": ("x@" + "b." * 20_000 + "com y", "email:0:40005"),
    "digits": ("card " + "4" * 300_000, ""),
    "phone without an end": ("+1" + "(" * 300_000, ""),
    "address part": ("1.2.3." + "9" * 300_000, ""),
    "many at signs": ("a@" * 100_000, ""),
}


@pytest.mark.parametrize("name", LONG)
def test_one_long_span(spark, name):
    """One span of a great length takes no longer than its text, and is found whole."""
    text, base = LONG[name]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.find_personal_data(df.withColumn("text", F.lit("mail a@b.cc"))).collect()  # compiled, so that what is measured is the text
    began = time.monotonic()
    r = pii.find_personal_data(df).first()
    assert time.monotonic() - began < 15, "a quadratic pattern takes minutes"
    assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()


def test_added_spans(spark):
    """Planted spans that no base pattern finds, among decoys: precision and recall."""
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, planted = [], {}
    for i in range(300):
        token = "".join(rng.choice("abcdefghjkmnpqrstuvwxyz23456789ABCDEFGH") for _ in range(32))
        kind, span = [("secret", token), ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}"), ("none", digits(4)), ("none", "plainwordsonly")][i % 4]
        cue = {"secret": "token: ", "phone": "please call ", "none": ["order number ", "the secret: "][i % 2]}[kind]
        text = f"some words here {cue}{span} and some more words"
        rows.append((i, text))
        if kind != "none":
            planted[i] = f"{kind}:{text.index(span)}:{text.index(span) + len(span)}"
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {i: s for i, s in got.items() if s}
    right = sum(added.get(i) == s for i, s in planted.items())
    assert right >= 0.95 * len(planted) and right >= 0.95 * len(added)


def test_no_python_in_the_plan(spark, sf_dir):
    plan = pii.op1_personal_data(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
