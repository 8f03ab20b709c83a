"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose candidate spans. Five labelers (pattern with its checks, gazetteer, context words, shape, borders)
vote on each candidate: for, against, or not at all. A candidate's votes and kind are one of at most
KINDS * 3 ** LABELERS patterns of votes, so the corpus boils down to a bounded table of counts. On it
expectation-maximisation estimates how reliable each labeler is and how likely each pattern is to be personal data;
these likelihoods train the final classifier, a logistic regression on the votes and on what the span looks like (length,
kinds of characters, the word before it, each by kind), which decides on the spans. Its rows are one of LOOKS looks for
each pattern of votes, so they are bounded as well.

Spans that match a base pattern and pass its checks always stay; the classifier adds spans that no base span of their
kind overlaps. Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored, text_of, unpacked

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("pattern", "gazetteer", "context", "shape", "border")
#: Votes.
NONE, AGAINST, FOR = 0, 1, 2
#: Code points before and after a candidate that the context and border labelers see.
BEFORE = 40
#: Code points of a piece of text.
PIECE = 16_384
#: Numbers of looks of a candidate: 8 lengths, 4 kinds of characters, 16 groups of words before.
LOOKS = 512

# The base patterns, written so that Java's matcher neither backtracks nor recurses over long runs. They find what the
# plain patterns find: a match never starts inside a run of its first class unless the match before ended there.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",  # shorter runs fail the check of 13 digits
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates, less certain.
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}{{1,64}}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{{1,63}}(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{{1,63}}){{1,4}}",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<=(?:[tT]oken|TOKEN|[pP]assword|PASSWORD|[pP]asswd|[sS]ecret|SECRET|[aA]pi_key|API_KEY)[ ]{0,2}[=:][ ]{0,2}\"{0,1})[0-9A-Za-z+/_-]{8,}+",
}
#: A text without this holds no candidate of the kind; spares the costlier patterns.
GATE = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]|[0-9]{3}[ .-][0-9]{4}", "secret": r"(?i)(?:token|passw|secret|api_key)[a-z]{0,4} {0,2}[=:]"}

# Gazetteers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us", "ca", "ch", "at", "nl", "be", "pt", "pl", "ru", "jp", "cn", "in", "br", "mx", "au")
DIALLING_CODES = r"\+ ?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
KEY_STARTS = r"^(?:sk|pk|gh[pousr]_|glpat|xox[abp]|AKIA|AIza|eyJ)"
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|address|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client|from)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|amex|mastercard|account|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
    "secret": r"(?i)(?:token|passw(?:or)?d|secret|key)",
}
COUNTER_CUES = r"(?i)\b(?:version|v|isbn|order|invoice|section|figure|page|build|release)[ .:#]{0,3}$"


def found(text, pattern: str, gate):
    """The matches of a pattern, in order; an empty array where the gate is closed."""
    return F.when(gate, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def let(value, body):
    """body(value) with value evaluated once, for use where an inlined expression would be evaluated for each element."""
    return F.transform(F.array(value), body)[0]


def running(values, zero, op):
    """For each place of an int array, op over all values before it. Blocks of about sqrt(n) values keep that far from quadratic."""
    step = F.ceil(F.sqrt(F.size(values))).cast("int")
    fold = lambda a: F.aggregate(a, zero, op)

    def by_blocks(step):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / step).cast("int")), lambda k: fold(F.slice(values, k * step + 1, step)))
        before = let(blocks, lambda all_: F.transform(all_, lambda _, k: fold(F.slice(all_, F.lit(1), k))))

        def place(before, i):
            block = F.floor(i / step).cast("int")
            return op(F.get(before, block), fold(F.slice(values, block * step + 1, i - block * step)))

        return let(before, lambda before: F.transform(values, lambda _, i: place(before, i)))

    return F.when(F.size(values) > 0, let(step, by_blocks)).otherwise(F.array().cast("array<int>"))


def positions(text, pattern: str, matches):
    """array<struct<t, s, e>>: matches with their places. What stands between matches tells where they are."""

    def placed(matches, gaps, lengths):
        before = running(lengths, F.lit(0), lambda n, x: n + x)

        def place(before, m, i):
            return let(F.get(before, i) + F.char_length(F.get(gaps, i)), lambda s: F.struct(m.alias("t"), s.alias("s"), (s + F.char_length(m)).alias("e")))

        return let(before, lambda before: F.transform(matches, lambda m, i: place(before, m, i)))

    def with_gaps(matches):
        gaps = F.when(F.size(matches) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
        lengths = lambda gaps: F.transform(matches, lambda m, i: F.char_length(m) + F.char_length(F.get(gaps, i)))
        return let(gaps, lambda gaps: let(lengths(gaps), lambda own: placed(matches, gaps, own)))

    return let(matches, with_gaps)


def luhn(digits):
    """Whether a string of 13 to 19 digits passes the Luhn check; false for other lengths."""

    def add(total, i):
        d = digits.substr(F.char_length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add)
    return F.when(F.char_length(digits).between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def digits_of(t):
    return F.regexp_replace(t, "[^0-9]", "")


def passes(kind: str, t):
    """The check of a base match."""
    n = F.char_length(digits_of(t))
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return luhn(digits_of(t))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def pieces_of(text):
    """A text cut into pieces of PIECE code points, each with the first BEFORE of the next: places in it are found without reading all of it."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.char_length(text) / PIECE).cast("int")), lambda i: text.substr(i * PIECE + 1, F.lit(PIECE + BEFORE)))


def cut(pieces, start, size):
    """size (at most BEFORE) code points from start on."""
    return F.get(pieces, F.floor(start / PIECE).cast("int")).substr(start % PIECE + 1, size)


def look(c, before):
    """What a candidate looks like, as one number below LOOKS: length, kinds of characters, and the word before it."""
    t = c["t"]
    size = F.least(F.lit(7), F.floor(F.log2(F.char_length(t) + 1)).cast("int"))
    made = F.when(t.rlike("[0-9]"), F.when(t.rlike("[A-Za-z]"), 0).otherwise(1)).otherwise(F.when(t.rlike("[A-Z]"), 2).otherwise(3))
    word = F.crc32(F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]*$", 1))) % 16
    return ((size * 4 + made) * 16 + word).cast("int")


def votes(kind: str, c, d, before, next_, pattern_vote):
    """The pattern of votes on candidate c (struct t, s, e) with digits d as one number.

    Candidates have any length, so patterns over them neither try every start of a run nor repeat a group but possessively.
    """
    t, last = c["t"], F.right(before, F.lit(1))
    vote = lambda yes, no: F.when(yes, FOR).when(no, AGAINST).otherwise(NONE)
    distinct = F.size(F.array_distinct(F.filter(F.split(d, ""), lambda x: x != "")))
    if kind == "email":
        top = F.lower(F.regexp_extract(t, r"(?<![A-Za-z0-9-])([A-Za-z0-9-]++)$", 1))
        gazetteer = vote(top.isin(*TOP_DOMAINS), top.rlike("[0-9]"))
        shape = vote(F.char_length(t).between(6, 80), F.char_length(t) > 254)
    elif kind == "ip":
        head = F.split(t, r"\.")[0].cast("int")
        gazetteer = vote(head.between(1, 223) & (head != 127), head.isNull() | (head == 0) | (head > 239))
        shape = vote(F.char_length(t) > 9, F.char_length(t) < 8)
    elif kind == "card":
        gazetteer = vote(d.rlike(CARD_ISSUERS), ~d.rlike(CARD_ISSUERS))
        shape = vote(luhn(d) & (distinct > 2), ~luhn(d) | (distinct < 3))
    elif kind == "phone":
        gazetteer = vote(t.rlike("^" + DIALLING_CODES), t.rlike(r"^\+ ?0"))
        shape = vote(F.char_length(d).between(9, 15) & (distinct > 2), ~F.char_length(d).between(7, 15) | (distinct < 3))
    else:
        gazetteer = vote(t.rlike(KEY_STARTS), t.rlike("^[A-Za-z][a-z]*+(?:[-_/][a-z]++)*+$"))
        shape = vote(t.rlike("[0-9]") & t.rlike("[A-Za-z]"), t.rlike("^[A-Za-z]+$"))
    context = vote(before.rlike(CUES[kind]), before.rlike(COUNTER_CUES))
    border = vote(~last.rlike(r"[\p{L}\p{N}]") & ~next_.rlike(r"[\p{L}\p{N}]"), last.rlike(r"[\p{L}\p{N}]") | next_.rlike(r"[\p{L}\p{N}]"))
    out = F.lit(KINDS.index(kind))
    for v in (pattern_vote, gazetteer, context, shape, border):
        out = out * 3 + v
    return out.cast("int")


def _checked(kind: str):
    return F.transform(f"_pb_{kind}", lambda c: F.struct(c["t"].alias("t"), c["s"].alias("s"), c["e"].alias("e"), passes(kind, c["t"]).alias("ok")))


def _judged(kind: str, pieces, c, how, vote):
    start = F.greatest(F.lit(0), c["s"] - BEFORE)

    def judged(before, d):
        code = votes(kind, c, d, before, cut(pieces, c["e"], F.lit(1)), vote)
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), c["s"].alias("s"), c["e"].alias("e"), how.alias("how"), code.alias("votes"), look(c, before).alias("look"))

    return let(cut(pieces, start, c["s"] - start), lambda before: let(digits_of(c["t"]), lambda d: judged(before, d)))


def _judged_base(kind: str, pieces):
    return F.transform(f"_c_{kind}", lambda c: _judged(kind, pieces, c, F.when(c["ok"], 0).otherwise(1), F.when(c["ok"], FOR).otherwise(AGAINST)))


def _judged_loose(kind: str, pieces):
    free = F.col(f"_pl_{kind}")
    if kind in BASE:
        free = F.filter(free, lambda c: ~F.exists(f"_c_{kind}", lambda b: b["ok"] & (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return F.transform(free, lambda c: _judged(kind, pieces, c, F.lit(2), F.lit(NONE)))


def candidates(docs: DataFrame) -> DataFrame:
    """docs with _spans: array<struct<k, s, e, how, votes, look>> of all candidates, by kind and start.

    how: 0 base, 1 a base match that fails its check, 2 loose (overlapping no base span of its kind).
    """
    df = docs.withColumn("_text", text_of())
    text = F.col("_text")
    for kind in KINDS:
        df = df.withColumn(f"_gate_{kind}", text.rlike(GATE[kind]))
    for name, patterns in (("b", BASE), ("l", LOOSE)):
        for kind, pattern in patterns.items():
            df = df.withColumn(f"_m{name}_{kind}", found(text, pattern, F.col(f"_gate_{kind}")))
    for name, patterns in (("b", BASE), ("l", LOOSE)):
        for kind, pattern in patterns.items():
            df = df.withColumn(f"_p{name}_{kind}", positions(text, pattern, F.col(f"_m{name}_{kind}")))
    for kind in BASE:
        df = df.withColumn(f"_c_{kind}", _checked(kind))
    any_ = F.lit(False)
    for kind in KINDS:
        any_ = any_ | (F.size(f"_c_{kind}") > 0 if kind in BASE else F.lit(False)) | (F.size(f"_pl_{kind}") > 0 if kind in LOOSE else F.lit(False))

    def judged(pieces):
        parts = []
        for kind in KINDS:
            parts += [_judged_base(kind, pieces)] * (kind in BASE) + [_judged_loose(kind, pieces)] * (kind in LOOSE)
        return F.array_sort(F.concat(*parts))

    none = F.array().cast("array<struct<k:int,s:int,e:int,how:int,votes:int,look:int>>")
    return df.select(*docs.columns, F.when(any_, let(pieces_of(text), judged)).otherwise(none).alias("_spans"))


def estimate(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Expectation-maximisation over patterns of votes: the probability that a candidate with the pattern is personal data.

    Labelers vote independently given the truth; each has a table of vote probabilities for either truth, shared by
    all kinds; each kind has its own share of true candidates.
    """
    n = len(LABELERS)
    keys = sorted(counts)
    weight = np.array([counts[k] for k in keys], dtype=np.float64)
    kind = np.array([k // 3**n for k in keys], dtype=np.int64)
    vote = np.array([[k // 3 ** (n - 1 - i) % 3 for i in range(n)] for k in keys], dtype=np.int64).reshape(-1, n)
    ballot = (vote == FOR).sum(axis=1) - (vote == AGAINST).sum(axis=1)
    q = np.clip(0.5 + 0.2 * ballot, 0.05, 0.95)
    for _ in range(rounds if keys else 0):
        prior = np.array([(np.sum((weight * q)[kind == k]) + 1) / (np.sum(weight[kind == k]) + 2) for k in range(len(KINDS))])
        log = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])])
        for i in range(n):
            for truth, share in enumerate((1 - q, q)):
                table = np.array([np.sum((weight * share)[vote[:, i] == v]) for v in range(3)]) + 1.0
                log[truth] += np.log(table / table.sum())[vote[:, i]]
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(keys, q.tolist(), strict=True))


def _features(keys: np.ndarray) -> np.ndarray:
    """For each key (votes * LOOKS + look): the places of its features, kind, votes, and kind with length, characters, word before."""
    n, kinds = len(LABELERS), len(KINDS)
    code, seen = keys // LOOKS, keys % LOOKS
    kind = code // 3**n
    out = [kind, *(kinds + 3 * i + code // 3 ** (n - 1 - i) % 3 for i in range(n))]
    at = kinds + 3 * n
    for part, many in ((seen // 64, 8), (seen // 16 % 4, 4), (seen % 16, 16)):
        out.append(at + kind * many + part)
        at += kinds * many
    return np.stack(out, axis=1)


def train(counts: dict[int, int], likelihood: dict[int, float], steps: int = 600, rate: float = 0.5) -> tuple[list[float], list[float]]:
    """Logistic regression on votes and looks with the likelihoods of the votes as targets.

    counts are by votes * LOOKS + look. Gives what each pattern of votes, and each kind * LOOKS + look, adds to the score; a
    candidate counts as personal data from a sum of 0 on.
    """
    n = len(LABELERS)
    every = np.arange(len(KINDS) * 3**n, dtype=np.int64)
    w = np.zeros(len(KINDS) * (1 + 8 + 4 + 16) + 3 * n)
    if counts:
        keys = np.array(sorted(counts), dtype=np.int64)
        own, target = _features(keys), np.array([likelihood[k // LOOKS] for k in keys.tolist()])
        share = np.log1p([counts[k] for k in keys.tolist()])
        share = share / share.sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(w[own].sum(axis=1), -50, 50)))
            pull = np.repeat(share * (p - target), own.shape[1])
            w -= rate * own.shape[1] * (np.bincount(own.ravel(), weights=pull, minlength=len(w)) + 1e-4 * w)
    by_votes = w[_features(every * LOOKS)[:, : 1 + n]].sum(axis=1)
    looks = (np.arange(len(KINDS))[:, None] * 3**n * LOOKS + np.arange(LOOKS)[None, :]).ravel()
    return by_votes.tolist(), w[_features(looks)[:, 1 + n :]].sum(axis=1).tolist()


def classifier(spans: DataFrame) -> tuple[list[float], list[float]]:
    """What votes and looks add to a candidate's score, learned from all candidates in _spans."""
    # at most len(KINDS) * 3 ** len(LABELERS) * LOOKS rows, whatever the input
    rows = spans.select(F.explode("_spans").alias("c")).groupBy((F.col("c.votes").cast("long") * LOOKS + F.col("c.look")).alias("key")).count().collect()
    counts = {r[0]: r[1] for r in rows}
    by_votes: dict[int, int] = {}
    for k, n in counts.items():
        by_votes[k // LOOKS] = by_votes.get(k // LOOKS, 0) + n
    return train(counts, estimate(by_votes))


def decided(spans: DataFrame, scores: tuple[list[float], list[float]]) -> DataFrame:
    """_spans cut down to base spans and those the classifier adds."""
    by_votes, by_look = (F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>") for table in scores)
    score = lambda c: F.get(by_votes, c["votes"]) + F.get(by_look, c["k"] * LOOKS + c["look"])
    return spans.withColumn("_spans", F.filter("_spans", lambda c: (c["how"] == 0) | ((c["how"] == 2) & (score(c) >= 0))))


def as_text(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added of every row.

    Null text counts as empty: no spans, and the digest of the empty string. Repeated rows each give their row. Texts of any
    length are read whole; an empty table gives no rows, and a classifier that adds nothing it has no reason to.
    """
    spans = stored(candidates(docs.select("doc_id", "text")).select("doc_id", "_spans"), "spans")
    out = decided(spans, classifier(spans))
    base = F.filter("_spans", lambda c: c["how"] == 0)
    count = lambda i: F.size(F.filter("_spans", lambda c: (c["how"] == 0) & (c["k"] == i))).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("_spans")).alias("spans"), F.size(F.filter("_spans", lambda c: c["how"] > 0)).cast("long").alias("n_added"))


def masked(text, spans):
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first to start names what they cover."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))

    def joined(ordered, done):
        # done: where the spans before each one end
        part = lambda c, at: F.when(c["s"] >= at, F.concat(text.substr(at + 1, c["s"] - at), F.get(names, c["k"]))).otherwise(F.lit(""))
        end = F.array_max(F.transform(ordered, lambda c: c["e"]))
        return F.concat(F.array_join(F.zip_with(ordered, done, part), ""), text.substr(end + 1, F.char_length(text)))

    ends = lambda ordered: F.transform(ordered, lambda c: c["e"])
    before = lambda ordered: let(ends(ordered), lambda own: running(own, F.lit(0), lambda a, b: F.greatest(a, b)))
    return let(ordered, lambda ordered: let(before(ordered), lambda done: joined(ordered, done)))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """docs with personal data masked; where n_chars is among the columns it follows the text. Null texts stay null."""
    spans = stored(candidates(packed(docs, without="text", text=F.col("text"))), "spans")
    some = F.size("_spans") > 0
    out = decided(spans, classifier(spans)).withColumn("text", F.when(some, masked(F.col("text"), F.col("_spans"))).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unpacked(out, docs.columns, **new)


def op1_personal_data(spark, sf_dir: str) -> DataFrame:
    """Personal data in every row of documents."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
