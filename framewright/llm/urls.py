"""URL filters: rules for hosts and paths, and a weighted vocabulary for urls that no rule decides.

Terms are found by an Aho-Corasick automaton in one pass over a url, whatever their number. A hit counts where neither
neighbour is a letter or digit. One hit of a strict term rejects a url, as do several different soft terms.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, ship

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

STRICT = ("casino", "porn", "xxx", "viagra", "cialis", "escort", "warez", "payday-loan")
SOFT = ("free", "bet", "bets", "betting", "win", "cheap", "pill", "pills", "pharma", "ads", "ad", "track", "tracker", "click", "bonus", "jackpot", "poker", "slots", "loan", "loans", "dating", "crack", "torrent", "replica")

#: A url is rejected by one strict hit or so many different soft terms: a term's weight is 1 or its share of that.
SOFT_HITS = 2

MOST_RULES = 100_000

JUDGED = "rule string, verdict string, n_strict long, n_soft long, distinct_soft long"

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_WORD = frozenset(string.ascii_lowercase + string.digits)


class Vocabulary:
    """Counts of strict and soft terms (lower-case, not empty) in a text."""

    def __init__(self, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT):
        self.terms = ahocorasick.Automaton()
        for term in dict.fromkeys((*soft, *strict)):
            self.terms.add_word(term, (term, term in strict))
        self.terms.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[str, bool]]:
        """(term, whether it is strict) of each hit between boundaries; hits may overlap."""
        if not len(self.terms):
            return
        for last, (term, strict) in self.terms.iter(text):
            first = last - len(term) + 1
            if (first == 0 or text[first - 1] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
                yield term, strict

    def counts(self, url: str) -> tuple[int, int, int]:
        """Strict hits, soft hits, different soft terms; only A-Z are lower-cased."""
        strict, soft = 0, []
        for term, is_strict in self.hits(url.translate(_LOWER)):
            if is_strict:
                strict += 1
            else:
                soft.append(term)
        return strict, len(soft), len(set(soft))


class Rules:
    """Rules by host. The longest that fits wins (host and path together); of equal ones that with the longer host, then the first."""

    def __init__(self, rules: Sequence[tuple[str, str, str]] = RULES):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules: they are sent with every task, so {MOST_RULES} at most")
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def best(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) for a host, whose parents' rules fit too, and a path."""
        found, size = None, (-1, -1)
        while True:
            for start, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (len(host) + len(start), len(host)) > size:
                    found, size = (host + start, verdict), (len(host) + len(start), len(host))
            _, dot, host = host.partition(".")
            if not dot:
                return found


def parts(url):
    """host and path columns of a url column: what stands after the first ``://``; both empty without one, and for null."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """row, host, path, rule, verdict, n_strict, n_soft, distinct_soft: a row of pages, packed, and what is said of its url.

    The verdict (allow or block) is that of the longest rule that fits, else the vocabulary's over the whole url; rule
    is null then. Urls that are null or have no ``://`` have an empty host and path, so only the vocabulary judges them
    (null: allow). Every row is judged alone, whole urls of any length in one pass; repeated rows are judged alike,
    other columns travel in ``row`` and take no part, an empty table gives none.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        vocabulary, by_host = Vocabulary(strict, soft), Rules(rules)
        for urls, hosts, paths in batches:
            out = []
            for u, h, p in zip(urls, hosts, paths, strict=True):
                n_strict, n_soft, distinct = vocabulary.counts(u)
                rule, verdict = by_host.best(h, p) or (None, "block" if n_strict or distinct >= soft_hits else "allow")
                out.append((rule, verdict, n_strict, n_soft, distinct))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in JUDGED.split(", ")])

    ship(pages.sparkSession)
    host, path = parts(F.col("url"))
    split = packed(pages, url=F.col(f"`{url}`").cast("string")).select("row", "url", host.alias("host"), path.alias("path"))
    said = split.withColumn("said", F.pandas_udf(run, JUDGED)(F.coalesce("url", F.lit("")), "host", "path"))
    return said.select("row", "host", "path", "said.*")


def op12_urls(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict and the counts of terms of every row of pages."""
    got = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    return got.select("row.page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "distinct_soft")


def _sql() -> str:
    quoted = lambda values: ", ".join(f"'{v}'" for v in values)
    hits = lambda terms: f"""list_concat([], flatten(list_transform([{quoted(terms)}], lambda t: list_transform(list_filter(range(1, length(low) - length(t) + 2),
            lambda i: substr(low, i, length(t)) = t AND NOT regexp_matches(substr(low, i - 1, (i > 1)::INTEGER), '[a-z0-9]') AND NOT regexp_matches(substr(low, i + length(t), 1), '[a-z0-9]')), lambda i: t))))"""  # noqa: E731
    return f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"({quoted(r)})" for r in RULES)}),
u AS (SELECT row_number() OVER () AS nth, page_id, translate(coalesce(url, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low,
        CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT nth, page_id, low, regexp_extract(rest, '^[^/?#]*') AS given, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
h AS (SELECT nth, page_id, translate(given, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, path, {hits(STRICT)} AS strict, {hits(SOFT)} AS soft FROM s),
best AS (SELECT h.nth, arg_max({{'rule': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) AS b
    FROM h JOIN rules r ON (h.host = r.host OR h.host LIKE '%.' || r.host) AND starts_with(h.path, r.path) GROUP BY h.nth)
SELECT page_id, host, path, b.rule AS rule, len(strict) AS n_strict, len(soft) AS n_soft, len(list_distinct(soft)) AS distinct_soft,
    coalesce(b.verdict, CASE WHEN len(strict) > 0 OR len(list_distinct(soft)) >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best USING (nth)
"""


OP12_SQL = _sql()
