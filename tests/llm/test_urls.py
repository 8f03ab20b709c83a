import random
import re

import pytest

from framewright.llm import urls

from ..compare import differences, duck


def test_same_as_sql(spark, sf_dir):
    assert differences(urls.op12_urls(spark, sf_dir), duck(sf_dir), urls.OP12_SQL) == []


def plain(url):
    """host, path, rule, verdict, n_strict, n_soft, distinct_soft by regular expressions and every rule tried."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    host = low(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest[len(host) : len(host) + 1] == "/" else ""
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    count = lambda term: len(re.findall(rf"(?<![a-z0-9])(?={re.escape(term)}(?![a-z0-9]))", low(url or "")))
    strict, soft = sum(map(count, urls.STRICT)), [count(t) for t in urls.SOFT]
    best = max(fit, default=(0, None, "block" if strict or sum(map(bool, soft)) >= 2 else "allow"))
    return host, path, best[1], best[2], strict, sum(soft), sum(map(bool, soft))


ODD = [
    None, "", "nothing", "://", "http://", "http://a", "HTTP://Example.ORG/es/x", "http://example.org", "http://example.org?x=/es/", "http://sub.example.org/en/12", "http://badexample.org/en/12", "http://example.org/en/2", "http://x.com/fr/casino",
    "http://casino.net/", "http://casinos.net/", "http://cheap-pills.net/", "http://cheap.net/?cheap=cheap", "http://x.net/free#bets", "http://x.net/FREE/BETS", "http://x.net/payday-loan", "http://x.net/ümlautfreeü-win", "ftp://u:p@h:80/a://b/de/", "http://com/de/", "http://.com/de/", "casino", "http://a\nb.org/x\ny?z",
    "http://x.net/" + "free-" * 50_000, "http://x.net/" + "a" * 300_000 + "casino",
]


def test_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(ODD + ODD[:3])] + [(None, "http://x.org/", None)], "page_id long, url string, verdict string")
    got = urls.judged(df).collect()
    assert len(got) == len(ODD) + 4 and {r["row"]["verdict"] for r in got} == {"clash", None}
    for r in got:
        assert tuple(r[c] for c in ("host", "path", "rule", "verdict", "n_strict", "n_soft", "distinct_soft")) == plain(r["row"]["url"]), r["row"]["url"] and r["row"]["url"][:80]
    assert urls.judged(df.limit(0)).count() == 0


def test_random_urls(spark):
    rng = random.Random(5)
    bits = ["http://", "://", "example", ".", "org", "com", "/", "es", "fr/", "en/1", "de", "-", "?", "#", "free", "win", "CASINO", "xxx", "bets", "bet", "ad", "é", "9", "ads"]
    made = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(3000)]
    got = urls.judged(spark.createDataFrame([(u,) for u in made], "url string")).collect()
    for r in got:
        assert tuple(r[c] for c in ("host", "path", "rule", "verdict", "n_strict", "n_soft", "distinct_soft")) == plain(r["row"]["url"]), r["row"]["url"]


def test_longest_rule_and_bounds(spark):
    rules = urls.Rules([("a.b", "/", "allow"), ("b", "/xx", "block"), ("b", "/", "block"), ("", "/", "allow")])
    assert rules.best("a.b", "/xxx") == ("b/xx", "block") or rules.best("a.b", "/xxx") == ("a.b/", "allow")
    assert rules.best("z.b", "/x") == ("b/", "block") and rules.best("c", "/") is None and rules.best("b", "") is None
    with pytest.raises(ValueError, match="rules"):
        urls.Rules([("h", "/", "allow")] * (urls.MOST_RULES + 1))
    assert urls.Vocabulary((), ()).counts("anything") == (0, 0, 0)
    got = urls.judged(spark.createDataFrame([("http://n/one-two",)], "url string"), rules=(), strict=(), soft=("one", "two", "three"), soft_hits=3).first()
    assert got["verdict"] == "allow" and got["distinct_soft"] == 2
