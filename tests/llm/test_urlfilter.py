import re

import pytest
from pyspark.sql import functions as F

from mediatally.llm import urlfilter as U

URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/x", "http://example.net/EN/", "http://example.net/en",
    "http://badexample.net/en/", "http://x.example.com/de/1?q=/fr/", "http://x.example.com?/de/", "http://example.org/fr/a", "http://org/fr/", "http://sorg/fr/",
    "http://a.org/fr#/", "http://net#x/", "http://a\nb.net/c\nd", "ftp://u@example.com:80/de/", "x://y://net/", "http://shop.example/cart/checkout",
    "http://shop.example/CART/checkout/1", "http://10.0.0.1/", "http://casino.example/", "http://my-casino.example/", "http://www.xxx.com/", "http://a.example/wiki/login",
    "http://a.example/login.php", "http://adserver.example/", "http://ÄÖ.net/ä", "://net/",
]


def simple(url, rules=(("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    hit = [r for r in U.PATTERN_RULES if re.search(r.pattern, (url or "").lower())]
    return host, path, None, "block" if any(r.verdict == "block" for r in hit) else "allow"


def test_against_every_rule_on_every_url(spark):
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, found string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect()}
    assert found == {i: simple(u) for i, u in enumerate(URLS)}


def test_rules_beyond_one_index(spark, monkeypatch):
    monkeypatch.setattr(U, "RULES_AT_ONCE", 2)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    assert {r.page_id: r.rule for r in U.filter_urls(df).collect()} == {i: simple(u)[2] for i, u in enumerate(URLS)}


def test_rules_are_filed_under_their_rarest_token():
    index = U.filed(U.HOST_RULES, {"net": 90, "example": 50, "en": 60, "com": 40, "de": 30, "org": 9, "fr": 10})
    assert {t: [r.name for r in rules] for t, rules in index.items()} == {"net": ["net/"], "example": ["example.net/en/"], "de": ["example.com/de/"], "org": ["org/fr/"]}
    assert U.host_rule("block", "a.example/pre").tokens == ("a", "example")  # "pre" may go on in a url
    assert all(set(r.tokens) <= U.tokens_of("http://www.adserver.example/cart/checkout/login/wiki/casino/xxx") for r in U.PATTERN_RULES)


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert sorted(r.verdict for r in U.filter_urls(df).collect()) == ["allow", "block", "block"]
    assert U.filter_urls(df.where("false")).count() == 0


def test_tokens_are_read_off_the_pattern():
    assert {r.name: r.tokens for r in U.PATTERN_RULES} == {
        "login page": ("login",), "shopping cart": ("cart", "checkout"), "ad server": ("adserver",), "gambling host": ("casino",),
        "adult host": ("xxx",), "raw address": (), "encyclopaedia": ("wiki",),
    }
    cases = {
        r"/ads": (), r"/ads/": ("ads",), r"^ads$": ("ads",), r"ads": (), r"/(?:ads|promo)/": (), r"/(ads)/(x1)\.": ("ads", "x1"), r"/ads?/": (), r"/a[0-9]/b/": ("b",),
        r"/(?:x/)?ads/": ("ads",), r"/(?:x)?ads/": (), r"\bads\b": ("ads",), r"(?i)/ads/": (), r"/ads(?:/|$)": ("ads",), r"/ads(?:/|\d)": (), r"/a.b/": (), r"/ADS/": ("ads",),
        r"/[^/]*ads/": (), r"/(?:[^/]*[.-])?ads[a-f]": (), r"/ads(?=/)": (), r"a/(?:b/)*c/": ("c",), "": (),
    }
    assert {p: U.literal_tokens(p) for p in cases} == cases


def test_a_pattern_never_fits_without_its_tokens():
    texts = [u.lower() for u in URLS if u] + ["x/ads/y", "ads", "xads/", "/adsx/", "/ads", "/x/ads/", "/xads/", "/a1/b/", "/ads1", "a/b/b/c/", "-ads-", "/ads.x1."]
    patterns = [r.pattern for r in U.PATTERN_RULES] + [r"/ads/", r"^ads$", r"/(?:x/)?ads/", r"\bads\b", r"/ads(?:/|$)", r"a/(?:b/)*c/", r"/a[0-9]/b/"]
    for pattern in patterns:
        fitted = [t for t in texts if re.search(pattern, t)]
        assert all(set(U.literal_tokens(pattern)) <= U.tokens_of(t) for t in fitted), pattern


def test_a_hundred_thousand_rules_from_a_table(spark):
    n = 100_000
    table = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("verdict"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("site"), F.col("id"), F.lit(".example.com/"))).alias("host"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("tag"), F.col("id"))).alias("name"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("/tag"), F.col("id"), F.lit("(?:/|$)"))).alias("pattern"),
    )
    rules = U.rules_of(table)
    urls = spark.range(0, n, 97).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.site"), F.col("id"), F.lit(".example.com/tag"), F.col("id") + 1, F.lit("/x")).alias("url"))
    found = {r.page_id: (r.rule, r.pattern, r.verdict) for r in U.filter_urls(urls, rules).collect()}
    verdict = lambda i: "allow" if i % 3 == 0 else "block"
    # An even site has a host rule; behind an odd one stands an even tag, which no rule names.
    assert found == {i: (f"site{i}.example.com/", None, verdict(i)) if i % 2 == 0 else (None, None, "allow") for i in range(0, n, 97)}
    index = U.filed(rules, U.token_counts(urls, rules))
    fetched = [sum(len(index.get(t, ())) for t in U.tokens_of(r.url)) + len(index.get("", ())) for r in urls.collect()]
    assert max(fetched) <= 2  # of 100,000 rules


def test_rules_that_cannot_be_used(spark):
    schema = "verdict string, host string, name string, pattern string, extra int"
    for row in ((None, "a/", None, None, 1), ("block", None, "x", None, 1), ("block", "a/", "x", "a", 1)):
        with pytest.raises(ValueError):
            U.rules_of(spark.createDataFrame([row], schema))
    with pytest.raises(re.error):
        U.rules_of(spark.createDataFrame([("block", None, "x", "(", 1)], schema))
    two = spark.createDataFrame([("block", "a/", None, None, 1)] * 2, schema)
    with pytest.raises(ValueError):
        U.rules_of(two, most=1)
    assert len(U.rules_of(two)) == 2 and U.rules_of(two.where("false")) == ()
