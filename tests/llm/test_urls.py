import re

import pytest
from pyspark.sql import functions as F

from cellframe.llm.urls import PATTERNS, SITES, index, op13_url_rules, pattern_rule, site_rule, token_counts, with_verdicts
from conftest_llm import SF, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :]).group()


def by_hand(url, sites, patterns):
    """All rules, one after the other: sites by comparing strings, patterns by their expressions."""
    host, path = split(url)
    fit = [r for r in sites if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if fit:
        best = min(fit, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
        return host, path, best[0] + best[1], best[2]
    lowered = (url or "").translate(LOWER)
    verdicts = {p.verdict for p in patterns if re.search(p.pattern.replace(r"\z", r"\Z").replace("\\x{", "\\x{"), lowered)}
    return host, path, None, "allow" if not verdicts or "allow" in verdicts else "block"


def python_pattern(rule):
    return type(rule)(rule.rule, rule.verdict, rule.site, re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), rule.pattern), rule.tokens)


ODD = [
    None, "", "no scheme.example.com/en/", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com/EN/1", "http://example.com",
    "http://notexample.com/en/1", "http://a.b.example.com/en/?q=http://www.example.com/en/", "http://x.net/es/", "http://net/fr/x", "http://x.net/esx/",
    "http://x.org/a?u=://spam-farm.example.com/en/", "http://spam-x.org", "http://Spam-X.org/\nen", "x://é.com/中文/en/", "http://a.b:80/en/", "http://user@x.com/en/",
    "http://x.org/ADS/banners/1", "http://x.org/popunder", "http://x.org/popunders", "http://x.org/popunder?x", "http://ads-help.x.org/banners/", "http://ads.x.org/",
    "http://" + "a." * 20_000 + "example.com/en/" + "y" * 50_000, "http://x.org#://y.com/", "http://x.org?/en/://",
]
SITE_ROWS = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def test_odd_urls(spark):
    frame = spark.createDataFrame([(u, "x", "y", "z") for u in ODD], "url string, host string, `a.b` string, verdict string")
    found = rows(with_verdicts(frame, SITES + PATTERNS))
    assert set(found[0]) == {"url", "host", "a.b", "verdict", "path", "rule", "candidates"} and len(found) == len(ODD)
    patterns = [python_pattern(p) for p in PATTERNS]
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == by_hand(r["url"], SITE_ROWS, patterns), r["url"]
    assert rows(with_verdicts(frame, SITES, prefix="new."))[0]["host"] == "x"
    assert with_verdicts(frame.limit(0), SITES).count() == 0
    assert {r["verdict"] for r in rows(with_verdicts(frame, []))} == {"allow"}


@pytest.mark.parametrize(
    "text, tokens",
    [("||ads.", {"ads"}), ("ads.", set()), ("/ads^", {"ads"}), ("||a-b*c-d", {"a"}), ("|http://x*", {"http", "x"} - {"x"}), ("*-q-*r", {"q"}), ("-shop|", {"shop"}), ("É9.", {"9"})],
)
def test_only_whole_tokens_index_a_rule(text, tokens):
    assert pattern_rule(text).tokens == tokens


def test_tokens_of_site_rules():
    assert site_rule("x.example.com", "/en/ab", "block").tokens == {"x", "example", "com", "en"}
    assert site_rule("com", "", "block").tokens == {"com"}


def test_rules_are_listed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("http://www.example.com/en/1",)] * 3 + [("http://example.com/",), (None,)], "url string")
    counts = token_counts(urls, SITES)
    assert counts == {"com": 4, "example": 4, "en": 3, "www": 3, "net": 0, "es": 0, "fr": 0}
    listed, bare = index([*SITES, pattern_rule("ads")], counts)
    assert {t: [e["rule"] for e in entries] for t, entries in listed.items()} == {
        "com": ["com/"], "en": ["example.com/en/", "www.example.com/en/"], "es": ["net/es/"], "fr": ["net/fr/"]
    }
    assert [e["rule"] for e in bare] == ["ads"]


def test_many_rules_run_on_few_urls(spark):
    rules = [site_rule(f"h{k}.example.org", "", "block") for k in range(3000)] + [pattern_rule("ads")]
    frame = spark.range(4000).select(F.concat(F.lit("http://h"), F.col("id"), F.lit(".example.org/x")).alias("url"))
    found = rows(with_verdicts(frame, rules))
    assert sum(r["verdict"] == "block" for r in found) == 3000
    assert sum(r["candidates"] for r in found) == 3000 + 4000


def test_no_shuffle_and_no_python(spark):
    plan = with_verdicts(spark.read.parquet(f"{SF}/pages.parquet"), SITES + PATTERNS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_query_equals_all_rules_on_all_urls(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    patterns = [python_pattern(p) for p in PATTERNS]
    for r in op13_url_rules(spark, SF).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == by_hand(pages[r["page_id"]], SITE_ROWS, patterns)
