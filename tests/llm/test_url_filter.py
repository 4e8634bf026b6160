from tessera.llm import queries, url_filter
from tessera.llm.url_filter import Rule

SCHEMA = "page_id long, url string, host string"


def judge(spark, urls, rules):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], SCHEMA)
    return [r.asDict() for r in url_filter.filter_urls(df, rules).orderBy("page_id").collect()]


def test_tokens_are_whole_in_every_match():
    assert url_filter.literal_tokens("||example.net/en/") == ["en", "example", "net"]
    assert url_filter.literal_tokens("^free^bets*") == ["free"]


def test_rule_without_token_is_refused():
    try:
        url_filter.literal_tokens("*a*")
    except ValueError:
        return
    raise AssertionError


def test_base_rules(spark):
    urls = ["http://example.net/en/1", "https://sub.example.net/en", "HTTP://EXAMPLE.NET/x",
            "https://a.example.com/de/2?q=1", "https://a.example.org/fr/2#t", "ftp://other.net",
            "http://notexample.com/de/", "no scheme", None, "", "://", "http://x.net?y=/", "http://net/"]
    out = judge(spark, urls, queries.BASE_RULES)
    got = [(r["host"], r["path"], r["pattern"], r["action"]) for r in out]
    assert got == [
        ("example.net", "/en/1", "||example.net/en/", "allow"),
        ("sub.example.net", "/en", "||net/", "block"),
        ("example.net", "/x", "||net/", "block"),
        ("a.example.com", "/de/2", "||example.com/de/", "block"),
        ("a.example.org", "/fr/2", "||org/fr/", "allow"),
        ("other.net", "", None, "allow"),
        ("notexample.com", "/de/", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("x.net", "", None, "allow"), ("net", "/", "||net/", "block")]


def test_candidates_are_complete(spark):
    """Every rule that its regular expression matches is fetched by the index."""
    import re
    rules = [Rule("^casino^", "block"), Rule("||shop.*/sale^", "block"), Rule("/ads/*/x^", "block", 2),
             Rule("^utm_source=feed^", "block"), Rule("||a.b/", "allow", 1)]
    urls = ["http://casino.com/", "http://x.com/casino", "http://shop.de/a/sale", "http://my.shop.de/sale/1",
            "http://q.com/ads/7/x", "http://q.com/ads/7/xy", "http://q.com/?utm_source=feed", "http://a.b/ads/x/x"]
    for r, url in zip(judge(spark, urls, rules), urls):
        target = re.sub(r"#.*", "", url.split("://", 1)[1])
        fits = [x for x in rules if re.search(url_filter.regex_of(x.pattern), target)]
        best = max(fits, key=lambda x: (x.priority, len(x.pattern), x.pattern), default=None)
        assert r["pattern"] == (best.pattern if best else None), url


def test_rarest_token_files_the_rule(spark):
    urls = spark.createDataFrame([("example.net/en/1",), ("example.net/en/2",), ("x.net/en/3",)], "target string")
    index = {r["pattern"]: r["token"] for r in url_filter.index_rules(urls, [Rule("||example.net/en/", "a")]).collect()}
    assert index == {"||example.net/en/": "example"}


def test_empty_and_repeated(spark):
    assert judge(spark, [], queries.URL_RULES) == []
    out = judge(spark, ["http://x.net/"] * 3, queries.URL_RULES)
    assert [r["pattern"] for r in out] == ["||net/"] * 3
