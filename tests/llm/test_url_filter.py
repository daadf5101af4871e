import random

from quillon.llm.queries import URL_RULES
from quillon.llm.url_filter import url_filter


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, urls, rules, default="allow"):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, rule int")
    out = url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default).collect()
    assert len(out) == len(urls)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert got == {i: brute(u, rules, default) for i, u in enumerate(urls)}


ODD = [
    None, "", "no scheme", "http://", "http://NET/", "http://a.Net", "https://x.net/?q=/en/", "ftp://example.net/en/x#y", "http://example.net?x/", "http://xexample.com/de/",
    "http://a.example.com/de/", "http://EXAMPLE.COM/DE/", "http://example.com/de", "http://é.org/fr/x y", "http://org/fr/", "http://a://b/c", "x://.net/", "http://a..net//", "http://u@p.net:80/", "//net/",
    "http://" + "a." * 300 + "net/" + "b/" * 300,
]


def test_contract_rules(spark):
    check(spark, ODD + ["http://same.net/a"] * 30, URL_RULES)
    check(spark, ODD, URL_RULES[:0] or [("none.example", "/", "block")], default="block")


def test_random_rules(spark):
    r = random.Random(5)
    hosts, parts = ["a", "b.a", "c.b.a", "d", "x.d"], ["/", "/p", "/p/", "/p/q", "/p/q/", "", "/pq"]
    rules = [(r.choice(hosts), r.choice(parts), r.choice(["allow", "block"])) for _ in range(25)]
    urls = [f"http://{r.choice(['', 'z.'])}{r.choice(hosts)}{r.choice(parts)}{r.choice(['', 'r', '?x', '#/p'])}" for _ in range(300)]
    check(spark, urls, rules)
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []


def test_very_deep_urls_are_expanded_by_the_rules_alone(spark):
    deep = ["http://" + "a." * 10_000 + "example.net/" + "b/" * 10_000, "http://" + "." * 10_000 + "org/fr/" + "/" * 10_000, "http://net" + "/" * 10_000, "x://" + "net." * 10_000]
    check(spark, deep + [None, "none"] * 50, URL_RULES)
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, deep[0]), (2, None)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter(pages, rules, "block").collect()] == [(None, "block")] * 2
