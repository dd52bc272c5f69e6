import random

from cohortmill.llm.urls import build_trie, judge_urls, longest_rule, split_url

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/fr", "block"),
         ("net", "", "allow"), ("a.net", "/fr/x", "allow"), ("a.net", "/fr/x", "block")]


def brute(url):
    host, path = split_url(url)
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def urls():
    draw = random.Random(4)
    found = [None, "", "no scheme", "http://", "http://Example.COM", "x://net", "http://com/?a://b", "http://a.net/fr/x"]
    for _ in range(300):
        host = ".".join(draw.choices(["www", "example", "a", "net", "com", "EXAMPLE"], k=draw.randint(1, 4)))
        found.append(f"http://{host}" + "".join(draw.choices(["/en", "/fr", "/", "/x", "/en/", "r", "?q=1", "#t"], k=draw.randint(0, 4))))
    return found


def test_trie_is_the_longest_rule():
    trie = build_trie(RULES)
    for url in urls():
        host, path, rule, verdict = brute(url)
        assert longest_rule(trie, host, path) == ((rule, verdict) if rule is not None else (None, None)), url


def test_both_ways_agree(spark, rows):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls())], "page_id long, url string, host string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), ("x", None, "block")], "host string, path string, action string")
    want = sorted((i, *brute(u)) for i, u in enumerate(urls()))
    for bound in (1 << 20, 0):
        found = judge_urls(pages, rules, max_trie_bytes=bound)
        assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, found.drop("url").collect()), key=lambda r: r[0]) == want


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, action string")
    assert judge_urls(pages, rules).collect() == []
    assert judge_urls(spark.createDataFrame([(1, "http://a/b")], pages.schema), rules).first()["verdict"] == "allow"
