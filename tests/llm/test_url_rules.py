import random
import re

from retrievalkit.llm.url_rules import judge_urls


def split(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    if not m:
        return "", ""
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def brute(url, rules):
    host, path = split(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def test_random_rules_match_brute_force(spark):
    r = random.Random(4)
    hosts = [".".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "/".join(r.choice(["x", "y", "xx"]) for _ in range(r.randint(0, 3))) for _ in range(40)] + ["", "/"]
    rules = sorted({(r.choice(hosts), r.choice(paths)) for _ in range(120)})
    rules = [(h, p, r.choice(["allow", "block"])) for h, p in rules]
    urls = [f"http://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?q=/x', '#f'])}" for _ in range(500)]
    urls += [None, "", "no scheme", "://", "http://", "http://A.B/X", "http://a.b?x", "HTTP://c:80/x", "http://a\n.b/x\ny", "a://b://c/x"]
    urls += ["http://a.b.c/x/y"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "7 as rule", "8 as key", "9 as part")
    for parts in (1, 7):
        got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), parts=parts)
        assert got.columns == ["page_id", "url", "key", "part", "host", "path", "rule", "verdict"]
        rows = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in got.collect()}
        assert rows == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([(None, "http://a.net/x"), (1, None), (1, "http://A.NET/x")], "page_id long, url string")
    rules = spark.createDataFrame([("NET", "/", "block"), ("net", "/", "allow"), (None, None, None)], "host string, path string, verdict string")
    got = sorted((str(r["page_id"]), str(r["rule"]), r["verdict"]) for r in judge_urls(pages, rules).collect())
    assert got == [("1", "None", "allow"), ("1", "net/", "block"), ("None", "net/", "block")]
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert judge_urls(pages.limit(0), rules).count() == 0
