"""Url rules against a loop over all rules, with nested, equal and overlapping rules and hot urls."""

import random
import re
from collections import Counter

from quarrybook.llm import url_rules

RULES = "host string, path string, verdict string"


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), h + p, v == "block", v) for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[4] if best else "allow"


def made(n_rules, n_urls):
    rnd = random.Random(3)
    hosts = [".".join(rnd.choices(["a", "b", "net", "network", "ex", "a-b"], k=rnd.randint(1, 4))) for _ in range(40)]
    paths = ["", "/", *("/" + "/".join(rnd.choices(["x", "y", "xy", "é"], k=rnd.randint(1, 4))) + rnd.choice(["", "/"]) for _ in range(30))]
    rules = [(rnd.choice(hosts), rnd.choice(paths), rnd.choice(["allow", "block"])) for _ in range(n_rules)]
    urls = [(i, rnd.choice(["http://", "HTTPS://", ""]) + rnd.choice(["", "q."]) + rnd.choice(hosts).upper() + rnd.choice(paths) + rnd.choice(["", "?a=://b", "#c/"])) for i in range(n_urls)]
    odd = [(None, None), (7, ""), (8, "://"), (9, "file:///x"), (10, "http://net"), (11, "http://net.?/"), (12, "http://a.net/" + "x/" * 20_000), (13, "http://" + "b." * 5000 + "net/x")]
    return rules, urls + odd + odd[:3] + [(20, "http://a.net/x/y")] * 400


def judged(spark, urls, rules):
    table = spark.createDataFrame([(*u, "old", 1) for u in urls], "page_id long, url string, rule string, _row int").repartition(5)
    return url_rules.judge_urls(table, spark.createDataFrame(rules, RULES))


def test_equals_a_loop_over_all_rules(spark):
    rules, urls = made(120, 700)
    found = judged(spark, urls, rules)
    assert found.columns == ["page_id", "url", "_row", "host", "path", "rule", "verdict"]
    assert Counter((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()) == Counter((*u, *brute(u[1], rules)) for u in urls)


def test_nested_rules_close_again(spark):
    rules = [("net", "/", "block"), ("net", "/a/", "allow"), ("net", "/a/b/", "block"), ("net", "/a/b/c/", "allow"), ("x.net", "/a/", "block")]
    urls = [(i, f"http://{host}{path}") for i, (host, path) in enumerate((h, p) for h in ("net", "x.net", "y.x.net", "xnet", "net.org") for p in ("", "/", "/a", "/a/", "/a/b/", "/a/b/c/d", "/a/c", "/b"))]
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in judged(spark, urls, rules).collect()} == {i: brute(u, rules)[2:] for i, u in urls}


def test_without_rules_or_rows(spark):
    rules, urls = made(5, 20)
    assert {(r["rule"], r["verdict"]) for r in judged(spark, urls, []).collect()} == {(None, "allow")}
    assert judged(spark, urls[:1], rules).limit(0).count() == 0
    assert url_rules.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(rules, RULES)).collect() == []
    twice = [("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("net", None, "allow")]
    assert [r["verdict"] for r in judged(spark, [(1, "http://net/x")], twice).collect()] == ["block"]
