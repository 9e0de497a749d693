from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from skysift.llm import bloom, url_filter
from skysift.llm.queries import URL_RULES


def brute(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for rule, action in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    return host, path, best and best[0], best[1] if best else "allow"


def test_same_as_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.com", "a.example.com", "com", "x.net", "example.net", "b.c.example.net", "q.org", "EXAMPLE.Com", "ÉX.com", "notcom", ""]
    paths = ["/en/1", "/en/7", "/en/77?x", "/de/8", "/de/9#z", "/es/", "/es", "", "/EN/1"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "://com/en/", "a://b?c://com/en/", "x" * 20000 + "://com/en/1"]
    rows = [(i % 290, u, "clash", "clash") for i, u in enumerate(urls)] + [(5, urls[5], "clash", "clash")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    got = Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == Counter((i, u, *brute(u)) for i, u, _, _ in rows)


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "rule string, action string")
    pages = spark.createDataFrame([(1, "http://a.com/b")], "page_id long, url string")
    assert url_filter.filter_urls(pages, rules).first().verdict == "allow"
    some = spark.createDataFrame([("com/", "block"), (None, "block"), ("com/", "allow")], "rule string, action string")
    assert url_filter.filter_urls(pages, some).first().verdict == "block"
    assert url_filter.filter_urls(pages.limit(0), some).count() == 0


def test_filter_passes_members_and_few_others(spark):
    keys = spark.range(20000).selectExpr("concat('k', id) AS key")
    may = bloom.may_contain(keys, "key")
    assert keys.filter(may(F.col("key"))).count() == 20000
    assert spark.range(20000).selectExpr("concat('other', id) AS key").filter(may(F.col("key"))).count() < 400
    assert keys.filter(bloom.may_contain(keys.limit(0), "key")(F.col("key"))).count() == 0


def test_long_list(spark):
    rules = spark.range(300_000).selectExpr("concat('host', id, '.org/p/') AS rule", "IF(id % 2 = 0, 'block', 'allow') AS action")
    pages = spark.createDataFrame([(i, f"http://a.host{i}.org/p/{i}") for i in range(0, 600_000, 9973)], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, rules, default="none").collect()}
    assert all(got[i].verdict == ("none" if i >= 300_000 else "allow" if i % 2 else "block") for i in got) and len(got) == 61


def test_longest_rule_and_ties(spark):
    rules = spark.createDataFrame([("a.com/b", "allow"), ("com/bcde", "block"), ("com/bcd", "allow")], "rule string, action string")
    pages = spark.createDataFrame([(1, "http://x.a.com/bcde"), (None, "http://x.a.com/bz"), (None, "http://com/bcdz")], "page_id long, url string")
    got = sorted((r.url, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, default="none").collect())
    assert got == [("http://com/bcdz", "com/bcd", "allow"), ("http://x.a.com/bcde", "com/bcde", "block"), ("http://x.a.com/bz", "a.com/b", "allow")]
