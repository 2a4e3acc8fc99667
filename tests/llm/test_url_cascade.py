"""URL rules by cascades against a plain loop over rules; the cascade against a set."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.llm import url_cascade as uc


def slow(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = []
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((-len(rule), -len(h), rule, verdict != "block"))
    best = min(fits, default=None)
    return (host, path, best and best[2], ("allow" if best[3] else "block") if best else "allow")


URLS = [
    None, "", "no scheme", "://", "http://", "http:///x", "http://org", "http://org/", "http://ORG/x", "http://a.b.Example.ORG/es/1", "https://example.org/en/12?q#f",
    "http://example.org?x=/es/", "http://example.org#/es/", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/a://b.org/",
    "http://a..org/", "http://.org/", "http://org./", "http://example.org:80/es/", "http://é.com/de/ü", "http://x.com/de/" + "z" * 100_000,
    "http://" + "a." * 3000 + "org/x", "http://x.org/a\nb?c", "http://x.com/\n/fr/", "http://u@x.com/fr/", "http://xyz.net/", "http://example.org/en/2",
]


def test_rules_equal_a_plain_loop(spark):
    rows = [(i, u, "x", "x", "x", "x") for i, u in enumerate(URLS + URLS[:5])]
    pages = spark.createDataFrame(rows, "page_id int, url string, host string, path string, rule string, verdict string")
    found = uc.judge(pages, spark.createDataFrame(uc.RULES, "rule string, verdict string"))
    assert found.columns[-4:] == ["host_", "path_", "rule_", "verdict_"]
    got = {r["page_id"]: (r["host_"], r["path_"], r["rule_"], r["verdict_"]) for r in found.collect()}
    assert got == {r[0]: slow(r[1], uc.RULES) for r in rows}


def test_many_rules_equal_a_plain_loop(spark):
    draw = random.Random(4)
    hosts = [f"{a}{b}.{c}" for a in ("", "m.", "www.") for b in ("aa", "bb", "ab") for c in ("com", "org", "co.uk")]
    urls = [f"http://{draw.choice(hosts)}/{draw.choice(['x', 'xy', 'xyz', ''])}/{draw.randrange(9)}" for _ in range(500)]
    rules = {f"{draw.choice(hosts)}{draw.choice(['', '/', '/x', '/xy/', '/xyz/1'])}": draw.choice(["allow", "block"]) for _ in range(40)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = uc.judge(pages, spark.createDataFrame(list(rules.items()), "rule string, verdict string")).collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(found)] == [slow(u, rules.items()) for u in urls]


def test_ties_both_verdicts_and_nulls(spark):
    rules = [("b.c/d", "allow"), ("a.b.c/", "block"), ("q.net/", "allow"), ("Q.net/", "block"), (None, "block")]
    pages = spark.createDataFrame([(1, "http://a.b.c/d"), (2, "http://q.net/"), (3, "http://r.net/")], "page_id int, url string")
    found = uc.judge(pages, spark.createDataFrame(rules, "rule string, verdict string"), default="block").collect()
    assert [(r["rule"], r["verdict"]) for r in sorted(found)] == [("a.b.c/", "block"), ("q.net/", "block"), (None, "block")]


@pytest.mark.parametrize("n, size", [(1, 4000), (300, 4000), (3999, 4000), (4000, 4000)])
def test_a_cascade_is_exact_over_its_universe(spark, n, size):
    universe = spark.range(size).select(F.concat(F.lit("key"), "id").alias("key"), (F.col("id") < n).alias("truth"))
    universe = universe.unionByName(universe)
    levels = uc.build(universe.filter("truth").select("key"), universe)
    assert universe.filter(uc.listed(F.col("key"), levels) != F.col("truth")).count() == 0
    if n == 300:
        assert len(levels) > 2 and sum(x.bits for x in levels) < 40 * n


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id int, url string")
    assert uc.judge(pages, none).collect()[0][2:] == ("x.org", "/", None, "allow")
    some = spark.createDataFrame(uc.RULES, "rule string, verdict string")
    assert uc.judge(pages.limit(0), some).count() == 0
    assert uc.build(none.select(F.col("rule").alias("key")), pages.select(F.col("url").alias("key"))) == []


def test_too_many_keys_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(uc, "MOST_BITS", 1000)
    keys = spark.range(1000).select(F.col("id").cast("string").alias("key"))
    with pytest.raises(ValueError, match="split the listed keys"):
        uc.build(keys, keys)
