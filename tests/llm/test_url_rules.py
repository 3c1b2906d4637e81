from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from customsloom.llm import url_rules as ur
from tests.conftest import SF


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(t), t, v) for v, t in ur.RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_given_rules_equal_brute_force(spark):
    odd = [None, "", "no scheme/x", "http://", "HTTP://A.Example.ORG/en/12?x#y", "http://example.org/en/1", "http://notexample.org/en/1", "http://example.org", "x://com/fr/a", "http://a.com/fr", "http://b.com/de/#q", "http://c.ORG?q=/z", "ftp://É.com/de/é", "a://b://c.org/"]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionAll(spark.createDataFrame([(1000 + i, u) for i, u in enumerate(odd)], "page_id bigint, url string"))
    got = ur.judge_pages(pages).collect()
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")


def test_mined_rules_decide_what_they_were_mined_from(spark):
    rows = [(i, f"http://s{i % 7}.good.org/en/{i}") for i in range(60)] + [(100 + i, f"http://s{i}.com/de/{i}?track=1") for i in range(40)] + [(200, "http://x.net/q?track=9"), (201, "http://new.good.net/en/5"), (None, None)]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id bigint, url string, verdict string")
    got = {r["page_id"]: r for r in ur.judge(pages).collect()}
    assert got[200]["verdict"] == "block" and "key:track" in got[200]["mined"] and got[201]["verdict"] == "allow" and got[None]["verdict"] == "allow"
    assert len(ur.judge(pages).columns) == len(set(ur.judge(pages).columns))


def test_rules_hold_in_brute_force(spark):
    """Support and confidence of every mined rule, counted again."""
    rows = [(["a", "b"], "allow")] * 5 + [(["a"], "block")] * 3 + [(["b", "c"], "allow")] * 2
    data = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    for r in ur.mine(data, 0.1, 0.5).collect():
        held = [v for t, v in rows if set(r["items"]) <= set(t)]
        assert r["support"] == sum(v == r["verdict"] for v in held) / len(rows) and r["confidence"] == sum(v == r["verdict"] for v in held) / len(held)


def test_verdicts_equal_those_of_all_token_sets(spark):
    """Against every subset of a url's tokens, with support and confidence counted over the labelled urls."""
    rng = random.Random(6)
    urls = [f"http://{rng.choice(['good.org', 'bad.com', 'x.net', 'y.net'])}/{rng.choice('abc')}/{rng.choice('de')}" + rng.choice(["", "?k=1", "?m=1"]) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, 1, 2, 3, 4) for i, u in enumerate(urls)], "page_id bigint, url string, tokens int, given int, found int, _rest int")
    rules = [("allow", "good.org/"), ("block", "bad.com/a/"), ("allow", "bad.com/b/")]
    host, path, rest = ur.parts(F.col("url"))
    sets = {r["page_id"]: r["t"] for r in pages.select("page_id", ur.tokens(F.col("url"), host, path, rest).alias("t")).collect()}
    got = {r["page_id"]: r for r in ur.judge(pages, rules=rules, min_support=0.02, min_confidence=0.7).collect()}
    labelled = [(frozenset(sets[i]), r["verdict"]) for i, r in got.items() if r["rule"]]
    usual = max(sorted({v for _, v in labelled}), key=lambda v: sum(x == v for _, x in labelled))
    least = max(3, 0.02 * len(labelled))
    for i, r in got.items():
        assert (r["tokens"], r["given"], r["found"], r["_rest"]) == (1, 2, 3, 4)
        if r["rule"]:
            continue
        best = None
        for n in range(1, len(sets[i]) + 1):
            for part in itertools.combinations(sets[i], n):
                held = [v for t, v in labelled if t.issuperset(part)]
                for v in set(held):
                    count = sum(x == v for x in held)
                    if count >= least and count / len(held) >= 0.7:
                        best = max(best or (0, 0, ""), (count / len(held), count, v))
        assert (r["confidence"], r["verdict"]) == ((pytest.approx(best[0]), best[2]) if best else (None, usual))


def test_every_part_of_a_url_counts(spark):
    """The fifth segment alone tells the verdict; a crowd of equal urls with many parts is one item."""
    rules = [("block", "bad.com/"), ("allow", "good.com/")]
    rows = [(i, f"http://bad.com/2024/05/12/news/casino/{i}") for i in range(40)] + [(100 + i, f"http://good.com/2024/05/12/news/sport/{i}") for i in range(60)]
    rows += [(200 + i, "http://a.b.c.d.e.f.good.com/" + "/".join(f"s{j}" for j in range(40)) + "?" + "&".join(f"k{j}=1" for j in range(10))) for i in range(30)]
    rows += [(900, "http://other.net/2024/05/12/news/casino/x"), (901, "http://other.net/2024/05/12/news/sport/x"), (902, "http://other.net/q?k9=1")]
    got = {r["page_id"]: r for r in ur.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules=rules, min_support=0.05).collect()}
    assert got[900]["verdict"] == "block" and "path:casino" in got[900]["mined"]
    assert got[901]["verdict"] == "allow" and got[902]["verdict"] == "allow" and "key:k9" in got[902]["mined"]


def test_urls_that_each_lack_another_key(spark):
    """Item sets of such keys double with each of them: keys under one verdict alone aren't mined."""
    keys = [f"k{i}" for i in range(200)]
    rows = [(i, "http://a.bad.com/x?" + "&".join(f"{k}=1" for k in keys if k != keys[i])) for i in range(200)] + [(300 + i, f"http://good.com/y/{i}?q=1") for i in range(100)] + [(500, "http://other.net/z?k7=1&q=2"), (501, "http://other.net/z?q=1"), (502, "http://other.net/w")]
    got = {r["page_id"]: r for r in ur.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules=[("block", "bad.com/"), ("allow", "good.com/")]).collect()}
    assert (got[500]["verdict"], got[500]["mined"], got[500]["confidence"]) == ("block", "key:k7", 1.0)
    assert (got[501]["verdict"], got[501]["mined"]) == ("allow", "key:q") and (got[502]["verdict"], got[502]["mined"]) == ("block", None)


def test_no_labels_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://x.net/a"), (2, None)], "page_id bigint, url string")
    assert [r["verdict"] for r in ur.judge_pages(pages).collect()] == ["allow", "allow"]
    assert ur.judge_pages(pages.where("false")).count() == 0
