"""Rules from the lines of filter lists, against expressions written by hand."""

from __future__ import annotations

import pytest

from quillgraph.llm import url_filter

LINES = [
    "! a comment", "[Adblock Plus 2.0]", "", "  ", "example.com##.ad", "example.com#@#.ad", "||Ads.example^", "||track.", "@@||ads.example/ok/", "/banner/*/img", "|http://start.example/a", "/end.gif|",
    "||opt.example^$script,image", "||party.example^$third-party", "||dom.example^$domain=x.org", "/^[a-z]+\\.rx\\.example\\/q[0-9]+$/", "||pay.example/a^b", "swf|", "@@||never.example^",
]
URLS = {
    "http://ads.example/x": "block", "http://sub.ADS.example": "block", "http://badads.example/x": "allow", "http://ads.example.org/": "allow", "http://ads.example:80/": "block", "http://ads.example/ok/1": "allow", "http://ads.example/OK/1": "allow",
    "http://track.me/": "block", "http://x.track.io/a": "block", "http://backtrack.me/": "allow", "http://a.b/banner/1/img": "block", "http://a.b/BANNER/x/IMGs": "block", "http://a.b/banner/img": "allow",
    "http://start.example/abc": "block", "https://x.start.example/abc": "allow", "http://a.b/the/end.gif": "block", "http://a.b/the/end.gifs": "allow", "http://opt.example/": "block", "http://party.example/": "allow", "http://dom.example/": "allow",
    "http://abc.rx.example/q12": "block", "http://abc.rx.example/q12/": "allow", "http://pay.example/a/b": "block", "http://pay.example/a.b": "allow", "http://a.b/m.swf": "block", "http://a.b/": "allow", "no url": "allow",
}


@pytest.mark.parametrize("most", [20_000, 1])
def test_lines(spark, most):
    rules = url_filter.filter_rules(spark.createDataFrame([(x,) for x in [*LINES, *LINES]], "value string"))
    assert rules.count() == 11
    assert {tuple(r.tokens) for r in rules.collect()} == {("ads", "example"), ("track",), (), ("opt", "example"), ("pay", "example"), ("never", "example")}
    pages = spark.createDataFrame(list(enumerate([*URLS, None])), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules, most=most).collect()}
    assert {u: got[k] for k, u in enumerate(URLS)} == URLS and got[len(URLS)] == "allow"


def test_tokens_change_no_verdict(spark):
    rules = url_filter.filter_rules(spark.createDataFrame([(x,) for x in LINES], "value string"))
    bare = rules.selectExpr("pattern", "cast(array() as array<string>) as tokens", "verdict", "prefix")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = lambda r: sorted((x.page_id, x.verdict, x.matched) for x in url_filter.judge(pages, r).collect())
    assert rows(rules) == rows(bare)


def test_no_lines(spark):
    rules = url_filter.filter_rules(spark.createDataFrame([], "value string"))
    pages = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    assert url_filter.judge(pages, rules).first().verdict == "allow"
