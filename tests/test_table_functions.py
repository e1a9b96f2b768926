"""Rows of pages and feeds before an error, and fixed rows."""

import os

import pytest
from pyspark.sql import functions as F

from fennelmill.plans.queries import QUERIES
from fennelmill.sources import markup, tables

DATA = "/root/testdata/sf0.001"


def rows(spark, function, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = {}
    for r in df.lateralJoin(function(F.col("text").outer())).orderBy("i", "pos").collect():
        out.setdefault(r.i, []).append(tuple(r)[3:])
    return out


ITEM = "<div class='{c}'><a href='{u}'>x</a><p class='name'> n{i} <b>b</b></p></div>"


def test_maker_rows(spark):
    page = lambda c, n, u="/g": "".join(ITEM.format(c=c, u=u, i=i) for i in range(n))
    function = tables.maker_rows("https://m.example/a/b", [("gone", "u")] * 3, [("none", "v")] * 2)
    got = rows(spark, function, [page("item", 7), page("block-thumbnail-t", 1) + page("item", 3), None, "", "<p>no", page("item", 2) + page("item", 1, "http://[x") + page("item", 1), "<div class=item><h2>no link</h2></div>", page("item", 1) + "<![nonsense[ " + page("item", 1)])
    assert got[0] == [(f"n{i} b", "https://m.example/g", "page") for i in range(5)]
    assert got[1] == [("n0 b", "https://m.example/g", "page")]
    assert got[2] == [("gone", "u", "unreachable")] * 3 and got[3] == got[4] == got[6] == [("none", "v", "nothing")] * 2
    assert got[5] == [("n0 b", "https://m.example/g", "page"), ("n1 b", "https://m.example/g", "page")]  # the third link can't be resolved
    assert got[7][0] == ("n0 b", "https://m.example/g", "page")


def test_related_rows(spark):
    page = "<article><h2><a href='/a'> A <i>b </i></a></h2></article>" * 4
    got = rows(spark, tables.related_rows(), [page, "<article><p>x</p></article>" + page, None, page[:80]])
    assert got[0] == [("Ab", "/a", "page")] * 3 and got[1] == [("Ab", "/a", "page")] * 2 and 2 not in got and got[3][0] == ("Ab", "/a", "page")


def test_feeds_that_break_off(spark):
    item = lambda i, more="": f"<item><title>n{i} &amp; x</title><link>u{i}</link>{more}</item>"
    head, date = "<rss xmlns:ht='h'><channel>", "<pubDate>d</pubDate>"
    whole = head + "".join(item(i, date) for i in range(12)) + "</channel></rss>"
    broken = [head + item(0, date) + item(1, date)[:20], head + item(0, date) + "</wrong>" + item(1, date), head + item(0, date) + item(1) + item(2, date), "no xml", None, "", head + "x" * 40_000 + "".join(item(i, date) for i in range(3)) + "<item><ti"]
    got = rows(spark, tables.news_rows(), [whole, *broken])
    assert [len(got.get(i, [])) for i in range(8)] == [10, 1, 1, 1, 0, 0, 0, 3] and got[0][0] == ("n0 & x", "u0", "d")
    trends = rows(spark, tables.trend_rows(("toys", "5+")), [head + item(0, "<ht:approx_traffic>7</ht:approx_traffic>") + item(1) + "</channel>", *broken[3:5], head + "<item>"])
    assert trends == {0: [("n0 & x", "7"), ("n1 & x", "unknown")], 1: [("toys", "5+")], 2: [("toys", "5+")], 3: [("toys", "5+")]}


def test_a_tree_holds_what_stands_before_broken_markup():
    assert [n.name for n in markup.tree("<p><b>x</b><![nonsense[ <i>").walk()][:2] == ["p", "b"]


def test_many_feeds_at_once_give_the_rows_of_the_table_functions(spark):
    item = lambda i, more="": f"<item><title>n{i} &amp; x</title><link>u{i}</link>{more}<title>again</title></item>"
    head, date, traffic = "<rss xmlns:ht='h'><channel>", "<pubDate>d</pubDate>", "<ht:approx_traffic>7</ht:approx_traffic>"
    feeds = [head + "".join(item(i, date + traffic) for i in range(12)) + "</channel></rss>", head + item(0, date) + item(1, date)[:20], head + item(0, date) + "</wrong>" + item(1, date), head + item(0, date) + item(1) + item(2, date), "no xml", None, "", head + "x" * 40_000 + item(0, date) + item(1, date) + "<item><ti", head + "<item><title/>" + item(4, date) + "</item>"]
    pages = spark.createDataFrame(list(enumerate(feeds)), "k int, xml string").repartition(3)
    for array, function in ((tables.news_items("xml"), tables.news_rows()), (tables.trend_items("xml", ("toys", "5+")), tables.trend_rows(("toys", "5+")))):
        one = {tuple(r) for r in pages.lateralJoin(function(F.col("xml").outer())).drop("xml").collect()}
        assert {tuple(r) for r in pages.select("k", F.inline(array)).collect()} == one and len(one) > 10
        assert pages.where("false").select(F.inline(array)).count() == 0


@pytest.mark.parametrize("name", ["s13_trend_rows", "s14_news_rows"])
@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_feeds_of_queries_go_to_python_by_batches(spark, name):
    plan = QUERIES[name].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "PythonUDTF" not in plan
    assert "<item>" not in plan[plan.index("Exchange") :], "markup is made behind the shuffle"
