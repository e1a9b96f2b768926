import json
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fennelmill import schemas
from fennelmill.operators import articles, matching, offers, relational, render, tasks, validate

WORD = st.sampled_from(["red", "blue", "toy", "x1", "ラトル", "block"])


def plain_match(left, pool):
    out = []
    for title in left:
        best, score = None, 0
        a = set(re.findall("[一-龥ぁ-んァ-ンa-zA-Z0-9]+", title or ""))
        for i, p in enumerate(pool):
            n = len(a & set(re.findall("[一-龥ぁ-んァ-ンa-zA-Z0-9]+", p or "")))
            if n >= 2 and n > score:
                best, score = i, n
        out.append(best)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(WORD, max_size=5).map(" ".join), min_size=1, max_size=5), st.lists(st.lists(WORD, max_size=5).map(" ".join), max_size=8))
def test_best_match_agrees_with_a_plain_loop(spark, left, pool):
    a = spark.createDataFrame(list(enumerate(left)), "k int, t string")
    b = spark.createDataFrame(list(enumerate(pool)), "k int, t string")
    got = {r.k: r.match for r in matching.best_match(a, b, "k", "t", "k", "t").collect()}
    assert [got[i] for i in range(len(left))] == plain_match(left, pool)


def test_overlaps_meet_all_rows_of_both_sides(spark):
    a = spark.createDataFrame([(0, "red toy red"), (1, "blue"), (2, None)], "i int, t string")
    b = spark.createDataFrame([(7, "toy red x1"), (8, "red"), (9, "block"), (1, "toy"), (10, "")], "k int, u string")
    got = {(r.i, r.k): r.shared for r in matching.overlaps(a, b, "i", "t", "k", "u").collect()}
    assert got == {(0, 7): 2, (0, 8): 1, (0, 1): 1}
    plan = matching.overlaps(a, b, "i", "t", "k", "u")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_overlaps_are_counted_by_tasks_of_a_bounded_size(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "MOST_BROADCAST", most)
    monkeypatch.setattr(matching, "JOINED", 50, raising=False)
    a, b = spark.range(10).selectExpr("id i", "concat('w', id % 5, ' w', id % 3, ' x') t"), spark.range(40).selectExpr("id k", "concat('w', id % 7, ' x') u")
    found = matching.overlaps(a, b, "i", "t", "k", "u")
    words = lambda *numbers: {"x", *(f"w{n}" for n in numbers)}
    assert {(r.i, r.k): r.shared for r in found.collect()} == {(i, k): len(words(i % 5, i % 3) & words(k % 7)) for i in range(10) for k in range(40)}
    rows = sum(len(words(i % 5, i % 3) & words(k % 7)) for i in range(10) for k in range(40))
    assert found.rdd.getNumPartitions() == -(-rows // 50)


def test_best_match_plan_is_an_equi_join(spark):
    a = spark.createDataFrame([(1, "a b")], "k int, t string")
    plan = matching.best_match(a, a, "k", "t", "k", "t")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_merge_by_id_keeps_targets_and_first_of_found(spark):
    t = spark.createDataFrame([(0, "a"), (1, "a")], "pos int, item_id string")
    s = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, None), (4, None)], "pos int, item_id string")
    assert [(r.branch, r.item_id) for r in relational.merge_by_id(t, s, "item_id").orderBy("branch", "pos").collect()] == [(0, "a"), (0, "a"), (1, "b"), (1, None)]


def test_rule_score_and_texts(spark):
    rows = [("plain", ["a"] * 3, 880, 100), ("plain", ["a"] * 4, 5000, 100), ("STEM", ["a"] * 4, 5001, 101), ("stem", None, None, None), ("知育", [], 0, 500)]
    df = spark.createDataFrame(rows, "name string, features array<string>, price long, reviews long")
    assert [r.s for r in df.select(articles.rule_score("name", "features", "price", "reviews").alias("s")).collect()] == [3.8, 4.3, 4.8, 3.8, 4.5]
    got = df.select(articles.pros_of("features").alias("p"), articles.cons_of("price").alias("c")).collect()
    assert got[0].p == ["a", "a"] and len(got[4].p) == 2 and got[3].c == got[0].c
    assert [r.s for r in spark.createDataFrame([("ラトル",), ("積み木",), ("ブロック",), ("x",), (None,)], "k string").select(articles.slug_of("k").alias("s")).collect()] == ["baby-rattle", "building-blocks", "building-blocks", "baby-toy", "baby-toy"]


def test_cheapest_ties_zero_and_null(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 0), (1, None), (2, 0), (2, None)], "k int, price long")
    got = [(r.k, r.price, r.is_cheapest) for r in articles.cheapest_flag(df, "price", "k").collect()]
    assert sorted(got, key=str) == sorted([(1, 5, True), (1, 5, True), (1, 0, False), (1, None, False), (2, 0, None), (2, None, None)], key=str)
    nested = df.groupBy("k").agg(F.collect_list(F.struct("price")).alias("p")).select("k", F.explode(articles.cheapest_nested("p")).alias("x")).select("k", "x.*")
    assert sorted(((r.k, r.price, r.is_cheapest) for r in nested.collect()), key=str) == sorted(got, key=str)


def test_offers_from_raw_responses(spark):
    b = spark.createDataFrame([('{"Items":[{"Item":{"itemName":"w","itemPrice":5,"affiliateUrl":"","itemUrl":"u","mediumImageUrls":[],"itemCode":"c1","rank":3}},{"itemName":"n","itemUrl":"v","affiliateUrl":"aff","mediumImageUrls":[{"imageUrl":"i"}],"reviewCount":4}]}',)], "j string")
    rows = b.select(F.from_json("j", schemas.RESPONSE_B).alias("r")).select("r.*")
    got = [(r.title, r.url, r.image, r.item_code, r.review_count) for r in offers.search_b(rows).orderBy("pos").collect()]
    assert got == [("w", "u", "", "c1", 0), ("n", "aff", "i", "", 4)]
    assert [(r.rank, r.item_code) for r in offers.ranking_b(rows).orderBy("pos").collect()] == [(3, "c1"), (None, None)]
    a = spark.createDataFrame([('{"items":[{"asin":"X","itemInfo":{"title":{"displayValue":"t"}},"offersV2":{"listings":[{"price":{"money":{"amount":12.7}}}]}},{"asin":"Y"}]}',)], "j string").select(F.from_json("j", schemas.RESPONSE_A).alias("r")).select("r.*")
    got = [(r.item_id, r.title, r.price, r.features, r.url) for r in offers.catalogue_a(a, tag="g").orderBy("pos").collect()]
    assert got == [("X", "t", 12, [], "https://shop-a.example/item/X?tag=g"), ("Y", None, 0, [], "https://shop-a.example/item/Y?tag=g")]
    c = spark.createDataFrame([('{"hits":[{"name":"n","url":"https://c/1","image":{"small":"s"},"seller":{"name":""}},{"name":"","url":"x"},{"name":"m"}]}',)], "j string").select(F.from_json("j", schemas.RESPONSE_C).alias("r")).select("r.*")
    assert [(r.title, r.image, r.shop) for r in offers.hits_c(c).collect()] == [("n", "s", "c")]
    k = spark.createDataFrame([('{"items":[{"volumeInfo":{"title":"b","imageLinks":{"smallThumbnail":"http://i"}}}]}',)], "j string").select(F.from_json("j", schemas.RESPONSE_BOOKS).alias("r")).select("r.*")
    assert [(r.title, r.authors, r.image) for r in offers.books(k).collect()] == [("b", ["unknown"], "https://i")]


def test_search_term_and_book_query(spark):
    df = spark.createDataFrame([("k", "t"), ("", "a title longer than twenty characters"), ("", None)], "k string, t string")
    assert [r.s for r in df.select(offers.search_term(F.col("k"), F.col("t"), "toys").alias("s")).collect()] == ["k", "a title longer than ", "toys"]
    q = spark.createDataFrame([("learn abc",), ("abc",)], "k string").select(offers.book_query(F.col("k"), "learn", "book").alias("q"))
    assert [r.q for r in q.collect()] == ["learn abc book", "abc learn book"]


def article(spark):
    base = spark.createDataFrame([(0, "A", "red toy x1", 100, ["f1", "f2", "f3", "f4"], "ua", "img"), (1, "B", "STEM " + "b" * 30, 100, None, "ub", "")], "pos int, item_id string, title string, price long, features array<string>, url string, image string")
    pool = spark.createDataFrame([(0, "red toy", "r0"), (1, "toy red x1", "r1")], "pos int, title string, url string")
    none = spark.createDataFrame([], "pos int, title string, url string")
    videos = spark.createDataFrame([(0, None, "https://v/watch?v=1"), (1, "t", None), (2, "u", "https://v/watch?v=3"), (3, "z", "https://v/watch?v=4")], "pos int, title string, url string")
    books = spark.createDataFrame([(0, "b", "bu", None, None)], "pos int, title string, url string, image string, description string")
    topic = spark.createDataFrame([("m", "ラトル")], "mode string, keyword string")
    signal = spark.createDataFrame([("preorder", "a very long signal title")], "type string, title string")
    return articles.article(topic, signal, articles.enriched(base, pool, none), videos, books, none, none, none, datetime(2024, 2, 1, 8, 5, 6))


def test_article_assembly(spark):
    r = article(spark).first()
    assert (r.slug, r.date, r.signal_type, r.meta_description[-3:]) == ("baby-rattle", "2024-02-01T08:05:06+09:00", "preorder", "...")
    assert "a very long sig..." in r.title
    assert [(p.item_id, p.score, p.link_b, p.link_c) for p in r.products] == [("A", 4.3, "r1", ""), ("B", 4.2, "", "")]
    assert [(v.title, v.embed.count("/1") or v.embed.count("/3")) for v in r.videos] == [("recommended video", 1), ("u", 1)]
    assert r.books[0].description == "..." and r.news == [] and r.tags[0] == "ラトル"


def test_render_structure(spark):
    text = render.rendered(article(spark), "2024-02-01").first().content
    head, body = text.split("---\n\n", 1)
    assert [x.split(":")[0] for x in head.strip().split("\n") if ":" in x] == ["date", "draft", "slug", "tags", "title"]
    assert "| 1 | red toy x1... | 4.3 | f1 | [more](ua) |" in body and "| 2 | STEM " + "b" * 15 + "... |" in body
    assert body.count("**(lowest)**") == 2 and body.count("[shop C](#)") == 2 and body.count("![") == 1
    assert "## News" not in body and "## Videos" in body and body.count("### ") == 2 + 2 + 1 + 2  # items, videos, book, features
    bare = render.rendered(spark.createDataFrame([{}], schemas.struct(schemas.ARTICLE)), "2024-02-01").first().content
    assert "No Title" in bare and "tags: []" in bare


def test_tasks_and_queue(spark):
    trends = spark.createDataFrame([(0, "a b"), (1, "c")], "pos int, query string")
    items = spark.createDataFrame([("z",), ("y",), ("x",), ("w",)], "item_id string")
    t = tasks.task_from_trends(trends, items, "2024-02-01").first()
    assert (t.task_id, t.item_ids, t.min_words) == ("2024-02-01-a-b", ["w", "x", "y"], 1500)
    assert tasks.task_from_trends(trends.where("false"), items, "2024-02-01").count() == 0
    q = tasks.append(tasks.append(spark.createDataFrame([], schemas.TOPIC), "one"), "two")
    head, rest = tasks.pop(q, tasks.default_topic(spark))
    assert head.first().keyword == "one" and [r.keyword for r in rest.collect()] == ["two"]
    assert tasks.pop(rest.where("false"), tasks.default_topic(spark))[0].first().mode == "daily_random"


ORDER = {
    "type": "object",
    "required": ["code", "lines"],
    "properties": {
        "code": {"type": "string"}, "state": {"type": "string", "enum": ["open", "paid"]}, "weight": {"type": ["number", "null"]}, "count": {"type": "integer"},
        "lines": {"type": "array", "items": {"type": "object", "required": ["sku"], "properties": {"sku": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}}}},
        "buyer": {"type": "object", "properties": {"the name": {"type": "string"}}},
    },
}


def test_validation(spark, tmp_path):
    docs = {
        '{"code": "a", "lines": [], "more": 1, "weight": null, "count": 2.0}': [],
        '{"code": 1, "lines": [{"sku": "x"}, 2], "state": "odd"}': [("code", "type"), ("lines[]", "type"), ("state", "enum")],
        '{"lines": {"sku": 1}, "weight": "w", "count": 2.5}': [("code", "required"), ("count", "type"), ("lines", "type"), ("weight", "type")],
        '{"code": "a", "lines": [{"sku": "x", "tags": ["t", 1]}, {"tags": []}], "buyer": {"the name": 1}}': [("buyer.the name", "type"), ("lines[].sku", "required"), ("lines[].tags[]", "type")],
        '{"code": null, "lines": [], "state": null}': [("code", "type"), ("state", "enum"), ("state", "type")],
        "[1]": [("", "json")], "{": [("", "json")], None: [("", "json")], '"text"': [("", "json")], "": [("", "json")],
    }
    (tmp_path / "order.json").write_text(json.dumps(ORDER, indent=1))
    df = spark.createDataFrame(list(enumerate(docs)), "k int, d string")
    broken = validate.violations(df, "d", "k", validate.read_schema(spark, str(tmp_path / "order.json")))
    assert sorted(map(tuple, broken.collect())) == [(k, *x) for k, xs in enumerate(docs.values()) for x in sorted(xs)]
    assert broken._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
    assert validate.violations(df, "d", "k", {}).where("path <> ''").count() == 0


def test_default_rows_and_lookup(spark):
    one = spark.createDataFrame([(1,)], "x int")
    assert relational.or_default(one, spark.createDataFrame([(9,)], "x int")).count() == 1
    assert relational.or_default(one.where("x > 1"), spark.createDataFrame([(9,)], "x int")).first().x == 9
    posts = spark.createDataFrame([("p", ["b", "a", "zz"])], "post string, ids array<string>")
    found = relational.lookup_in_order(posts, "ids", spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), "id", ["post"])
    assert [(r.pos, r.id) for r in found.orderBy("pos").collect()] == [(0, "b"), (1, "a")]


def test_latest_and_without_repeats(spark):
    docs = spark.createDataFrame([("s", "2024-01-01", "a"), ("s", "2024-01-02", "b"), ("t", "2024-01-01", "c")], "slug string, date string, title string")
    assert sorted(r.title for r in articles.latest_by_slug(docs).collect()) == ["b", "c"]
    assert [r.keyword for r in articles.without_repeats(spark.createDataFrame([("a",), ("b",)], "keyword string"), spark.createDataFrame([("a",)], "keyword string")).collect()] == ["b"]


def test_numbers_by_range_are_those_of_one_order(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("x"), F.col("id").alias("y")).repartition(6)
    got = relational.numbered_by_range(df, F.desc("x"), "y").agg(F.count("*").alias("n"), F.countDistinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b")).first()
    assert tuple(got) == (20_000, 20_000, 1, 20_000)
    rows = sorted((r.place, -r.x) for r in relational.numbered_by_range(df, F.desc("x"), "y").collect())
    assert rows == sorted(rows, key=lambda r: (r[0])) and [x for _, x in rows] == sorted(x for _, x in rows)
    assert relational.numbered_by_range(df.where("false"), "x").count() == 0
