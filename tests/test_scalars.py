import re
import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fennelmill.functions import scalars as S


def values(spark, rows, ddl, **columns):
    return spark.createDataFrame(rows, ddl).select(*(c.alias(k) for k, c in columns.items())).collect()


def one(spark, value, expression, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expression.alias("y")).first().y


def test_truthy_falls_through_null_and_empty(spark):
    rows = [(None, "b"), ("", "b"), ("a", "b"), ("", "")]
    assert [r.y for r in values(spark, rows, "a string, b string", y=S.first_truthy("a", "b", default="d"))] == ["b", "b", "a", "d"]


def test_first_element_defaults_under_ansi(spark):
    ddl = "l array<struct<price:struct<amount:double>>>"
    rows = [([((9.9,),)],), ([],), (None,), ([(None,)],), ([((None,),)],)]
    got = values(spark, rows, ddl, y=S.whole_amount(S.first_of("l", "price", "amount")))
    assert [r.y for r in got] == [9, 0, 0, 0, 0]


def test_prefix_counts_code_points_and_tail_always_follows(spark):
    assert one(spark, "ab", S.clipped("x", 5)) == "ab..."
    assert one(spark, "😀漢字です", S.clipped("x", 2)) == "😀漢..."
    assert one(spark, None, S.clipped("x", 2)) is None


def test_int_option(spark):
    rows = [(v,) for v in (None, "", "x", "7", "0", "99", " 8 ", "1.5", "+3")]
    assert [r.y for r in values(spark, rows, "x string", y=S.int_option("x", 5, 1, 50))] == [5, 5, 5, 7, 1, 50, 8, 5, 3]


def test_tokens_split_where_the_class_ends(spark):
    assert one(spark, "スロープ・café ＡＢ a1 々x a1", S.tokens("x")) == ["スロ", "プ", "caf", "a1", "x", "a1"]
    assert one(spark, "a1 a1 b", S.token_set("x")) == ["a1", "b"]
    assert one(spark, None, S.tokens("x")) == []


def test_referral(spark):
    url = lambda x, **k: one(spark, x, S.referral("x", "https://r.example/go", k.get("site", "s"), "p", "r.example"))
    assert url("https://a/ b*~漢") == "https://r.example/go?sid=s&pid=p&vc_url=" + urllib.parse.quote("https://a/ b*~漢", safe="")
    assert url("https://r.example/x") == "https://r.example/x"
    assert url("https://a", site="") == "https://a"
    assert url(None) is None


def test_small_string_functions(spark):
    assert one(spark, "https://v/watch?v=abc&t=1", S.after_last("x", "v=")) == "abc&t=1"
    assert one(spark, "plain", S.after_last("x", "v=")) == "plain"
    assert one(spark, "\t　 a b \n", S.stripped("x")) == "a b"
    assert one(spark, "/d/a.b.json", S.stem("x")) == "a.b"
    assert one(spark, ".hidden", S.stem("x")) == ".hidden"
    assert one(spark, "my-first-post", S.heading_from_name("x")) == "My First Post"
    assert one(spark, "http://a http://b", S.secure("x")) == "https://a https://b"
    assert one(spark, "50,000+", S.traffic_number("x")) == 50000
    assert one(spark, "none", S.traffic_number("x")) is None
    assert one(spark, "a STEM toy", S.contains_any("x", ["STEM"])) is True
    assert one(spark, "a stem toy", S.contains_any("x", ["STEM"])) is False
    assert one(spark, None, S.contains_any("x", ["STEM"])) is False
    assert one(spark, 11, S.page_of("x"), "x int") == 2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=20), min_size=1, max_size=8))
def test_tokens_and_encoding_agree_with_python(spark, texts):
    got = values(spark, [(t,) for t in texts], "x string", t=S.tokens("x"), u=S.percent_encoded("x"))
    assert [r.t for r in got] == [re.findall("[一-龥ぁ-んァ-ンa-zA-Z0-9]+", t) for t in texts]
    assert [r.u for r in got] == [urllib.parse.quote(t, safe="") for t in texts]


def test_null_safe_text(spark):
    assert one(spark, None, F.concat(S.text("x"), F.lit("!"))) == "!"


def test_map_value(spark):
    df = spark.createDataFrame([({"a": 3, "n": None},), (None,)], "m map<string,int>")
    assert [tuple(r) for r in df.select(S.map_value("m", "a", 101).alias("a"), S.map_value("m", "b", 101).alias("b"), S.map_value("m", "n", 101).alias("n")).collect()] == [(3, 101, 101), (101, 101, 101)]


def test_counts_are_observed(spark):
    from fennelmill.operators.relational import counted

    df, seen = counted(spark.range(7), "rows_written")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 7
