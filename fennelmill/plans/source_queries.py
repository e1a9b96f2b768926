"""Sources, sinks, documents and rendering bound to the tables: answers as providers send them are built from rows, and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fennelmill import schemas
from fennelmill.functions import scalars as S
from fennelmill.operators import articles, offers, relational, render, tasks, validate
from fennelmill.plans.registry import query, table
from fennelmill.sources import files, markup, named, remote, tables


def _answers(df: DataFrame, item: F.Column, items: str, schema: str) -> DataFrame:
    """Each row as the JSON answer of a provider with one item, parsed as such an answer is."""
    sent = df.select(F.to_json(F.struct(F.array(item).alias(items))).alias("sent"))
    return sent.select(F.from_json("sent", schema).alias("r")).select("r.*")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size")
    item = F.struct(
        F.col("p_partkey").cast("string").alias("asin"),
        F.struct(F.struct(F.col("p_name").alias("displayValue")).alias("title"), F.when(k % 3 > 0, F.struct(F.array("p_brand", "p_type").alias("displayValues"))).alias("features")).alias("itemInfo"),
        F.when(k % 5 > 0, F.struct(F.struct(F.struct(F.concat(F.lit("https://img.example/"), "p_partkey").alias("url")).alias("large")).alias("primary"))).alias("images"),
        F.when(k % 4 > 0, F.struct(F.array(F.struct(F.struct(F.struct(F.col("p_retailprice").alias("amount")).alias("money")).alias("price"))).alias("listings"))).alias("offersV2"),
    )
    return offers.catalogue_a(_answers(table(spark, sf_dir, "part"), item, "items", schemas.RESPONSE_A), tag="t")


_CATALOGUE = (
    "SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, CASE WHEN p_size % 4 > 0 THEN CAST(trunc(p_retailprice) AS BIGINT) ELSE 0 END AS price, CASE WHEN p_size % 3 > 0 THEN p_brand || '; ' || p_type ELSE '' END AS features,"
    " 'https://shop-a.example/item/' || p_partkey || '?tag=t' AS url, CASE WHEN p_size % 5 > 0 THEN 'https://img.example/' || p_partkey END AS image FROM part"
)


@query(_CATALOGUE)
def s5_catalogue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir).select("item_id", "title", "price", F.array_join("features", "; ").alias("features"), "url", "image")


@query(f"WITH a AS ({_CATALOGUE}) SELECT item_id, price, 0 AS branch FROM a WHERE price > 1200 UNION ALL SELECT item_id, price, 1 FROM a WHERE price <= 1200 OR price IS NULL")
def s7_lookup_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _catalogue(spark, sf_dir)
    return offers.targets_then_search(found.where("price > 1200"), found).select("item_id", "price", "branch")


def _shop_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size")
    plain = F.struct(
        k.cast("int").alias("rank"), F.col("p_name").alias("itemName"), F.floor("p_retailprice").alias("itemPrice"), F.when(k % 2 == 0, F.concat(F.lit("https://r.example/"), "p_partkey")).otherwise("").alias("affiliateUrl"), F.concat(F.lit("https://b.example/"), "p_partkey").alias("itemUrl"),
        F.when(k % 3 > 0, F.array(F.struct(F.concat(F.lit("https://img.example/"), "p_partkey").alias("imageUrl")))).otherwise(F.array()).alias("mediumImageUrls"), F.when(k % 7 > 0, F.col("p_partkey").cast("string")).alias("itemCode"), F.when(k % 4 > 0, F.col("p_partkey")).alias("reviewCount"),
    )
    names = [f.name for f in table(spark, sf_dir, "part").select(plain.alias("x")).schema["x"].dataType]
    wrapped = F.when(k % 2 == 1, plain)
    item = F.struct(wrapped.alias("Item"), *(F.when(k % 2 == 0, plain[n]).alias(n) for n in names))
    return _answers(table(spark, sf_dir, "part"), item, "Items", schemas.RESPONSE_B)


_SHOP_B = (
    "p_name AS title, CAST(floor(p_retailprice) AS BIGINT) AS price, CASE WHEN p_size % 2 = 0 THEN 'https://r.example/' || p_partkey ELSE 'https://b.example/' || p_partkey END AS url,"
    " CASE WHEN p_size % 3 > 0 THEN 'https://img.example/' || p_partkey ELSE '' END AS image, CASE WHEN p_size % 4 > 0 THEN p_partkey ELSE 0 END AS review_count"
)


@query(f"SELECT {_SHOP_B}, CASE WHEN p_size % 7 > 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS item_code FROM part")
def s8_search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.search_b(_shop_b(spark, sf_dir)).select("title", "price", "url", "image", "review_count", "item_code")


@query(f"SELECT {_SHOP_B}, CASE WHEN p_size % 7 > 0 THEN CAST(p_partkey AS VARCHAR) END AS item_code, CAST(p_size AS INTEGER) AS rank FROM part")
def s9_ranked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offers.ranking_b(_shop_b(spark, sf_dir)).select("title", "price", "url", "image", "review_count", "item_code", "rank")


@query(
    "SELECT p_name AS title, CASE WHEN p_size % 3 > 0 THEN p_brand || ', ' || p_type ELSE 'unknown' END AS authors, CASE WHEN p_size % 4 > 0 THEN p_type ELSE 'no description' END AS description, 'https://books.example/' || p_partkey AS url,"
    " CASE WHEN p_size % 5 = 0 THEN 'https://t.example/s' || p_partkey WHEN p_size % 5 = 1 THEN NULL ELSE 'https://t.example/' || p_partkey END AS image, CASE WHEN contains(p_name, 'ring') THEN p_name || ' book' ELSE p_name || ' ring book' END AS asked FROM part"
)
def s11_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size")
    thumbs = F.struct(F.when(k % 5 > 0, F.concat(F.lit("http://t.example/"), "p_partkey")).otherwise("").alias("thumbnail"), F.concat(F.lit("https://t.example/s"), "p_partkey").alias("smallThumbnail"))
    item = F.struct(F.struct(F.col("p_name").alias("title"), F.when(k % 3 > 0, F.array("p_brand", "p_type")).alias("authors"), F.when(k % 4 > 0, F.col("p_type")).alias("description"), F.concat(F.lit("https://books.example/"), "p_partkey").alias("infoLink"), F.when(k % 5 != 1, thumbs).alias("imageLinks")).alias("volumeInfo"))
    found = offers.books(_answers(table(spark, sf_dir, "part"), item, "items", schemas.RESPONSE_BOOKS))
    return found.select("title", F.array_join("authors", ", ").alias("authors"), "description", "url", "image", offers.book_query(F.col("title"), "ring", "book").alias("asked"))


@query("SELECT p_name AS title, 'https://video.example/watch?v=' || p_partkey AS url, CASE WHEN p_size % 3 > 0 THEN 'https://img.example/' || p_partkey END AS thumbnail FROM part")
def s12_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.struct(F.struct(F.concat(F.lit("https://img.example/"), "p_partkey").alias("url")).alias("high"))
    item = F.struct(F.struct(F.col("p_partkey").cast("string").alias("videoId")).alias("id"), F.struct(F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 > 0, shown).alias("thumbnails")).alias("snippet"))
    return offers.videos(_answers(table(spark, sf_dir, "part"), item, "items", schemas.RESPONSE_VIDEOS)).select("title", "url", "thumbnail")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN left(p_type, 20) ELSE 'toys' END AS term FROM part")
def p5_search_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 3
    keyword = F.when(k == 0, F.col("p_brand")).when(k == 1, "")
    return table(spark, sf_dir, "part").select("p_partkey", offers.search_term(keyword, F.when(k == 1, F.col("p_type")).when(k == 2, F.lit("")), "toys").alias("term"))


@query("SELECT p_partkey, i AS pos, p_name || ' ' || i AS title, CASE WHEN i % 2 = 0 THEN 'https://maker.example/g/' || p_partkey ELSE 'http://other.example/' || p_partkey END AS url FROM part, (SELECT unnest(range(0, 5)) AS i) WHERE i <= p_size % 7 AND p_size % 11 > 0")
def s13_maker_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = lambda i: F.when(i % 2 == 0, F.concat(F.lit("/g/"), "p_partkey")).otherwise(F.concat(F.lit("http://other.example/"), "p_partkey"))
    one = lambda i: F.concat(F.lit("<div class='x item'><a href='"), link(i), F.lit("'>more</a><p class='name'> "), F.col("p_name"), F.lit(" <b>"), i.cast("string"), F.lit("</b></p></div>"))
    html = F.when(F.col("p_size") % 11 > 0, F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size") % 7), one), "<hr>"), F.lit("<div class='item'><h2>no link</h2></div>"))).otherwise("<p>none</p>")
    pages = relational.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", html.alias("html"))
    return pages.select("p_partkey", F.posexplode(markup.maker_items("html", "https://maker.example/shop/list.aspx")).alias("pos", "i")).select("p_partkey", F.col("pos").cast("long").alias("pos"), "i.title", "i.url")


@query("SELECT p_brand, p_size, i - 1 AS pos, names[i] AS title, 'https://x.example/' || keys[i] AS url FROM (SELECT p_brand, p_size, list(p_name ORDER BY p_partkey) AS names, list(p_partkey ORDER BY p_partkey) AS keys FROM part GROUP BY ALL), (SELECT unnest(range(1, 11)) AS i) WHERE i <= len(names)")
def s14_xml_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each brand and size, of which the first ten items are read."""
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    item = F.concat(F.lit("<item>"), tag("title", F.col("p_name")), tag("link", F.concat(F.lit("https://x.example/"), "p_partkey")), F.lit("</item>"))
    groups = relational.collected(table(spark, sf_dir, "part"), ["p_brand", "p_size"], [F.col("p_partkey")], item, "items")
    feeds = groups.select("p_brand", "p_size", F.concat(F.lit("<rss><channel><title>all</title>"), F.array_join("items", ""), F.lit("</channel></rss>")).alias("xml"))
    found = feeds.select("p_brand", "p_size", F.posexplode(markup.feed_items("xml", 10)).alias("pos", "i"))
    return found.select("p_brand", "p_size", F.col("pos").cast("long").alias("pos"), "i.title", F.col("i.link").alias("url"))


_LINKS_SQL = "SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '<li><a href=\"([^\"]*)\">[^<]*</a>', 1) AS u, regexp_extract_all(regexp_extract(html, '(?s)<nav[^>]*>(.*?)</nav>', 1), '<li><a href=\"[^\"]*\">([^<]*)</a>', 1) AS t FROM pages"


@query(
    f"WITH l AS ({_LINKS_SQL}) SELECT page_id, i - 1 AS pos, trim(t[i]) AS title, 'https://maker.example' || u[i] AS url, 'page' AS origin FROM l, (SELECT unnest(range(1, 6)) AS i) WHERE page_id % 7 > 1 AND i <= len(t)"
    " UNION ALL SELECT page_id, i, 'away ' || i, 'https://maker.example/' || i, 'unreachable' FROM pages, (SELECT unnest(range(0, 3)) AS i) WHERE page_id % 7 = 0 UNION ALL SELECT page_id, i, 'none ' || i, 'https://maker.example/', 'nothing' FROM pages, (SELECT unnest(range(0, 2)) AS i) WHERE page_id % 7 = 1"
)
def s15_item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages by a lateral join: some could not be had, some hold no item, and fixed rows stand for these."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 7 == 1, F.regexp_replace("html", "(?s)<nav.*?</nav>", "")).when(F.col("page_id") % 7 > 1, F.col("html")).alias("html"))
    fixed = {"unreachable": [(f"away {i}", f"https://maker.example/{i}") for i in range(3)], "nothing": [(f"none {i}", "https://maker.example/") for i in range(2)]}
    rows = tables.maker_rows("https://maker.example/shop/list", **fixed, containers=(".goods_list_item", "nav li"), names=(".name", "a"))
    return pages.lateralJoin(rows(F.col("html").outer())).select("page_id", F.col("pos").cast("long").alias("pos"), "title", "url", "origin")


@query(f"WITH l AS ({_LINKS_SQL}) SELECT page_id, i - 1 AS pos, trim(t[i]) AS title, u[i] AS url FROM l, (SELECT unnest(range(1, 4)) AS i) WHERE i <= least(len(t), CASE WHEN page_id % 5 = 0 THEN 2 ELSE 3 END)")
def s16_related_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three links of all pages by a lateral join; every fifth page breaks off after its second."""
    cut = F.regexp_extract("html", "(?s)^(.*?<li>.*?<li>.*?</a>)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 5 == 0, cut).otherwise(F.col("html")).alias("html"))
    return pages.lateralJoin(tables.related_rows("nav li", "a")(F.col("html").outer())).select("page_id", F.col("pos").cast("long").alias("pos"), "title", "url")


_FEED_SQL = """i AS (SELECT l_orderkey, l_linenumber, 'line ' || l_partkey AS title, CASE WHEN l_linenumber % 4 > 0 THEN CAST(l_suppkey AS VARCHAR) END AS extra FROM lineitem),
x AS (SELECT *, '<item><title>' || title || '</title><link>https://x.example/' || l_linenumber || '</link>' || CASE WHEN extra IS NULL THEN '' ELSE '<pubDate>' || extra || '</pubDate><ht:approx_traffic>' || extra || '</ht:approx_traffic>' END || '</item>' AS text FROM i),
p AS (SELECT *, row_number() OVER w - 1 AS pos, sum(len(text)) OVER w AS ends, sum(len(text)) OVER (PARTITION BY l_orderkey) AS size FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, title, extra)),
f AS (SELECT * FROM p WHERE l_orderkey % 3 > 0 OR ends <= size // 2)"""


def _order_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed for each order with its lines as items; every third one breaks off in the middle."""
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    title, extra = F.concat(F.lit("line "), "l_partkey"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_suppkey").cast("string"))
    item = F.concat(F.lit("<item>"), tag("title", title), tag("link", F.concat(F.lit("https://x.example/"), "l_linenumber")), F.coalesce(F.concat(tag("pubDate", extra), tag("ht:approx_traffic", extra)), F.lit("")), F.lit("</item>"))
    feeds = relational.collected(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), title, extra], item, "items")
    feeds = feeds.select("l_orderkey", F.array_join("items", "").alias("items"))
    head = "<rss xmlns:ht='https://trends.example/'><channel><title>all</title>"
    broken = F.concat(F.lit(head), F.expr("substring(items, 1, cast(length(items) div 2 as int))"))
    return feeds.select("l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, broken).otherwise(F.concat(F.lit(head), "items", F.lit("</channel></rss>"))).alias("xml"))


@query(f"WITH {_FEED_SQL} SELECT l_orderkey, pos, title AS query, coalesce(extra, 'unknown') AS traffic FROM f UNION ALL SELECT l_orderkey, 0, 'toys', '50,000+' FROM p GROUP BY l_orderkey HAVING NOT bool_or(l_orderkey % 3 > 0 OR ends <= size // 2)")
def s13_trend_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of a feed for each order; those that break off before the end of an item give the fallback row."""
    found = _order_feeds(spark, sf_dir).select("l_orderkey", F.inline(tables.trend_items("xml", ("toys", "50,000+"))))
    return found.select("l_orderkey", F.col("pos").cast("long").alias("pos"), "query", "traffic")


@query(f"WITH {_FEED_SQL} SELECT l_orderkey, pos, title, 'https://x.example/' || l_linenumber AS url, extra AS published FROM f WHERE pos < 10 AND pos < coalesce((SELECT min(g.pos) FROM f g WHERE g.l_orderkey = f.l_orderkey AND g.extra IS NULL), 1000)")
def s14_news_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News of the same feeds: up to the place where a feed breaks off, or to an item without a date."""
    found = _order_feeds(spark, sf_dir).select("l_orderkey", F.inline(tables.news_items("xml")))
    return found.select("l_orderkey", F.col("pos").cast("long").alias("pos"), "title", "url", "published")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'none' END AS known, CASE p_brand WHEN 'Brand#2' THEN 'one' WHEN 'Brand#4' THEN 'two' END AS by_column FROM part")
def p_map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.create_map(F.when(F.col("p_size") % 2 == 0, "name").otherwise("other"), F.col("p_name"))
    labels = F.create_map(F.lit("Brand#2"), F.lit("one"), F.lit("Brand#4"), F.lit("two"))
    return table(spark, sf_dir, "part").select("p_partkey", S.map_value(held, "name", "none").alias("known"), S.map_value(labels, F.col("p_brand")).alias("by_column"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 < 3 OR value IS NULL THEN 5 ELSE greatest(1, least(CAST(round(value) AS BIGINT), 50)) END AS INTEGER) AS n FROM events")
def s17_int_option_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 1, "").when(k == 2, "x1").when(k > 2, F.round("value").cast("long").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.int_option(raw, 5, 1, 50).alias("n"))


@query("SELECT event_id, 'high' AS rule FROM events WHERE value > 90 UNION ALL SELECT event_id, 'kind' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'there' FROM events WHERE value IS NULL")
def d14_constraints_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"high": F.col("value") <= 90, "kind": F.col("event_type") != "error", "there": F.col("value").isNotNull()}
    return validate.constraint_violations(table(spark, sf_dir, "events"), "event_id", rules)


@query("SELECT o_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS twice FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def p12_nested_projection_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = relational.collected(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber")], F.struct("l_linenumber", "l_partkey", "l_quantity"), "lines")
    docs = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    twice = F.transform("lines", lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].alias("l_partkey"), (x["l_quantity"] * 2).alias("twice")))
    return docs.select("o_orderkey", F.explode(twice).alias("x")).select("o_orderkey", "x.*")


# Sinks -------------------------------------------------------------------------------------------------------------


@query("SELECT p_brand AS run_date, p_partkey AS slug, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind FROM part WHERE p_brand <> 'Brand#17' UNION ALL SELECT p_brand, p_partkey, 'again', NULL FROM part WHERE p_brand = 'Brand#17' AND p_size > 10")
def k1_documents_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by partition; one partition is written again and replaced."""
    where = files.scratch(spark, "documents")
    docs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("run_date"), F.col("p_partkey").alias("slug"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"), "p_size")
    files.write_documents(docs.drop("p_size"), where, "run_date")
    files.write_documents(docs.where("run_date = 'Brand#17' and p_size > 10").select("run_date", "slug", F.lit("again").alias("title"), F.lit(None).cast("string").alias("kind")), where, "run_date")
    return spark.read.schema("slug BIGINT, title STRING, kind STRING, run_date STRING").json(where).select("run_date", "slug", "title", "kind")


@query("SELECT CAST(p_partkey AS VARCHAR) AS item_code, CAST(p_size + 1 AS INTEGER) AS rank FROM part")
def k4_ranks_by_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table written, read, changed and written again."""
    kept = files.Snapshots(spark, files.scratch(spark, "ranks"), schemas.RANKS)
    kept.write(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item_code"), F.col("p_size").cast("int").alias("rank")), "r1", datetime(2024, 1, 1))
    kept.write(kept.read().withColumn("rank", F.col("rank") + 1), "r2", datetime(2024, 1, 2))
    return kept.read()


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, '# ' || p_name || chr(10) || p_type AS content FROM part")
def k2_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part, written by the tasks and read back."""
    where = files.scratch(spark, "texts")
    named.write_named(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), F.concat(F.lit("# "), "p_name", F.lit("\n"), "p_type").alias("content")), where, ".md", folders=1024)
    return named.read_named(spark, where, ".md")


@query("SELECT p_partkey, '{\"p_partkey\":' || p_partkey || ',\"p_name\":\"' || p_name || '\",\"size\":' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE CAST(p_size AS VARCHAR) END || '}' AS json FROM part")
def k8_json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files.as_json(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 1, F.col("p_size")).alias("size")))
    return docs.select(F.get_json_object("json", "$.p_partkey").cast("long").alias("p_partkey"), "json")


@query("SELECT '/p/' || p_partkey AS permalink, CAST((row_number() OVER (ORDER BY p_size DESC, '/p/' || p_partkey) - 1) // 10 + 1 AS INTEGER) AS page FROM part")
def k9_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.concat(F.lit("/p/"), "p_partkey").alias("permalink"), F.col("p_type").alias("summary"), F.col("p_brand").alias("content"), "p_size")
    return files.index_rows(posts, "p_size").select("permalink", "page")


_BROKEN = "s_suppkey % 5 = 4"


def _written_suppliers(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a JSON document for each supplier, some of them cut off, and files of another kind."""
    where = files.scratch(spark, "raw")
    whole = F.to_json(F.struct(F.array(F.struct(F.col("s_name").alias("title"), F.concat(F.lit("/s/"), "s_suppkey").alias("url")), F.struct(F.lit("more").alias("title"), F.lit(None).cast("string").alias("url"))).alias("items")))
    suppliers = table(spark, sf_dir, "supplier")
    named.write_named(suppliers.select(F.concat(F.lit("s-"), "s_suppkey").alias("name"), F.when(F.expr(_BROKEN), F.substring(whole, 1, 20)).otherwise(whole).alias("content")), where, ".json")
    named.write_named(suppliers.where("s_suppkey % 7 = 0").select(F.concat(F.lit("notes-"), "s_suppkey").alias("name"), F.lit("no").alias("content")), where, ".txt")
    return where


@query(f"SELECT 's-' || s_suppkey AS stem, 0 AS pos, s_name AS title, '/s/' || s_suppkey AS url FROM supplier WHERE NOT {_BROKEN} UNION ALL SELECT 's-' || s_suppkey, 1, 'more', NULL FROM supplier WHERE NOT {_BROKEN}")
def s1_json_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.scan_json(spark, _written_suppliers(spark, sf_dir), schemas.FEEDS["maker"])
    return found.rows.select("stem", F.posexplode("items").alias("pos", "i")).select("stem", "pos", "i.title", "i.url")


@query(f"SELECT 's-' || s_suppkey AS stem, 20::BIGINT AS size FROM supplier WHERE {_BROKEN}")
def s2_json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.scan_json(spark, _written_suppliers(spark, sf_dir), schemas.FEEDS["maker"])
    return found.rejects.select("stem", F.length("content").cast("long").alias("size"))


@query("SELECT 's-' || s_suppkey AS stem FROM supplier")
def s3_file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_stems(spark, _written_suppliers(spark, sf_dir))


@query("SELECT 'c' || c_custkey AS item_code, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-02 03:04:05.678' END AS seen_at, c_nationkey || ' x' AS title, CAST(c_custkey AS INTEGER) AS rank FROM customer")
def s4_state_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all customers, a document for each hundred keys, read back as two keyed tables."""
    where = files.scratch(spark, "state")
    code = F.concat(F.lit("c"), "c_custkey")
    seen = F.struct(F.when(F.col("c_custkey") % 2 == 0, "2024-01-02T03:04:05.678").alias("seen_at"), F.concat("c_nationkey", F.lit(" x")).alias("title"))
    held = table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 100).cast("string").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct(code, seen))).alias("history"), F.map_from_entries(F.collect_list(F.struct(code, "c_custkey"))).alias("last_rankings"))
    named.write_named(held.select("name", F.to_json(F.struct("history", "last_rankings")).alias("content")), where, ".json")
    history, ranks = files.read_state(spark, where, schemas.STATE)
    return history.join(ranks, "item_code")


@query(
    "SELECT 'a' || s_suppkey AS slug, 0::BIGINT AS pos, CASE WHEN s_suppkey % 4 > 1 THEN s_name END AS title, 'v' || s_suppkey AS embed FROM supplier WHERE s_suppkey % 4 > 0 UNION ALL SELECT 'a' || s_suppkey, 1, CASE WHEN s_suppkey % 4 > 1 THEN 'two' END, 'w' FROM supplier WHERE s_suppkey % 4 > 0"
    " UNION ALL SELECT 'reject', count(*), NULL, NULL FROM supplier WHERE s_suppkey % 8 = 4"
)
def s2_drifting_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for each supplier, of one of four shapes or cut off, brought to one shape by way of VARIANT; rejects are counted."""
    where = files.scratch(spark, "articles")
    k = F.col("s_suppkey") % 4
    first = F.concat(F.lit("v"), "s_suppkey")
    two = lambda field: F.array(F.struct(F.col("s_name").alias("title"), first.alias(field)), F.struct(F.lit("two").alias("title"), F.lit("w").alias(field)))
    doc = F.to_json(F.struct(F.concat(F.lit("a"), "s_suppkey").alias("slug"), F.when(k == 1, F.array(first, F.lit("w"))).alias("youtube_embeds"), F.when(k == 2, two("embed")).alias("videos")))
    other = F.to_json(F.struct(F.concat(F.lit("a"), "s_suppkey").alias("slug"), F.when(k == 3, two("embed_html")).alias("youtube_embeds")))
    content = F.when(F.col("s_suppkey") % 8 == 4, F.lit('{"slug": "cut')).when(k == 3, other).otherwise(doc)
    named.write_named(table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("name"), content.alias("content")), where, ".json")
    found = files.scan_drifting(spark, where, schemas.ARTICLE, schemas.DRIFTING)
    videos = found.rows.select("slug", F.posexplode("videos").alias("pos", "v")).select("slug", F.col("pos").cast("long").alias("pos"), "v.title", "v.embed")
    rejects = found.rejects.agg(F.count("*").alias("pos")).select(F.lit("reject").alias("slug"), "pos", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("embed"))
    return videos.unionByName(rejects)


@query(
    "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16'),"
    " a AS (SELECT user_id, event_type, value FROM e WHERE n = 1 AND event_type <> 'error'), b AS (SELECT user_id, event_type, value FROM o WHERE n = 1 AND event_type <> 'error')"
    " SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'inserted' WHEN a.user_id IS NULL THEN 'removed' ELSE 'updated' END AS change, b.event_type AS old_type, a.event_type AS new_type, b.value AS old_value, a.value AS new_value"
    " FROM a FULL JOIN b ON a.user_id = b.user_id WHERE b.user_id IS NULL OR a.user_id IS NULL OR a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value"
)
def d4_changed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second half of the events changed in the last event of each user, users whose last is an error being gone."""
    events = table(spark, sf_dir, "events").where("user_id is not null")
    kept = files.Snapshots(spark, files.scratch(spark, "users"), "user_id BIGINT, event_type STRING, value DOUBLE")
    last = lambda df: df.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*").where("event_type <> 'error'")
    kept.write(last(events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))), "r1", datetime(2024, 1, 16))
    kept.write(last(events), "r2", datetime(2024, 2, 1))
    found = kept.changed("r2", ["user_id"])
    return found.select("user_id", "change", F.col("before.event_type").alias("old_type"), F.col("after.event_type").alias("new_type"), F.col("before.value").alias("old_value"), F.col("after.value").alias("new_value"))


@query("SELECT r_regionkey AS k, 'none' AS title FROM region")
def s4_missing_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    default = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.lit("none").alias("title"))
    return files.read_json_or(spark, f"{files.scratch(spark, 'nothing')}/state.json", "k BIGINT, title STRING", default)


def _paged_answers(spark: SparkSession, sf_dir: str, end: str, size: int, item: F.Column, body) -> dict:
    """Options of a feed whose pages of suppliers lie in files, written by the tasks."""
    remote.register(spark)
    where = files.scratch(spark, "answers")
    placed = relational.numbered_by_range(table(spark, sf_dir, "supplier"), F.col("s_suppkey").asc_nulls_last())
    pages = relational.collected(placed.withColumn("page", F.floor((F.col("place") - 1) / size)), ["page"], [F.col("place")], item, "items")
    total = table(spark, sf_dir, "supplier").agg(F.count("*").alias("total"))
    named.write_named(pages.crossJoin(total).select(F.concat(F.lit(f"{end}-"), F.col("page") * size + 1).alias("name"), F.to_json(body).alias("content")), where, ".json")
    return {"transport": "fennelmill.sources.remote:recorded_folder", "answers": named.qualified(spark, where), "page_parameter": "start", "page_size": str(size)}


@query("SELECT CAST(s_suppkey AS VARCHAR) AS item_id, s_name AS title, CAST((row_number() OVER (ORDER BY s_suppkey) - 1) // 10 AS INTEGER) AS page FROM supplier")
def s6_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword search over all its pages, asked for by several tasks."""
    item = F.struct(F.col("s_suppkey").cast("string").alias("asin"), F.struct(F.struct(F.col("s_name").alias("displayValue")).alias("title")).alias("itemInfo"))
    options = _paged_answers(spark, sf_dir, "searchItems", 10, item, F.struct(F.struct("items", F.col("total").alias("totalResultCount")).alias("searchResult")))
    read = spark.read.format("feed").options(feed="search_a", page_total="searchResult.totalResultCount", **options).load().where("keyword = 'k'")
    answers = read.select("page", F.from_json("response", schemas.RESPONSE_A).alias("r")).select("page", F.explode("r.items").alias("i"))
    return answers.select(F.col("i.asin").alias("item_id"), F.col("i.itemInfo.title.displayValue").alias("title"), "page")


@query("SELECT s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'https://referral.example/x' || s_suppkey ELSE 'https://referral.example/go?sid=s&pid=p&vc_url=' || url_encode('https://c.example/' || s_suppkey) END AS url, 100 * s_suppkey AS price FROM supplier")
def s10_feed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of the third marketplace through the data source, page by page from recorded files."""
    item = F.struct(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://referral.example/x"), "s_suppkey")).otherwise(F.concat(F.lit("https://c.example/"), "s_suppkey")).alias("url"), (F.col("s_suppkey") * 100).alias("price"))
    options = _paged_answers(spark, sf_dir, "search", 50, item, F.struct(F.col("items").alias("hits"), F.col("total").alias("totalResultsAvailable")))
    read = spark.read.format("feed").options(feed="hits_c", page_total="totalResultsAvailable", interval="0.01", **options).load().where("keyword = 'k'")
    return offers.hits_c(read.select(F.from_json("response", schemas.RESPONSE_C).alias("r")).select("r.*"), site="s", partner="p").select("title", "url", "price")


@query("SELECT 'post-' || s_suppkey AS name, 'About \"' || s_name || '\"' AS title, 'x, ' || s_nationkey AS tags, '# ' || s_name || chr(10) || 'text' AS body FROM supplier")
def s18_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts written as Markdown with a header, a file each, and read back."""
    where = files.scratch(spark, "posts")
    post = F.concat(F.lit("---\ntitle: "), render.quoted(F.concat(F.lit('About "'), "s_name", F.lit('"'))), F.lit("\ntags:\n- x\n- "), render.quoted(F.col("s_nationkey").cast("string")), F.lit("\n---\n# "), F.col("s_name"), F.lit("\ntext"))
    named.write_named(table(spark, sf_dir, "supplier").select(F.concat(F.lit("post-"), "s_suppkey").alias("name"), post.alias("content")), where, ".md")
    found = files.read_posts(spark, where)
    return found.select("name", F.col("front_matter")["title"].alias("title"), F.array_join(F.from_json(F.col("front_matter")["tags"], "array<string>"), ", ").alias("tags"), "body")


@query("SELECT min(p_partkey) + 1 AS seq, count(*) - 1 AS n FROM part")
def k6_queue_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue without its head, written as the next snapshot; its new head and length."""
    kept = files.Snapshots(spark, files.scratch(spark, "queue"), schemas.TOPIC)
    kept.write(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.lit("m").alias("mode"), F.col("p_name").alias("keyword"), F.lit("").alias("item_id")), "r1", datetime(2024, 1, 1))
    rest = tasks.pop(kept.read(), tasks.default_topic(spark))[1]
    kept.write(rest, "r2", datetime(2024, 1, 2))
    return kept.read().agg(F.min("seq").alias("seq"), F.count("*").alias("n"))


# Whole documents ---------------------------------------------------------------------------------------------------

_SCORED = (
    "SELECT p_partkey, p_brand, p_name AS name, CAST(floor(p_retailprice * 8) AS BIGINT) AS price, 'https://a.example/' || p_partkey AS link_a, CASE WHEN p_size % 2 = 0 THEN 'https://b.example/' || p_partkey ELSE '' END AS link_b, CASE WHEN p_size % 3 = 0 THEN 'https://img.example/' || p_partkey ELSE '' END AS image,"
    " [p_brand, p_type, p_name, 'more'][1:p_size % 5] AS features, round(least(3.8::DOUBLE + CASE WHEN p_size % 5 > 3 THEN 0.5 ELSE 0.0 END::DOUBLE + CASE WHEN contains(p_name, 'STEM') THEN 0.4 ELSE 0.0 END::DOUBLE + CASE WHEN floor(p_retailprice * 8) > 5000 THEN -0.2 ELSE 0.0 END::DOUBLE + CASE WHEN p_size * 4 > 100 THEN 0.3 ELSE 0.0 END::DOUBLE, 5.0), 1) AS score,"
    " CASE WHEN p_size % 5 = 0 THEN ['well rated', 'a standard choice'] ELSE [p_brand, p_type, p_name, 'more'][1:least(p_size % 5, 2)] END AS pros, CASE WHEN floor(p_retailprice * 8) > 10000 THEN 'rather costly' ELSE 'nothing in particular' END AS cons FROM part"
)


def _scored(parts: DataFrame, *keep: str) -> DataFrame:
    k = F.col("p_size")
    features = F.slice(F.array("p_brand", "p_type", "p_name", F.lit("more")), F.lit(1), k % 5)
    base = parts.select(*keep, "p_partkey", "p_brand", F.col("p_name").alias("name"), F.floor(F.col("p_retailprice") * 8).alias("price"), F.concat(F.lit("https://a.example/"), "p_partkey").alias("link_a"), F.when(k % 2 == 0, F.concat(F.lit("https://b.example/"), "p_partkey")).otherwise("").alias("link_b"), F.when(k % 3 == 0, F.concat(F.lit("https://img.example/"), "p_partkey")).otherwise("").alias("image"), features.alias("features"), (k * 4).alias("reviews"))
    return base.select("*", articles.rule_score("name", "features", "price", "reviews").alias("score"), articles.pros_of("features").alias("pros"), articles.cons_of("price").alias("cons"))


@query(f"SELECT p_partkey, score, array_to_string(pros, ', ') AS pros, cons FROM ({_SCORED})")
def d7_scores_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(table(spark, sf_dir, "part")).select("p_partkey", "score", F.array_join("pros", ", ").alias("pros"), F.array_join("cons", ", ").alias("cons"))


_NL = "chr(10)"


@query(
    f"WITH s AS ({_SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS i, price = min(CASE WHEN price > 0 THEN price END) OVER (PARTITION BY p_brand) AS lowest FROM s),"
    f" t AS (SELECT *, '| ' || i || ' | ' || left(name, 20) || '... | ' || score || ' | ' || pros[1] || ' | [more](' || link_a || ') |' AS line,"
    f" '### ' || name || {_NL} || CASE WHEN image <> '' THEN '![' || name || '](' || image || ')' || {_NL} ELSE '' END || '- **price**: ' || price || CASE WHEN lowest THEN ' **(lowest)**' ELSE '' END || {_NL} || '- **score**: ' || score || '/5.0' || {_NL}"
    f" || '- [shop A](' || link_a || ') / [shop B](' || CASE WHEN link_b = '' THEN '#' ELSE link_b END || ') / [shop C](#)' || {_NL} || '> **for**: ' || array_to_string(pros, ', ') || {_NL} || '> **against**: ' || cons || {_NL} || '#### Features' || {_NL}"
    f" || CASE WHEN len(features) > 0 THEN '- ' || array_to_string(features, {_NL} || '- ') || {_NL} ELSE '' END || '---' AS part FROM r),"
    f" g AS (SELECT p_brand, string_agg(line, {_NL} ORDER BY i) FILTER (i <= 3) AS top, string_agg(part, {_NL} ORDER BY i) AS parts, min(p_partkey) AS k FROM t GROUP BY 1)"
    f" SELECT p_brand AS name, '---' || {_NL} || 'date: \"2024-02-01T09:30:00+09:00\"' || {_NL} || 'draft: false' || {_NL} || 'slug: \"' || p_brand || '\"' || {_NL} || 'tags:' || {_NL} || '- \"' || p_brand || '\"' || {_NL} || '- \"a \\\"b\\\"\"' || {_NL} || 'title: \"All of ' || p_brand || '\"' || {_NL} || '---' || {_NL} || {_NL}"
    f" || '# All of ' || p_brand || {_NL} || '> Links may be referral links. Updated: 2024-02-01' || {_NL} || 'A lead.' || {_NL} || '> Why now: new' || {_NL} || '## Top three' || {_NL} || '| no. | item | score | why | link |' || {_NL} || '|:---:|:---|:---:|:---|:---:|' || {_NL} || top || {_NL} || '## All items' || {_NL} || parts || {_NL}"
    f" || '## Videos' || {_NL} || '### v' || k || {_NL} || '<iframe></iframe>' || {_NL} || '## Books' || {_NL} || '### [b' || k || '](https://books.example/)' || {_NL} || 'about it' || {_NL} || '## Read on' || {_NL} || '- [one](/1)' || {_NL} || '- [two](/2)' || {_NL} || '> **A word from us**: Choose well.' || {_NL} || '---' || {_NL} || 'Prices and stock are those of the time of writing.' AS content FROM g"
)
def d10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each brand, of all its parts, as a whole text."""
    product = F.struct(F.col("p_partkey").cast("string").alias("item_id"), "name", "price", "link_a", "link_b", F.lit(None).cast("string").alias("link_c"), "image", "score", "pros", "cons", "features")
    scored = _scored(table(spark, sf_dir, "part"))
    groups = relational.collected(scored, ["p_brand"], [-F.col("score"), F.col("p_partkey")], product, "products")
    first = scored.groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    text = lambda s: F.lit(s)
    nothing = F.array().cast("array<struct<title:string,url:string>>")
    docs = groups.join(first, "p_brand").select(
        F.col("p_brand").alias("slug"), F.concat(F.lit("All of "), "p_brand").alias("title"), text("2024-02-01T09:30:00+09:00").alias("date"), text("A lead.").alias("lead"), text("new_arrival").alias("signal_type"), text("new").alias("signal_type_label"), "products",
        F.array(F.struct(F.concat(F.lit("v"), "k").alias("title"), text("<iframe></iframe>").alias("embed"))).alias("videos"),
        F.array(F.struct(F.concat(F.lit("b"), "k").alias("title"), text("https://books.example/").alias("url"), text("").alias("image"), text("about it").alias("description"))).alias("books"),
        nothing.alias("news"), nothing.alias("maker_items"), F.array(F.struct(text("one").alias("title"), text("/1").alias("url")), F.struct(text("two").alias("title"), text("/2").alias("url"))).alias("links"),
        text("Choose well.").alias("comment"), F.array(F.col("p_brand"), F.lit('a "b"')).alias("tags"),
    )
    return render.rendered(docs, "2024-02-01")


@query(
    f"WITH s AS ({_SCORED}), l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, s.* FROM lineitem JOIN s ON p_partkey = l_partkey),"
    " g AS (SELECT l_orderkey, arg_min(name, pos) AS first, arg_min(p_brand, pos) AS brand, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY score DESC, pos) AS products, coalesce(string_agg(name, ',' ORDER BY pos) FILTER (pos < 3 AND l_orderkey % 4 > 0), '') AS books, coalesce(string_agg('https://b.example/' || p_partkey, ',' ORDER BY pos) FILTER (link_b <> ''), '') AS links FROM l GROUP BY 1)"
    " SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN 'Rising fast: ' || left(first, 15) || '... and why' WHEN 1 THEN 'First seen: ' || left(first, 15) || '... and what it offers' ELSE brand || ': ranked and compared' END AS title, CASE l_orderkey % 3 WHEN 0 THEN 'sudden_jump' WHEN 1 THEN 'new_arrival' END AS signal_type,"
    " CASE l_orderkey % 3 WHEN 0 THEN 'rising' WHEN 1 THEN 'new' ELSE '' END AS signal_type_label, products, books, links, brand || ',guide,comparison' AS tags FROM g"
)
def d8_articles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for each order, of all its lines as products."""
    of_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("pos", F.row_number().over(of_order) - 1)
    # parts are scored behind the shuffle by orders, which so carries their own columns only
    rows = _scored(lines, "l_orderkey", "pos").withColumn("item_id", F.col("p_partkey").cast("string")).withColumn("link_c", F.lit(None).cast("string"))
    kind = F.when(F.col("l_orderkey") % 3 == 0, "sudden_jump").when(F.col("l_orderkey") % 3 == 1, "new_arrival").otherwise("standard")
    topic, signal = F.struct(F.lit("daily").alias("mode"), F.col("p_brand").alias("keyword")), F.struct(kind.alias("type"), F.col("name").alias("title"))
    book = {"title": F.col("name"), "url": F.col("link_a"), "image": F.col("image"), "description": F.lit("about it")}
    feeds = {"books": (F.col("l_orderkey") % 4 > 0, book), "links": (F.col("link_b") != "", {"title": F.col("name"), "url": F.col("link_b")})}
    made = articles.articles_of("l_orderkey", rows, topic, signal, feeds, datetime(2024, 2, 1, 9, 30))
    ids = lambda a, f: F.array_join(F.transform(a, lambda x: x[f]), ",")
    return made.select("l_orderkey", "title", "signal_type", "signal_type_label", ids("products", "item_id").alias("products"), ids("books", "title").alias("books"), ids("links", "url").alias("links"), F.array_join("tags", ",").alias("tags"))
