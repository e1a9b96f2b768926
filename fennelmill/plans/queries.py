"""Each query binds an operator to columns of the tables; the SQL beside it says the same to DuckDB."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fennelmill.functions import scalars as S
from fennelmill.operators import articles, matching, relational, render, signals, tasks, validate
from fennelmill.plans.registry import QUERIES, Query, query, table
from fennelmill.sources import markup
from fennelmill.sources.files import written

# Signals ----------------------------------------------------------------------------------------------------------

#: The bindings of the arrival patterns to part names.
_ANNOUNCED, _COLLABORATION = "(ECONOMY|PROMO)", "(ring|gear)"
_FROM, _TO = "1995-02-01", "1995-03-01"


def _arrival_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A month of shipped parts as a feed, and the parts shipped before as history."""
    lines = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("title"))
    ts = lambda t: F.lit(t).cast("timestamp_ntz")
    feed = lines.where((F.col("l_shipdate") >= ts(_FROM)) & (F.col("l_shipdate") < ts(_TO))).join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    feed = feed.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").cast("string").alias("item_code"), "title", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("image"), F.floor("l_extendedprice").alias("price"))
    history = lines.where(F.col("l_shipdate") < ts(_FROM)).select(F.col("l_partkey").cast("string").alias("item_code")).distinct()
    return feed, history


def _rankings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users ranked by their events on the last two days of January 2024: the current ranking and the one before."""
    events = table(spark, sf_dir, "events")
    days = events.where(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")).where(F.col("ts") < F.lit("2024-01-31").cast("timestamp_ntz"))
    counts = days.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), "user_id")))
    nothing = F.lit(None).cast("string")
    current = ranked.where("day = date'2024-01-30'").select(F.col("rank").alias("pos"), "rank", F.col("user_id").cast("string").alias("item_code"), F.concat(F.lit("user "), F.col("user_id")).alias("title"), nothing.alias("url"), nothing.alias("image"), F.lit(None).cast("long").alias("price"))
    return current, ranked.where("day = date'2024-01-29'").select(F.col("user_id").cast("string").alias("item_code"), "rank")


_FEED_SQL = f"""feed AS (SELECT l_orderkey * 10 + l_linenumber AS pos, CAST(l_partkey AS VARCHAR) AS item_code, concat_ws(' ', p_name, p_type) AS title, CAST(floor(l_extendedprice) AS BIGINT) AS price
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '{_FROM}' AND l_shipdate < TIMESTAMP '{_TO}'),
history AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS item_code FROM lineitem WHERE l_shipdate < TIMESTAMP '{_FROM}'),
flagged AS (SELECT f.*, h.item_code IS NULL AND row_number() OVER (PARTITION BY f.item_code ORDER BY pos) = 1 AS is_new, regexp_matches(title, '{_ANNOUNCED}') AS is_ann, regexp_matches(title, '{_COLLABORATION}') AS is_col
  FROM feed f LEFT JOIN history h ON h.item_code = f.item_code),
arrivals AS (SELECT CASE WHEN is_new THEN 'new_arrival' ELSE 'preorder' END AS type, item_code, title, price, CAST(NULL AS INTEGER) AS jump, CAST(3 * is_new::INT + 5 * is_ann::INT + 4 * is_col::INT AS DOUBLE) AS score, 0 AS branch, pos FROM flagged WHERE is_new OR is_ann)"""
_RANK_SQL = """counts AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY day ORDER BY n DESC, user_id) AS INTEGER) AS rank FROM counts),
jumps AS (SELECT 'sudden_jump' AS type, CAST(c.user_id AS VARCHAR) AS item_code, 'user ' || c.user_id AS title, CAST(NULL AS BIGINT) AS price, coalesce(p.rank, 101) - c.rank AS jump, (coalesce(p.rank, 101) - c.rank) * 0.5::DOUBLE + 5 AS score, 1 AS branch, CAST(c.rank AS BIGINT) AS pos
  FROM (SELECT * FROM ranked WHERE day = DATE '2024-01-30') c LEFT JOIN (SELECT * FROM ranked WHERE day = DATE '2024-01-29') p ON p.user_id = c.user_id
  WHERE coalesce(p.rank, 101) - c.rank > 20 OR (coalesce(p.rank, 101) = 101 AND c.rank <= 30))"""
_SIGNAL = ("type", "item_code", "title", "price", "jump", "score", "branch", "pos")


@query(f"WITH {_FEED_SQL} SELECT * FROM arrivals")
def d1_new_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, history = _arrival_feed(spark, sf_dir)
    return signals.arrivals(feed, history, _ANNOUNCED, _COLLABORATION).select(*_SIGNAL)


@query(f"WITH {_RANK_SQL} SELECT * FROM jumps")
def d2_rank_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.rank_jumps(*_rankings(spark, sf_dir)).select(*_SIGNAL)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, history = _arrival_feed(spark, sf_dir)
    both = signals.arrivals(feed, history, _ANNOUNCED, _COLLABORATION).unionByName(signals.rank_jumps(*_rankings(spark, sf_dir)), allowMissingColumns=True)
    return both.select(*_SIGNAL)


@query(f"WITH {_FEED_SQL}, {_RANK_SQL} SELECT * FROM arrivals UNION ALL BY NAME SELECT * FROM jumps")
def u1_signal_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir)


@query(f"WITH {_FEED_SQL}, {_RANK_SQL} SELECT * FROM (SELECT * FROM arrivals UNION ALL BY NAME SELECT * FROM jumps) ORDER BY score DESC, branch, pos LIMIT 1")
def d3_top_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.top_signal(_signals(spark, sf_dir))


@query(f"WITH {_FEED_SQL}, {_RANK_SQL}, a AS (SELECT * FROM arrivals UNION ALL BY NAME SELECT * FROM jumps) SELECT 'standard' AS type, 'best of ' || count(*) || ' signals' AS title, max(score) AS score FROM a HAVING coalesce(max(score), 0) <= 100 UNION ALL (SELECT type, title, score FROM a WHERE score > 100 ORDER BY score DESC, branch, pos LIMIT 1)")
def f9_top_signal_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best signal above a score that few reach, or a row made of all signals where there is none."""
    found = _signals(spark, sf_dir)
    default = found.agg(F.lit("standard").alias("type"), F.concat(F.lit("best of "), F.count("*"), F.lit(" signals")).alias("title"), F.max("score").alias("score"))
    best = relational.top_rows(found.where("score > 100"), 1, F.desc("score"), "branch", "pos")
    return relational.or_default(best.select("type", "title", "score"), default)


@query(
    "WITH old AS (SELECT user_id, max(ts) AS seen_at, arg_max(event_type, (ts, event_id)) AS title FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),"
    " fresh AS (SELECT user_id, arg_max(event_type, event_id) AS title FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY 1)"
    " SELECT CAST(coalesce(f.user_id, o.user_id) AS VARCHAR) AS item_code, CASE WHEN f.user_id IS NULL THEN o.seen_at ELSE TIMESTAMP '2024-02-01' END AS seen_at, CASE WHEN f.user_id IS NULL THEN o.title ELSE f.title END AS title FROM old o FULL JOIN fresh f ON f.user_id = o.user_id"
)
def d4_history_rollforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    code = F.col("user_id").cast("string").alias("item_code")
    old = events.where(F.col("ts") < cut).groupBy(code).agg(F.max("ts").alias("seen_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("title"))
    feed = events.where((F.col("ts") >= cut) & (F.col("event_type") != "error")).select(code, F.col("event_type").alias("title"), F.col("event_id").alias("pos"))
    return signals.next_history(old, feed, datetime(2024, 2, 1))


@query(f"WITH {_RANK_SQL} SELECT CAST(user_id AS VARCHAR) AS item_code, rank FROM ranked WHERE day = DATE '2024-01-30'")
def d4_next_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.next_ranks(*_rankings(spark, sf_dir))


@query("SELECT event_id, regexp_matches(event_type, '(click|view)') AS is_announced, regexp_matches(props, '[13579]\\}') AS is_collaboration, (value > 50) IS TRUE AS is_new FROM events WHERE regexp_matches(event_type, '(click|view)') OR value > 50")
def f4_arrival_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", S.matches("event_type", "(click|view)").alias("is_announced"), S.matches("props", r"[13579]\}").alias("is_collaboration"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("is_new"))
    return rows.where("is_announced or is_new")


# Matching ---------------------------------------------------------------------------------------------------------

_TOKENS_SQL = "list_distinct(regexp_extract_all({c}, '([一-龥ぁ-んァ-ンa-zA-Z0-9]+)', 1))"


@query(
    f"WITH l AS (SELECT item_id, {_TOKENS_SQL.format(c='text')} AS t FROM benchmark), r AS (SELECT doc_id, {_TOKENS_SQL.format(c='text')} AS t FROM documents),"
    " a AS (SELECT item_id, unnest(t) AS k FROM l), b AS (SELECT doc_id, unnest(t) AS k FROM r), s AS (SELECT item_id, doc_id, count(*) AS n FROM a JOIN b USING (k) GROUP BY ALL HAVING count(*) >= 2),"
    " m AS (SELECT item_id, arg_max(doc_id, (n, -doc_id)) AS match, max(n) AS score FROM s GROUP BY 1) SELECT item_id, match, score FROM benchmark LEFT JOIN m USING (item_id)"
)
def j1_best_match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.best_match(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


_TOP_THREE = (
    f"WITH l AS (SELECT item_id, {_TOKENS_SQL.format(c='text')} AS t FROM benchmark), r AS (SELECT doc_id, {_TOKENS_SQL.format(c='text')} AS t FROM documents),"
    " a AS (SELECT item_id, unnest(t) AS k FROM l), b AS (SELECT doc_id, unnest(t) AS k FROM r), s AS (SELECT item_id, doc_id, count(*) AS score FROM a JOIN b USING (k) GROUP BY ALL HAVING count(*) >= 2),"
    " m AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS place, doc_id AS match, score FROM s QUALIFY place <= 3)"
)


@query(f"{_TOP_THREE} SELECT * FROM m")
def j6_top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three documents that share most tokens with each item, ties in the documents' order."""
    return matching.best_matches(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query(f"{_TOP_THREE} SELECT item_id AS pos, '2024-02-01-' || replace(text, ' ', '-') AS task_id, string_agg(match, ',' ORDER BY place) AS item_ids, text || ', guide, comparison' AS keywords FROM m JOIN benchmark USING (item_id) GROUP BY item_id, text")
def d11_tasks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each item as a trend, with the three documents that match it best."""
    trends = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("query"))
    made = tasks.tasks_for_trends(trends, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("title")), "2024-02-01")
    return made.select("pos", "task_id", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), F.array_join("keywords", ", ").alias("keywords"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def j2_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@query(
    "WITH t AS (SELECT user_id, event_id, 0 AS branch FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, event_id, 1 AS branch FROM events WHERE event_type = 'click'),"
    " u AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY branch, event_id) AS n FROM (SELECT * FROM t UNION ALL SELECT * FROM s)) SELECT user_id, event_id, branch FROM u WHERE branch = 0 OR n = 1"
)
def j2_targets_then_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    of = lambda t: events.where(F.col("event_type") == t).select("user_id", "event_id")
    return relational.merge_by_id(of("purchase"), of("click"), "user_id", "event_id")


@query("SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS is_new FROM customer")
def j3_history_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return table(spark, sf_dir, "customer").join(known, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNull().alias("is_new"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate < TIMESTAMP '1995-01-15')")
def u5_not_in_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    shipped = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") < F.lit("1995-01-15").cast("timestamp_ntz")).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(shipped, "p_partkey", "left_anti")


@query(f"WITH {_RANK_SQL} SELECT CAST(c.user_id AS VARCHAR) AS item_code, c.rank AS now_rank, coalesce(p.rank, 101) AS last_rank FROM (SELECT * FROM ranked WHERE day = DATE '2024-01-30') c LEFT JOIN (SELECT * FROM ranked WHERE day = DATE '2024-01-29') p ON p.user_id = c.user_id")
def j4_rank_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, last = _rankings(spark, sf_dir)
    return now.select("item_code", F.col("rank").alias("now_rank")).join(last, "item_code", "left").select("item_code", "now_rank", F.coalesce("rank", F.lit(signals.UNRANKED)).alias("last_rank"))


@query("SELECT n_name, (SELECT count(*) FROM region) AS regions, (SELECT string_agg(r_name, ',' ORDER BY r_regionkey) FROM region) AS names FROM nation")
def j5_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    one = region.agg(F.count("*").alias("regions")).crossJoin(region.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: r["r_name"]), ",").alias("names")))
    return table(spark, sf_dir, "nation").select("n_name").crossJoin(one)


@query(
    "SELECT '2024-02-01-' || replace(q, ' ', '-') AS task_id, q || ': compared' AS theme, ids AS item_ids, 1500 AS min_words, 2500 AS max_words FROM (SELECT p_name AS q FROM part ORDER BY p_partkey LIMIT 1),"
    " (SELECT string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT CAST(p_partkey AS VARCHAR) AS k FROM part ORDER BY k LIMIT 3))"
)
def d11_task_from_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    trends = part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("query"))
    task = tasks.task_from_trends(trends, part.select(F.col("p_partkey").cast("string").alias("item_id")), "2024-02-01")
    return task.select("task_id", "theme", F.array_join("item_ids", ",").alias("item_ids"), "min_words", "max_words")


@query("SELECT o_orderkey, i AS pos, p_partkey, p_name FROM (SELECT o_orderkey, unnest(ids) AS p_partkey, generate_subscripts(ids, 1) - 1 AS i FROM (SELECT l_orderkey AS o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1)) JOIN part USING (p_partkey)")
def j7_lookup_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    posts = relational.collected(lines, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], F.col("l_partkey"), "ids").withColumnRenamed("l_orderkey", "o_orderkey")
    found = relational.lookup_in_order(posts, "ids", table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", ["o_orderkey"])
    return found.select("o_orderkey", F.col("pos").cast("long").alias("pos"), "p_partkey", "p_name")


# Scores and documents ---------------------------------------------------------------------------------------------


def _counted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left")


@query(
    "SELECT p_partkey, round(least(3.8::DOUBLE + CASE WHEN p_size > 3 THEN 0.5 ELSE 0.0 END::DOUBLE + CASE WHEN contains(p_type, 'ECONOMY') OR contains(p_type, 'SMALL') THEN 0.4 ELSE 0.0 END::DOUBLE"
    " + CASE WHEN p_retailprice > 950 THEN -0.2 ELSE 0.0 END::DOUBLE + CASE WHEN coalesce(n, 0) > 30 THEN 0.3 ELSE 0.0 END::DOUBLE, 5.0), 1) AS score"
    " FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"
)
def d5_rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = articles.rule_score_from(F.col("p_size") > 3, S.contains_any("p_type", ["ECONOMY", "SMALL"]), F.col("p_retailprice") > 950, F.coalesce("n", F.lit(0)) > 30)
    return _counted_parts(spark, sf_dir).select("p_partkey", score.alias("score"))


@query(
    "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'well rated, a standard choice' ELSE array_to_string([p_brand, p_type][1:least(p_size % 4, 2)], ', ') END AS pros, CASE WHEN p_retailprice * 10.5 > 10000 THEN 'rather costly' ELSE 'nothing in particular' END AS cons FROM part"
)
def d6_pros_cons(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = F.slice(F.array("p_brand", "p_type", "p_name"), F.lit(1), F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(articles.pros_of(features), ", ").alias("pros"), F.array_join(articles.cons_of(F.col("p_retailprice") * 10.5), ", ").alias("cons"))


@query(
    f"WITH base AS (SELECT item_id AS pos, text FROM benchmark), b AS (SELECT doc_id AS pos, text FROM documents), c AS (SELECT conv_id * 1000 + turn AS pos, text FROM conversations),"
    f" lt AS (SELECT pos, unnest({_TOKENS_SQL.format(c='text')}) AS k FROM base), bt AS (SELECT pos, unnest({_TOKENS_SQL.format(c='text')}) AS k FROM b), ct AS (SELECT pos, unnest({_TOKENS_SQL.format(c='text')}) AS k FROM c),"
    " mb AS (SELECT l, arg_max(r, (n, -r)) AS m FROM (SELECT lt.pos AS l, bt.pos AS r, count(*) AS n FROM lt JOIN bt USING (k) GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1), mc AS (SELECT l, arg_max(r, (n, -r)) AS m FROM (SELECT lt.pos AS l, ct.pos AS r, count(*) AS n FROM lt JOIN ct USING (k) GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1)"
    " SELECT pos, 'a' || pos AS link_a, coalesce('d' || mb.m, '') AS link_b, coalesce('c' || mc.m, '') AS link_c, 3.8::DOUBLE AS score FROM base LEFT JOIN mb ON mb.l = pos LEFT JOIN mc ON mc.l = pos"
)
def d7_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    base = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("title"), F.lit(0).cast("long").alias("price"), F.concat(F.lit("a"), F.col("item_id")).alias("url"), nothing.alias("image"), F.lit(None).cast("array<string>").alias("features"))
    pool = lambda df, key, mark: df.select(key.alias("pos"), F.col("text").alias("title"), F.concat(F.lit(mark), key).alias("url"))
    pool_b = pool(table(spark, sf_dir, "documents"), F.col("doc_id"), "d")
    pool_c = pool(table(spark, sf_dir, "conversations"), F.col("conv_id") * 1000 + F.col("turn"), "c")
    return articles.enriched(base, pool_b, pool_c).select("pos", "link_a", "link_b", "link_c", "score")


_FIVE = "t AS (SELECT *, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part QUALIFY place <= 5)"


@query(
    f"WITH {_FIVE}, p AS (SELECT p_partkey AS k, place, p_name, round(least(3.8::DOUBLE + CASE WHEN p_size % 5 > 3 THEN 0.5 ELSE 0.0 END::DOUBLE, 5.0), 1) AS score FROM t)"
    " SELECT 'building-blocks' AS slug, 'First seen: ' || left((SELECT p_name FROM p WHERE place = 1), 15) || '... and what it offers' AS title, '2024-02-01T09:30:00+09:00' AS date, 'new_arrival' AS signal_type, 'new' AS signal_type_label,"
    " (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY score DESC, place) FROM p) AS products, (SELECT string_agg(p_name, ',' ORDER BY place) FROM p WHERE place <= 3) AS books, 'ブロック,guide,comparison' AS tags"
)
def d8_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = _article(spark, sf_dir)
    ids = lambda a, f: F.array_join(F.transform(a, lambda x: x[f]), ",")
    return doc.select("slug", "title", "date", "signal_type", "signal_type_label", ids("products", "item_id").alias("products"), ids("books", "title").alias("books"), F.array_join("tags", ",").alias("tags"))


def _article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article of the five dearest parts, which stand in for all feeds."""
    top = relational.top_rows(table(spark, sf_dir, "part"), 5, F.desc("p_retailprice"), "p_partkey")
    part = relational.numbered(top, F.desc("p_retailprice"), "p_partkey").withColumn("pos", F.col("place") - 1)
    nothing = F.lit(None).cast("string")
    features = F.slice(F.array(*[F.lit(f"feature {i}") for i in range(5)]), F.lit(1), F.col("p_size") % 5)
    base = part.select("pos", F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.floor("p_retailprice").alias("price"), F.concat(F.lit("https://a.example/"), "p_partkey").alias("url"), nothing.alias("image"), features.alias("features"))
    none = spark.createDataFrame([], "pos BIGINT, title STRING, url STRING")
    links = part.select("pos", F.col("p_name").alias("title"), F.concat(F.lit("https://video.example/watch?v="), "p_partkey").alias("url"))
    topic = spark.createDataFrame([("daily_random", "ブロック")], "mode STRING, keyword STRING")
    signal = part.where("pos = 0").select(F.lit("new_arrival").alias("type"), F.col("p_name").alias("title"))
    books = links.select("*", nothing.alias("image"), F.lit("about it").alias("description"))
    return articles.article(topic, signal, articles.enriched(base, none, none), links, books, links, none, links, datetime(2024, 2, 1, 9, 30))


@query(
    f"WITH {_FIVE} SELECT '# First seen: ' || left((SELECT p_name FROM t WHERE place = 1), 15) || '... and what it offers' AS first_line, 5::BIGINT AS sections, 3::BIGINT AS videos, (SELECT count(*) FROM t WHERE floor(p_retailprice) = (SELECT min(floor(p_retailprice)) FROM t)) AS lowest"
)
def d10_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = render.rendered(_article(spark, sf_dir), "2024-02-01")
    text = F.col("content")
    return page.select(
        F.regexp_extract(text, r"(?m)^(# .*)$", 1).alias("first_line"), F.regexp_count(text, F.lit(r"(?m)^#### Features")).cast("long").alias("sections"),
        F.regexp_count(text, F.lit("<iframe")).cast("long").alias("videos"), F.regexp_count(text, F.lit(r"\(lowest\)")).cast("long").alias("lowest"),
    )


@query("SELECT l_orderkey, l_linenumber, min(CASE WHEN l_extendedprice > 0 THEN l_extendedprice END) OVER (PARTITION BY l_orderkey) AS min_price, l_extendedprice = min(CASE WHEN l_extendedprice > 0 THEN l_extendedprice END) OVER (PARTITION BY l_orderkey) AS is_cheapest FROM lineitem")
def d9_cheapest_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return articles.cheapest_flag(lines, "l_extendedprice", "l_orderkey").select("l_orderkey", "l_linenumber", "min_price", "is_cheapest")


@query("SELECT l_orderkey, l_linenumber, l_quantity = min(CASE WHEN l_quantity > 0 THEN l_quantity END) OVER (PARTITION BY l_orderkey) AS is_cheapest FROM lineitem")
def d9_cheapest_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    element = F.struct("l_linenumber", F.col("l_quantity").alias("price"))
    orders = relational.collected(lines, ["l_orderkey"], [F.col("l_linenumber")], element, "products")
    flagged = orders.select("l_orderkey", F.explode(articles.cheapest_nested("products")).alias("p"))
    return flagged.select("l_orderkey", "p.l_linenumber", "p.is_cheapest")


@query("SELECT p_brand, i - 1 AS pos, ids[i] AS p_partkey FROM (SELECT p_brand, list(p_partkey ORDER BY p_retailprice DESC, p_partkey)[1:3] AS ids FROM part GROUP BY 1), (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(ids)")
def a6_collect_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = relational.collected(table(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], F.col("p_partkey"), "ids", most=3)
    return top.select("p_brand", F.posexplode("ids").alias("pos", "p_partkey"))


@query("SELECT p_brand, min(CASE WHEN p_retailprice > 0 THEN p_retailprice END) AS min_price, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS dearest, bool_or(contains(p_type, 'SMALL')) AS any_steel, count(*) AS n FROM part GROUP BY 1")
def a1_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.min(F.when(price > 0, price)).alias("min_price"), F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("dearest"), F.bool_or(F.contains("p_type", F.lit("SMALL"))).alias("any_steel"), F.count("*").alias("n")
    )


@query(f"SELECT b.item_id, d.doc_id, CAST(len(list_intersect({_TOKENS_SQL.format(c='b.text')}, {_TOKENS_SQL.format(c='d.text')})) AS INTEGER) AS shared FROM benchmark b JOIN documents d ON d.doc_id = b.item_id")
def a3_token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, d = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a")), table(spark, sf_dir, "documents").select("doc_id", "text")
    return b.join(d, F.col("item_id") == F.col("doc_id")).select("item_id", "doc_id", S.overlap("a", "text").alias("shared"))


@query(
    f"WITH b AS (SELECT item_id, unnest({_TOKENS_SQL.format(c='text')}) AS k FROM benchmark), d AS (SELECT doc_id, unnest({_TOKENS_SQL.format(c='text')}) AS k FROM documents)"
    " SELECT item_id, doc_id, CAST(count(*) AS INTEGER) AS shared FROM b JOIN d USING (k) GROUP BY ALL"
)
def a3_token_overlap_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of every item with every document that shares a token with it; other pairs share none."""
    return matching.overlaps(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "text", "doc_id", "text")


@query("SELECT user_id AS item_code, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def a7_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("item_code")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"))


@query("SELECT p_partkey, p_retailprice, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM part QUALIFY place <= 3")
def o1_top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = relational.top_rows(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 3, F.desc("p_retailprice"), "p_partkey")
    return relational.numbered(top, F.desc("p_retailprice"), "p_partkey")


@query("SELECT p_partkey, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 10 + 1 AS INTEGER) AS page FROM part")
def o8_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.numbered(table(spark, sf_dir, "part"), "p_partkey", partition=["p_brand"]).select("p_partkey", S.page_of("place").alias("page"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) = 1 AS is_first FROM lineitem")
def w1_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(w) == 1).alias("is_first"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY ALL) SELECT a.day, a.user_id, a.n, a.n - coalesce(b.n, 0) AS rise FROM d a LEFT JOIN d b ON b.user_id = a.user_id AND b.day = a.day - 1")
def w2_change_since_yesterday(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count("*").alias("n"))
    before = days.select(F.date_add("day", 1).alias("day"), "user_id", F.col("n").alias("m"))
    return days.join(before, ["day", "user_id"], "left").select("day", "user_id", "n", (F.col("n") - F.coalesce("m", F.lit(0))).alias("rise"))


# Expressions ------------------------------------------------------------------------------------------------------


@query("SELECT page_id, CASE WHEN contains(url, 'example.org') THEN url ELSE 'https://referral.example/go?sid=s1&pid=p1&vc_url=' || url_encode(url) END AS link FROM pages")
def d13_url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.referral("url", "https://referral.example/go", "s1", "p1", "example.org").alias("link"))


@query("SELECT page_id, string_split(url, '/')[-1] AS tail, starts_with(url, 'http://') AS plain, CASE WHEN starts_with(url, 'http://') THEN replace(url, 'http://', 'https://') ELSE url END AS secured, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def s3_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.after_last("url", "/").alias("tail"), F.startswith("url", F.lit("http://")).alias("plain"), S.secure("url").alias("secured"), S.stem("url").alias("stem"))


_UNREF = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"


@query(
    f"SELECT page_id, {_UNREF.format(x="regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>([^<]*)</title>', 1)")} AS title, {_UNREF.format(x="regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>([^<]*)</h1>', 1)")} AS heading,"
    " array_to_string(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)[1:5], ' ') AS links FROM pages"
)
def s15_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", markup.element_text("html", "title").alias("title"), markup.element_text("html", "h1").alias("heading"), F.array_join(markup.link_targets("html", 5), " ").alias("links"))


@query("SELECT page_id, regexp_extract(html, '<nav><ul><li><a href=\"([^\"]*)\"', 1) AS link, regexp_extract(url, '^(https?://[^/]*)', 1) || regexp_extract(html, '<nav><ul><li><a href=\"([^\"]*)\"', 1) AS resolved FROM pages")
def s16_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.get(markup.link_targets("html", 1), 0)
    return table(spark, sf_dir, "pages").select("page_id", link.alias("link"), markup.resolved(link, "url").alias("resolved"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing.x'), 'none') AS missing FROM events")
def p2_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.from_json("props", "k BIGINT, missing STRUCT<x STRING>")
    return table(spark, sf_dir, "events").select("event_id", doc["k"].alias("k"), S.path(doc["missing"]["x"], "none").alias("missing"))


@query("SELECT doc_id, left(text, 100) || '...' AS meta, left(text, 15) AS short, length(text) AS n FROM documents")
def p9_prefix_ellipsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.clipped("text", 100).alias("meta"), S.prefix("text", 15).alias("short"), F.length("text").cast("long").alias("n"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'rising' WHEN 'view' THEN 'orders open' WHEN 'purchase' THEN 'new' ELSE '' END AS label, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS kind FROM events")
def p10_case_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = {"click": "rising", "view": "orders open", "purchase": "new"}
    return table(spark, sf_dir, "events").select("event_id", articles.by_type(F.col("event_type"), labels, F.lit("")).alias("label"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"))


@query("SELECT n_nationkey, coalesce(nullif(CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN NULL ELSE n_name END, ''), 'other') AS shown, coalesce(nullif(CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END, ''), CAST(n_regionkey AS VARCHAR)) AS two FROM nation")
def p4_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    maybe = F.when(k % 3 == 0, "").when(k % 3 == 2, name)
    return table(spark, sf_dir, "nation").select("n_nationkey", S.first_truthy(maybe, default="other").alias("shown"), S.first_truthy(F.when(k % 2 == 0, "").otherwise(name), F.col("n_regionkey").cast("string")).alias("two"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE CAST(trunc(p_retailprice) AS BIGINT) END AS price, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS image FROM part")
def p3_first_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = F.array(F.struct(F.struct(F.col("p_retailprice").alias("amount")).alias("price"), F.col("p_brand").alias("image")))
    some = F.when(F.col("p_size") % 3 != 0, listing).when(F.col("p_size") % 2 == 0, F.slice(listing, 1, 0))
    rows = table(spark, sf_dir, "part").select("p_partkey", some.alias("listings"))
    return rows.select("p_partkey", S.whole_amount(S.first_of("listings", "price", "amount")).alias("price"), S.first_of("listings", "image", default="").alias("image"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN 5 WHEN event_id % 5 = 1 THEN 5 WHEN event_id % 5 = 2 THEN 5 ELSE greatest(1, least(CAST(round(value) AS BIGINT), 50)) END AS INTEGER) AS n FROM events WHERE value IS NOT NULL")
def s17_int_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, "").when(k == 2, "x1").otherwise(F.round("value").cast("long").cast("string"))
    return table(spark, sf_dir, "events").where("value is not null").select("event_id", S.int_option(raw, 5, 1, 50).alias("n"))


@query("SELECT l_orderkey, l_linenumber, greatest(10.0, least(l_quantity, 40.0)) AS q, power(2, l_linenumber)::DOUBLE AS delay FROM lineitem")
def s17_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.clamp("l_quantity", 10.0, 40.0).alias("q"), F.pow(F.lit(2.0), F.col("l_linenumber")).alias("delay"))


@query("SELECT p_partkey, regexp_extract_all(p_type, '([一-龥ぁ-んァ-ンa-zA-Z0-9]+)', 1)[1] AS first_token, len(list_distinct(regexp_extract_all(p_type || ' ' || p_brand || ' ' || p_type, '([一-龥ぁ-んァ-ンa-zA-Z0-9]+)', 1))) AS n_tokens FROM part")
def u3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.get(S.tokens("p_type"), 0).alias("first_token"), F.size(S.token_set(F.concat_ws(" ", "p_type", "p_brand", "p_type"))).cast("long").alias("n_tokens"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS stamped, strftime(ts, '%Y-%m-%d') AS day, TRY_CAST(regexp_replace(CAST(event_id * 1000 AS VARCHAR) || '+', '[^0-9]', '', 'g') AS BIGINT) AS traffic FROM events")
def p16_dates_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.offset_time("ts").alias("stamped"), F.substring(S.offset_time("ts"), 1, 10).alias("day"), S.traffic_number(F.concat((F.col("event_id") * 1000).cast("string"), F.lit("+"))).alias("traffic"))


@query("SELECT c_custkey, trim(c_mktsegment) AS name, 'x-' || lower(c_mktsegment) AS slug FROM customer")
def p9_strip_and_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = F.concat(F.lit("\t　 "), "c_mktsegment", F.lit("  \n"))
    return table(spark, sf_dir, "customer").select("c_custkey", S.stripped(padded).alias("name"), F.concat(F.lit("x-"), F.lower("c_mktsegment")).alias("slug"))


@query("SELECT o_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS twice FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <= 3")
def p12_nested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = relational.collected(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber")], F.struct("l_linenumber", "l_partkey", "l_quantity"), "lines")
    docs = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    few = F.transform(F.filter("lines", lambda x: x["l_linenumber"] <= 3), lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].alias("l_partkey"), (x["l_quantity"] * 2).alias("twice")))
    return docs.select("o_orderkey", F.explode(few).alias("x")).select("o_orderkey", "x.*")


# Sources, queue, validation and extensions --------------------------------------------------------------------------


@query("SELECT p_partkey, p_name AS title, 'https://x.example/' || p_partkey AS url, p_brand AS published FROM part")
def s14_xml_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    item = F.concat(tag("title", F.col("p_name")), tag("link", F.concat(F.lit("https://x.example/"), "p_partkey")), tag("pubDate", F.col("p_brand")))
    feeds = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("<rss><channel>"), tag("item", item), F.lit("</channel></rss>")).alias("xml"))
    rows = feeds.select("p_partkey", F.explode(markup.feed_items("xml", 10)).alias("i"))
    return rows.select("p_partkey", F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.col("i.pubDate").alias("published"))


@query("SELECT event_id, CASE WHEN value > 90 THEN 'high' WHEN event_type = 'error' THEN 'kind' END AS rule FROM events WHERE value > 90 AND event_type <> 'error' OR value <= 90 AND event_type = 'error' UNION ALL SELECT event_id, unnest(['high', 'kind']) FROM events WHERE value > 90 AND event_type = 'error'")
def d14_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.constraint_violations(table(spark, sf_dir, "events").where("value is not null and event_type is not null"), "event_id", {"high": F.col("value") <= 90, "kind": F.col("event_type") != "error"})


_PART_SCHEMA = {"type": "object", "required": ["title", "price"], "properties": {"title": {"type": "string"}, "price": {"type": "integer"}}}


@query("SELECT p_partkey, 'price' AS path, 'type' AS rule FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'title', 'required' FROM part WHERE p_size % 5 = 0")
def d14_json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.concat(F.lit('{"item_id": "x", "url": "u", "fetched_at": "t", "extra": 1, "price": '), F.when(F.col("p_size") % 3 == 0, '"dear"').otherwise(F.col("p_size").cast("string")))
    doc = F.concat(fixed, F.when(F.col("p_size") % 5 == 0, "").otherwise(F.concat(F.lit(', "title": "'), "p_brand", F.lit('"'))), F.lit("}"))
    return validate.violations(table(spark, sf_dir, "part").select("p_partkey", doc.alias("doc")), "doc", "p_partkey", _PART_SCHEMA)


@query("SELECT 'head' AS part, min(p_partkey) AS seq, 1::BIGINT AS n FROM part UNION ALL SELECT 'rest', min(p_partkey), count(*) FROM part WHERE p_partkey > (SELECT min(p_partkey) FROM part)")
def d12_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.lit("m").alias("mode"), F.col("p_name").alias("keyword"), F.lit("").alias("item_id"))
    head, rest = tasks.pop(queue, tasks.default_topic(spark))
    of = lambda df, name: df.agg(F.min("seq").alias("seq"), F.count("*").alias("n")).select(F.lit(name).alias("part"), "seq", "n")
    return of(head, "head").unionByName(of(rest, "rest"))


@query("SELECT 0::BIGINT AS seq, 'daily_random' AS mode, arg_max(p_brand, (n, p_brand)) AS keyword, '' AS item_id FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def d12_fifo_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic taken from a queue that no part is in: the brand with most parts."""
    part = table(spark, sf_dir, "part")
    queue = part.where("p_retailprice < 0").select(F.col("p_partkey").alias("seq"), F.lit("m").alias("mode"), F.col("p_name").alias("keyword"), F.lit("").alias("item_id"))
    brands = part.groupBy("p_brand").agg(F.count("*").alias("n"))
    default = brands.agg(F.max_by("p_brand", F.struct("n", "p_brand")).alias("keyword")).select(F.lit(0).cast("long").alias("seq"), F.lit("daily_random").alias("mode"), "keyword", F.lit("").alias("item_id"))
    return tasks.pop(queue, default)[0]


@query("SELECT tag, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([lang, source]) AS tag FROM documents) WHERE tag IS NOT NULL GROUP BY 1")
def d18_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.tag_counts(table(spark, sf_dir, "documents").select(F.array_compact(F.array("lang", "source")).alias("tags")), "tags")


@query(
    "WITH w AS (SELECT p_partkey, lower(p_type) AS t, list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: len(x) >= 2 AND abs(len(x) - 5) <= 0.4 * greatest(len(x), 5)) AS ws FROM part),"
    " d AS (SELECT p_partkey, CASE WHEN contains(t, 'medum') THEN 0.0 ELSE coalesce(list_min(list_transform(ws, lambda x: levenshtein(x, 'medum') / greatest(len(x), 5))), 1.0) END AS distance FROM w) SELECT p_partkey, round(distance, 6) AS distance FROM d WHERE distance <= 0.4"
)
def d17_fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fuzzy_search(table(spark, sf_dir, "part"), "Medum", ["p_type"]).select("p_partkey", F.round("distance", 6).alias("distance"))


@query(
    "WITH q AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark), e AS (SELECT p_partkey, unnest([{'c': p_name, 'w': 0.4}, {'c': p_type, 'w': 0.3}, {'c': p_brand, 'w': 0.2}, {'c': p_type || ' ' || p_name, 'w': 0.1}]) AS x FROM part),"
    " r AS (SELECT p_partkey, lower(x.c) AS text, CAST(x.w AS DOUBLE) AS w FROM e), t AS (SELECT DISTINCT text FROM r),"
    " s AS (SELECT text, word, len(word) AS m, CAST(floor(0.4 * len(word) + 1e-9) AS BIGINT) AS k, unnest(range(0, len(text))) AS x FROM t, q WHERE len(word) <= 32),"
    " d AS (SELECT text, word, levenshtein(word, substr(text, x + 1, l)) / m + x / 1000 AS score FROM (SELECT *, unnest(range(greatest(m - k, 0), m + k + 1)) AS l FROM s)),"
    " m AS (SELECT text, word, CASE WHEN text = word THEN 2.220446049250313e-16 ELSE greatest(0.001, min(score)) END AS score FROM d GROUP BY text, word HAVING min(score) <= 0.4 + 1e-12)"
    " SELECT p_partkey, word, round(exp(sum(ln(score) * w * round(1 / sqrt(greatest(1, len(regexp_extract_all(text, '[^ ]+')))), 3))), 6) AS score FROM r JOIN m USING (text) GROUP BY p_partkey, word"
)
def d17_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of one table sought in four weighted columns of another."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("word"))
    parts = table(spark, sf_dir, "part").withColumn("whole", F.concat_ws(" ", "p_type", "p_name"))
    found = matching.search(parts, words, "p_partkey", "word", {"p_name": 0.4, "p_type": 0.3, "p_brand": 0.2, "whole": 0.1})
    return found.withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'https://referral.example/go?sid=s&pid=p&vc_url=' || url_encode('https://c.example/' || p_partkey) ELSE 'https://referral.example/x' END AS url, p_brand AS image, CASE WHEN p_size % 3 = 0 THEN 'c' ELSE p_type END AS shop FROM part WHERE p_size % 4 <> 0")
def d15_hit_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fennelmill.operators import offers

    nothing = F.lit(None).cast("string")
    k = F.col("p_size")
    hit = F.struct(
        F.when(k % 4 != 0, F.col("p_name")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("https://c.example/"), "p_partkey")).otherwise("https://referral.example/x").alias("url"), F.lit(1).cast("long").alias("price"), F.col("p_partkey").cast("string").alias("code"),
        nothing.alias("janCode"), F.struct(F.lit("").alias("url")).alias("exImage"), F.struct(nothing.alias("small"), F.col("p_brand").alias("medium")).alias("image"), F.struct(F.when(k % 3 == 0, "").otherwise(F.col("p_type")).alias("name")).alias("seller"),
        F.struct(F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("rate")).alias("review"),
    )
    response = table(spark, sf_dir, "part").select(F.array(hit).alias("hits"))
    return offers.hits_c(response, site="s", partner="p").select(F.col("code").cast("long").alias("p_partkey"), "title", "url", "image", "shop")


@query("SELECT event_type, count(*) AS n, (SELECT count(*) FROM events WHERE value > 50) AS rows FROM events WHERE value > 50 GROUP BY 1")
def a5_observed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows counted while they are written, beside what is read back of them."""
    rows, seen = relational.counted(table(spark, sf_dir, "events").where("value > 50"), "kept")
    kept = written(rows, "kept")
    return kept.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("rows", F.lit(seen.get["rows"]))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT -1, 'none' WHERE NOT EXISTS (SELECT 1 FROM region)")
def f9_default_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return relational.or_default(region, spark.createDataFrame([(-1, "none")], region.schema))


from fennelmill.plans import source_queries, stream_queries  # noqa: E402, F401  these add theirs to the same registry
