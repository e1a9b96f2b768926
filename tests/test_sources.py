import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fennelmill import schemas
from fennelmill.sources import files, markup, remote
from fennelmill.streaming import signals as streaming


def test_json_folder_with_rejects(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"items": [{"title": "x", "url": "u"}]}')
    (tmp_path / "a.json").write_text('{"items": [')
    (tmp_path / "c.txt").write_text("no")
    scan = files.scan_json(spark, str(tmp_path), schemas.FEEDS["maker"])
    assert [(r.stem, r["items"][0].title) for r in scan.rows.collect()] == [("b", "x")]
    assert [r.stem for r in scan.rejects.collect()] == ["a"]
    gone = files.scan_json(spark, str(tmp_path / "none"), schemas.FEEDS["maker"])
    assert gone.rows.count() == gone.rejects.count() == 0 and gone.rows.columns == scan.rows.columns
    assert [r.stem for r in files.file_stems(spark, str(tmp_path)).collect()] == ["a", "b"]


def test_optional_document_and_state(spark, tmp_path):
    p = tmp_path / "state.json"
    assert [d.count() for d in files.read_state(spark, str(p), schemas.STATE)] == [0, 0]
    p.write_text(json.dumps({"history": {"a:1": {"seen_at": "2026-04-01T10:00:00.123456", "title": "t"}, "b": {"seen_at": None, "title": None}}, "last_rankings": {"a:1": 3}}))
    history, ranks = files.read_state(spark, str(p), schemas.STATE)
    assert sorted((r.item_code, r.seen_at, r.title) for r in history.collect()) == [("a:1", datetime(2026, 4, 1, 10, 0, 0, 123456), "t"), ("b", None, None)]
    assert [tuple(r) for r in ranks.collect()] == [("a:1", 3)]
    p.write_text("{broken")
    assert files.read_json_or(spark, str(p), "x int", spark.createDataFrame([(7,)], "x int")).first().x == 7


def test_posts_and_sinks(spark, tmp_path):
    (tmp_path / "p.md").write_text("---\ntitle: A post\ntags: [x, y]\ndraft: false\n---\nBody\nmore")
    (tmp_path / "q.md").write_text("no header")
    got = {r.name: r for r in files.read_posts(spark, str(tmp_path)).collect()}
    assert got["p"].front_matter["title"] == "A post" and json.loads(got["p"].front_matter["tags"]) == ["x", "y"] and got["p"].body == "Body\nmore"
    assert got["q"].front_matter is None and got["q"].body == "no header"
    out = str(tmp_path / "out")
    docs = spark.createDataFrame([("d1", "s", 1, None), ("d1", "t", 2, "漢")], "run_date string, slug string, n int, x string")
    files.write_documents(docs, out, "run_date", "slug")
    files.write_documents(docs.where("slug = 's'").withColumn("n", F.lit(9)), out, "run_date", "slug")
    assert sorted((r.slug, r.n) for r in spark.read.json(out).collect()) == [("s", 9), ("t", 2)]
    assert json.loads(files.as_json(docs.where("n = 1")).first().json) == {"run_date": "d1", "slug": "s", "n": 1, "x": None}


def test_snapshots(spark, tmp_path):
    s = files.Snapshots(spark, str(tmp_path / "ranks"), schemas.RANKS)
    assert s.read().count() == 0
    s.write(spark.createDataFrame([("a", 1)], "item_code string, rank int"), "r1", datetime(2024, 1, 1))
    s.write(s.read().withColumn("rank", F.col("rank") + 1), "r2", datetime(2024, 1, 2))
    assert s.current() == "r2" and [tuple(r) for r in s.read().collect()] == [("a", 2)]


def test_index_pages(spark):
    posts = spark.createDataFrame([(f"t{i}", f"/p/{i:02d}", "s", "c", i) for i in range(25)], "title string, permalink string, summary string, content string, day int")
    got = {r.permalink: r.page for r in files.index_rows(posts, "day").collect()}
    assert [got[f"/p/{i:02d}"] for i in (24, 15, 14, 5, 4, 0)] == [1, 1, 2, 2, 3, 3]


PAGE = """<div class="item"><a href="/g/1">x</a><h2> one <b>1</b></h2></div><div class="item big"><h2>no link</h2></div><div class="item"><a href="http://o/2"></a><span class="name">two</span></div>"""


def test_html_items(spark):
    df = spark.createDataFrame([(PAGE,), ("<p>nothing</p>",), (None,), ("",), ("<div class=item><a href='x'>",)], "h string")
    got = [[(i.title, i.url) for i in r.x] for r in df.select(markup.maker_items("h", "https://m.example/shop/d.aspx").alias("x")).collect()]
    assert got == [[("one 1", "https://m.example/g/1"), ("two", "http://o/2")], [], [], [], []]
    page = "<article><h2 class='entry-title'><a href='/a'> A <i>b </i></a></h2></article>" * 4 + "<article><p>x</p></article>"
    links = spark.createDataFrame([(page,)], "h string").select(markup.related_links("h").alias("x")).first().x
    assert [(i.title, i.url) for i in links] == [("Ab", "/a")] * 3


def test_xml_feeds(spark):
    xml = "<rss><channel><title>c</title>" + "".join(f"<item><title>n{i} &amp; x</title><link>u{i}</link><pubDate>Mon, 01 Jan</pubDate></item>" for i in range(12)) + "</channel></rss>"
    df = spark.createDataFrame([(xml,)], "x string")
    got = markup.news(df, "x").orderBy("pos").collect()
    assert len(got) == 10 and (got[0].title, got[0].url, got[0].published) == ("n0 & x", "u0", "Mon, 01 Jan")
    bad = spark.createDataFrame([("<rss><channel><item>",), (None,), ("",)], "x string")
    assert markup.news(bad, "x").count() == 0
    t = markup.trends(spark.createDataFrame([("<rss><channel><item><title>q</title></item></channel></rss>",)], "x string"), "x").first()
    assert (t.query, t.traffic) == ("q", "unknown")


class Fake:
    """Answers in turn, and a clock that sleeping moves."""

    def __init__(self, *answers):
        self.answers, self.asked, self.now, self.slept = list(answers), [], 0.0, []

    def __call__(self, request):
        self.asked.append(request)
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def access(self, credential="id"):
        grants = [remote.Grant("https://old", "all/read", authorization="Bearer {token}, old"), remote.Grant("https://new", "all::read", True, "Bearer {token}, new", "v2.")]
        return remote.Access(self, remote.grant_for(credential, grants), credential, "secret", clock=lambda: self.now)

    def ask(self, retry=remote.Retry(), access=None):
        return retry.send(self, remote.Request("POST", "https://api/x", {"Content-Type": "application/json"}), access, self.sleep)


TOKEN = remote.Response(200, '{"access_token": "t", "expires_in": 100}')
OK = remote.Response(200, '{"ok": 1}')


def test_tokens_are_kept_and_grants_differ():
    fake = Fake(TOKEN, OK, OK, TOKEN, OK)
    access = fake.access()
    fake.ask(access=access), fake.ask(access=access)
    fake.now = 41
    fake.ask(access=access)
    assert [r.url for r in fake.asked] == ["https://old", "https://api/x", "https://api/x", "https://old", "https://api/x"]
    assert fake.asked[0].headers["Authorization"].startswith("Basic ") and fake.asked[0].body == "grant_type=client_credentials&scope=all/read"
    assert fake.asked[1].headers == {"Content-Type": "application/json", "Authorization": "Bearer t, old"}
    fake = Fake(TOKEN, OK)
    fake.ask(access=fake.access("v2.x"))
    assert fake.asked[0].body == {"grant_type": "client_credentials", "scope": "all::read", "client_id": "v2.x", "client_secret": "secret"} and fake.asked[1].headers["Authorization"] == "Bearer t, new"
    fake = Fake(remote.Response(500))
    with pytest.raises(remote.FeedError, match="token"):
        fake.ask(access=fake.access())
    fake = Fake(remote.Response(200, '{"access_token": "t"}'))
    access = fake.access()
    access.headers()
    fake.now = 3539
    assert access.headers() and len(fake.asked) == 1


def test_retries():
    bad = remote.Response(500)
    fake = Fake(TOKEN, remote.Response(429), remote.FeedError("connection", "x"), bad, bad, bad)
    with pytest.raises(remote.FeedError) as e:
        fake.ask(access=fake.access())
    assert e.value.stage == "request" and fake.slept == [2, 4, 8, 16]
    fake = Fake(TOKEN, remote.Response(401), TOKEN, OK)
    assert fake.ask(access=fake.access()) == OK
    assert Fake(remote.Response(404, '{"none": 1}')).ask().text == '{"none": 1}'
    fake = Fake(*[bad] * 7)
    with pytest.raises(remote.FeedError):
        fake.ask(remote.Retry(attempts=7))
    assert fake.slept == [2, 4, 8, 16, 30, 30]
    with pytest.raises(remote.FeedError) as e:
        Fake().ask(remote.Retry(attempts=0))
    assert e.value.stage == "attempts"


def test_feed_source(spark):
    remote.register(spark)
    recorded = json.dumps({"/c/search": {"status": 200, "body": {"hits": [{"name": "n", "url": "u"}]}}, "/books": {"status": 503, "body": {}}})
    read = lambda feed, **o: spark.read.format("feed").options(feed=feed, recorded=recorded, **o).load()
    assert json.loads(read("hits_c", keyword="k").first().response)["hits"][0]["name"] == "n"
    assert json.loads(read("books").first().response) == {"items": []}
    assert read("hits_c").where("keyword = 'z'").first().keyword == "z"
    assert json.loads(read("search_b", credentials="none").first().response) == {"Items": []}
    assert len(json.loads(read("search_b", credentials="none", mock="true").first().response)["Items"]) == 1
    feeds, gone = remote.FEEDS, remote.recorded({"recorded": "{}"})
    assert feeds["hits_c"].parameters({"results": "99", "keyword": "k"})["results"] == 50 and feeds["hits_c"].parameters({"results": "x"})["results"] == 5
    assert feeds["videos"].parameters({"keyword": "k", "suffix": "review"})["q"] == "k review"
    assert feeds["ranking_b"].parameters({"extra": '{"applicationId": "a"}'}) == {"genreId": "566382", "applicationId": "a"}
    with pytest.raises(remote.FeedError):
        feeds["search_b"].fetch(remote.recorded({"recorded": '{"/b/search": {"status": 500, "body": {}}}'}), {})
    with pytest.raises(remote.FeedError):
        feeds["search_b"].fetch(gone, {})
    assert feeds["ranking_b"].fetch(gone, {}) == {"Items": []} and feeds["videos"].fetch(remote.recorded({"recorded": '{"/videos": {"status": 403, "body": {}}}'}), {}) == {"items": []}


def test_catalogue_feeds_with_tokens_and_batches(spark):
    from fennelmill.operators import offers

    remote.register(spark)
    item = lambda i: {"asin": i, "itemInfo": {"title": {"displayValue": f"t{i}"}}}
    answers = json.dumps({"/token": {"status": 200, "body": {"access_token": "t"}}, "/getItems": {"status": 200, "body": {"itemsResult": {"items": [item("A")]}}}, "/searchItems": {"status": 404, "body": {"errors": []}}})
    grants = json.dumps([{"url": "https://x/token", "scope": "s"}])
    read = lambda feed, **o: spark.read.format("feed").options(feed=feed, recorded=answers, grants=grants, credential="c", secret="s", base="https://x", **o).load()
    items = lambda df: offers.catalogue_a(df.select(F.from_json("response", schemas.RESPONSE_A).alias("r")).select("r.*"))
    both = offers.targets_then_search(items(read("lookup_a", ids="A")), items(read("search_a", keyword="k")))
    assert [(r.item_id, r.title) for r in both.collect()] == [("A", "tA")]
    many = read("lookup_a", ids="A,B,C,D,E", batch="2")
    assert many.rdd.getNumPartitions() == 3 and many.count() == 3
    asked = remote.FEEDS["lookup_a"].parameters({"ids": "A,B", "tag": "g", "marketplace": "m"})
    assert asked["itemIds"] == ["A", "B"] and asked["resources"] == remote.LOOKUP_FIELDS and (asked["itemIdType"], asked["marketplace"], asked["partnerTag"]) == ("ASIN", "m", "g")
    assert remote.FEEDS["search_a"].parameters({"keyword": "k", "results": "99", "resources": "x,y"}) == {"resources": ["x", "y"], "keywords": "k", "searchIndex": "All", "itemCount": 10, "partnerTag": "", "marketplace": ""}


def test_a_transport_of_the_user(spark, tmp_path):
    (tmp_path / "own_transport.py").write_text(
        "from fennelmill.sources.remote import Response\n"
        "def answers(options):\n"
        "    return lambda request: Response(200, '{\"Items\": [{\"itemName\": \"' + options['greeting'] + request.url + str(request.parameters['keyword']) + '\"}]}')\n"
    )
    spark.sparkContext.addPyFile(str(tmp_path / "own_transport.py"))
    remote.register(spark)
    got = spark.read.format("feed").options(feed="search_b", transport="own_transport:answers", greeting="hi ", base="https://b", config='{"path": "/v2"}', keyword="k").load()
    assert json.loads(got.first().response) == {"Items": [{"itemName": "hi https://b/v2k"}]}


def test_http_transport():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path.startswith("/ok?") else 503)
            self.end_headers()
            self.wfile.write(json.dumps({"hits": [self.path]}).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send, at = remote.http({}), f"http://127.0.0.1:{server.server_port}"
    assert json.loads(send(remote.Request("GET", f"{at}/ok", parameters={"q": "a b"})).text) == {"hits": ["/ok?q=a+b"]}
    assert send(remote.Request("GET", f"{at}/no")).status == 503
    server.shutdown()
    server.server_close()
    with pytest.raises(remote.FeedError, match="connection"):
        send(remote.Request("GET", f"{at}/ok", timeout=2))


def test_daily_run(spark, tmp_path):
    from fennelmill.plans import daily

    at = [str(tmp_path / n) for n in ("raw", "state", "articles", "posts", "queue", "topics")]
    layout = daily.Layout(*at)
    raw = tmp_path / "raw"
    raw.mkdir()
    put = lambda name, doc: (raw / f"{name}.json").write_text(json.dumps(doc))
    put("search_b", {"items": [{"title": "red toy x", "item_code": "c1", "url": "ub", "price": 5}, {"title": "限定 toy", "item_code": "c2", "url": "u2", "price": 6}]})
    put("ranking_b", {"items": [{"title": "r", "item_code": "c9", "rank": 90}]})
    put("catalogue_a", {"items": [{"item_id": "A", "title": "toy red", "price": 7, "features": ["f"], "url": "ua"}]})
    put("trends", {"top_queries": [{"query": "a b", "traffic": "5+"}]})
    when = datetime(2024, 2, 1, 8)
    assert [(r.type, r.item_code, r.score) for r in daily.detect(spark, layout, "r1", when).collect()] == [("new_arrival", "c2", 7.0)]
    put("ranking_b", {"items": [{"title": "r", "item_code": "c9", "rank": 60}]})
    assert [(r.type, r.jump) for r in daily.detect(spark, layout, "r2", datetime(2024, 2, 2, 8)).collect()] == [("sudden_jump", 30)]
    topic = daily.next_topic(spark, layout, "r2", when)
    assert topic.first().keyword == "toys"
    doc = daily.write_article(spark, layout, topic, spark.createDataFrame([], "pos int, title string, url string"), when).first()
    assert (doc.slug, doc.signal_type, [(p.item_id, p.link_b) for p in doc.products]) == ("baby-toy", "sudden_jump", [("A", "ub")])
    assert [p.name for p in (tmp_path / "articles").iterdir()] == ["2024-02-01-baby-toy.json"]
    posts = daily.render_posts(spark, layout, when)
    assert [p.name for p in (tmp_path / "posts").iterdir()] == ["baby-toy.md"]
    assert [r.name for r in posts.collect()] == ["baby-toy"] and "### toy red" in spark.read.text(str(tmp_path / "posts"), wholetext=True).first().value
    (tmp_path / "items").mkdir()
    (tmp_path / "items" / "B1.json").write_text("{}")
    assert daily.plan_task(spark, layout, str(tmp_path / "items"), when).first().item_ids == ["B1"]
    [task] = (tmp_path / "queue").iterdir()
    assert task.name == "2024-02-01-a-b.json" and json.loads(task.read_text())["min_words"] == 1500


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    events = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 5)), ("a", datetime(2024, 1, 1, 0, 6)), ("b", datetime(2024, 1, 1, 1, 5))], "k string, t timestamp_ntz").withColumn("t", F.col("t").cast("timestamp"))
    events.write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    for name, df in (("first", streaming.first_seen(stream, "k", "t")), ("windows", streaming.counts_by_window(stream, "t", "k"))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).outputMode("append").start().awaitTermination(120)
    assert sorted(r.k for r in spark.table("first").collect()) == ["a", "b"]
    assert [(r.k, r.n) for r in spark.table("windows").collect()] in ([("a", 2)], [])
    out = []
    ranks = files.Snapshots(spark, str(tmp_path / "ranks"), schemas.RANKS)
    run = streaming.jump_batches(spark, ranks, lambda df, i: out.append((i, sorted(r.item_code for r in df.collect()))))
    batch = lambda rows: spark.createDataFrame([(i, r, c, "t", None, None, 1) for i, (c, r) in enumerate(rows)], "pos int, rank int, item_code string, title string, url string, image string, price long")
    run(batch([("a", 50), ("b", 90)]), 0)
    run(batch([("a", 20), ("b", 90)]), 1)
    run(batch([("a", 20), ("b", 90)]), 1)
    assert out == [(0, ["a"]), (1, ["a"]), (1, ["a"])]
