"""Pages, rates and polling of feeds."""

import json
import time
from collections import Counter

import pytest

from fennelmill.sources import remote


def answers(folder, end, pages, size, total):
    folder.mkdir()
    for p in range(pages):
        (folder / f"{end}-{1 + p * size}.json").write_text(json.dumps({"hits": [{"name": f"{p}-{i}"} for i in range(size)], "totalResultsAvailable": total}))


def asked(folder):
    return Counter(p.name.split(".")[0] for p in folder.iterdir()) if folder.exists() else Counter()


def options(tmp_path, **more):
    return {"feed": "hits_c", "transport": "fennelmill.sources.remote:recorded_folder", "answers": f"file://{tmp_path}/answers", "asked": f"file://{tmp_path}/asked", "page_parameter": "start", "page_total": "totalResultsAvailable", "page_size": "3", **more}


def test_pages_are_planned_from_the_number_of_results(spark, tmp_path):
    remote.register(spark)
    answers(tmp_path / "answers", "search", 7, 3, 20)
    rows = spark.read.format("feed").options(**options(tmp_path, tasks="3")).load().collect()
    assert sorted(r.page for r in rows) == list(range(7)) and all(json.loads(r.response)["hits"][0]["name"] == f"{r.page}-0" for r in rows)
    assert set(asked(tmp_path / "asked")) == {f"search-{1 + 3 * p}" for p in range(7)}
    few = spark.read.format("feed").options(**options(tmp_path, page_most="2")).load()
    assert sorted(r.page for r in few.collect()) == [0, 1]
    assert spark.read.format("feed").options(**options(tmp_path, credentials="none")).load().collect()[0].page is None


def test_no_page_is_left_out_unless_asked(tmp_path):
    """More than a thousand pages are planned, each for one task."""
    answers(tmp_path / "answers", "search", 1, 3, 3600)
    parts = remote.FeedReader(options(tmp_path)).partitions()
    assert sorted(p for part in parts for p in part.pages) == list(range(1200))


def test_searches_with_retries_read_all_pages(tmp_path):
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers" / "searchItems-1.json").write_text(json.dumps({"searchResult": {"items": [], "totalResultCount": 60_000}}))
    found = remote.FeedReader(options(tmp_path, feed="search_a", page_total="searchResult.totalResultCount", page_size="10")).partitions()
    assert sum(len(part.pages) for part in found) == 6000


@pytest.mark.parametrize("late", [[0, 0, 0, 0], [0, 7.3, 0.4, 100.01], [3, 2, 1, 0]])
def test_tasks_share_one_rate_however_late_they_start(tmp_path, late):
    """A clock of its own for each task: the instants of all requests are an interval apart, and none is lost."""
    answers(tmp_path / "answers", "search", 1, 3, 3 * 40)
    reader = remote.FeedReader(options(tmp_path, interval="1", tasks="4"))
    _, *parts = reader.partitions()
    assert sorted(p for part in parts for p in part.pages) == list(range(1, 40))
    times = []
    for part, wait in zip(parts, late):
        now = [time.time() + wait]
        for _ in part.pages:
            part.turns.wait(lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
            times.append(now[0])
            now[0] += 0.3  # the request itself takes a while
    times.sort()
    assert len(times) == 39 and min(b - a for a, b in zip(times, times[1:])) > 1 - 1e-6




def test_a_restarted_stream_asks_for_no_page_twice(spark, tmp_path):
    remote.register(spark)
    answers(tmp_path / "answers", "search", 3, 3, 9)
    clock = tmp_path / "clock"
    given = options(tmp_path, pages="3", every="10", clock="fennelmill.sources.remote:recorded_clock", clock_file=f"file://{clock}")

    def poll(now):
        clock.write_text(str(now))
        stream = spark.readStream.format("feed").options(**given).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return sum(asked(tmp_path / "asked").values()), spark.read.parquet(str(tmp_path / "out")).count()

    assert poll(1000) == (3, 3)
    assert poll(1004) == (3, 3)  # the same run: nothing is asked again
    assert poll(1010) == (6, 6)
    assert poll(1055) == (9, 9)  # runs that passed are over
    assert set(asked(tmp_path / "asked").values()) == {3}


def test_options_have_defaults_bounds_and_orders():
    """What is asked of a feed where the user says nothing, too much, or another order."""
    asked = lambda feed, **o: remote.FEEDS[feed].parameters(o)
    assert asked("hits_c") == {"in_stock": "true", "query": "", "results": 5, "sort": "-score", "image_size": 300}
    assert asked("hits_c", keyword="k", results="99", sort="+price", image_size="x") == {"in_stock": "true", "query": "k", "results": 50, "sort": "+price", "image_size": 300}
    assert asked("search_b")["sort"] == "-updateTimestamp" and asked("books")["orderBy"] == "relevance"
    assert asked("search_a", results="0")["itemCount"] == 1 and asked("search_a")["searchIndex"] == "All"
    assert asked("videos", keyword="k", suffix="review")["q"] == "k review" and asked("books", extra='{"maxResults": 9}')["maxResults"] == 9
    assert asked("lookup_a", ids="a,b", tag="t")["itemIds"] == ["a", "b"]


def test_a_search_pages_its_results_as_the_sql_orders_them(spark, tmp_path):
    from fennelmill.plans.queries import QUERIES

    spark.range(25).selectExpr("if(id < 3, null, id) s_suppkey", "concat('n', id) s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    found = {(r.title, r.page) for r in QUERIES["s6_keyword_search"].run(spark, str(tmp_path)).collect()}
    assert found == {(f"n{i}", (i - 3) // 10) for i in range(3, 25)} | {(f"n{i}", 2) for i in range(3)}
