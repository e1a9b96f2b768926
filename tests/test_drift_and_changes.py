"""Documents of several shapes, and what changes between two states of a table."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from fennelmill import schemas
from fennelmill.operators import relational, render
from fennelmill.sources import files

DOC = {"slug": "s", "title": "T", "date": "2024-02-01T00:00:00+09:00", "lead": "L", "signal_type": None, "products": [{"name": "p", "price": 5, "link_a": "u", "score": 4.2, "pros": ["a"], "cons": ["b"], "features": [], "item_id": "i"}], "tags": ["x"], "extra": {"ignored": 1}}
SHAPES = {
    "texts": DOC | {"youtube_embeds": ["<i/>", "<j/>"]},
    "named": DOC | {"youtube_embeds": [{"embed_html": "<i/>"}, {"embed_html": "<j/>", "more": 2}]},
    "ours": DOC | {"videos": [{"embed": "<i/>"}, {"embed": "<j/>", "title": None}]},
    "mixed": DOC | {"youtube_embeds": ["<i/>", {"embed_html": "<j/>"}]},
}


def test_all_shapes_render_equal_pages(spark, tmp_path):
    for name, doc in SHAPES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    for name, text in {"cut": '{"slug": "x', "list": "[1]", "other": '{"slug": 5, "videos": 7}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    found = files.scan_drifting(spark, str(tmp_path), schemas.ARTICLE, schemas.DRIFTING)
    assert sorted(r.stem for r in found.rejects.collect()) == ["cut", "list"]  # an empty file has no row
    pages = {r.name: r.content for r in render.rendered(found.rows.where("stem <> 'other'"), "2024-02-01", "stem").collect()}
    assert set(pages) == set(SHAPES) and len(set(pages.values())) == 1 and "<i/>" in pages["ours"] and "### p" in pages["ours"]
    assert found.rows.where("stem = 'other'").first().videos == []
    shapes = {r["shape"]: r.documents for r in files.shapes_of(spark, str(tmp_path), "$.youtube_embeds").collect()}
    assert shapes["ARRAY<STRING>"] == 1 and sum(shapes.values()) == 6
    assert "youtube_embeds" in files.common_shape(spark, str(tmp_path)) or "VARIANT" in files.common_shape(spark, str(tmp_path))
    assert files.scan_drifting(spark, str(tmp_path / "none"), schemas.ARTICLE, schemas.DRIFTING).rows.count() == 0


def test_changes_of_a_keyed_table(spark):
    schema = "k string, j int, v string, w double"
    before = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 1, None, None), ("c", 1, "x", None), (None, 1, "n", 1.0), (None, None, "m", 1.0), ("d", None, "x", 1.0)], schema)
    after = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 1, None, None), ("c", 1, "x", 2.0), (None, 1, "n", None), (None, None, "m", 1.0), ("e", 2, None, None)], schema)
    got = {(r.k, r.j): (r.change, r.before and tuple(r.before), r.after and tuple(r.after)) for r in relational.changes(before, after, ["k", "j"]).collect()}
    assert got == {("c", 1): ("updated", ("x", None), ("x", 2.0)), (None, 1): ("updated", ("n", 1.0), ("n", None)), ("d", None): ("removed", ("x", 1.0), None), ("e", 2): ("inserted", None, (None, None))}
    wider = after.withColumn("z", F.lit(1)).drop("w")
    assert {r.change for r in relational.changes(after, wider, ["k", "j"]).collect()} == {"updated"}
    assert relational.changes(before, before.union(before), ["k", "j"]).count() == 0 and relational.changes(before.limit(0), before, ["k", "j"]).count() == 6


def test_what_a_run_changed(spark, tmp_path):
    kept = files.Snapshots(spark, str(tmp_path), schemas.RANKS)
    for i, rows in enumerate(([("a", 1), ("b", 2)], [("a", 1), ("b", 3)], [("b", 3)])):
        kept.write(spark.createDataFrame(rows, schemas.RANKS), f"r{i}", datetime(2024, 1, 1 + i))
    changed = lambda run: sorted((r.item_code, r.change) for r in kept.changed(run, ["item_code"]).collect())
    assert changed("r0") == [("a", "inserted"), ("b", "inserted")] and changed("r1") == [("b", "updated")] and changed("r2") == [("a", "removed")]
