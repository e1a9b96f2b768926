"""Files named by rows, written by tasks: all of them or none."""

import pytest
from pyspark.sql import functions as F

from fennelmill.sources import named

ROWS = "name string, content string"


def left(folder):
    return {p.name: p.read_text() for p in folder.iterdir()} if folder.exists() else {}


def test_each_row_is_a_file_and_others_stay(spark, tmp_path):
    out = tmp_path / "out"
    df = spark.range(500).select(F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") != 3, F.concat(F.lit("漢 "), "id")).alias("content")).repartition(6)
    named.write_named(df, str(out), ".md")
    assert left(out) == {f"n{i}.md": "" if i == 3 else f"漢 {i}" for i in range(500)}
    named.write_named(spark.createDataFrame([("n1", "new"), ("a b%é", "x")], ROWS), str(out), ".md")
    assert left(out)["n1.md"] == "new" and left(out)["a b%é.md"] == "x" and len(left(out)) == 501
    (out / "other.txt").write_text("stays")
    named.write_named(spark.createDataFrame([("only", "1")], ROWS), str(out), ".md", overwrite=True)
    assert left(out) == {"only.md": "1", "other.txt": "stays"}
    named.write_named(spark.createDataFrame([], ROWS), str(tmp_path / "none"), ".md")
    assert left(tmp_path / "none") == {}


@pytest.mark.parametrize("bad", ["a/b", "", None, ".hidden", "_x"])
def test_an_aborted_job_leaves_nothing(spark, tmp_path, bad):
    out = tmp_path / "out"
    named.write_named(spark.createDataFrame([("kept", "1")], ROWS), str(out), ".json")
    rows = [(f"n{i}", "x") for i in range(40)] + [(bad, "y")]
    with pytest.raises(Exception, match="no name of a file"):
        named.write_named(spark.createDataFrame(rows, ROWS).repartition(5), str(out), ".json")
    assert left(out) == {"kept.json": "1"}


def test_two_rows_of_a_name(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "3", 1)], ROWS + ", at int")
    for parts in (1, 3):
        with pytest.raises(Exception, match="two rows have the name"):
            named.write_named(rows.repartition(parts, "at"), str(tmp_path / "x"), ".json")
    assert left(tmp_path / "x") == {}
    named.write_named(rows.repartition(3), str(tmp_path / "x"), ".json", order="at")
    assert left(tmp_path / "x") == {"a.json": "2", "b.json": "3"}


def test_folders_are_moved_whole_and_read_by_tasks(spark, tmp_path):
    out = tmp_path / "out"
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("漢 "), "id").alias("content"))
    read = lambda: {r.name: r.content for r in named.read_named(spark, str(out), ".md").collect()}
    named.write_named(rows(0, 300).repartition(5), str(out), ".md", folders=16)
    assert {p.name[:5] for p in out.iterdir()} == {"part-"} and read() == {f"n{i}": f"漢 {i}" for i in range(300)}
    named.write_named(rows(290, 320), str(out), ".md", folders=16)
    assert read() == {f"n{i}": f"漢 {i}" for i in range(320)}
    with pytest.raises(Exception, match="two rows have the name"):
        named.write_named(rows(0, 5).unionByName(rows(4, 9)), str(out), ".md", folders=16)
    named.write_named(rows(0, 3), str(out), ".md", folders=16, overwrite=True)
    assert read() == {f"n{i}": f"漢 {i}" for i in range(3)} and not [p for p in out.iterdir() if p.name.startswith("_")]
