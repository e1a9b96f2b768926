"""Spans of regular-expression matches as column expressions: no Python code runs on the executors."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a match is: its place in code points, its text, the text of one group, and the text since the match before.
SPAN = "array<struct<start:bigint,end:bigint,value:string,part:string,gap:string>>"

#: Matches that are placed one behind the other.
_CHUNK = 256


def add_matches(df: DataFrame, column: str, text: str, pattern: str, group: int = 0, needs: str | tuple[str, ...] | None = None, gaps: bool = False, holds: str | None = None) -> DataFrame:
    """Add the leftmost non-overlapping matches of ``pattern`` in column ``text``, as an array of :data:`SPAN`.

    The gaps between matches come from splitting at the pattern and the matches from extracting it; both use the same
    search, so the lengths of both add up to positions. Texts without any of the strings ``needs``, or without a match of the
    simpler pattern ``holds``, are not searched, those without matches not split. Matches are placed in chunks, so that a text with very many of them costs little more
    for each. ``gap`` is filled only on request. A pattern must not match the empty string; a NULL
    text has no matches.
    """
    needs = (needs,) if isinstance(needs, str) else needs
    found, parts, between, offsets = (f"{column}__{x}" for x in ("found", "parts", "between", "offsets"))
    searched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if holds:
        searched = F.when(F.col(text).rlike(holds), searched)
    df = df.withColumn(found, F.coalesce(F.when(reduce(or_, (F.contains(F.col(text), F.lit(x)) for x in needs)), searched) if needs else searched, F.array().cast("array<string>")))
    some = F.size(found) > 0
    df = df.withColumn(between, F.when(some, F.split(text, pattern, -1)))
    df = df.withColumn(parts, F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.col(found))
    none = F.array().cast(SPAN)
    size = lambda i: F.length(F.get(between, i)) + F.length(F.get(found, i))
    chunks = F.sequence(F.lit(0), ((F.size(found) - 1) / _CHUNK).cast("int"))
    inside = lambda c: F.sequence(c * _CHUNK, F.least((c + 1) * _CHUNK, F.size(found)) - 1)

    def begin(acc: Column, c: Column) -> Column:
        length = F.aggregate(inside(c), F.lit(0).cast("long"), lambda n, i: n + size(i))
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def walk(acc: Column, i: Column) -> Column:
        gap, value = F.get(between, i), F.get(found, i)
        start = acc["at"] + F.length(gap)
        end = start + F.length(value)
        one = F.struct(start.alias("start"), end.alias("end"), value.alias("value"), F.get(parts, i).alias("part"), (gap if gaps else F.lit(None).cast("string")).alias("gap"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    starts = F.aggregate(chunks, zero, begin, lambda acc: acc["out"])
    df = df.withColumn(offsets, F.when(F.size(found) > _CHUNK, starts).when(some, F.array(F.lit(0).cast("long"))))
    walked = lambda c: F.aggregate(inside(c), F.struct(F.get(offsets, c).alias("at"), none.alias("out")), walk, lambda acc: acc["out"])
    return df.withColumn(column, F.when(some, F.flatten(F.transform(chunks, walked))).otherwise(none)).drop(found, parts, between, offsets)


def tagged(column: str, kind: str, place: int) -> Column:
    """Spans of a kind as ``array<struct<start, place, end, kind>>``: their natural order is by start, then kind as listed."""
    return F.transform(column, lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("place"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def written(spans: Column) -> Column:
    """``kind:start:end`` of tagged spans, sorted and joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
