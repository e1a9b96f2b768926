"""Connected components by repeated contraction, wholly in tables that live in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fennelmill.llm.common import discard, materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for each id in ``links``: the smallest id reachable from it.

    Each round points every vertex at the smallest of itself and its neighbours, follows one more pointer, and contracts
    the graph to the vertices pointed at; a group of any diameter is done in a number of rounds that grows with its
    logarithm. Neighbours are reduced by a map-side minimum and hot vertices meet one-row sides in joins that Spark can
    split, so no group is gathered in a task. NULL ends and loops are no links; an empty table gives no rows.
    """
    edges = materialise(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") < F.col("b"))).distinct(), "edges"
    )
    found = kept = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("p")), "pointers")
        further = least.select(F.col("v").alias("p"), F.col("p").alias("q"))
        step = materialise(least.join(further, "p").select("v", F.col("q").alias("p")), "pointers")
        if found is None:
            found, kept = step.select(F.col("v").alias("id"), F.col("p").alias("component")), step
        else:
            moved = step.select(F.col("v").alias("component"), F.col("p").alias("to"))
            found = materialise(found.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")), "components")
            discard(kept)
            kept = found
        left, right = step.select(F.col("v").alias("a"), F.col("p").alias("x")), step.select(F.col("v").alias("b"), F.col("p").alias("y"))
        ends = edges.join(left, "a").join(right, "b")
        fewer = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), "edges")
        discard(edges, least, *([] if kept is step else [step]))
        edges = fewer
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    discard(edges)
    return found
