"""Connected components as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.session import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``root`` (least node of its component) of every node with an edge.

    Edges between a node and itself and repeated edges are allowed, rows with a null
    end are no edges. Each round links all neighbours of a node that are larger to its
    least neighbour, then all that are smaller; both are aggregates, so a node of very
    many neighbours costs only partial sums. Ends when nothing changes; about
    log^2 of the longest path rounds. Every round is a written table.
    """
    links = (
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .filter("x is not null and y is not null and x != y")
        .select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        .distinct()
    )
    links = materialize(links, "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        # Written, so that the join deals both sides anew and can split a node of many links.
        least = materialize(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("low")), "least")
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("low").alias("y"))
        large = materialize(large.distinct(), "large")
        least = materialize(large.groupBy("x").agg(F.min("y").alias("low")), "least")
        small = large.join(least, "x").filter("y != low").select(F.col("y").alias("x"), F.col("low").alias("y"))
        links = materialize(small.union(least.select("x", F.col("low").alias("y"))).distinct(), "links")
    roots = links.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return links.select(F.col("x").alias("node"), F.col("y").alias("root")).union(roots)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
