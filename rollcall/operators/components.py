"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) with component the smallest id reachable over undirected ``edges`` (src, dst).

    Alternating large-star and small-star rounds until the edges no longer change, each round a table
    in the shared folder. Every round is a hash aggregation and a join of the edges alone: nothing is
    collected but one checksum row, and a hub's neighbours are rows, never one list. Self loops and
    repeated edges are harmless; a vertex without edges is its own component.
    """

    def closed(e: DataFrame) -> DataFrame:
        return e.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()

    def checksum(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()

    edges = materialise(closed(edges.select("src", "dst").dropna()))
    seen = checksum(edges)
    if seen[0]:
        while True:
            # large star: each vertex's larger neighbours link to its smallest neighbour (itself included)
            both = edges.union(edges.select("dst", "src")).toDF("src", "dst")
            least = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
            edges = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()
            # small star: each vertex's smaller neighbours, and itself, link to the smallest of them
            least = edges.groupBy("src").agg(F.min("dst").alias("low"))
            down = edges.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
            edges = materialise(closed(down.union(least.select("src", F.col("low").alias("dst")))))
            now = checksum(edges)
            if now == seen:
                break
            seen = now
    label = edges.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("component"))
    return vertices.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
