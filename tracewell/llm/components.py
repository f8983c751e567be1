"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum, combined before the shuffle, and an equi-join; the minima are written to the shared
folder, so both sides of the join are plain shuffles that adaptive execution can split where a hub is hot. Nothing but two
counts a round reaches the driver: edges, by which tables are written in no more files than they need, and nodes that keep
the edges from being stars. Stars end the search, so edges that are stars already cost no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize


#: Edges in a file of a written table, and files that it may have anyway.
FILE_ROWS, FILES = 50_000, 8


def _star(edges: DataFrame, large: bool, files: int) -> DataFrame:
    """One step over edges (u, v), u > v."""
    if large:
        arcs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select("u", "v")
    least = materialize(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files), "star")
    joined = arcs.join(least, "u")
    if large:
        out = joined.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    done = materialize(out.where("u != v").distinct().coalesce(files), "edges")
    drop_materialized(edges.sparkSession, least)
    return done


def _state(edges: DataFrame) -> tuple[int, int]:
    """Edges, and nodes that have two edges down or edges both ways."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
    loose = F.col("down") > F.when(F.col("least") == 0, 0).otherwise(1)
    return tuple(nodes.agg(F.coalesce(F.sum("down"), F.lit(0)), F.count_if(loose)).first())


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable. Loops and repeats are fine."""
    spark = edges.sparkSession
    pairs = edges.where(F.col(left) != F.col(right)).select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).distinct()
    now = materialize(pairs, "edges")
    while True:
        n, loose = _state(now)
        if not loose:
            break
        files = max(FILES, -(-n // FILE_ROWS))
        wide = _star(now, True, files)
        narrow = _star(wide, False, files)
        drop_materialized(spark, now, wide)
        now = narrow
    # A star: every node points at its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
