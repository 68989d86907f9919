"""Connected components of an edge table by alternating large-star and small-star rounds.

Every step is a group minimum (combined before the shuffle), written, and an equi-join of edges with
written minima, which adaptive execution may split at a hub.  A lost executor repeats one step at
most.  Rounds go on until no edge changes, which they reach whatever the graph: each moves nodes under
smaller ones only.  Edges whose ends are equal or null connect nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.shared import drop_written, materialise


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Hang each node's larger (large star) or smaller (small star) neighbours under the least one.
    ``rows`` is about how many edges there are."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = materialise(least.select("u", F.least("u", "m").alias("m")), "least", rows)
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = materialise(out.where(F.col("u") != F.col("v")).distinct(), "edges", rows)
    for done in (least, edges):
        drop_written(edges.sparkSession, done)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge table (u long, v long); component is the smallest
    node reachable.  Nodes that are alone in their component and have no edge are not listed."""
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        done = now.agg(F.count(F.lit(1)), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if done == state or not done[0]:
            break
        state = done
        now = _star(_star(now, True, 2 * done[0]), False, 2 * done[0])
    # settled: every edge hangs a node under its component's least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
