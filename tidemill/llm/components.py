"""Connected components by alternating large-star and small-star over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, store

#: Share of all edges over which a node's edges are joined by broadcast, and the fewest edges for which it pays.
HEAVY_SHARE, HEAVY_LEAST = 10_000, 64


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star operation on ``n`` distinct edges (u, v).

    Every node's neighbours are tied to the smallest of them and itself: the
    larger neighbours by large-star, the smaller ones and the node by
    small-star. The minimum is pre-aggregated and joined back. Nodes with over
    n / HEAVY_SHARE edges, of which there can be 2 * HEAVY_SHARE at most, get
    theirs by broadcast, so no task has to take all edges of one node. The others
    are merged, so that nothing that grows with the edges passes the driver.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "low").alias("m"), "k")
    heavy = max(HEAVY_LEAST, n // HEAVY_SHARE)
    many, few = (least.filter(F.col("k") > heavy).select("u", "m"), least.filter(F.col("k") <= heavy).select("u", "m"))
    marked = near.join(F.broadcast(many), "u", "left")
    tied = marked.filter("m is not null").unionByName(marked.filter("m is null").select("u", "v").join(few.hint("merge"), "u"))
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _state(edges: DataFrame):
    """The number of edges (u > v), and of nodes that keep them from being stars: tied to several smaller nodes, or to both sides."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
    return nodes.agg(F.sum("ups").alias("n"), F.expr("count_if(ups > 1 or ups = 1 and down = 1)").alias("open")).collect()[0]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the integer edges (u, v); component is the smallest node reachable.

    Loops, repeated edges and null ends are ignored. An empty table gives an
    empty result. Each step is written to the shared folder, so a lost
    executor costs that step at most; the loop ends when the edges are stars,
    that is when every node points at its component's least node.
    """
    now = store(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state.open:
            break
        half = store(_star(now, True, state.n), "edges")
        discard(now)
        now = store(_star(half, False, state.n), "edges")
        discard(half)
        state = _state(now)
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
