"""Connected components of a graph as DataFrame rounds.

Large-star and small-star steps alternate: every node links its larger
neighbours, then its smaller ones, to the smallest node around it, until the
links are stars.  Each round is written to the shared folder, so lineage stays
short and a lost executor repeats one round at most.  Nothing is collected.

The smallest node of a component has links to all others.  While all nodes fit a
broadcast, links meet their minimum by it; beyond that nodes of so many links do,
which are bounded in number.  So no task gets a whole component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import BROADCAST_BYTES, ROW_BYTES, materialize


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: Nodes of more links are hubs; with this many hubs or more, only those of still more links.
HUB_LINKS, MOST_HUBS = 500, 200_000


def star(edges: DataFrame, n_edges: int, large: bool) -> DataFrame:
    """One step on ``n_edges`` links (a, b), a > b."""
    around = both_ways(edges) if large else edges
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
    if 2 * n_edges * (ROW_BYTES + 16) <= BROADCAST_BYTES:  # as many nodes at most
        return star_of(around.join(F.broadcast(least.drop("n")), "a"), least, large)
    least = materialize(least, "least")
    # 2 * n_edges links at most, so fewer than MOST_HUBS nodes have more links than this.
    limit = max(HUB_LINKS, 2 * n_edges // MOST_HUBS)
    hubs = F.broadcast(least.filter(F.col("n") > limit).select("a", "m"))
    light = least.filter(F.col("n") <= limit).select("a", "m")
    if least.filter(F.col("n") > limit).isEmpty():
        joined = around.join(light, "a")
    else:
        joined = around.join(hubs, "a").unionByName(around.join(hubs, "a", "left_anti").join(light, "a"))
    return star_of(joined, least, large)


def star_of(joined: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """The links of a step from links with their first node's least neighbour ``m``."""
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node in ``links`` (a, b); the component is its smallest node."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = materialize(edges, "links")
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            break
        state = mark
        edges = materialize(star(edges, mark[0], True), "links")
        edges = materialize(star(edges, mark[0], False), "links")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
