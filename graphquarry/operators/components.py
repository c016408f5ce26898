"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.plans.storage import discard, gathered, materialise

#: Share of the edges from which a node's are joined by broadcast; there are fewer such nodes than its inverse.
HOT_SHARE = 0.002
#: Edges up to which no node can have too many for one task.
FEW = 500_000


def _star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
    """(src, dst): neighbours of each src joined to the least node among them and src.

    Up to FEW edges a node's neighbours are gathered. Beyond, the least node is found by partial aggregation, and a hub's is sent to wherever
    its edges are, so that no task gets all of them.
    """
    if total <= FEW:
        near = gathered(pairs.groupBy("src").agg(F.collect_set("dst").alias("near")), total)
        near = near.withColumn("least", F.least("src", F.array_min("near")))
        if large:
            return near.withColumn("src_", F.explode(F.filter("near", lambda x: x > F.col("src")))).select(F.col("src_").alias("src"), F.col("least").alias("dst"))
        others = F.array_append(F.filter("near", lambda x: x != F.col("least")), F.col("src"))
        return near.select(F.explode(others).alias("src"), F.col("least").alias("dst"))
    least = pairs.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"), F.count(F.lit(1)).alias("many"))
    hot = least.filter(F.col("many") > total * HOT_SHARE)
    rest = pairs.join(F.broadcast(hot.select("src")), "src", "left_anti")
    joined = pairs.join(F.broadcast(hot), "src").unionByName(rest.join(least.hint("merge"), "src"))
    if large:
        return joined.filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    moved = joined.filter("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst")))


def _unsettled(state: DataFrame, edges: int) -> bool:
    """Whether some node has an edge down and another edge: then the edges, each from a node to a lesser one, aren't all stars around their least nodes."""
    ends = state.select(F.col("src").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(state.select(F.col("dst").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    by_node = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return gathered(by_node, 2 * edges).filter("down > 1 or (down = 1 and up = 1)").limit(1).count() > 0


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """(id, component) of every node of ``edges``; a component is named by its least id.

    ``most`` says how many edges there are at most, if that is known. Each round is written to the shared folder, so that a lost executor never reaches back
    beyond one round; rounds grow with the logarithm of the longest path, and end as soon as all edges lead to the least
    node of their component. Only counts reach
    the driver. Null ends and self loops give no edge; a node that has only self loops is
    its own component.
    """
    ends = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna()
    loops = ends.filter("src = dst").select("src").distinct()
    state = ends.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    state = materialise(state if most is None else gathered(state, most), "components")
    while (n := state.count()) and _unsettled(state, n):
        both = state.unionByName(state.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _star(both, True, 2 * n).filter("src <> dst")
        if 2 * n > FEW:
            large = materialise(large.distinct(), "components")
        before, state = state, materialise(gathered(_star(large, False, 2 * n).filter("src <> dst").distinct(), n), "components")
        discard(before, large)
    stars = state.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    heads = state.select("dst").distinct().select(F.col("dst").alias("id"), F.col("dst").alias("component"))
    alone = loops.join(stars.unionByName(heads).select(F.col("id").alias("src")), "src", "left_anti").select(F.col("src").alias("id"), F.col("src").alias("component"))
    return stars.unionByName(heads).unionByName(alone)
