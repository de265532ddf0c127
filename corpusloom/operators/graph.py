"""Connected components by frontier breadth-first search over a hash-partitioned adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def _rank(col):
    """Total order of nodes: by hash, so seeds spread evenly, then by the node itself."""
    return F.struct(F.xxhash64(col).alias("h"), col.alias("n"))


def _voronoi(adj: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): every node gets a seed that reaches it in the fewest steps.

    Seeds are the nodes whose hash is below that of all their neighbours, so each component has
    at least one (its least node), and seeds are dense enough that the search stays shallow even
    on long chains. All seeds expand together, one join per step.
    """
    seeds = (
        adj.groupBy("u")
        .agg(F.min(_rank(F.col("v"))).alias("low"))
        .select("u", (_rank(F.col("u")) < F.col("low")).alias("seed"))
    )
    state, nodes = scratch.counted(seeds)
    first, reached = scratch.counted(state.where("seed").select(F.col("u").alias("node"), F.col("u").alias("label")))
    labels = [first]
    frontier = labels[0]
    while reached < nodes:
        known = labels[0]
        for more in labels[1:]:
            known = known.unionByName(more)
        step = (
            frontier.join(adj, frontier["node"] == adj["u"])
            .groupBy("v")
            .agg(F.min(_rank(F.col("label"))).alias("best"))
            .select(F.col("v").alias("node"), F.col("best.n").alias("label"))
            .join(known.select("node"), "node", "left_anti")
        )
        frontier, grown = scratch.counted(step)
        if not grown:
            raise RuntimeError("a node of the graph can't be reached from any seed")
        reached += grown
        labels.append(frontier)
        if len(labels) >= 8:
            merged = labels[0]
            for more in labels[1:]:
                merged = merged.unionByName(more)
            frontier = scratch.table(frontier)
            whole = scratch.table(merged)
            scratch.drop(*labels)
            labels = [whole]
    out = labels[0]
    for more in labels[1:]:
        out = out.unionByName(more)
    scratch.drop(state)
    return out


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that occurs in an edge with another node.

    ``edges`` has two columns of one type, in any order of ends; loops and repeated edges are
    ignored and null ends dropped. The root is some node of the component, the same for all of
    its nodes; an empty input gives an empty result. Where the regions of two seeds touch, the
    seeds are joined in a contracted graph, which is searched in the same way until it has no
    edge left; each round leaves at most half of the nodes. Nothing is collected.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = (
        pairs.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .unionByName(pairs.select(F.col(b).alias("u"), F.col(a).alias("v")))
        .distinct()
    )
    adj, left = scratch.counted(both)
    mapping = None
    while left:
        labels = scratch.table(_voronoi(adj, scratch))
        here = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
        there = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
        touching = (
            adj.join(here, "u").join(there, "v").where("lu <> lv").select(F.col("lu").alias("u"), F.col("lv").alias("v")).distinct()
        )
        smaller, left = scratch.counted(touching)
        scratch.drop(adj)
        adj = smaller
        if mapping is None:
            mapping = labels
        else:
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            older = mapping
            mapping = scratch.table(
                older.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            )
            scratch.drop(older, labels)
    if mapping is None:
        return both.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    return mapping.select("node", F.col("label").alias("root"))
