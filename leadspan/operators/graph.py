"""Walks, version heads and connected components over edge tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspan.session import cut_lineage


def walk(edges: DataFrame, anchors: DataFrame, depth: int = 2, relations: Sequence[str] | None = None, incoming: bool = False) -> DataFrame:
    """Nodes within ``depth`` hops of each query's anchors (query_id, type, id); entities are passed through, not returned.

    One join per hop over the frontier only; places already visited by the query are removed before the next hop.
    """
    used = edges if relations is None else edges.filter(F.col("relation").isin(list(relations)))
    hops = used.select(F.col("from_type").alias("type"), F.col("from_id").alias("id"), F.col("to_type").alias("_t"), F.col("to_id").alias("_i"))
    if incoming:
        hops = hops.union(used.select("to_type", "to_id", "from_type", "from_id"))
    frontier = anchors.select("query_id", "type", "id").distinct()
    visited = frontier
    for _ in range(depth):
        nxt = frontier.join(hops, ["type", "id"]).select("query_id", F.col("_t").alias("type"), F.col("_i").alias("id")).distinct()
        frontier = cut_lineage(nxt.join(visited, ["query_id", "type", "id"], "left_anti"))
        visited = visited.union(frontier)
    return visited.filter("type = 'node'").select("query_id", F.col("id").alias("node_id"))


def _follow(pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pointer doubling: (node, to) pairs that reached an end, and those that never will.

    It stops once a round settles nothing: in a chain every depth occurs, so what is left leads into a cycle.
    """
    settled, moving, left = pointers.limit(0), pointers, pointers.count()
    while left:
        ahead = moving.select(F.col("node").alias("to"), F.col("to").alias("_next"), F.lit(False).alias("_done")).union(settled.select("node", "to", F.lit(True)))
        stepped = moving.join(ahead, "to", "left").select("node", F.coalesce("_next", "to").alias("to"), F.coalesce("_done", F.lit(True)).alias("_end"))
        stepped = cut_lineage(stepped)
        settled = settled.union(stepped.filter("_end").select("node", "to"))
        moving = stepped.filter("NOT _end").select("node", "to")
        now_left = moving.count()
        if now_left == left:
            break
        left = now_left
    return settled, moving


def canonical_head(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, head_id): the end of the chain of newest incoming ``supersedes`` edges; in a cycle, where it is entered."""
    parent = edges.filter("relation = 'supersedes' AND to_type = 'node' AND from_type = 'node'").groupBy(F.col("to_id").alias("node")).agg(
        F.max_by("from_id", F.struct("created_at", "edge_id")).alias("to")
    )
    parent = cut_lineage(parent)
    settled, looping = _follow(parent)
    left = looping.count()
    heads = settled
    if left:
        inside = parent.join(looping.select("node"), "node", "left_semi")
        jumped = _jump(inside, max(1, left.bit_length()))
        on_cycle = jumped.select(F.col("to").alias("node")).distinct()
        tails = cut_lineage(inside.join(on_cycle, "node", "left_anti"))
        entered, _ = _follow(tails)
        heads = heads.union(entered).union(on_cycle.select("node", F.col("node").alias("to")))
    return nodes.select("node_id").join(heads.select(F.col("node").alias("node_id"), F.col("to").alias("_head")), "node_id", "left").select(
        "node_id", F.coalesce("_head", "node_id").alias("head_id")
    )


def _jump(pointers: DataFrame, rounds: int) -> DataFrame:
    """Doubling inside a closed set where every node has a successor; after enough rounds all pointers lie on cycles."""
    moving = pointers
    for _ in range(rounds):
        ahead = moving.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        moving = cut_lineage(moving.join(ahead, "to").select("node", F.col("_next").alias("to")))
    return moving


def connected_components(pairs: DataFrame) -> DataFrame:
    """(node, component) for every node of ``pairs`` (a, b); the component is its smallest node.

    Each round every node takes the smallest label around it and then the label of that label, until nothing changes.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).filter("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        low = labels.join(near, "node").select("node", "component", F.least("component", "_near").alias("_low"))
        via = labels.select(F.col("node").alias("_low"), F.col("component").alias("_far"))
        stepped = cut_lineage(low.join(via, "_low", "left").select("node", "component", F.least("_low", F.coalesce("_far", "_low")).alias("_new")))
        labels = stepped.select("node", F.col("_new").alias("component"))
        if stepped.filter("component <> _new").isEmpty():
            return labels
