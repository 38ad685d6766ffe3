"""Bounded expansion and reach over relationships. An edge is read from both ends as two equi-joins, never as one OR."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import cut


def steps(edges: DataFrame, direction: str = "both", kinds: list[str] | None = None) -> DataFrame:
    """(src, dst, id, row_seq): the moves that edges (id, from_entity, to_entity, kind, row_seq) allow."""
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    out = edges.select(F.col("from_entity").alias("src"), F.col("to_entity").alias("dst"), "id", "row_seq")
    back = edges.select(F.col("to_entity").alias("src"), F.col("from_entity").alias("dst"), "id", "row_seq")
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def reach(seeds: DataFrame, edges: DataFrame, hops: int, direction: str = "both") -> DataFrame:
    """(node, depth): everything within so many hops of seeds (node), with the least number of hops."""
    move = steps(edges, direction).select("src", "dst").filter("src <> dst").distinct()
    seen = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for h in range(1, hops + 1):
        new = front.join(move, front["node"] == move["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = cut(new.withColumn("depth", F.lit(h)))
        seen = seen.unionByName(front)
    return seen


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2, per_node: int = 128, most_nodes: int = 300, most_edges: int = 1000, direction: str = "both", kinds: list[str] | None = None, merges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(nodes (node, depth), edges (id), reasons it was cut short): breadth first, bounded at every hop.

    Each node takes its first per_node edges in each direction, by row_seq; aliases of a merged entity are on the front together.
    A hop that would exceed most_nodes keeps the nodes that the earliest edges lead to. hops is held to 1 to 4.
    """
    hops, reasons = max(1, min(4, hops)), []
    move = steps(edges, direction, kinds)

    def with_aliases(nodes: DataFrame, depth: int) -> DataFrame:
        if merges is None:
            return nodes.select("node").distinct().withColumn("depth", F.lit(depth))
        group = merges.select(F.col("entity_id").alias("m"), "canonical_id").unionByName(merges.select(F.col("canonical_id").alias("m"), "canonical_id")).distinct()
        root = nodes.join(group, nodes["node"] == group["m"]).select("canonical_id").distinct()
        more = group.join(root, "canonical_id", "left_semi").select(F.col("m").alias("node"))
        return nodes.select("node").unionByName(more).distinct().withColumn("depth", F.lit(depth))

    seen = cut(with_aliases(seeds, 0).orderBy("node").limit(most_nodes))
    front, n = seen, seen.count()
    for h in range(1, hops + 1):
        # only the front's edges are ranked
        near = front.select("node").join(move, F.col("node") == F.col("src")).withColumn("__r", F.row_number().over(Window.partitionBy("src").orderBy("row_seq", "dst", "id")))
        if near.filter(F.col("__r") > per_node).limit(1).count():
            reasons.append("per_node")
        new = near.filter(F.col("__r") <= per_node).groupBy(F.col("dst").alias("node")).agg(F.min("row_seq").alias("at")).join(seen.select("node"), "node", "left_anti")
        found = new.count()
        if n + found > most_nodes:
            reasons.append("nodes")
            new = new.orderBy("at", "node").limit(max(0, most_nodes - n))
        front = cut(with_aliases(new, h).join(seen.select("node"), "node", "left_anti").orderBy("node").limit(max(0, most_nodes - n)))
        seen, n = seen.unionByName(front), n + front.count()
        if not found or n >= most_nodes:
            break
    known = seen.select("node")
    inside = move.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").groupBy("id").agg(F.min("row_seq").alias("row_seq"))
    if inside.count() > most_edges:
        reasons.append("edges")
    return seen, inside.orderBy("row_seq", "id").limit(most_edges), list(dict.fromkeys(reasons))


def touching(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with an end among members (node), each once."""
    one = lambda c: edges.join(members.select(F.col("node").alias(c)).distinct(), c, "left_semi").select(edges.columns)
    return one("from_entity").unionByName(one("to_entity")).dropDuplicates(["id"])


def closure(roots: DataFrame, parents: DataFrame) -> DataFrame:
    """(id): roots (id) and all their descendants by parents (parent_id, id), however deep; it ends when a step finds nothing new, so cycles end it."""
    links = cut(parents.select("parent_id", "id").distinct())
    seen = front = cut(roots.select("id").distinct())
    while True:
        front = cut(links.join(front.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi").select("id").distinct().join(seen, "id", "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front))


def merge_boards(boards: DataFrame, most_nodes: int = 300) -> DataFrame:
    """The latest version of each node of several boards. boards: node_id, version, name."""
    last = boards.groupBy("node_id").agg(F.max("version").alias("version"), F.max_by("name", "version").alias("name"))
    return last.orderBy("node_id").limit(most_nodes)
