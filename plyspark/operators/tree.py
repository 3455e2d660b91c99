"""Opening trees: an edge table by depth, and its assembly into nodes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .search import tree_slice

DEFAULT_DEPTH, MAX_DEPTH = 5, 65535


def opening_tree_edges(position: DataFrame, key: int, depth: int = DEFAULT_DEPTH, game_ids: DataFrame | None = None) -> DataFrame:
    """One row per (depth, parent_hash, encoded_move): how often the move was played there, by occurrence
    of the root (a game that visits it twice counts twice), results, rating sums, and a sample game."""
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError("invalid argument: depth")
    rows = tree_slice(position, key, depth, game_ids)
    before = F.lag("child_hash").over(W.partitionBy("game_id", "root_ply").orderBy("depth"))
    rows = rows.withColumn("parent_hash", F.coalesce(before, F.lit(key).cast("long")))
    both = F.col("white_elo").isNotNull() & F.col("black_elo").isNotNull()
    mean = F.when(both, (F.col("white_elo") + F.col("black_elo")) / F.lit(2.0))
    return rows.groupBy("depth", "parent_hash", "encoded_move").agg(
        F.min("child_hash").alias("child_hash"), F.count("*").alias("frequency"),
        F.count_if(F.col("result") > 0).alias("white_wins"), F.count_if(F.col("result") == 0).alias("draws"), F.count_if(F.col("result") < 0).alias("black_wins"),
        F.avg(F.col("white_elo").cast("double")).alias("avg_white_elo"), F.avg(F.col("black_elo").cast("double")).alias("avg_black_elo"),
        F.coalesce(F.sum(F.col("result") * mean) / F.nullif(F.sum(mean), F.lit(0.0)), F.lit(0.0)).alias("elo_weighted_score"),
        F.min("game_id").alias("sample_id"), F.min(F.struct("game_id", "root_ply")).getField("root_ply").alias("sample_root_ply"),
    )


@dataclass
class TreeNode:
    """A position of the tree; the edge that led here, and the children if it is expanded."""

    zobrist_hash: int
    depth: int
    edge: dict = field(default_factory=dict)
    expanded: bool = False
    children: list[TreeNode] = field(default_factory=list)


def assemble(edges: list[dict], key: int, depth: int, name=lambda edge: str(edge["encoded_move"])) -> TreeNode:
    """Nested nodes from collected edges, for presentation.

    A child that two parents of one depth share appears under both.  Children go by frequency, then name
    (the move's notation).  Nodes at the last depth stay unexpanded; depth 0 leaves the root so.
    """
    by_parent: dict[tuple[int, int], list[dict]] = {}
    for edge in edges:
        by_parent.setdefault((edge["depth"], edge["parent_hash"]), []).append(edge)
    root = TreeNode(key, 0)
    todo = [root]
    while todo:
        node = todo.pop()
        if node.depth >= depth:
            continue
        node.expanded = True
        for edge in sorted(by_parent.get((node.depth + 1, node.zobrist_hash), []), key=lambda e: (-e["frequency"], name(e).encode())):
            node.children.append(TreeNode(edge["child_hash"], node.depth + 1, edge))
        todo += node.children
    return root


def expand(node: TreeNode, stats: list[dict], name=lambda row: str(row["encoded_move"])) -> TreeNode:
    """Expands a node with collected `opening_stats` of its hash; an expanded node stays as it is."""
    if not node.expanded:
        node.expanded = True
        node.children = [TreeNode(r["child_hash"], node.depth + 1, r) for r in sorted(stats, key=lambda r: (-r["frequency"], name(r).encode()))]
    return node
