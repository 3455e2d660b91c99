"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written

MAX_ROUNDS = 60
#: So many links (32 MB) are joined in one task; more go round by round over all tasks.
LOCAL_LINKS = 1_000_000


def _known(root: dict[int, int], x: int) -> int:
    root.setdefault(x, x)
    return x


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's links as one link from each node to the smallest node that its own links reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = find(_known(root, a)), find(_known(root, b))
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    for low in range(0, len(nodes), 50_000):
        part = nodes[low : low + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, component) for every node of links(a, b): component is the smallest node reached.

    Each round turns the links of a node towards its smallest neighbour: first the links to larger nodes,
    then those to smaller ones.  Rounds grow with the logarithm of the largest component.  A node with very
    many links is a hot key of one join only, which adaptive execution splits; sums are pre-aggregated.
    Self-links count for their node; an empty table gives an empty result.
    """
    prepare(links.sparkSession)
    links = written(links.select("a", "b"), name)
    if links.count() <= LOCAL_LINKS:
        return links.coalesce(1).mapInArrow(_contracted, "a long, b long").toDF("node", "component")
    # Links of one task are contracted before any are shuffled.
    edges = written(links.mapInArrow(_contracted, "a long, b long").distinct(), name)
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    edges = edges.where("a > b")
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a > b").distinct(), name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct(), name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise ValueError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct().unionByName(alone.join(edges, alone.node == edges.a, "left_anti")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
