"""Approximate nearest neighbours by largest inner product, with stable projections and kd-trees.

Inner products become distances by one more coordinate: with M the largest norm, a vector x gets
sqrt(M^2 - |x|^2) and a query 0, so that squared distance is |q|^2 + M^2 - 2 x.q.  Gaussian projections
are 2-stable: the squared length of the m-dimensional projection of a difference, over its squared
length, has the chi-square distribution with m degrees of freedom.  A kd-tree over the projections gives
neighbours in order of projected distance; each is verified on the original vectors in double precision.
The search stops when the next projected distance is so large that a vector nearer than the k-th best so
far would project that far with a probability of 1 - confidence at most.

Vectors are dealt to the cells of a kd-tree over the projections, which is drawn up from a sample of about
SAMPLE of them; every vector is indexed, in blocks of bounded size (parts of a cell, if it holds more) that
each hold a tree of their own.  A query is first searched for in its own cell.  That gives it a k-th best
score, with which the same stopping test is put to every other cell's box: only cells that pass are visited,
and there the search begins with that score.  Where vectors have near neighbours, a query so meets few cells;
where all are about as far from each other, projections of few dimensions tell little apart, most cells pass
the test, and the work grows with queries times vectors.  Partial results are cut to k per query.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, as
candidate or query; vectors meet those of their own length only; rows with equal ids are separate
candidates, but a query is never paired with its own id; queries with equal ids are searched for one by one,
those that are equal altogether once; a null id is a candidate after all others in
ties, never a query; a query with fewer candidates than k gets all of them; no vectors, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, written

DIMENSIONS, CONFIDENCE, LEAF = 8, 0.98, 64
#: Vectors of a block, queries of a group, queries and leaves that are compared at once.
BLOCK, GROUP, TILE, CHUNK = 8192, 2048, 64, 64
#: The sample that a tree of cells is drawn up from, most cells of a tree, and most trees: one for each vector length
#: with more than one in TREES of all vectors.
SAMPLE, CELLS, TREES = 20_000, 4096, 100
SEED = 5
PLACED = "dim int, cell int, vec_id long, vector array<double>, scale double, query boolean"
INDEX = "dim int, cell int, part int, ids binary, vectors binary, projected binary, scale double"
ASKED = "dim int, cell int, query_id long, number long, vector array<double>, least double"
FOUND = "query_id long, number long, vec_id long, score double"
NO_ID = (1 << 63) - 1


def chi_square_cdf(x: float, m: int) -> float:
    """For an even number of degrees of freedom: one minus a Poisson sum."""
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < p else (low, middle)
    return high


def projection(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim + 1, DIMENSIONS))


def kd_order(points: np.ndarray) -> np.ndarray:
    """Row order in which each run of LEAF points is a leaf of a kd-tree: median splits along the widest side."""
    order = np.arange(len(points))
    todo = [(0, len(points))]
    while todo:
        low, high = todo.pop()
        if high - low > LEAF:
            own = order[low:high]
            side = int(np.argmax(np.ptp(points[own], axis=0)))
            half = -(-(high - low) // LEAF) // 2 * LEAF
            order[low:high] = own[np.argsort(points[own, side], kind="stable")]
            todo += [(low, low + half), (low + half, high)]
    return order


class Block:
    """One block of vectors in tree order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, scale: float):
        self.ids, self.vectors, self.scale = ids, vectors, scale
        cuts = np.arange(0, len(ids), LEAF)
        self.ends = np.append(cuts, len(ids))
        self.low, self.high = np.minimum.reduceat(projected, cuts), np.maximum.reduceat(projected, cuts)

    @staticmethod
    def built(ids: np.ndarray, vectors: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest = np.sqrt(np.maximum(scale - (vectors**2).sum(1), 0))
        projected = np.column_stack([vectors, rest]) @ projection(vectors.shape[1])
        order = kd_order(projected)
        return ids[order], vectors[order], projected[order]

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, far: float, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the k nearest found of each query, of those that reach its least score; far: the
        chi-square quantile of the stopping test."""
        return [x for low in range(0, len(q), TILE) for x in self._tile(ids[low : low + TILE], q[low : low + TILE], k, far, least[low : low + TILE].copy())]

    def _tile(self, ids: np.ndarray, q: np.ndarray, k: int, far: float, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        shadows = q @ projection(q.shape[1])[:-1]
        away = np.zeros((len(q), len(self.low)))
        for side in range(self.low.shape[1]):  # squared distances of projected queries and leaves
            x = shadows[:, side, None]
            away += np.maximum(np.maximum(self.low[:, side] - x, x - self.high[:, side]), 0) ** 2
        base = (q * q).sum(1) + self.scale
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in q]

        def verify(i: int, rows: np.ndarray) -> None:
            rows = rows[self.ids[rows] != ids[i]]
            score = (self.vectors[rows] * q[i]).cumsum(1)[:, -1]  # added up from the left for every row, so equal vectors tie
            found, scores = np.append(best[i][0], self.ids[rows]), np.append(best[i][1], score)
            keep = np.lexsort((found, -scores))[:k]
            best[i] = found[keep], scores[keep]
            if len(keep) >= k:
                least[i] = max(least[i], scores[keep[-1]])

        done = np.zeros(away.shape, bool)
        for i in np.flatnonzero(np.isinf(least)).tolist():  # nothing known yet: the nearest leaves first
            first = np.argsort(away[i], kind="stable")[:4]
            done[i, first] = True
            verify(i, np.concatenate([np.arange(self.ends[x], self.ends[x + 1]) for x in first]))
        for low in range(0, away.shape[1], CHUNK):
            leaves = slice(low, min(low + CHUNK, away.shape[1]))
            passed = (away[:, leaves] <= (far * np.maximum(base - 2 * least, 0))[:, None]) & ~done[:, leaves]
            some = np.flatnonzero(passed.any(1))
            if not len(some):
                continue
            a, b = self.ends[leaves.start], self.ends[leaves.stop]
            rough = q[some] @ self.vectors[a:b].T
            near = (rough >= (least[some] - 1e-9 * base[some])[:, None]) & np.repeat(passed[some], np.diff(self.ends[leaves.start : leaves.stop + 1]), axis=1)
            for x in np.flatnonzero(near.any(1)).tolist():
                verify(int(some[x]), a + np.flatnonzero(near[x]))
        return best


class Cells:
    """A kd-tree of cells over projected points: sides and cuts of its inner nodes, level by level."""

    def __init__(self, sides: np.ndarray, cuts: np.ndarray):
        self.sides, self.cuts = sides, cuts
        self.depth = (len(sides) + 1).bit_length() - 1

    @classmethod
    def drawn(cls, points: np.ndarray, cells: int) -> Cells:
        """Median splits along the widest side; cells: a power of two."""
        sides, cuts = np.zeros(cells - 1, np.int64), np.zeros(cells - 1)
        parts = {0: points}
        for node in range(cells - 1):
            own = parts.pop(node)
            if len(own):
                sides[node] = int(np.argmax(np.ptp(own, axis=0)))
                cuts[node] = np.median(own[:, sides[node]])
            left = own[:, sides[node]] < cuts[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[left], own[~left]
        return cls(sides, cuts)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.sides[node]] >= self.cuts[node])
        return node - len(self.sides)

    def away(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points and cells, at least."""
        n, m = points.shape
        low, high = np.full((1, m), -np.inf), np.full((1, m), np.inf)
        first = 0
        for level in range(self.depth):
            nodes = np.arange(first, first + (1 << level))
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            at = np.arange(len(nodes))
            high[2 * at, self.sides[nodes]] = np.minimum(high[2 * at, self.sides[nodes]], self.cuts[nodes])
            low[2 * at + 1, self.sides[nodes]] = np.maximum(low[2 * at + 1, self.sides[nodes]], self.cuts[nodes])
            first += len(nodes)
        out = np.zeros((n, len(low)))
        for side in range(m):
            x = points[:, side, None]
            out += np.maximum(np.maximum(low[:, side] - x, x - high[:, side]), 0) ** 2
        return out


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _projected(vectors: np.ndarray, scale: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(scale - (vectors**2).sum(1), 0))
    return np.column_stack([vectors, rest]) @ projection(vectors.shape[1])


def _draw(table: pa.Table) -> pa.Table:
    n, scale = table.column("n")[0].as_py(), table.column("scale")[0].as_py()
    cells = min(CELLS, 1 << max(0, -(-n // BLOCK) - 1).bit_length())
    made = Cells.drawn(_projected(_matrix(table.column("vector")), scale), cells)
    return pa.table({"dim": table.column("dim")[:1], "sides": [made.sides.tobytes()], "cuts": [made.cuts.tobytes()]})


def _build(table: pa.Table) -> pa.Table:
    scale = table.column("scale")[0].as_py()
    ids, vectors, projected = Block.built(table.column("vec_id").to_numpy(), _matrix(table.column("vector")), scale)
    return pa.table({c: table.column(c)[:1] for c in ("dim", "cell", "part")} | {"ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "projected": [projected.tobytes()], "scale": [scale]})


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of each vector length by themselves."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield batch.filter(pa.array(dims == dim))


def _search(k: int, far: float):
    def search(queries: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(index):
            row = index.slice(0, 1).to_pylist()[0]
            ids = np.frombuffer(row["ids"], np.int64)
            block = Block(ids, np.frombuffer(row["vectors"]).reshape(len(ids), -1), np.frombuffer(row["projected"]).reshape(len(ids), -1), row["scale"])
            query_ids, numbers = queries.column("query_id").to_numpy(), queries.column("number").to_numpy()
            found = block.search(query_ids, _matrix(queries.column("vector")), k, far, queries.column("least").to_numpy().copy())
            out = [(np.full(len(f), a), np.full(len(f), b), f, x) for a, b, (f, x) in zip(query_ids, numbers, found, strict=True)]
        joined = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table({n.split()[0]: pa.array(c) for n, c in zip(FOUND.split(", "), joined, strict=True)})

    return search


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(F.col(vector), lambda x: x != 0)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, confidence: float = CONFIDENCE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score for every row of vectors where `queries` holds."""
    spark, far = vectors.sparkSession, chi_square_quantile(confidence, DIMENSIONS)
    prepare(spark)
    clean = vectors.where(usable(vector_col)).withColumn("query", F.coalesce(queries & F.col(id_col).isNotNull(), F.lit(False)))
    clean = clean.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.size(vector_col).alias("dim"), "query")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    sizes = written(clean.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("scale")), "sizes")  # a row for each vector length
    known = clean.join(sizes, "dim")

    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = known.where((F.col("n") > BLOCK) & (F.col("n") * TREES > total))
    drawn = F.pmod(F.xxhash64("vector", "id"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n")
    trees = {r.dim: Cells(np.frombuffer(r.sides, np.int64), np.frombuffer(r.cuts)) for r in large.where(drawn).groupBy("dim").applyInArrow(_draw, "dim int, sides binary, cuts binary").collect()}  # TREES rows
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch):
                tree, cell = shared.value.get(rows.column("dim")[0].as_py()), np.zeros(len(rows), np.int64)
                if tree:
                    cell = tree.of(_projected(_matrix(rows.column("vector")), rows.column("scale")[0].as_py()))
                yield pa.RecordBatch.from_arrays([rows.column("dim"), pa.array(cell.astype(np.int32)), rows.column("id"), rows.column("vector"), rows.column("scale"), rows.column("query")], names=[c.split()[0] for c in PLACED.split(", ")])

    placed = written(known.select("dim", F.coalesce("id", F.lit(NO_ID)).alias("id"), "vector", "scale", "query").mapInArrow(place, PLACED), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cells = written(cells, "cells")
    dealt = placed.join(cells, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), "parts").cast("int"))
    index = written(dealt.groupBy("dim", "cell", "part").applyInArrow(_build, INDEX), "index")

    def found(asked: DataFrame, name: str) -> DataFrame:
        """Queries with a cell each, searched for in all its parts; groups of queries are of bounded size."""
        per = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
        per = written(per, "groups")
        keys = ["dim", "cell", "part", "group"]
        asked = asked.join(per, ["dim", "cell"]).join(cells, ["dim", "cell"])
        asked = asked.withColumn("group", F.pmod(F.xxhash64("number", "query_id"), "groups").cast("int")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).drop("groups", "parts")
        blocks = index.join(per, ["dim", "cell"]).withColumn("group", F.explode(F.expr("sequence(0, groups - 1)"))).drop("groups")
        return written(asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(_search(k, far), FOUND), name)

    asked = placed.where("query").select("dim", "cell", F.col("vec_id").alias("query_id"), F.xxhash64("vector").alias("number"), "vector", F.lit(float("-inf")).alias("least"))
    asked = written(asked.dropDuplicates(["dim", "query_id", "number"]), "queries")
    out = found(asked, "near")
    if trees:
        nearest_first = W.partitionBy("query_id", "number").orderBy(F.desc("score"))
        least = out.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") == k).select("query_id", "number", F.col("score").alias("reached"))
        further = asked.join(least, ["query_id", "number"], "left").withColumn("least", F.coalesce("reached", "least")).join(sizes.select("dim", "scale"), "dim")

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows in _by_length(batch):
                    tree = shared.value.get(rows.column("dim")[0].as_py())
                    if tree:
                        q, reached = _matrix(rows.column("vector")), rows.column("least").to_numpy()
                        away = tree.away(q @ projection(q.shape[1])[:-1])
                        base = (q * q).sum(1) + rows.column("scale")[0].as_py()
                        with np.errstate(invalid="ignore"):
                            ok = away <= (far * np.maximum(base - 2 * reached, 0))[:, None]
                        ok[np.arange(len(rows)), rows.column("cell").to_numpy()] = False
                        x, cell = np.nonzero(ok)
                        for low in range(0, len(x), 4096):
                            some = rows.take(pa.array(x[low : low + 4096]))
                            yield pa.RecordBatch.from_arrays([some.column("dim"), pa.array(cell[low : low + 4096].astype(np.int32)), *(some.column(c) for c in ("query_id", "number", "vector", "least"))], names=[c.split()[0] for c in ASKED.split(", ")])

        further = written(further.select("dim", "cell", "query_id", "number", "vector", "least", "scale").mapInArrow(route, ASKED), "routes")
        out = out.unionByName(found(further, "far"))
    nearest_first = W.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


#: The query in DuckDB, over all pairs of a query and a candidate.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, x FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE list_count(embedding) = len(embedding) AND len(embedding) > 0)
  WHERE isfinite(list_sum(x)) AND isfinite(list_max(x)) AND isfinite(list_min(x)) AND (list_max(x) <> 0 OR list_min(x) <> 0)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x) AS score
  FROM v q JOIN v c ON len(q.x) = len(c.x) AND q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20
"""
