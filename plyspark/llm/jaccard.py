"""N-gram Jaccard join: links texts whose five-word shingle sets have a resemblance of 0.75 or more.

Equal sets are one class.  A class's point is its count vector: shingles hashed into groups (GROUPS, or more
for large sets), the number in each.  The sum of two points' smaller coordinates bounds the overlap from above; an R-tree over
points bounds whole boxes by their largest coordinates.

One tree over all points would not be distributed, and in so many dimensions its boxes overlap; so points
are first dealt out by prefix: two linked sets, both in one fixed order, share one of their first
n - ceil(0.75 n) + 1 shingles.  The order puts shingles of many documents last, by a count table of fixed
size that only orders and never decides.  So a passage in a third of all documents is in nobody's prefix
unless the document is little else.  Each prefix shingle's classes are one small collection of points.

Then two rounds find every component.  The first verifies each collection's classes against its first
class and the next few in one order of all classes, so that near copies, whose collections have much the
same members, meet much the same few.  The second merges the collections that have one first class, takes
those that still hold more than one component, builds their R-trees, and verifies each pair of different
components whose bound allows a link.  Pairs that share a component add nothing and are not expanded, so a
group of near copies that link costs its size, not its square.  Collections of over BLOCK classes are
joined block by block.

Defined results: texts without words have an empty set, linked with nothing; texts of one to four words
have their sequence as one shingle; a null id is a row of its own class; rows with equal ids and texts
each give a row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, split_by, without, written
from .components import components
from .shingles import shingle_sets, signed
from .textkernel import mix

PERCENT = 75
GROUPS = 256
#: Slots of the count table, 4 bytes each; its chunks are summed apart.
SLOTS, CHUNKS = 1 << 20, 32
#: Points of one block of a large collection, and of one leaf of a tree.
BLOCK, LEAF = 4096, 32
#: Boxes below an inner node of a tree, and pairs of boxes that are compared at once.
FAN, BOXES = 8, 4096
#: Pairs that leave a task at once.
PAIRS = 20_000
#: Beside the first class of its collection, a class meets so many that follow it in one order of all classes.
AHEAD = 3
#: A class with more than one in so many rows is joined by a broadcast.
HOT = 1000
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def digests(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set, whatever its order."""
    out = []
    with np.errstate(over="ignore"):
        for c in (_C1, _C2):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * c + c), dtype=np.uint64)])
            out.append(mix(run[offsets[1:]] - run[offsets[:-1]] + np.diff(offsets).astype(np.uint64)))
    return out[0], out[1]


def points(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Count vectors, two bytes a group: GROUPS groups, or as many (a power of two) as a quarter of the set's size
    asks for, so that chance overlaps of large sets are bounded as well as those of small ones."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        groups = max(GROUPS, 1 << ((b - a) // 4).bit_length())
        counts = np.bincount((values[a:b] & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        out.append(counts.astype("<u2").tobytes())
    return out


def point(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, "<u2").astype(np.int32)


def folded(at: np.ndarray, groups: int) -> np.ndarray:
    """A point, or rows of points, with only so many groups: groups that share their low bits are summed."""
    return at if at.shape[-1] == groups else at.reshape(*at.shape[:-1], -1, groups).sum(-2)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


def need(na, nb):
    """Overlap that sets of these sizes must reach to be linked."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


_ROWS = "kind int, doc_id long, n int, c1 long, c2 long, payload binary"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text (kind 0), and the task's counts of shingles by slot (kind 1, a row for each chunk)."""
    seen = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for low, high, values, offsets in shingle_sets(batch.column(1), True):
            seen += np.bincount((values >> np.uint64(44)).astype(np.int64), minlength=SLOTS)
            c1, c2 = digests(values, offsets)
            n = high - low
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).slice(low, n), pa.array(np.diff(offsets).astype(np.int32)), pa.array(signed(c1)), pa.array(signed(c2)), pa.array(points(values, offsets), pa.binary())], names=_names(_ROWS))
    chunks = [zlib.compress(c.astype("<i8").tobytes(), 1) for c in np.split(seen, CHUNKS)]
    none = pa.nulls(CHUNKS, pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(CHUNKS, np.int32)), pa.array(np.arange(CHUNKS)), pa.nulls(CHUNKS, pa.int32()), none, none, pa.array(chunks, pa.binary())], names=_names(_ROWS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(stored), "<i8")
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], names=["doc_id", "payload"])


def count_table(rows: DataFrame) -> np.ndarray:
    """How many documents' shingles fall in each slot, summed over all tasks: SLOTS numbers."""
    parts = rows.where("kind = 1").select("doc_id", "payload")
    summed = parts.repartition(CHUNKS, "doc_id").mapInArrow(_sum_chunks, "doc_id long, payload binary")
    out = np.zeros(SLOTS, np.int64)
    for chunk, stored in summed.collect():  # CHUNKS rows
        out.reshape(CHUNKS, -1)[chunk] = np.frombuffer(zlib.decompress(stored), "<i8")
    # Only the order matters: counts over twice the mean are ranked, all others are alike.
    return np.where(out > 2 * out.mean() + 8, np.minimum(out, (1 << 31) - 1), 0).astype(np.int32)


def prefixes(docs: DataFrame, order: np.ndarray) -> DataFrame:
    """(sig, c1) for each prefix shingle of each set; a task gives a class that it has just seen no more rows."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, known = shared.value, set()
        for batch in batches:
            for _, _, values, offsets in shingle_sets(batch.column(1), True):
                c1 = signed(digests(values, offsets)[0])
                sizes = np.diff(offsets)
                fresh = np.array([c not in known and not known.add(c) for c in c1.tolist()], bool)
                if len(known) > 500_000:
                    known.clear()
                text = np.repeat(np.arange(len(sizes)), sizes)
                by = np.lexsort((values, rank[(values >> np.uint64(44)).astype(np.int64)], text))
                place = np.arange(len(values)) - np.repeat(offsets[:-1], sizes)
                keep = (place < (sizes - (-(-PERCENT * sizes // 100)) + 1)[text]) & fresh[text]
                yield pa.RecordBatch.from_arrays([pa.array(signed(values[by][keep])), pa.array(c1[text[keep]])], names=["sig", "c1"])

    return docs.mapInArrow(emit, "sig long, c1 long")


class Tree:
    """A bulk-loaded R-tree: leaves of LEAF points, inner nodes of FAN boxes.  A box keeps the largest coordinates
    and the smallest and largest size of what is below it; level 0 are the leaves, the last level has one box."""

    def __init__(self, at: np.ndarray, n: np.ndarray):
        self.order = np.lexsort((at[:, :8].argmax(1), n))  # linked sets have like sizes
        at, n = at[self.order], n[self.order]
        cuts = np.arange(0, len(n), LEAF)
        self.at, self.n, self.cuts = at, n, np.append(cuts, len(n))
        self.top = [np.maximum.reduceat(at, cuts, axis=0)]
        self.small, self.large = [np.minimum.reduceat(n, cuts)], [np.maximum.reduceat(n, cuts)]
        while len(self.small[-1]) > 1:
            cuts = np.arange(0, len(self.small[-1]), FAN)
            self.top.append(np.maximum.reduceat(self.top[-1], cuts, axis=0))
            self.small.append(np.minimum.reduceat(self.small[-1], cuts))
            self.large.append(np.maximum.reduceat(self.large[-1], cuts))

    def below(self, level: int, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The boxes below those of a level, and for each which of `boxes` it is below."""
        first = boxes * FAN
        number = np.minimum(first + FAN, len(self.small[level - 1])) - first
        of = np.repeat(np.arange(len(boxes)), number)
        return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number), of

    def pairs(self, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (of self, of other) whose bound reaches what their sizes need, by descending both trees
        together; each pair of points of one tree comes once."""
        todo = [(len(self.small) - 1, len(other.small) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            x, y, i, j = todo.pop()
            if len(i) > BOXES:
                todo += [(x, y, i[k : k + BOXES], j[k : k + BOXES]) for k in range(0, len(i), BOXES)]
                continue
            small, large, small_, large_ = self.small[x][i], self.large[x][i], other.small[y][j], other.large[y][j]
            keep = (large * 100 >= PERCENT * small_) & (large_ * 100 >= PERCENT * small)
            keep[keep] = np.minimum(self.top[x][i[keep]], other.top[y][j[keep]]).sum(1) >= need(small[keep], small_[keep])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if x == y == 0:
                yield from self._points(other, i, j)
                continue
            if x >= y:
                i, of = self.below(x, i)
                j, x_ = j[of], x - 1
            else:
                x_ = x
            y_ = y
            if y >= x:
                j, of = other.below(y, j)
                i, y_ = i[of], y - 1
            if other is self:
                i, j = i[i <= j], j[i <= j]
            todo.append((x_, y_, i, j))

    def _points(self, other: Tree, leaves: np.ndarray, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i, j in zip(leaves.tolist(), others.tolist(), strict=True):
            a, b = slice(self.cuts[i], self.cuts[i + 1]), slice(other.cuts[j], other.cuts[j + 1])
            bound = np.minimum(self.at[a][:, None], other.at[b][None]).sum(2)
            p, q = np.nonzero(bound >= need(self.n[a][:, None], other.n[b][None]))
            if other is self and i == j:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield self.order[p + a.start], other.order[q + b.start]


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of different components in each (sig, i, j); rows come sorted by these three."""

    def done(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        own = [r for r in rows if r[3] == rows[0][1]]
        theirs = own if rows[0][1] == rows[0][2] else [r for r in rows if r[3] == rows[0][2]]
        if not own or not theirs:
            return
        sides = [_by_groups(own), _by_groups(theirs)]
        for x_groups, x in sides[0].items():
            for y_groups, y in sides[1].items():
                # Sets of linked sizes have as many groups, or half or twice as many.
                if (own is theirs and y_groups < x_groups) or not x_groups <= 2 * y_groups <= 4 * x_groups:
                    continue
                same = own is theirs and x_groups == y_groups
                groups = min(x_groups, y_groups)
                a = Tree(folded(x[0], groups), x[1])
                b = a if same else Tree(folded(y[0], groups), y[1])
                for i, j in a.pairs(b):
                    keep = x[3][i] != y[3][j]
                    # A pair that meets in several collections counts in the first of them only.
                    for k in np.flatnonzero(keep).tolist():
                        mine, theirs_ = x[4][i[k]], y[4][j[k]]
                        keep[k] = np.intersect1d(mine, theirs_, assume_unique=True)[0] == rows[0][0]
                    low, high = np.minimum(x[2][i], y[2][j])[keep], np.maximum(x[2][i], y[2][j])[keep]
                    yield from zip(low.tolist(), high.tolist())

    def pairs() -> Iterator[tuple[int, int]]:
        rows, key = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key and rows:
                    yield from done(rows)
                    rows = []
                key = row[:3]
                rows.append(row)
        if rows:
            yield from done(rows)

    # One collection can have millions of pairs; they leave as they are found.
    found = pairs()
    while out := list(islice(found, PAIRS)):
        yield _pair_batch(out)


def _by_groups(rows: list[tuple]) -> dict[int, tuple]:
    """Points, sizes, nodes, components and collections of the rows, by their number of groups."""
    kinds: dict[int, list[tuple]] = {}
    for r in rows:
        kinds.setdefault(len(r[7]) // 2, []).append(r)
    return {k: (np.stack([point(r[7]) for r in rs]), *(np.array([r[c] for r in rs], np.int64) for c in (6, 4, 5)), [np.array(r[8], np.int64) for r in rs]) for k, rs in kinds.items()}


def _pair_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = sorted(set(pairs))
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in both], pa.int64()), pa.array([b for _, b in both], pa.int64())], names=["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, na, nb, pa_, pb = (c.to_pylist() for c in batch.columns)
        keep = [i for i in range(len(a)) if bound(point(pa_[i]), point(pb[i])) >= need(na[i], nb[i])]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, sa, sb = (c.to_pylist() for c in batch.columns)
        keep = []
        for i in range(len(a)):
            x, y = np.frombuffer(sa[i], np.uint64), np.frombuffer(sb[i], np.uint64)
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            shared = int((x[at] == y).sum())
            if 100 * shared >= PERCENT * (len(x) + len(y) - shared):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, values, offsets in shingle_sets(batch.column(1), True):
            c1, c2 = digests(values, offsets)
            stored = [values[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(signed(c1)), pa.array(signed(c2)), pa.array(stored, pa.binary())], names=["doc_id", "c1", "c2", "own"])


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of classes (a, b) that are linked; sets are made anew from the texts of the classes concerned."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes.select("node", "rep", "c1", "c2"), "node")
    wanted = written(wanted, "wanted")
    some, _ = split_by(docs, "doc_id", wanted, "rep")
    made = some.mapInArrow(_sets, "doc_id long, c1 long, c2 long, own binary").alias("s")
    w = wanted.alias("w")
    sets = made.join(w, F.col("s.doc_id").eqNullSafe(F.col("w.rep")) & (F.col("s.c1") == F.col("w.c1")) & (F.col("s.c2") == F.col("w.c2")))
    sets = written(sets.select("node", "own").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("sb")), "b")
    return written(both.select("a", "b", "sa", "sb").mapInArrow(_linked, "a long, b long"), "linked")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links lead to), and
    class1, class2 (digests of its set)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(docs.mapInArrow(_summaries, _ROWS), "summaries")
    texts = rows.where("kind = 0")
    classes = texts.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("payload").alias("point"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    sig = W.partitionBy("sig")
    dealt = prefixes(docs, count_table(rows)).withColumn("first", F.min("c1").over(sig)).withColumn("last", F.max("c1").over(sig))
    shared = dealt.where("first < last").select("sig", "c1", "first").distinct()  # as dealt out: no new shuffle
    ahead = W.partitionBy("sig").orderBy("c1")
    shared = shared.withColumns({f"next{k}": F.lead("c1", k).over(ahead) for k in range(1, AHEAD + 1)} | {"size": F.count("*").over(sig)})
    shared = written(shared, "prefixes")

    brief = classes.select("c1", "node", "n")
    partners = F.array_distinct(F.array_compact(F.array("first", *[f"next{k}" for k in range(1, AHEAD + 1)])))
    ends = shared.select("c1", F.explode(partners).alias("first")).where("c1 <> first")
    ends = ends.select(F.least("c1", "first").alias("c1"), F.greatest("c1", "first").alias("first")).distinct()
    sized = ends.join(brief, "c1").join(brief.select(F.col("c1").alias("first"), F.col("node").alias("node2"), F.col("n").alias("n2")), "first")
    sized = sized.where(F.least("n", "n2") * 100 >= F.greatest("n", "n2") * PERCENT)
    sized = sized.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()
    by_a = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("point").alias("pa"))
    by_b = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("point").alias("pb"))
    pairs = sized.join(by_a, "a").join(by_b, "b").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_bounded, "a long, b long")
    pairs = written(pairs, "pairs")
    links = _verified(pairs, docs, classes)
    found = written(components(links), "components")

    # Of AHEAD + 2 classes or fewer, every pair is verified.  The others are merged by their first class, as the
    # many shingles that near copies share have much the same classes: a class goes to each merged collection once.
    left = shared.where(F.col("size") > AHEAD + 2).select(F.col("first").alias("sig"), "c1").distinct()
    left = left.join(brief.select("c1", "node"), "c1").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    left = left.select("sig", "node", "comp")
    open_ = left.groupBy("sig").agg(F.count("*").alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    left = left.join(open_.where("least < most").drop("least", "most"), "sig")
    left = left.withColumn("nb", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    met = left.withColumn("with", F.explode(F.expr("sequence(0, nb - 1)")))
    own = left.groupBy("node").agg(F.collect_list("sig").alias("sigs"))
    met = met.join(classes.select("node", "n", "point"), "node").join(own, "node")
    met = met.select("sig", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "comp", "n", "point", "sigs")
    crossed = met.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_cross_pairs, "a long, b long").distinct()
    more = written(crossed.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        links = written(links.unionByName(_verified(more, docs, classes)), "links")
        found = written(components(links), "components")

    least = found.join(classes.select("node", "rep", "c1", "c2"), "node")
    least = least.join(least.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select("c1", "c2", "component_id")
    every = classes.select("c1", "c2", "rep", "copies").join(least, ["c1", "c2"], "left")
    every = every.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.coalesce("component_id", "rep").alias("component_id"), "copies")
    every = written(every, "classes")
    out = texts.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "c1", "c2")
    # A class with more than one row in HOT of all goes to every task, of which there are at most HOT; the rows of
    # the others are dealt by class.
    hot = F.broadcast(every.where(F.col("copies") * HOT > every.agg(F.sum("copies")).first()[0]).drop("copies")) if not every.isEmpty() else every.drop("copies")
    same = (F.col("n_shingles") > 0) & (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2"))
    cold = out.join(hot, same, "left_anti").join(every.drop("copies"), same, "left")
    out = out.join(hot, same).unionByName(cold)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("c1").alias("class1"), F.col("c2").alias("class2"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the smallest id of each component only, all columns kept.

    Of rows with equal id and text one stays; rows with a null id, which nothing can name, stay.
    """
    found = written(jaccard_components(docs, id_col, text_col), "found")
    dropped = found.where("doc_id <> component_id").select("doc_id")
    repeated = found.where("doc_id is not null").groupBy("doc_id", "class1", "class2").count().where("count > 1").select("doc_id")
    some, plain = split_by(without(docs, id_col, dropped, "doc_id"), id_col, repeated, "doc_id")
    return plain.unionByName(some.dropDuplicates([id_col, text_col]))


#: The query in DuckDB: all pairs of documents that share a shingle, and whom their links reach.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
d AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(CAST(len(w) AS BIGINT) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM w JOIN reach ON reach.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""
