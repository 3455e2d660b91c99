"""Mixing sources to target weights with a time-varying curriculum.

Sources get targets by weight, no source above `most` times its size, the rest reshared by weight.
A source's documents lie on a line in an order drawn from a hash of their ids, one pass of the
source after another; a document is taken once for each pass whose middle of it lies below the
target.  Training time runs from 0 to 1.  Each source's weight follows a schedule over time; its
integral is the cumulative token demand, and a document taken at offset x of target y stands at the
time when that integral has reached x / y.  A later taking has an offset of its own, a source's size
further on, and so a later time.  Ordering all takings by their times mixes the sources as the schedules
ask at every moment.

Offsets are prefix sums in two levels: sums of (source, hash bucket), then rows within a bucket, so
a source with a third of all rows is spread over BUCKETS groups.

Defined results: a null or empty text has size 0, is never above its share and takes 0 words; a null
source is a source of its own, last in order; a null id hashes as the word null; equal rows are
separate documents; an empty table gives no rows; columns other than id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source: the groups that a source's prefix sums are dealt to.
BUCKETS = 4096
#: Weight over training time as (time, factor) knots, joined by straight lines; each has mean 1.
#: Sources take these in turn: early, steady and late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """One row per source: sid (rank, null last), source, source_size, weight, target.

    Capping sources in the order of size by weight: with the first k capped, what is left by the weight
    left is the level that the others get; the highest level that no remaining source's cap is below holds.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    per = per.withColumn("sid", F.row_number().over(by_name))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "sid")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(total)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    held = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return per.withColumn("target", F.least("cap", F.coalesce(held * F.col("weight"), F.col("cap")))).select("sid", "source", "source_size", "weight", "target")


def time_of(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral has reached `share` of its whole."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, done, out = sum(areas), 0.0, None
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas):
        slope = (w1 - w0) / (t1 - t0)
        x = share * F.lit(whole) - F.lit(done)
        at = F.lit(t0) + (x / F.lit(w0) if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * x, F.lit(0.0))) - F.lit(w0)) / F.lit(slope))
        done += area
        out = F.when(share * F.lit(whole) <= F.lit(done), at) if out is None else out.when(share * F.lit(whole) <= F.lit(done), at)
    return F.least(F.coalesce(out, F.lit(knots[-1][0])), F.lit(knots[-1][0]))


def placed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total: float = 1.5, most: float = 2.0, schedules=SCHEDULES, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`mix` in any order."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sized.withColumn("key", key).withColumn("bucket", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % BUCKETS).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    sources = source_targets(sums.select("source", F.col("in_bucket").alias("size")), weights, total, most)
    by_bucket = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # BUCKETS rows at most
    starts = sums.withColumn("before", F.coalesce(F.sum("in_bucket").over(by_bucket), F.lit(0))).drop("in_bucket")
    s, b, r = sources.alias("s"), starts.alias("b"), rows.alias("r")
    keyed = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select("sid", "source_size", "target", F.col("b.source").alias("b_source"), F.col("b.bucket").alias("b_bucket"), "before")
    rows = r.join(keyed, F.col("r.source").eqNullSafe(F.col("b_source")) & (F.col("r.bucket") == F.col("b_bucket")))
    within = W.partitionBy("sid", "b_bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size"))
    middle = F.col("start") + F.col("size") / F.lit(2.0)
    passes = [(F.lit(p) * F.col("source_size") + middle < F.col("target")) & (F.col("size") > 0) for p in range(int(-(-most // 1)))]
    rows = rows.withColumn("copies", sum((p.cast("int") for p in passes[1:]), passes[0].cast("int")))
    positions = []
    for p in range(len(passes)):
        share = (F.lit(p) * F.col("source_size") + F.col("start")) / F.col("target")
        position = None
        for i, knots in enumerate(schedules):
            here = (F.col("sid") - 1) % len(schedules) == i
            position = F.when(here, time_of(share, knots)) if position is None else position.when(here, time_of(share, knots))
        positions.append(position)
    rows = rows.withColumn("position", F.when(F.col("copies") > 0, positions[0])).withColumn("positions", F.slice(F.array(*positions), F.lit(1), F.col("copies")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "position", "positions", "copies", "key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document, range-sorted by position: doc_id, size, source_size, target, taken (words the
    mix takes, repeats counted), position (time of the first taking; null if not taken), positions (times of
    all takings, ascending; empty if not taken), copies and key."""
    return placed(docs, **options).repartitionByRange("position", "key", "doc_id").sortWithinPartitions("position", "key", "doc_id")


def taken_documents(docs: DataFrame, id_col: str = "doc_id", position_col: str | None = None, **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken, with all their columns; range-sorted
    by the positions of the takings, which stand in `position_col` if one is asked for.

    Positions go to each document by its id; rows that share an id share those of the one with most.
    """
    takings = placed(docs, id_col=id_col, **options).where("copies > 0")
    most = takings.groupBy("doc_id").agg(F.max(F.struct("copies", "positions", "key")).alias("_most")).select(F.col("doc_id").alias("_id"), F.col("_most.positions").alias("_positions"), F.col("_most.key").alias("_key"))
    joined = docs.join(most, F.col(id_col).eqNullSafe(F.col("_id")))
    order = ["_position", "_key", "_id"]
    rows = joined.withColumn("_position", F.explode("_positions")).drop("_positions").repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.select(*[F.col(c) for c in docs.columns], *([F.col("_position").alias(position_col)] if position_col else []))


#: The query in DuckDB: the same order of documents, and water-filling in closed form.
MIX_SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
k AS (SELECT *, CAST(('0x' || substr(key, 1, 8)) AS BIGINT) % 4096 AS bucket FROM r),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM k GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (sid - 1) % 3] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS cap FROM p),
l AS (
  SELECT *, cap / weight AS ratio,
         ((SELECT sum(source_size) FROM w) * CAST(1.5 AS DOUBLE)
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT sid, source, source_size,
         least(cap, coalesce((SELECT max(level) FROM l WHERE level <= ratio) * weight, cap)) AS target FROM l),
o AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, t.sid,
         CAST(sum(k.size) OVER (PARTITION BY t.sid ORDER BY k.bucket, k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - k.size AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
c AS (
  SELECT *, CASE WHEN size > 0 AND start + size / CAST(2 AS DOUBLE) < target THEN 1 ELSE 0 END
          + CASE WHEN size > 0 AND source_size + (start + size / CAST(2 AS DOUBLE)) < target THEN 1 ELSE 0 END AS copies FROM o)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CASE WHEN copies > 0 THEN least(0 + CASE (sid - 1) % 3
         WHEN 0 THEN (sqrt(greatest(CAST(2.25 AS DOUBLE) + CAST(-2 AS DOUBLE) * (start / target), 0)) - CAST(1.5 AS DOUBLE)) / CAST(-1 AS DOUBLE)
         WHEN 1 THEN start / target
         ELSE (sqrt(greatest(CAST(0.25 AS DOUBLE) + CAST(2 AS DOUBLE) * (start / target), 0)) - CAST(0.5 AS DOUBLE)) / CAST(1 AS DOUBLE) END, 1) END AS position
FROM c
"""
