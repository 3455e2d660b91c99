"""Changes to tables as new tables: upserts, duplicates, deletes, patches.

Nothing is updated in place: each operator returns the table as it will be, to be written beside the old
one and swapped in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

REVIEW = ("new", "needs_review", "studied", "archived")
IDENTITY = ["white_id", "black_id", "event_id", "date", "result", "moves"]


def new_dimension_rows(incoming: DataFrame, existing: DataFrame, attributes: list[str], order: str = "seq") -> DataFrame:
    """Names not yet in the dimension, each with the attributes of its first appearance; later ones never change it."""
    first = incoming.groupBy("name").agg(F.min_by(F.struct(*attributes), order).alias("first"), F.min(order).alias(order))
    return first.join(existing.select("name"), "name", "left_anti").select("name", *[F.col(f"first.{a}").alias(a) for a in attributes], order)


def with_ids(rows: DataFrame, start: int, order: list[str], column: str = "id") -> DataFrame:
    """Consecutive ids from start in the given order, without one task seeing all rows.

    Rows are range-partitioned and sorted once; the number of rows of each partition (a row per partition
    on the driver) gives each its first id.
    """
    spark = rows.sparkSession
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.persist()
    sizes = rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    firsts, total = [], start
    for part, n in sizes:
        firsts.append((part, total))
        total += n
    offsets = spark.createDataFrame(firsts, "_part int, _first long")
    within = F.col("_row") - F.shiftleft(F.col("_part").cast("long"), 33)
    return rows.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_first") + within).drop("_part", "_row", "_first")


def dedup_games(incoming: DataFrame, existing: DataFrame | None, identity: list[str] = IDENTITY, order: str = "seq") -> DataFrame:
    """Incoming rows whose identity is new: the first of each, by order, and none that exists.  Nulls compare equal."""
    keys = [F.coalesce(F.col(c).cast("string") if c != "moves" else F.concat_ws(",", F.col(c).cast("array<string>")), F.lit("\0")) for c in identity]
    key = F.sha2(F.concat_ws("\1", *keys), 256)
    rows = incoming.withColumn("_key", key)
    first = rows.withColumn("_nth", F.row_number().over(W.partitionBy("_key").orderBy(order))).where("_nth = 1").drop("_nth")
    if existing is not None:
        first = first.join(existing.select(key.alias("_key")).distinct(), "_key", "left_anti")
    return first.drop("_key")


def delete_games(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The table without the given games; use column game_id for positions and tags.  Players and events stay."""
    return table.join(ids.select(F.col("id").alias(column)), column, "left_anti")


def patch_games(game: DataFrame, patches: DataFrame, fields: list[str], only_manual: bool = True) -> DataFrame:
    """Fields replaced where a patch has a value; only games entered by hand may change."""
    p = patches.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    allowed = F.col("source_type") == "manual" if only_manual else F.lit(True)
    out = game.join(p, "id", "left")
    return out.withColumns({c: F.when(allowed, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in fields}).drop(*[f"_{c}" for c in fields])


def sync_elo(position: DataFrame, patches: DataFrame) -> DataFrame:
    """Ratings of positions follow their game's patch, side by side; a side without a value stays."""
    p = patches.select(F.col("id").alias("game_id"), F.col("white_elo").alias("_w"), F.col("black_elo").alias("_b"))
    out = position.join(p, "game_id", "left")
    return out.withColumns({"white_elo": F.coalesce("_w", "white_elo"), "black_elo": F.coalesce("_b", "black_elo")}).drop("_w", "_b")


def replace_notes(game_tag: DataFrame, notes: DataFrame, tag: str = "_notes") -> DataFrame:
    """The notes tag of the given games (id, notes) replaced; an empty text removes it."""
    given = notes.where("notes is not null")
    kept = game_tag.join(given.select(F.col("id").alias("game_id")), "game_id", "left_semi").where(F.col("name") != tag)
    others = game_tag.join(given.select(F.col("id").alias("game_id")), "game_id", "left_anti")
    last = kept.groupBy("game_id").agg(F.max("pos").alias("last"))
    added = given.where("notes <> ''").select(F.col("id").alias("game_id"), "notes").join(last, "game_id", "left")
    added = added.select("game_id", (F.coalesce("last", F.lit(-1)) + 1).cast("int").alias("pos"), F.lit(tag).alias("name"), F.col("notes").alias("value"))
    return others.unionByName(kept).unionByName(added)


def repeated_tags(game_tag: DataFrame) -> DataFrame:
    """Games that name a tag twice, which makes their insertion fail."""
    return game_tag.groupBy("game_id", "name").count().where("count > 1").select("game_id").distinct()


def set_provenance(game: DataFrame, changes: DataFrame) -> DataFrame:
    """source_type, source_label, review_status replaced where the change has a value; unknown states are refused."""
    if changes.where(F.col("review_status").isNotNull() & ~F.col("review_status").isin(*REVIEW)).limit(1).count():
        raise ValueError("invalid review_status")
    return patch_games(game, changes, ["source_type", "source_label", "review_status"], only_manual=False)


def import_summary(parsed: DataFrame) -> DataFrame:
    """Counters of an import from rows with status committed, duplicate, parse_error or empty_game."""
    bad = F.col("status").isin("parse_error", "empty_game")
    return parsed.agg(F.count("*").alias("attempted"), F.count_if(F.col("status") == "committed").alias("committed"), F.count_if(bad | (F.col("status") == "duplicate")).alias("skipped"), F.count_if(bad).alias("errors"))
