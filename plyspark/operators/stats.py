"""Opening statistics and rating distributions of the moves played from a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .search import at_hash, restricted

DEFAULT_WIDTH = 25


def _mean_elo() -> Column:
    both = F.col("white_elo").isNotNull() & F.col("black_elo").isNotNull()
    return F.when(both, (F.col("white_elo") + F.col("black_elo")) / F.lit(2.0))


def continuations(position: DataFrame, key: int, game_ids: DataFrame | None = None) -> DataFrame:
    """The path set: one row for each (game, move, child) played from the position, with the first ply of it."""
    roots = restricted(at_hash(position, key), game_ids).select("game_id", F.col("ply").alias("root_ply"))
    child = position.where(F.col("ply") > 0).select("game_id", (F.col("ply") - 1).alias("root_ply"), "encoded_move", F.col("zobrist_hash").alias("child_hash"), "result", "white_elo", "black_elo")
    keys = ["game_id", "encoded_move", "child_hash", "result", "white_elo", "black_elo"]
    return roots.join(child, ["game_id", "root_ply"]).groupBy(*keys).agg(F.min("root_ply").alias("root_ply"))


def opening_stats(position: DataFrame, key: int, game_ids: DataFrame | None = None) -> DataFrame:
    """One row per continuation.

    Frequency, results and mean ratings count every game that reaches the child position by any route (of
    the given games, if any); the weighted score and the samples come from games that played the move here.
    """
    path = continuations(position, key, game_ids)
    moves = path.groupBy("encoded_move", "child_hash").agg(
        F.min(F.struct("game_id", "root_ply")).alias("first"),
        F.max(F.struct("game_id", "root_ply")).alias("last"),
        F.min("root_ply").alias("root_ply"),
        F.sum(F.col("result") * _mean_elo()).alias("scored"),
        F.sum(_mean_elo()).alias("weight"),
    )
    children = path.select(F.col("child_hash").alias("zobrist_hash")).distinct()
    reached = restricted(position, game_ids).join(children, "zobrist_hash", "left_semi")
    games = reached.select("zobrist_hash", "game_id", "result", "white_elo", "black_elo").distinct()
    totals = games.groupBy("zobrist_hash").agg(
        F.count("*").alias("frequency"),
        F.count_if(F.col("result") > 0).alias("white_wins"),
        F.count_if(F.col("result") == 0).alias("draws"),
        F.count_if(F.col("result") < 0).alias("black_wins"),
        F.avg(F.col("white_elo").cast("double")).alias("avg_white_elo"),
        F.avg(F.col("black_elo").cast("double")).alias("avg_black_elo"),
    )
    out = moves.join(totals, moves.child_hash == totals.zobrist_hash)
    score = F.coalesce(F.col("scored") / F.nullif(F.col("weight"), F.lit(0.0)), F.lit(0.0))
    return out.select(
        "encoded_move", "child_hash", "root_ply", "frequency", "white_wins", "draws", "black_wins", "avg_white_elo", "avg_black_elo",
        F.col("first.game_id").alias("sample_min"), F.col("last.game_id").alias("sample_max"), score.alias("elo_weighted_score"),
        F.col("first.root_ply").alias("sample_min_ply"), F.col("last.root_ply").alias("sample_max_ply"),
    )


def attributed(stats: DataFrame, contexts: DataFrame) -> DataFrame:
    """Adds eco and opening_name of the lowest sample game that exists, else of the highest; continuations with
    neither are dropped.  contexts: id, eco, opening_name."""
    low = contexts.select(F.col("id").alias("sample_min"), F.struct("id", "eco", "opening_name").alias("low"))
    high = contexts.select(F.col("id").alias("sample_max"), F.struct("id", "eco", "opening_name").alias("high"))
    out = stats.join(low, "sample_min", "left").join(high, "sample_max", "left").withColumn("context", F.coalesce("low", "high"))
    out = out.where(F.col("context").isNotNull())
    ply = F.when(F.col("low").isNotNull(), F.col("sample_min_ply")).otherwise(F.col("sample_max_ply"))
    return out.select(*stats.columns, F.col("context.id").alias("sample_id"), ply.alias("sample_ply"), F.col("context.eco").alias("eco"), F.col("context.opening_name").alias("opening_name"))


def in_order(named: DataFrame, san: str = "san") -> DataFrame:
    """Continuations by frequency, the most frequent first, then by the bytes of their notation; those without come last."""
    return named.orderBy(F.desc("frequency"), F.col(san).asc_nulls_last(), "encoded_move")


def elo_distribution(position: DataFrame, key: int, width: int = DEFAULT_WIDTH, game_ids: DataFrame | None = None) -> DataFrame:
    """Results by move and bucket of mean rating, with empty buckets between a move's lowest and highest."""
    if width <= 0:
        raise ValueError("invalid argument: width must be positive")
    path = continuations(position, key, game_ids).where(_mean_elo().isNotNull())
    games = path.select("game_id", "encoded_move", "result", "white_elo", "black_elo").distinct()
    bucket = (F.floor(_mean_elo() / F.lit(width)) * width).cast("int")
    counted = games.groupBy("encoded_move", bucket.alias("bucket")).agg(
        F.count_if(F.col("result") > 0).alias("white_wins"), F.count_if(F.col("result") == 0).alias("draws"), F.count_if(F.col("result") < 0).alias("black_wins"), F.count("*").alias("game_count")
    )
    ends = counted.groupBy("encoded_move").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    spine = ends.select("encoded_move", F.explode(F.sequence("low", "high", F.lit(width))).alias("bucket"))
    names = ["white_wins", "draws", "black_wins", "game_count"]
    return spine.join(counted, ["encoded_move", "bucket"], "left").fillna(0, names).orderBy("encoded_move", "bucket")
