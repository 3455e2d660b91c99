"""Position search and counts by hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_hash(position: DataFrame, key: int) -> DataFrame:
    """Rows of one position; the comparison reaches the scan of a table clustered by hash."""
    return position.where(F.col("zobrist_hash") == F.lit(key).cast("long"))


def position_search(position: DataFrame, key: int, limit: int = 0, offset: int = 0) -> DataFrame:
    """Matches by game and ply; limit 0 asks for all, and an offset may stand alone."""
    rows = at_hash(position, key).select("game_id", "ply", "result", "white_elo", "black_elo").orderBy("game_id", "ply")
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit else rows


def count_positions(position: DataFrame, key: int | None = None) -> DataFrame:
    rows = position if key is None else at_hash(position, key)
    return rows.agg(F.count("*").alias("n"))


def restricted(position: DataFrame, game_ids: DataFrame | None) -> DataFrame:
    """Rows of the given games (column id); a semi-join, which is broadcast or shuffled as sizes ask."""
    return position if game_ids is None else position.join(game_ids.select(F.col("id").alias("game_id")), "game_id", "left_semi")


def count_distinct_games(position: DataFrame, key: int, game_ids: DataFrame | None = None) -> DataFrame:
    return restricted(at_hash(position, key), game_ids).agg(F.countDistinct("game_id").alias("n"))


def distinct_game_ids(position: DataFrame, key: int) -> DataFrame:
    return at_hash(position, key).select("game_id").distinct().orderBy("game_id")


def sample_hashes(position: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample of n rows, then their distinct hashes, so at most n.  The same rows are drawn
    however the table is partitioned, as rows are ranked by a digest of the seed and their values."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "zobrist_hash", "game_id", "ply"))
    drawn = position.select("zobrist_hash", key.alias("key"), "game_id", "ply").orderBy("key", "zobrist_hash", "game_id", "ply").limit(n)
    return drawn.select("zobrist_hash").distinct()


def tree_slice(position: DataFrame, key: int, depth: int, game_ids: DataFrame | None = None) -> DataFrame:
    """Rows up to `depth` plies behind each occurrence of a position: game_id, root_ply, depth, encoded_move,
    child_hash, result and ratings.  The occurrences of one hash join back on the game."""
    roots = restricted(at_hash(position, key), game_ids).select("game_id", F.col("ply").alias("root_ply"))
    child = position.select("game_id", "ply", "encoded_move", F.col("zobrist_hash").alias("child_hash"), "result", "white_elo", "black_elo")
    rows = roots.join(child, "game_id").where((F.col("ply") > F.col("root_ply")) & (F.col("ply") <= F.col("root_ply") + depth))
    return rows.select("game_id", "root_ply", (F.col("ply") - F.col("root_ply")).alias("depth"), "encoded_move", "child_hash", "result", "white_elo", "black_elo")


def clustered(position: DataFrame, partitions: int | None = None) -> DataFrame:
    """The table in hash order, range-partitioned: each file's and row group's minimum and maximum then let a
    scan for one hash skip all others.  Game and ply spread a hash that very many games share."""
    keys = ["zobrist_hash", "game_id", "ply"]
    dealt = position.repartitionByRange(partitions, *keys) if partitions else position.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)
