"""Game lists, single games, contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import GameFilter, filtered, page_limit
from .search import at_hash

LIST_COLUMNS = ["id", "white", "black", "white_elo", "black_elo", "result", "event", "date", "eco", "source_type", "source_label", "review_status"]


def game_view(game: DataFrame, player: DataFrame, event: DataFrame) -> DataFrame:
    """Games with names in place of ids.  Ratings of the game come first, the players' after."""
    w = player.select(F.col("id").alias("white_id"), F.col("name").alias("white"), F.col("elo").alias("_w"))
    b = player.select(F.col("id").alias("black_id"), F.col("name").alias("black"), F.col("elo").alias("_b"))
    e = event.select(F.col("id").alias("event_id"), F.col("name").alias("event"))
    out = game.join(w, "white_id").join(b, "black_id").join(e, "event_id", "left")
    return out.withColumns({"white_elo": F.coalesce("white_elo", "_w"), "black_elo": F.coalesce("black_elo", "_b")}).drop("_w", "_b")


def at_position(games: DataFrame, position: DataFrame, key: int) -> DataFrame:
    """Games that reach a position."""
    return games.join(at_hash(position, key).select(F.col("game_id").alias("id")), "id", "left_semi")


def matching(games: DataFrame, f: GameFilter, position: DataFrame | None = None) -> DataFrame:
    out = filtered(games, f)
    return at_position(out, position, f.position) if f.position is not None else out


def find_games(games: DataFrame, f: GameFilter, position: DataFrame | None = None) -> DataFrame:
    """A page of the list, by id; absent texts are empty."""
    rows = matching(games, f, position)
    rows = rows.fillna("", [c for c in ("result", "event", "date", "eco") if c in rows.columns])
    rows = rows.select(*[c for c in LIST_COLUMNS if c in rows.columns]).orderBy("id")
    rows = rows.offset(f.offset) if f.offset else rows
    return rows.limit(page_limit(f.limit))


def find_games_count(games: DataFrame, f: GameFilter, position: DataFrame | None = None) -> DataFrame:
    return matching(games, f, position).agg(F.count("*").alias("total_count"))


def find_game_ids(games: DataFrame, f: GameFilter, position: DataFrame | None = None) -> DataFrame:
    """All ids that match; no cap, no order, so that a semi-join can use it as it is."""
    return matching(games, f, position).select("id")


def game_contexts(game: DataFrame, game_tag: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id, eco, opening_name (the first tag named Opening), and moves where the table has them."""
    rows = game if ids is None else game.join(ids.select("id"), "id", "left_semi")
    opening = game_tag.where("name = 'Opening'").groupBy(F.col("game_id").alias("id")).agg(F.min_by("value", "pos").alias("opening_name"))
    return rows.select("id", "eco", *[c for c in ("moves",) if c in rows.columns]).join(opening, "id", "left")


def get_game(games: DataFrame, game_tag: DataFrame, game_id: int) -> DataFrame:
    """One game with its tags in order; no row if there is none."""
    tags = game_tag.where(F.col("game_id") == game_id).groupBy(F.col("game_id").alias("id"))
    tags = tags.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", "value"))), lambda t: F.struct(t["name"].alias("name"), t["value"].alias("value"))).alias("tags"))
    return games.where(F.col("id") == game_id).join(tags, "id", "left")
