"""Table schemas and their version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 2

POSITION = "zobrist_hash long, game_id long, ply int, encoded_move int, result byte, white_elo int, black_elo int"
PLAYER = "id long, name string, elo int, title string, country string"
EVENT = "id long, name string, site string, date string"
GAME = (
    "id long, white_id long, black_id long, event_id long, date string, result string, eco string, moves array<int>, "
    "white_elo int, black_elo int, source_type string, source_label string, review_status string"
)
GAME_TAG = "game_id long, pos int, name string, value string"
TABLES = {"game": GAME, "player": PLAYER, "event": EVENT, "game_tag": GAME_TAG, "position": POSITION}

#: Columns that version 1 of the game table lacks, with what its rows get.
ADDED_IN_2 = {"source_type": "imported", "source_label": None, "review_status": "new"}


class SchemaMismatch(ValueError):
    """A table of a newer version than this package knows."""


def migrated(game: DataFrame, version: int) -> DataFrame:
    """A game table of an older version, with the columns that it lacks; a newer one is refused."""
    if version > SCHEMA_VERSION:
        raise SchemaMismatch(f"schema version {version} is newer than {SCHEMA_VERSION}")
    for name, value in ADDED_IN_2.items():
        if name not in game.columns:
            game = game.withColumn(name, F.lit(value).cast("string"))
    return game
