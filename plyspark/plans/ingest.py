"""Imports of PGN files into a bundle, rebuilds, and changes to single games.

An import is one batch: parse, keep the first of equal games that the bundle lacks, add what the
dimensions lack, number the new rows in order of file and offset, and commit all tables at once.  Running it
again adds nothing, so an import that was cut off is simply repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import find_tag, parse_elo, position_rows, positions_of, result_number
from ..operators import changes
from ..sources.bundle import Bundle
from ..sources.pgn import parse_games, read_pgn

#: Tags that have columns of their own; all others are kept in game_tag.
OWN_TAGS = ("Event", "Site", "Date", "White", "Black", "Result", "WhiteElo", "BlackElo", "WhiteTitle", "BlackTitle", "ECO")


@dataclass(frozen=True)
class ImportSummary:
    attempted: int
    committed: int
    skipped: int
    errors: int


def described(parsed: DataFrame) -> DataFrame:
    """Parsed games with their tags as columns; unknown dates and empty texts are null."""
    def text(key):
        value = find_tag(F.col("tags"), key)
        return F.when(value != "", value)

    date = F.when(~text("Date").isin("????.??.??"), text("Date"))
    rest = F.filter("tags", lambda t: ~t["name"].isin(*OWN_TAGS))
    return parsed.withColumns({
        "white": F.coalesce(text("White"), F.lit("?")), "black": F.coalesce(text("Black"), F.lit("?")),
        "white_elo": parse_elo(find_tag(F.col("tags"), "WhiteElo")), "black_elo": parse_elo(find_tag(F.col("tags"), "BlackElo")),
        "white_title": text("WhiteTitle"), "black_title": text("BlackTitle"), "event": text("Event"), "site": text("Site"), "date": date, "eco": text("ECO"), "extra": rest,
    })


def _stored(bundle: Bundle, df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the bundle's folder of work in progress, read back: later steps start from there."""
    path = f"{bundle.path}/_work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return bundle.spark.read.schema(df.schema).parquet(path)


def import_texts(bundle: Bundle, texts: DataFrame, source_type: str = "imported", source_label: str | None = None) -> ImportSummary:
    """Imports games from rows (file, byte_offset, text)."""
    order = ["file", "byte_offset"]
    rows = _stored(bundle, described(parse_games(texts)), "parsed")
    good = rows.where("status = 'ok'")
    people = good.select("white", "white_elo", "white_title", *order).toDF("name", "elo", "title", *order)
    people = people.withColumn("side", F.lit(0)).unionByName(good.select("black", "black_elo", "black_title", *order).toDF("name", "elo", "title", *order).withColumn("side", F.lit(1)))
    people = people.withColumn("country", F.lit(None).cast("string")).withColumn("seq", F.struct(*order, "side"))
    ids = dict(bundle.manifest["next_ids"])
    player, event, game = bundle.table("player"), bundle.table("event"), bundle.table("game")

    added_players = _numbered(bundle, changes.new_dimension_rows(people, player, ["elo", "title", "country"]), ids, "player")
    events = good.where("event is not null").select(F.col("event").alias("name"), "site", "date", F.struct(*order).alias("seq"))
    added_events = _numbered(bundle, changes.new_dimension_rows(events, event, ["site", "date"]), ids, "event")
    players = player.select("id", "name").unionByName(added_players.select("id", "name"))
    all_events = event.select("id", "name").unionByName(added_events.select("id", "name"))

    keyed = good.join(players.select(F.col("id").alias("white_id"), F.col("name").alias("white")), "white")
    keyed = keyed.join(players.select(F.col("id").alias("black_id"), F.col("name").alias("black")), "black")
    keyed = keyed.join(all_events.select(F.col("id").alias("event_id"), F.col("name").alias("event")), "event", "left").withColumn("seq", F.struct(*order))
    unique = changes.dedup_games(keyed, game, order="seq")
    repeated = F.size(F.array_distinct(F.transform("extra", lambda t: t["name"]))) < F.size("extra")
    unique = unique.withColumn("extra", F.when(repeated, F.filter("extra", lambda t, i: F.array_position(F.transform("extra", lambda u: u["name"]), t["name"]) == i + 1)).otherwise(F.col("extra")))
    new = _numbered(bundle, unique, ids, "game")
    new = new.withColumns({"source_type": F.lit(source_type), "source_label": F.lit(source_label).cast("string"), "review_status": F.lit("new")})
    tags = new.select(F.col("id").alias("game_id"), F.posexplode("extra").alias("pos", "tag")).select("game_id", "pos", F.col("tag.name").alias("name"), F.col("tag.value").alias("value"))
    positions = positions_of(new.select(F.col("id").alias("game_id"), "moves", "hashes", result_number(F.col("result")).alias("result"), "white_elo", "black_elo"))

    attempted, ok = rows.agg(F.count("*"), F.count_if(F.col("status") == "ok")).first()
    committed = new.count()
    if committed:
        append = {"game": new, "game_tag": tags, "position": positions}
        append |= {"player": added_players} if ids.get("player") != bundle.manifest["next_ids"].get("player") else {}
        append |= {"event": added_events} if ids.get("event") != bundle.manifest["next_ids"].get("event") else {}
        bundle.commit(append=append, game_count=bundle.manifest["game_count"] + committed, next_ids=ids)
    return ImportSummary(attempted, committed, attempted - committed, attempted - ok)


def _numbered(bundle: Bundle, rows: DataFrame, ids: dict[str, int], name: str) -> DataFrame:
    """Rows with ids in order of seq, written; the next free id moves on."""
    rows = _stored(bundle, rows, name)
    first = ids.get(name, 1)
    n = rows.count()
    ids[name] = first + n
    if not n:
        return rows.withColumn("id", F.lit(None).cast("long"))
    return _stored(bundle, changes.with_ids(rows, first, ["seq"]), f"{name}-numbered")


def import_pgn(bundle: Bundle, files: str | list[str], source_label: str | None = None) -> ImportSummary:
    return import_texts(bundle, read_pgn(bundle.spark, files), source_label=source_label)


def rebuild_positions(bundle: Bundle) -> None:
    """Replays every game into a new position table, swapped in when it is whole."""
    game = bundle.table("game").select("id", "moves", "result", "white_elo", "black_elo")
    bundle.commit(replace={"position": position_rows(game)}, position_index_dirty=False)


def open_bundle(spark: SparkSession, path: str) -> Bundle:
    """Opens a bundle; one whose positions are marked as out of date gets them rebuilt first."""
    bundle = Bundle.open(spark, path)
    if bundle.manifest["position_index_dirty"]:
        rebuild_positions(bundle)
    return bundle


def delete_games(bundle: Bundle, ids: list[int], only_manual: bool = False) -> int:
    """Removes games with their tags and positions; returns how many there were."""
    found = bundle.table("game").where(F.col("id").isin(*ids))
    if only_manual:
        found = found.where("source_type = 'manual'")
    gone = [r.id for r in found.select("id").collect()]
    if gone:
        keys = bundle.spark.createDataFrame([(i,) for i in gone], "id long")
        tables = {"game": "id", "game_tag": "game_id", "position": "game_id"}
        bundle.commit(replace={t: changes.delete_games(bundle.table(t), keys, c) for t, c in tables.items()}, game_count=bundle.manifest["game_count"] - len(gone))
    return len(gone)
