"""The board kernel as column functions (Arrow-batched) and table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable
from .board import Board, InvalidFen, InvalidMove, name_of, pv_to_san, replay, replayed, signed, uci_of


TEXT = T.StringType()


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, TEXT) for n in names])


def _board(fen) -> Board | None:
    try:
        return Board(fen) if isinstance(fen, str) else None
    except InvalidFen:
        return None


def _each(series: pd.Series, f) -> pd.Series:
    return pd.Series([f(x) for x in series], dtype=object)


@F.pandas_udf(TEXT)
def normal_fen(fen: pd.Series) -> pd.Series:
    """The FEN written anew; null if it is invalid."""
    return _each(fen, lambda x: (b := _board(x)) and b.fen())


@F.pandas_udf(T.LongType())
def fen_hash(fen: pd.Series) -> pd.Series:
    """The position's 64-bit hash, signed; null if the FEN is invalid."""
    return pd.Series([signed(b.hash()) if (b := _board(x)) else None for x in fen], dtype="Int64")


@F.pandas_udf(TEXT)
def replay_fen(moves: pd.Series, ply: pd.Series) -> pd.Series:
    """FEN after the first `ply` moves; null where there are fewer."""

    def one(m, n):
        if m is None or pd.isna(n) or not 0 <= n <= len(m):
            return None
        return replay([int(x) for x in m], int(n)).fen()

    return pd.Series([one(m, n) for m, n in zip(moves, ply)], dtype=object)


@F.pandas_udf(TEXT)
def move_san(fen: pd.Series, move: pd.Series) -> pd.Series:
    """SAN of a 16-bit move on a board; null if it is not legal there."""

    def one(x, m):
        b = _board(x)
        return b.san(int(m)) if b and not pd.isna(m) and int(m) in b.legal_moves() else None

    return pd.Series([one(x, m) for x, m in zip(fen, move)], dtype=object)


@F.pandas_udf(TEXT)
def move_san_at(moves: pd.Series, ply: pd.Series, move: pd.Series) -> pd.Series:
    """SAN of a move on the board after `ply` moves of a game."""

    def one(ms, n, m):
        if ms is None or pd.isna(n) or pd.isna(m) or not 0 <= n <= len(ms):
            return None
        b = replay([int(x) for x in ms], int(n))
        return b.san(int(m)) if int(m) in b.legal_moves() else None

    return pd.Series([one(*x) for x in zip(moves, ply, move)], dtype=object)


@F.pandas_udf(T.IntegerType())
def san_move(fen: pd.Series, san: pd.Series) -> pd.Series:
    """The 16-bit move that a SAN means on a board; null if none or more than one."""

    def one(x, s):
        b = _board(x)
        try:
            return b.parse_san(s) if b and isinstance(s, str) else None
        except InvalidMove:
            return None

    return pd.Series([one(x, s) for x, s in zip(fen, san)], dtype="Int32")


def move_info(b: Board, m: int) -> dict:
    after = b.copy()
    after.play(m)
    return {"uci": uci_of(m), "san": b.san(m), "from": name_of(m & 63), "to": name_of(m >> 6 & 63), "promotion": "nbrq"[m >> 12 & 3] if m >> 15 else None, "move": m, "fen": after.fen()}


@F.pandas_udf(_texts("uci", "san", "from", "to", "promotion").add("move", T.IntegerType()).add("fen", TEXT))
def apply_uci(fen: pd.Series, uci: pd.Series) -> pd.DataFrame:
    """The move and the FEN after it; nulls if it is illegal."""

    def one(x, u):
        b = _board(x)
        try:
            return move_info(b, b.parse_uci(u)) if b and isinstance(u, str) else {}
        except InvalidMove:
            return {}

    rows = [one(x, u) for x, u in zip(fen, uci)]
    return pd.DataFrame({c: [r.get(c) for r in rows] for c in ("uci", "san", "from", "to", "promotion", "move", "fen")}).astype({"move": "Int32"})


@F.pandas_udf(T.ArrayType(_texts("uci", "san", "from", "to", "promotion")))
def legal_moves(fen: pd.Series) -> pd.Series:
    """All legal moves of a board, by UCI; null if the FEN is invalid."""

    def one(x):
        b = _board(x)
        if b is None:
            return None
        found = sorted((move_info(b, m) for m in b.legal_moves()), key=lambda m: m["uci"])
        return [{k: m[k] for k in ("uci", "san", "from", "to", "promotion")} for m in found]

    return _each(fen, one)


@F.pandas_udf(T.ArrayType(TEXT))
def line_san(fen: pd.Series, pv: pd.Series) -> pd.Series:
    """SAN of a line of UCI moves up to the first illegal one; null if the FEN is invalid."""
    return pd.Series([pv_to_san(x, list(p)) if _board(x) and p is not None else None for x, p in zip(fen, pv)], dtype=object)


@F.pandas_udf(T.StructType().add("hashes", T.ArrayType(T.LongType())).add("fens", T.ArrayType(TEXT)).add("sans", T.ArrayType(TEXT)))
def game_sequence(moves: pd.Series) -> pd.DataFrame:
    """Hashes (the start first), FENs and SANs of a game, ply by ply."""
    rows = [replayed([int(x) for x in m]) if m is not None else (None, None, None) for m in moves]
    return pd.DataFrame(rows, columns=["hashes", "fens", "sans"])


def position_rows(games: DataFrame) -> DataFrame:
    """One row per ply, the start included, of games(id, moves, result, white_elo, black_elo); a game without
    moves gives none.  Boards are replayed once per game in Arrow batches; rows are exploded outside Python."""
    importable(games.sparkSession)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for moves in batch.column(1).to_pylist():
                b = Board()
                own = [signed(b.hash())]
                for m in moves or []:
                    b.play(m)
                    own.append(signed(b.hash()))
                found.append(own if moves else [])
            yield batch.append_column("hashes", pa.array(found, pa.list_(pa.int64())))

    rows = games.select(F.col("id").cast("long").alias("game_id"), F.col("moves").cast("array<int>").alias("moves"), result_number(F.col("result")).alias("result"), F.col("white_elo").cast("int").alias("white_elo"), F.col("black_elo").cast("int").alias("black_elo"))
    rows = rows.mapInArrow(hashes, "game_id long, moves array<int>, result byte, white_elo int, black_elo int, hashes array<long>")
    return positions_of(rows)


def positions_of(rows: DataFrame) -> DataFrame:
    """Explodes (game_id, moves, hashes, result, ratings) to position rows."""
    rows = rows.select("*", F.posexplode("hashes").alias("ply", "zobrist_hash"))
    move = F.when(F.col("ply") == 0, 0).otherwise(F.get("moves", F.col("ply") - 1))
    return rows.select("zobrist_hash", "game_id", "ply", move.cast("int").alias("encoded_move"), "result", "white_elo", "black_elo")


# --- scalars that need no Python ---


def result_number(result: Column) -> Column:
    """1, 0 or -1; anything else, unknown included, counts as a draw."""
    return F.when(result == "1-0", 1).when(result == "0-1", -1).otherwise(0).cast("byte")


def result_text(result: Column) -> Column:
    return F.when(result > 0, "1-0").when(result < 0, "0-1").otherwise("1/2-1/2")


def parse_elo(text: Column) -> Column:
    """Digits up to 32767; everything else is null, but a minus before zeros only is 0."""
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).when(text.rlike("^-0+$"), F.lit(0))
    return F.when(number <= 32767, number).cast("int")


def find_tag(tags: Column, key: str) -> Column:
    """Value of the first tag of that name, or an empty text."""
    return F.coalesce(F.get(F.filter(tags, lambda t: t["name"] == key), F.lit(0))["value"], F.lit(""))


def valid_uci(text: Column) -> Column:
    return text.rlike("^[a-h][1-8][a-h][1-8][qrbn]?$")


def parse_unsigned(text: Column) -> Column:
    """A whole text of digits as a number up to 2^63 - 1; null otherwise."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def hash_text(h: Column) -> Column:
    """Signed bits as an unsigned decimal text."""
    return F.conv(F.hex(h), 16, 10)


def hash_bits(text: Column) -> Column:
    """An unsigned decimal text as signed bits."""
    return F.conv(text, 10, -10).cast("long")


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL."""
    importable(spark)
    for f in (normal_fen, fen_hash, replay_fen, move_san, move_san_at, san_move, apply_uci, legal_moves, line_san, game_sequence):
        spark.udf.register(f.__name__, f)
