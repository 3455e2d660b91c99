"""Queries of the board kernel and the PGN parser over games made from the line items, with SQL for their answers.

A game is an order, with a ply for each of its line items.  Both sides push pawns by one square, each pawn
once: White's i-th move is on file (order + 3 i) mod 8, Black's j-th on (order + 5 j + 1) mod 8.  Nothing ever
meets, so a board follows from which files have been played, and SQL can say what the kernel must give:
boards, notations, legal moves, and which games transpose into each other.  Every twentieth game has an
illegal move behind its others, and every twentieth none at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions.board import START
from ..operators.changes import import_summary
from ..sources.pgn import parse_games, pgn_column
from .surrogate import table

FILES = "abcdefgh"


def _side(step: int, first: int, number: str) -> Column:
    """The files that a side plays, in order."""
    return F.expr(f"transform(filter(sequence(0, 7), i -> i < {number}), i -> cast((id + {first} + {step} * i) % 8 as int))")


def _letters(files: str, rank: str) -> str:
    return f"transform({files}, f -> concat(substr('{FILES}', f + 1, 1), '{rank}'))"


def _rank(mask: str, piece: str, there: int) -> str:
    """SQL of a rank of the board where pieces stand on the files whose bit is `there`, with runs of empty squares counted."""
    row = f"array_join(transform(sequence(0, 7), f -> if((shiftright({mask}, f) & 1) = {there}, '{piece}', '1')), '')"
    for n in range(8, 1, -1):
        row = f"replace({row}, '{'1' * n}', '{n}')"
    return row


def pawn_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n (plies), white and black (files played), sans, ucis, fen (behind the last ply), wm and bm (files as bits)."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.least(F.count("*"), F.lit(16)).cast("int").alias("n"))
    rows = rows.withColumn("white", _side(3, 0, "(n + 1) div 2")).withColumn("black", _side(5, 1, "n div 2"))
    rows = rows.withColumn("wm", F.expr("aggregate(white, 0, (a, f) -> a + shiftleft(1, f))")).withColumn("bm", F.expr("aggregate(black, 0, (a, f) -> a + shiftleft(1, f))"))
    both = "flatten(zip_with({}, {}, (w, b) -> if(b is null, array(w), array(w, b))))"
    rows = rows.withColumn("sans", F.expr(both.format(_letters("white", "3"), _letters("black", "6"))))
    ucis = ["transform({0}, f -> concat(substr('" + FILES + "', f + 1, 1), '" + a + "', substr('" + FILES + "', f + 1, 1), '" + b + "'))" for a, b in ("23", "76")]
    rows = rows.withColumn("ucis", F.expr(both.format(ucis[0].format("white"), ucis[1].format("black"))))
    fen = f"concat('rnbqkbnr/', {_rank('bm', 'p', 0)}, '/', {_rank('bm', 'p', 1)}, '/8/8/', {_rank('wm', 'P', 1)}, '/', {_rank('wm', 'P', 0)}, '/RNBQKBNR ', if(n % 2 = 0, 'w', 'b'), ' KQkq - 0 ', 1 + n div 2)"
    return rows.withColumn("fen", F.expr(fen))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The games as PGN texts; the place of a text in its file is the order's key."""
    c.register(spark)
    moves = "case when id % 20 = 1 then '' else array_join(transform(sans, (s, i) -> if(i % 2 = 0, concat(1 + i div 2, '. ', s), s)), ' ') end"
    more = "case when id % 20 = 0 then ' {a note} Ke5' else '' end"
    head = """concat('[Event "E"]\\n[White "W', id, '"]\\n[Black "B"]\\n[Result "', result, '"]\\n\\n')"""
    rows = pawn_games(spark, sf_dir).withColumn("result", F.expr("element_at(array('1-0', '0-1', '1/2-1/2', '*'), cast(id % 4 as int) + 1)"))
    return rows.select(F.lit("games").alias("file"), F.col("id").cast("long").alias("byte_offset"), F.expr(f"concat({head}, {moves}, {more}, ' ', result, '\\n\\n')").alias("text"))


def played(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The games that parse, with the kernel's own moves."""
    parsed = parse_games(texts(spark, sf_dir)).where("status = 'ok'").select(F.col("byte_offset").alias("id"), "moves", "result")
    return parsed.join(pawn_games(spark, sf_dir), "id")


def legal_move_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards that many games share are looked at once."""
    c.register(spark)
    games = pawn_games(spark, sf_dir).select("id", "fen")
    counts = games.select("fen").distinct().select("fen", F.size(c.legal_moves("fen")).alias("n"))
    return games.join(counts, "fen").select("id", "n")


def perft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes one ply below all boards of the table, by the length of their games; moves are applied, not only counted."""
    c.register(spark)
    boards = pawn_games(spark, sf_dir).groupBy("n", "fen").agg(F.count("*").alias("games"))
    rows = boards.select("n", "fen", "games", F.explode(c.legal_moves("fen")).alias("m"))
    after = rows.select("n", "games", c.apply_uci("fen", F.col("m.uci")).getField("fen").alias("after"))
    return after.where("after is not null").groupBy(F.col("n").alias("plies")).agg(F.sum("games").alias("nodes"))


def fen_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c.register(spark)
    fen = F.when(F.col("id") % 10 == 0, F.concat(F.lit("bad "), "fen")).when(F.col("id") % 10 != 1, F.col("fen"))
    return pawn_games(spark, sf_dir).select("id", c.normal_fen(fen).alias("written"))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last board of each game; a ply beyond the last has none."""
    return played(spark, sf_dir).select("id", c.replay_fen("moves", (F.col("n") + (F.col("id") % 5 == 0).cast("int")).cast("int")).alias("board"))


def san_and_uci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last move of each game in both notations, and a move that is not legal there."""
    rows = played(spark, sf_dir).withColumn("before", c.replay_fen("moves", (F.col("n") - 1).cast("int")))
    rows = rows.withColumn("uci", F.when(F.col("id") % 5 == 0, "e1e8").otherwise(F.element_at("ucis", -1))).withColumn("m", c.apply_uci("before", "uci"))
    return rows.select("id", "uci", F.col("m.san").alias("san"), c.move_san("before", F.col("m.move")).alias("again"), (c.san_move("before", F.col("m.san")) == F.col("m.move")).alias("same"))


def transpositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games that meet in one position have one hash there, and others another."""
    rows = played(spark, sf_dir).select("id", "moves", "result", F.lit(2000).alias("white_elo"), F.when(F.col("id") % 3 == 0, 1900).alias("black_elo"))
    p = c.position_rows(rows)
    return p.groupBy("ply").agg(F.count("*").alias("rows"), F.countDistinct("zobrist_hash").alias("hashes"), F.sum(F.col("result").cast("long")).alias("result"), F.count("black_elo").alias("rated"))


def game_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = played(spark, sf_dir).withColumn("s", c.game_sequence("moves"))
    return rows.select("id", F.array_join("s.sans", " ").alias("line"), F.element_at("s.fens", -1).alias("last_fen"), F.size("s.hashes").alias("hashes"), (F.col("s.hashes")[0] == c.fen_hash(F.lit(START))).alias("start"))


def lines_in_san(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines up to their first illegal move."""
    c.register(spark)
    line = F.when(F.col("id") % 5 == 0, F.concat(F.array(F.element_at("ucis", 1), F.lit("e1e3")), "ucis")).otherwise(F.col("ucis"))
    start = F.when(F.col("id") % 7 == 0, "bad").otherwise(START)
    return pawn_games(spark, sf_dir).select("id", F.size(line).alias("given"), F.array_join(c.line_san(start, line), " ").alias("sans"))


def import_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status")
    return import_summary(parse_games(texts(spark, sf_dir)).select(F.when(status == "ok", "committed").otherwise(status).alias("status")))


def parsed_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_games(texts(spark, sf_dir))
    return rows.select(F.col("byte_offset").alias("id"), "status", "result", c.find_tag(F.col("tags"), "White").alias("white"), F.coalesce(F.size("moves"), F.lit(-1)).alias("plies"))


def pgn_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported games parse to the same moves."""
    rows = played(spark, sf_dir).select("id", F.concat(F.lit("W"), "id").alias("white"), F.lit("B").alias("black"), "result", "moves", F.lit(2500).alias("white_elo"), F.lit(None).cast("int").alias("black_elo"), F.when(F.col("id") % 2 == 0, "A00").alias("eco"))
    texts_ = rows.select(F.lit("f").alias("file"), F.col("id").alias("byte_offset"), pgn_column(F.struct(*rows.columns)).alias("text"))
    parsed = parse_games(texts_).join(rows.select(F.col("id").alias("byte_offset"), F.col("moves").alias("given")), "byte_offset")
    return parsed.select(F.col("byte_offset").alias("id"), "status", (F.col("moves") == F.col("given")).alias("same"), c.find_tag(F.col("tags"), "GameId").alias("tag"), c.find_tag(F.col("tags"), "ECO").alias("eco"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict reading of numbers and moves: digits up to 32767, unsigned bits, squares of the board."""
    rows = pawn_games(spark, sf_dir).withColumn(
        "t",
        F.expr("case id % 6 when 0 then cast(id * 37 as string) when 1 then concat('+', id) when 2 then if(id % 4 = 0, '-0', '-1') when 3 then element_at(ucis, 1) when 4 then concat(element_at(ucis, 1), 'k') else concat('160456909845030', lpad(id, 5, '0')) end"),
    )
    bits = F.when(F.col("id") % 6 == 5, c.hash_text(c.hash_bits(F.col("t"))))
    return rows.select("id", c.parse_elo(F.col("t")).alias("elo"), F.coalesce(c.valid_uci(F.col("t")), F.lit(False)).alias("uci"), bits.alias("bits"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "legal_moves": legal_move_counts,
    "perft": perft,
    "fen_round_trip": fen_round_trip,
    "replay_fen": replay,
    "san_and_uci": san_and_uci,
    "replay_positions": transpositions,
    "game_sequences": game_sequences,
    "lines_in_san": lines_in_san,
    "pgn_import_summary": import_statuses,
    "pgn_parse": parsed_games,
    "pgn_round_trip": pgn_round_trip,
    "scalar_functions": scalar_functions,
}


def _rank_sql(mask: str, piece: str, there: int) -> str:
    row = "concat(" + ", ".join(f"CASE WHEN ({mask} >> {f}) & 1 = {there} THEN '{piece}' ELSE '1' END" for f in range(8)) + ")"
    for n in range(8, 1, -1):
        row = f"replace({row}, '{'1' * n}', '{n}')"
    return row


def _board_sql(wm: str, bm: str, n: str) -> str:
    return (
        f"concat('rnbqkbnr/', {_rank_sql(bm, 'p', 0)}, '/', {_rank_sql(bm, 'p', 1)}, '/8/8/', {_rank_sql(wm, 'P', 1)}, '/', {_rank_sql(wm, 'P', 0)}, "
        f"'/RNBQKBNR ', CASE WHEN {n} % 2 = 0 THEN 'w' ELSE 'b' END, ' KQkq - 0 ', 1 + {n} // 2)"
    )


#: The same games by relations: a row for each ply, and what each game has played behind each of its plies.
_GAMES = f"""WITH g AS (SELECT l_orderkey AS id, CAST(least(count(*), 16) AS INTEGER) AS n FROM lineitem GROUP BY l_orderkey),
p AS (
  SELECT id, n, k, CASE WHEN k % 2 = 1 THEN (id + 3 * ((k - 1) // 2)) % 8 ELSE (id + 5 * ((k - 2) // 2) + 1) % 8 END AS f
  FROM (SELECT id, n, CAST(unnest(generate_series(1, n)) AS INTEGER) AS k FROM g)),
q AS (SELECT *, substr('{FILES}', CAST(f AS INTEGER) + 1, 1) AS letter, CASE WHEN k % 2 = 1 THEN 1 << CAST(f AS INTEGER) ELSE 0 END AS wbit, CASE WHEN k % 2 = 0 THEN 1 << CAST(f AS INTEGER) ELSE 0 END AS bbit FROM p),
r AS (SELECT id, n, CAST(sum(wbit) AS INTEGER) AS wm, CAST(sum(bbit) AS INTEGER) AS bm,
             string_agg(letter || CASE WHEN k % 2 = 1 THEN '3' ELSE '6' END, ' ' ORDER BY k) AS line,
             arg_max(letter || CASE WHEN k % 2 = 1 THEN '3' ELSE '6' END, k) AS san,
             arg_max(letter || CASE WHEN k % 2 = 1 THEN '2' ELSE '7' END || letter || CASE WHEN k % 2 = 1 THEN '3' ELSE '6' END, k) AS uci,
             arg_min(letter, k) AS first_letter
      FROM q GROUP BY id, n),
b AS (SELECT *, {_board_sql('wm', 'bm', 'n')} AS fen, CASE WHEN n % 2 = 0 THEN wm ELSE bm END AS own FROM r),
ok AS (SELECT * FROM b WHERE id % 20 > 1)
"""
_A, _B, _C, _D, _E, _F, _G, _H = (f"((own >> {f}) & 1)" for f in range(8))
#: Moves of a side that has pushed the pawns `own`: pawns, knights, either bishop, rooks, queen, king.
_LEGAL = " + ".join([
    "16 - bit_count(own)", f"(1 - {_A}) + (1 - {_C}) + {_D} + (1 - {_F}) + (1 - {_H}) + {_E}",
    f"{_B} * (2 - {_A}) + {_D} * (5 - 4 * {_E})", f"{_E} * (5 - 4 * {_D}) + {_G} * (2 - {_H})", f"{_A} + {_H}",
    f"{_C} * (3 - 2 * {_B}) + {_D} + {_E} * (4 - 3 * {_F})", f"{_D} + {_E} + {_F}",
])

ORACLE_SQL = {
    "legal_moves": f"{_GAMES} SELECT id, CAST({_LEGAL} AS INTEGER) AS n FROM b",
    "perft": f"{_GAMES} SELECT n AS plies, CAST(sum({_LEGAL}) AS BIGINT) AS nodes FROM b GROUP BY n",
    "fen_round_trip": f"{_GAMES} SELECT id, CASE WHEN id % 10 > 1 THEN fen END AS written FROM b",
    "replay_fen": f"{_GAMES} SELECT id, CASE WHEN id % 5 <> 0 THEN fen END AS board FROM ok",
    "san_and_uci": f"{_GAMES} SELECT id, CASE WHEN id % 5 = 0 THEN 'e1e8' ELSE uci END AS uci, CASE WHEN id % 5 <> 0 THEN san END AS san, CASE WHEN id % 5 <> 0 THEN san END AS again, CASE WHEN id % 5 <> 0 THEN true END AS same FROM ok",
    "replay_positions": f"""{_GAMES}, s AS (
  SELECT id, k, sum(wbit) OVER o AS wm, sum(bbit) OVER o AS bm FROM q WHERE id % 20 > 1 WINDOW o AS (PARTITION BY id ORDER BY k)
  UNION ALL SELECT id, 0, 0, 0 FROM ok)
SELECT k AS ply, count(*) AS rows, count(DISTINCT wm * 256 + bm) AS hashes, CAST(sum(CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END) AS BIGINT) AS result,
       count(*) FILTER (WHERE id % 3 = 0) AS rated FROM s GROUP BY k""",
    "game_sequences": f"{_GAMES} SELECT id, line, fen AS last_fen, n + 1 AS hashes, true AS start FROM ok",
    "lines_in_san": f"""{_GAMES} SELECT id, CASE WHEN id % 5 = 0 THEN n + 2 ELSE n END AS given,
       CASE WHEN id % 7 <> 0 THEN CASE WHEN id % 5 = 0 THEN first_letter || '3' ELSE line END END AS sans FROM b""",
    "pgn_import_summary": f"{_GAMES} SELECT count(*) AS attempted, count(*) FILTER (WHERE id % 20 > 1) AS committed, count(*) FILTER (WHERE id % 20 < 2) AS skipped, count(*) FILTER (WHERE id % 20 < 2) AS errors FROM b",
    "pgn_parse": f"""{_GAMES} SELECT id, CASE id % 20 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'empty_game' ELSE 'ok' END AS status,
       CASE id % 4 WHEN 0 THEN '1-0' WHEN 1 THEN '0-1' WHEN 2 THEN '1/2-1/2' ELSE '*' END AS result, 'W' || id AS white, CASE WHEN id % 20 > 1 THEN n ELSE -1 END AS plies FROM b""",
    "pgn_round_trip": f"{_GAMES} SELECT id, 'ok' AS status, true AS same, CAST(id AS VARCHAR) AS tag, CASE WHEN id % 2 = 0 THEN 'A00' ELSE '' END AS eco FROM ok",
    "scalar_functions": f"""{_GAMES} SELECT id, CAST(CASE WHEN id % 6 = 0 AND id * 37 <= 32767 THEN id * 37 WHEN id % 12 = 8 THEN 0 END AS INTEGER) AS elo, id % 6 = 3 AS uci,
       CASE WHEN id % 6 = 5 THEN '160456909845030' || lpad(CAST(id AS VARCHAR), 5, '0') END AS bits FROM b""",
}
