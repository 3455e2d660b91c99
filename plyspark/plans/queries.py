"""One query for each relational operator, over the surrogate corpus, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, games, search, stats, tree
from ..operators.filters import GameFilter
from .surrogate import GAMES_SQL, POSITION_SQL
from .surrogate import games as games_of
from .surrogate import position as position_of

ROOT, OTHER = 3, 21
STRONG = GameFilter(result="1-0", min_elo=1500, limit=50, offset=10)
_STRONG = "result = '1-0' AND white_elo >= 1500 AND black_elo >= 1500"
_IDS = f"ids AS (SELECT DISTINCT g.id FROM games g JOIN pos p ON p.game_id = g.id WHERE p.zobrist_hash = {ROOT} AND {_STRONG.replace('result', 'g.result').replace('white_elo', 'g.white_elo').replace('black_elo', 'g.black_elo')})"


def _ids(spark: SparkSession, d: str, key: int = ROOT) -> DataFrame:
    return games.find_game_ids(games_of(spark, d), GameFilter(result="1-0", min_elo=1500, position=key), position_of(spark, d))


def _positions(select: str, *more: str) -> str:
    return f"WITH {', '.join([POSITION_SQL, *more])}\n{select}"


def _games(select: str, *more: str) -> str:
    return f"WITH {', '.join([GAMES_SQL, *more])}\n{select}"


def _both(select: str, *more: str) -> str:
    return f"WITH {', '.join([POSITION_SQL, GAMES_SQL, *more])}\n{select}"


STATS_COLUMNS = ["encoded_move", "child_hash", "root_ply", "frequency", "white_wins", "draws", "black_wins", "avg_white_elo", "avg_black_elo", "sample_min", "sample_max", "elo_weighted_score"]
_MEAN = "CASE WHEN white_elo IS NOT NULL AND black_elo IS NOT NULL THEN (white_elo + black_elo) / CAST(2 AS DOUBLE) END"


def _stats_sql(key: int, source: str, select: str = "SELECT * FROM stats") -> str:
    return f"""src AS (SELECT * FROM {source}),
path AS (
  SELECT r.game_id, c.encoded_move, c.zobrist_hash AS child_hash, c.result, c.white_elo, c.black_elo, min(r.ply) AS root_ply
  FROM src r JOIN pos c ON c.game_id = r.game_id AND c.ply = r.ply + 1
  WHERE r.zobrist_hash = {key} GROUP BY ALL),
moves AS (
  SELECT encoded_move, child_hash, min(root_ply) AS root_ply, min(game_id) AS sample_min, max(game_id) AS sample_max,
         coalesce(sum(CAST(result AS DOUBLE) * {_MEAN}) / nullif(sum({_MEAN}), 0), 0) AS elo_weighted_score
  FROM path GROUP BY ALL),
reached AS (
  SELECT DISTINCT zobrist_hash, game_id, result, white_elo, black_elo FROM src WHERE zobrist_hash IN (SELECT child_hash FROM path)),
totals AS (
  SELECT zobrist_hash, count(*) AS frequency, count(*) FILTER (WHERE result > 0) AS white_wins,
         count(*) FILTER (WHERE result = 0) AS draws, count(*) FILTER (WHERE result < 0) AS black_wins,
         avg(CAST(white_elo AS DOUBLE)) AS avg_white_elo, avg(CAST(black_elo AS DOUBLE)) AS avg_black_elo
  FROM reached GROUP BY zobrist_hash),
stats AS (
  SELECT encoded_move, child_hash, root_ply, frequency, white_wins, draws, black_wins, avg_white_elo, avg_black_elo,
         sample_min, sample_max, elo_weighted_score FROM moves JOIN totals ON zobrist_hash = child_hash)
{select}"""


def _distribution_sql(key: int, width: int, source: str) -> str:
    return f"""src AS (SELECT * FROM {source}),
path AS (
  SELECT DISTINCT r.game_id, c.encoded_move, c.result, c.white_elo, c.black_elo
  FROM src r JOIN pos c ON c.game_id = r.game_id AND c.ply = r.ply + 1
  WHERE r.zobrist_hash = {key} AND c.white_elo IS NOT NULL AND c.black_elo IS NOT NULL),
counted AS (
  SELECT encoded_move, CAST(floor((white_elo + black_elo) / CAST(2 AS DOUBLE) / {width}) * {width} AS INTEGER) AS bucket,
         count(*) FILTER (WHERE result > 0) AS white_wins, count(*) FILTER (WHERE result = 0) AS draws,
         count(*) FILTER (WHERE result < 0) AS black_wins, count(*) AS game_count
  FROM path GROUP BY ALL),
spine AS (
  SELECT encoded_move, CAST(unnest(generate_series(min(bucket), max(bucket), {width})) AS INTEGER) AS bucket FROM counted GROUP BY encoded_move)
SELECT s.encoded_move, s.bucket, coalesce(white_wins, 0) AS white_wins, coalesce(draws, 0) AS draws,
       coalesce(black_wins, 0) AS black_wins, coalesce(game_count, 0) AS game_count
FROM spine s LEFT JOIN counted c ON c.encoded_move = s.encoded_move AND c.bucket = s.bucket"""


def _slice_sql(key: int, depth: int, source: str) -> str:
    """An occurrence meets the plies behind it on (game, ply), one depth after another: an equal join for each."""
    deep = f"(SELECT game_id, ply AS root_ply, CAST(unnest(generate_series(1, {depth})) AS INTEGER) AS depth FROM {source} WHERE zobrist_hash = {key})"
    return f"""roots AS MATERIALIZED {deep},
plies AS MATERIALIZED (SELECT game_id, ply, encoded_move, zobrist_hash, result, white_elo, black_elo FROM pos),
slice AS (
  SELECT r.game_id, r.root_ply, r.depth, c.encoded_move, c.zobrist_hash AS child_hash, c.result, c.white_elo, c.black_elo
  FROM roots r JOIN plies c ON c.game_id = r.game_id AND c.ply = r.root_ply + r.depth)"""


def _edges_sql(key: int, depth: int, source: str) -> str:
    return (
        _slice_sql(key, depth, source)
        + f""",
parents AS (SELECT *, coalesce(lag(child_hash) OVER (PARTITION BY game_id, root_ply ORDER BY depth), {key}) AS parent_hash, {_MEAN} AS mean FROM slice)
SELECT depth, parent_hash, encoded_move, min(child_hash) AS child_hash, count(*) AS frequency,
       count(*) FILTER (WHERE result > 0) AS white_wins, count(*) FILTER (WHERE result = 0) AS draws, count(*) FILTER (WHERE result < 0) AS black_wins,
       avg(CAST(white_elo AS DOUBLE)) AS avg_white_elo, avg(CAST(black_elo AS DOUBLE)) AS avg_black_elo,
       coalesce(sum(CAST(result AS DOUBLE) * mean) / nullif(sum(mean), 0), 0) AS elo_weighted_score,
       min(game_id) AS sample_id
FROM parents GROUP BY depth, parent_hash, encoded_move"""
    )


_FILTERED = "(SELECT * FROM pos WHERE game_id IN (SELECT id FROM ids))"
_LIST = "id, white, black, white_elo, black_elo, result, coalesce(event, '') AS event, coalesce(eco, '') AS eco"
NAME = GameFilter(player_name="CUSTOMER#00000001", player_color="white", limit=500)
EITHER = GameFilter(player_name="customer#00000012", limit=500)
ECO = GameFilter(eco_prefix="2-h", limit=500)
ELO = GameFilter(min_elo=1800, max_elo=2300, limit=500)
AT = GameFilter(result="0-1", position=OTHER, limit=500)


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Incoming dimension rows: the white players of all games, with attributes of each game, by game id."""
    return games_of(spark, d).select(F.col("white").alias("name"), F.col("white_elo").alias("elo"), F.col("event").alias("country"), F.col("id").alias("seq"))


def _existing(spark: SparkSession, d: str) -> DataFrame:
    return games_of(spark, d).where("white_id % 4 = 0").select(F.col("white").alias("name")).distinct()


def _identified(spark: SparkSession, d: str) -> DataFrame:
    moves = position_of(spark, d).where("ply > 0").groupBy(F.col("game_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ply", "encoded_move"))), lambda m: m["encoded_move"]).alias("moves"))
    rows = games_of(spark, d).select("id", (F.col("white_id") % 10).alias("white_id"), (F.col("black_id") % 10).alias("black_id"), F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("event_id"), F.lit(None).cast("string").alias("date"), "result")
    return rows.join(moves, "id").withColumn("seq", F.col("id"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The surrogate as a game table whose every tenth game was entered by hand."""
    rows = games_of(spark, d).select("id", "result", "eco", "white_elo", "black_elo")
    return rows.withColumns({"source_type": F.when(F.col("id") % 10 == 0, "manual").otherwise("imported"), "source_label": F.lit(None).cast("string"), "review_status": F.lit("new")})


def _patches(spark: SparkSession, d: str) -> DataFrame:
    rows = games_of(spark, d).where("id % 4 = 0")
    return rows.select("id", F.when(F.col("id") % 8 == 0, "1-0").alias("result"), F.lit("patched").alias("eco"), F.when(F.col("id") % 3 == 0, 2000).alias("white_elo"), F.lit(None).cast("int").alias("black_elo"), F.lit("studied").alias("review_status"), F.lit(None).cast("string").alias("source_type"), F.lit("label").alias("source_label"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    rows = position_of(spark, d).where("ply > 0")
    return rows.select("game_id", F.col("ply").alias("pos"), F.when(F.col("encoded_move") % 2 == 0, "Opening").otherwise("Round").alias("name"), F.concat(F.lit("v"), F.col("zobrist_hash").cast("string")).alias("value"))


_TAGS = "tags AS (SELECT game_id, ply AS pos, (CASE WHEN encoded_move % 2 = 0 THEN 'Opening' ELSE 'Round' END) || left(CAST(game_id AS VARCHAR), 0) AS name, 'v' || CAST(zobrist_hash AS VARCHAR) AS value FROM pos WHERE ply > 0)"
_STORED = "stored AS (SELECT id, result, eco, white_elo, black_elo, CASE WHEN id % 10 = 0 THEN 'manual' ELSE 'imported' END AS source_type, CAST(NULL AS VARCHAR) AS source_label, 'new' AS review_status FROM games)"


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("id") % 20
    return games_of(spark, d).select(F.when(k == 0, "parse_error").when(k == 1, "empty_game").when(k < 5, "duplicate").otherwise("committed").alias("status"))


def _list(df: DataFrame) -> DataFrame:
    return df.select("id", "white", "black", "white_elo", "black_elo", "result", "event", "eco")


QUERIES = {
    "position_search": lambda s, d: search.position_search(position_of(s, d), ROOT, limit=100, offset=50),
    "count_positions": lambda s, d: search.count_positions(position_of(s, d)),
    "count_by_hash": lambda s, d: search.count_positions(position_of(s, d), ROOT),
    "count_distinct_games": lambda s, d: search.count_distinct_games(position_of(s, d), ROOT),
    "count_distinct_games_filtered": lambda s, d: search.count_distinct_games(position_of(s, d), ROOT, _ids(s, d)),
    "distinct_game_ids": lambda s, d: search.distinct_game_ids(position_of(s, d), OTHER),
    "sample_hashes": lambda s, d: search.sample_hashes(position_of(s, d), 20, 42),
    "tree_slice": lambda s, d: search.tree_slice(position_of(s, d), ROOT, 3),
    "opening_stats": lambda s, d: stats.opening_stats(position_of(s, d), ROOT).select(*STATS_COLUMNS),
    "opening_stats_start": lambda s, d: stats.opening_stats(position_of(s, d), 0).select(*STATS_COLUMNS),
    "opening_stats_filtered": lambda s, d: stats.opening_stats(position_of(s, d), ROOT, _ids(s, d)).select(*STATS_COLUMNS),
    "opening_stats_attributed": lambda s, d: stats.attributed(stats.opening_stats(position_of(s, d), ROOT), games.game_contexts(games_of(s, d), _tags(s, d))).select("encoded_move", "child_hash", "sample_id", "eco", "opening_name"),
    "elo_distribution": lambda s, d: stats.elo_distribution(position_of(s, d), ROOT, 100),
    "elo_distribution_filtered": lambda s, d: stats.elo_distribution(position_of(s, d), ROOT, 25, _ids(s, d)),
    "opening_tree_edges": lambda s, d: tree.opening_tree_edges(position_of(s, d), ROOT, 4).drop("sample_root_ply"),
    "opening_tree_edges_filtered": lambda s, d: tree.opening_tree_edges(position_of(s, d), ROOT, 3, _ids(s, d)).drop("sample_root_ply"),
    "tree_expand": lambda s, d: stats.opening_stats(position_of(s, d), OTHER).select("encoded_move", "child_hash", "frequency"),
    "find_games": lambda s, d: _list(games.find_games(games_of(s, d), STRONG)),
    "find_games_count": lambda s, d: games.find_games_count(games_of(s, d), STRONG),
    "find_games_by_color": lambda s, d: _list(games.find_games(games_of(s, d), NAME)),
    "find_games_by_player": lambda s, d: _list(games.find_games(games_of(s, d), EITHER)),
    "find_games_eco": lambda s, d: _list(games.find_games(games_of(s, d), ECO)),
    "find_games_elo": lambda s, d: _list(games.find_games(games_of(s, d), ELO)),
    "find_games_position": lambda s, d: _list(games.find_games(games_of(s, d), AT, position_of(s, d))),
    "find_game_ids": lambda s, d: _ids(s, d),
    "game_count": lambda s, d: games_of(s, d).agg(F.count("*").alias("n")),
    "get_game": lambda s, d: games.get_game(games_of(s, d), _tags(s, d), 33).selectExpr("id", "white", "black", "result", "concat_ws(',', transform(tags, t -> concat(t.name, '=', t.value))) AS tags"),
    "game_contexts": lambda s, d: games.game_contexts(games_of(s, d), _tags(s, d)),
    "dim_upsert": lambda s, d: changes.new_dimension_rows(_named(s, d), _existing(s, d), ["elo", "country"]),
    "game_dedup": lambda s, d: changes.dedup_games(_identified(s, d), None).select("id"),
    "game_dedup_existing": lambda s, d: changes.dedup_games(_identified(s, d).where("id % 2 = 0"), _identified(s, d).where("id % 2 = 1")).select("id"),
    "game_ids": lambda s, d: changes.with_ids(games_of(s, d).select(F.col("id").alias("seq")), 1, ["seq"]),
    "delete_game": lambda s, d: changes.delete_games(position_of(s, d), games_of(s, d).where("id % 3 = 0"), "game_id").groupBy("game_id").agg(F.count("*").alias("n")),
    "patch_game": lambda s, d: changes.patch_games(_stored(s, d), _patches(s, d), ["result", "eco"]).select("id", "result", "eco", "source_type"),
    "set_provenance": lambda s, d: changes.set_provenance(_stored(s, d), _patches(s, d)).select("id", "source_type", "source_label", "review_status"),
    "replace_notes": lambda s, d: changes.replace_notes(_tags(s, d), games_of(s, d).where("id % 50 = 0").select("id", F.when(F.col("id") % 100 == 0, "").otherwise("note").alias("notes")), "Round"),
    "elo_sync": lambda s, d: changes.sync_elo(position_of(s, d), _patches(s, d)).groupBy("game_id").agg(F.max("white_elo").alias("white_elo"), F.min("black_elo").alias("black_elo"), F.count("*").alias("n")),
    "import_summary": lambda s, d: changes.import_summary(_parsed(s, d)),
    "clustered_sink": lambda s, d: search.clustered(position_of(s, d)).groupBy("zobrist_hash").agg(F.count("*").alias("n"), F.min("game_id").alias("low"), F.max("game_id").alias("high")),
    "repeated_tags": lambda s, d: changes.repeated_tags(_tags(s, d)),
}

_FIRST = "FROM (SELECT *, row_number() OVER (PARTITION BY white_id, black_id, event_id, result, moves ORDER BY id) AS nth FROM k) WHERE nth = 1"
_KEYED = """k AS (
  SELECT g.id, white_id % 10 AS white_id, black_id % 10 AS black_id, CASE WHEN g.id % 5 <> 0 THEN g.id % 2 END AS event_id, g.result, m.moves
  FROM games g JOIN (SELECT game_id, list(encoded_move ORDER BY ply) AS moves FROM pos WHERE ply > 0 GROUP BY game_id) m ON m.game_id = g.id)"""

ORACLE_SQL = {
    "position_search": _positions(f"SELECT game_id, ply, result, white_elo, black_elo FROM pos WHERE zobrist_hash = {ROOT} ORDER BY game_id, ply LIMIT 100 OFFSET 50"),
    "count_positions": _positions("SELECT count(*) AS n FROM pos"),
    "count_by_hash": _positions(f"SELECT count(*) AS n FROM pos WHERE zobrist_hash = {ROOT}"),
    "count_distinct_games": _positions(f"SELECT count(DISTINCT game_id) AS n FROM pos WHERE zobrist_hash = {ROOT}"),
    "count_distinct_games_filtered": _both(f"SELECT count(DISTINCT game_id) AS n FROM {_FILTERED} WHERE zobrist_hash = {ROOT}", _IDS),
    "distinct_game_ids": _positions(f"SELECT DISTINCT game_id FROM pos WHERE zobrist_hash = {OTHER}"),
    "sample_hashes": _positions("SELECT DISTINCT zobrist_hash FROM (SELECT * FROM pos ORDER BY md5('42:' || zobrist_hash || ':' || game_id || ':' || ply), zobrist_hash, game_id, ply LIMIT 20)"),
    "tree_slice": _positions("SELECT * FROM slice", _slice_sql(ROOT, 3, "pos")),
    "opening_stats": _positions("", _stats_sql(ROOT, "pos")),
    "opening_stats_start": _positions("", _stats_sql(0, "pos")),
    "opening_stats_filtered": _both("", _IDS, _stats_sql(ROOT, _FILTERED)),
    "opening_stats_attributed": _both("", _TAGS, "ctx AS (SELECT g.id, g.eco, t.opening_name FROM games g LEFT JOIN (SELECT game_id, arg_min(value, pos) AS opening_name FROM tags WHERE name = 'Opening' GROUP BY game_id) t ON t.game_id = g.id)", _stats_sql(ROOT, "pos", """SELECT encoded_move, child_hash, coalesce(a.id, b.id) AS sample_id, CASE WHEN a.id IS NOT NULL THEN a.eco ELSE b.eco END AS eco, CASE WHEN a.id IS NOT NULL THEN a.opening_name ELSE b.opening_name END AS opening_name
FROM stats LEFT JOIN ctx a ON a.id = sample_min LEFT JOIN ctx b ON b.id = sample_max WHERE coalesce(a.id, b.id) IS NOT NULL""")),
    "elo_distribution": _positions("", _distribution_sql(ROOT, 100, "pos")),
    "elo_distribution_filtered": _both("", _IDS, _distribution_sql(ROOT, 25, _FILTERED)),
    "opening_tree_edges": _positions("", _edges_sql(ROOT, 4, "pos")),
    "opening_tree_edges_filtered": _both("", _IDS, _edges_sql(ROOT, 3, _FILTERED)),
    "tree_expand": _positions("", _stats_sql(OTHER, "pos", "SELECT encoded_move, child_hash, frequency FROM stats")),
    "find_games": _games(f"SELECT {_LIST} FROM games WHERE {_STRONG} ORDER BY id LIMIT 50 OFFSET 10"),
    "find_games_count": _games(f"SELECT count(*) AS total_count FROM games WHERE {_STRONG}"),
    "find_games_by_color": _games(f"SELECT {_LIST} FROM games WHERE contains(lower(white), 'customer#00000001') ORDER BY id LIMIT 500"),
    "find_games_by_player": _games(f"SELECT {_LIST} FROM games WHERE contains(lower(white), 'customer#00000012') OR contains(lower(black), 'customer#00000012') ORDER BY id LIMIT 500"),
    "find_games_eco": _games(f"SELECT {_LIST} FROM games WHERE lower(eco) LIKE '2-h%' ORDER BY id LIMIT 500"),
    "find_games_elo": _games(f"SELECT {_LIST} FROM games WHERE least(white_elo, black_elo) >= 1800 AND greatest(white_elo, black_elo) <= 2300 AND white_elo IS NOT NULL AND black_elo IS NOT NULL ORDER BY id LIMIT 500"),
    "find_games_position": _both(f"SELECT {_LIST} FROM games WHERE result = '0-1' AND id IN (SELECT game_id FROM pos WHERE zobrist_hash = {OTHER}) ORDER BY id LIMIT 500"),
    "find_game_ids": _both("SELECT id FROM ids", _IDS),
    "game_count": _games("SELECT count(*) AS n FROM games"),
    "get_game": _both("SELECT id, white, black, result, coalesce(tags, '') AS tags FROM games LEFT JOIN (SELECT game_id, string_agg(name || '=' || value, ',' ORDER BY pos) AS tags FROM tags GROUP BY game_id) ON game_id = id WHERE id = 33", _TAGS),
    "game_contexts": _both("SELECT id, eco, opening_name FROM games LEFT JOIN (SELECT game_id, arg_min(value, pos) AS opening_name FROM tags WHERE name = 'Opening' GROUP BY game_id) ON game_id = id", _TAGS),
    "dim_upsert": _games("SELECT white AS name, white_elo AS elo, event AS country, id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY white ORDER BY id) AS nth FROM games) WHERE nth = 1 AND white NOT IN (SELECT white FROM games WHERE white_id % 4 = 0)"),
    "game_dedup": _both(f"SELECT id {_FIRST}", _KEYED),
    "game_dedup_existing": _both(f"SELECT id {_FIRST.replace('FROM k)', 'FROM k WHERE id % 2 = 0) a')} AND NOT EXISTS (SELECT 1 FROM k b WHERE b.id % 2 = 1 AND b.white_id = a.white_id AND b.black_id = a.black_id AND b.event_id IS NOT DISTINCT FROM a.event_id AND b.result = a.result AND b.moves = a.moves)".replace("WHERE nth = 1 AND NOT", "WHERE a.nth = 1 AND NOT"), _KEYED),
    "game_ids": _games("SELECT id AS seq, row_number() OVER (ORDER BY id) AS id FROM games"),
    "delete_game": _both("SELECT game_id, count(*) AS n FROM pos WHERE game_id NOT IN (SELECT id FROM games WHERE id % 3 = 0) GROUP BY game_id"),
    "patch_game": _games("SELECT id, CASE WHEN id % 40 = 0 THEN '1-0' ELSE result END AS result, CASE WHEN id % 20 = 0 THEN 'patched' ELSE eco END AS eco, source_type FROM stored", _STORED),
    "set_provenance": _games("SELECT id, source_type, CASE WHEN id % 4 = 0 THEN 'label' END AS source_label, CASE WHEN id % 4 = 0 THEN 'studied' ELSE 'new' END AS review_status FROM stored", _STORED),
    "replace_notes": _both("""SELECT game_id, pos, name, value FROM tags WHERE NOT (name = 'Round' AND game_id IN (SELECT id FROM games WHERE id % 50 = 0))
UNION ALL SELECT g.id AS game_id, CAST(coalesce(max(t.pos), -1) + 1 AS INTEGER) AS pos, 'Round' AS name, 'note' AS value
FROM games g LEFT JOIN (SELECT * FROM tags WHERE name <> 'Round') t ON t.game_id = g.id WHERE g.id % 50 = 0 AND g.id % 100 <> 0 GROUP BY g.id""", _TAGS),
    "elo_sync": _both("SELECT p.game_id, max(CASE WHEN g.id IS NOT NULL AND g.id % 4 = 0 AND g.id % 3 = 0 THEN 2000 ELSE p.white_elo END) AS white_elo, min(p.black_elo) AS black_elo, count(*) AS n FROM pos p LEFT JOIN games g ON g.id = p.game_id GROUP BY p.game_id"),
    "import_summary": _games("SELECT count(*) AS attempted, count(*) FILTER (WHERE id % 20 >= 5) AS committed, count(*) FILTER (WHERE id % 20 < 5) AS skipped, count(*) FILTER (WHERE id % 20 < 2) AS errors FROM games"),
    "clustered_sink": _positions("SELECT zobrist_hash, count(*) AS n, min(game_id) AS low, max(game_id) AS high FROM pos GROUP BY zobrist_hash"),
    "repeated_tags": _positions("SELECT DISTINCT game_id FROM (SELECT game_id, name FROM tags GROUP BY game_id, name HAVING count(*) > 1)", _TAGS),
}
# Where a block of expressions brings its own final select, the one given here is empty.
ORACLE_SQL = {k: v.replace(")\n\n", ")\n") for k, v in ORACLE_SQL.items()}
