"""A corpus with the structure of games, made from order tables; the same in Spark and in SQL.

A game is an order, a ply one of its line items.  Moves come from an alphabet of six, and a position's hash
is the running exclusive or of its moves, so orders of the same moves transpose into one position, and a
game may visit a position again.

Queries read these tables as a server reads a bundle's: written once for a session and a folder of input,
positions clustered by hash, so that a search for one hash skips most row groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.search import clustered

ALPHABET = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _elo(key: str, factor: int, gap: int):
    return F.when(F.col(key) % gap != 0, F.lit(1200) + F.col(key) * factor % 1500).cast("int")


def _base(spark: SparkSession) -> str | None:
    """A folder that all executors see; none on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return base.rstrip("/") if base else "file:///tmp/checkpoints" if spark.sparkContext.master.startswith("local") else None


_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """The table `name` of this session and input, written when first asked for."""
    key, base = (spark.sparkContext.applicationId, sf_dir, name), _base(spark)
    if base is None:
        return make(spark, sf_dir)
    if key not in _written:
        df, path = make(spark, sf_dir), f"{base}/plyspark/surrogate/{name}-{uuid.uuid4().hex}"
        (clustered(df).write.option("parquet.block.size", 1 << 20) if name == "position" else df.write).parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "position", _position)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with names, as `operators.games.game_view` gives them; rated by player."""
    return _once(spark, sf_dir, "games", _games)


def _position(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    move = (F.col("l_partkey") % ALPHABET).cast("int")
    plies = items.select(
        F.col("l_orderkey").alias("game_id"), F.row_number().over(order).alias("ply"), (move + 1).alias("encoded_move"),
        F.expr("bit_xor(shiftleft(1L, cast(l_partkey % 6 as int)))").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("zobrist_hash"),
    )
    start = F.struct(F.lit(0).alias("ply"), F.lit(0).alias("encoded_move"), F.lit(0).cast("long").alias("zobrist_hash"))
    own = F.struct("ply", "encoded_move", "zobrist_hash")
    # The starting position comes with the first ply, so the table is scanned once.
    rows = plies.select("game_id", F.explode(F.when(F.col("ply") == 1, F.array(start, own)).otherwise(F.array(own))).alias("p")).select("game_id", "p.*")
    return rows.select(
        "zobrist_hash", "game_id", "ply", "encoded_move", (F.col("game_id") % 3 - 1).cast("byte").alias("result"), _elo("game_id", 37, 7).alias("white_elo"), _elo("game_id", 53, 11).alias("black_elo")
    )


def _games(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    n = customer.agg(F.count("*").alias("n"))
    rows = orders.crossJoin(F.broadcast(n)).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("white_id"), ((F.col("o_custkey") * 7 + 3) % F.col("n")).alias("black_id"), "o_orderstatus", F.col("o_orderpriority").alias("eco"))
    elo = _elo("c_custkey", 37, 7)
    w = customer.select(F.col("c_custkey").alias("white_id"), F.col("c_name").alias("white"), elo.alias("white_elo"), F.col("c_nationkey").alias("n_nationkey"))
    b = customer.select(F.col("c_custkey").alias("black_id"), F.col("c_name").alias("black"), elo.alias("black_elo"))
    events = nation.where("n_regionkey < 3").select("n_nationkey", F.col("n_name").alias("event"))
    out = rows.join(w, "white_id").join(b, "black_id").join(events, "n_nationkey", "left")
    result = F.when(F.col("o_orderstatus") == "F", "1-0").when(F.col("o_orderstatus") == "O", "0-1").otherwise("1/2-1/2")
    return out.select("id", "white_id", "black_id", "white", "black", "white_elo", "black_elo", result.alias("result"), "event", "eco")


#: The same tables as DuckDB common table expressions.  The empty strings that are appended keep texts from
#: staying dictionary-coded across joins, which some builds of that engine stumble over.
POSITION_SQL = """
ply AS (
  SELECT l_orderkey AS game_id, CAST(l_partkey % 6 AS INTEGER) AS k,
         CAST(row_number() OVER o AS INTEGER) AS ply,
         bit_xor(CAST(1 AS BIGINT) << CAST(l_partkey % 6 AS INTEGER)) OVER (o ROWS UNBOUNDED PRECEDING) AS zobrist_hash
  FROM lineitem
  WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)),
pos AS (
  SELECT zobrist_hash, game_id, ply, encoded_move, CAST(game_id % 3 - 1 AS TINYINT) AS result,
         CASE WHEN game_id % 7 <> 0 THEN CAST(1200 + game_id * 37 % 1500 AS INTEGER) END AS white_elo,
         CASE WHEN game_id % 11 <> 0 THEN CAST(1200 + game_id * 53 % 1500 AS INTEGER) END AS black_elo
  FROM (SELECT zobrist_hash, game_id, ply, k + 1 AS encoded_move FROM ply
        UNION ALL SELECT DISTINCT CAST(0 AS BIGINT), game_id, 0, 0 FROM ply))"""
GAMES_SQL = """
cust AS (
  SELECT c_custkey, c_name || left(CAST(c_custkey AS VARCHAR), 0) AS c_name, c_nationkey,
         CASE WHEN c_custkey % 7 <> 0 THEN CAST(1200 + c_custkey * 37 % 1500 + 0 * c_nationkey AS INTEGER) END AS elo FROM customer),
dealt AS MATERIALIZED (SELECT *, (o_custkey * 7 + 3) % n AS black_key FROM orders, (SELECT count(*) AS n FROM customer)),
games AS (
  SELECT o_orderkey AS id, w.c_custkey AS white_id, b.c_custkey AS black_id, w.c_name AS white, b.c_name AS black,
         w.elo AS white_elo, b.elo AS black_elo,
         (CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' ELSE '1/2-1/2' END) || left(CAST(o_orderkey AS VARCHAR), 0) AS result,
         n_name || left(CAST(o_orderkey AS VARCHAR), 0) AS event, o_orderpriority || left(CAST(o_orderkey AS VARCHAR), 0) AS eco
  FROM dealt
  JOIN cust w ON w.c_custkey = o_custkey
  JOIN cust b ON b.c_custkey = black_key
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n.n_nationkey = w.c_nationkey)"""
