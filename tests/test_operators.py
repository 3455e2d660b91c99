"""The analytic operators on small tables with values worked out by hand."""

import pytest

from plyspark.functions.board import Board, signed
from plyspark.functions.columns import find_tag, hash_bits, hash_text, legal_moves, parse_elo, position_rows, replay_fen, result_number
from plyspark.operators import changes, games, search, stats, tree
from plyspark.operators.filters import GameFilter, filtered, page_limit
from plyspark.schemas import GAME, GAME_TAG, POSITION, SchemaMismatch, migrated
from pyspark.sql import functions as F

ROWS = [
    (100, 1, 0, 0, 1, 2500, 2400), (200, 1, 1, 10, 1, 2500, 2400), (300, 1, 2, 11, 1, 2500, 2400),
    (100, 2, 0, 0, -1, 2200, 2100), (201, 2, 1, 20, -1, 2200, 2100), (301, 2, 2, 21, -1, 2200, 2100),
]


@pytest.fixture(scope="module")
def position(spark):
    return spark.createDataFrame(ROWS, POSITION).cache()


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def played(spark, *rows):
    """Positions of games given as (SAN text, result, white_elo, black_elo)."""
    made = []
    for i, (sans, result, w, b) in enumerate(rows, 1):
        board = Board()
        made.append((i, [board.apply_san(s) for s in sans.split()], result, w, b))
    games_df = spark.createDataFrame(made, "id long, moves array<int>, result string, white_elo int, black_elo int")
    return position_rows(games_df).cache()


def key_after(sans=""):
    b = Board()
    for s in sans.split():
        b.apply_san(s)
    return signed(b.hash())


def move(sans, san):
    b = Board()
    for s in sans.split():
        b.apply_san(s)
    return b.parse_san(san)


def test_filtered_position_store(spark, position):
    assert search.count_distinct_games(position, 100, ids(spark, 1)).first().n == 1
    rows = stats.opening_stats(position, 100, ids(spark, 1)).collect()
    assert len(rows) == 1 and rows[0].frequency == 1 and rows[0].elo_weighted_score == 1.0
    assert sorted(r.depth for r in search.tree_slice(position, 100, 2, ids(spark, 2)).collect()) == [1, 2]


def test_search_pages(position):
    assert [r.game_id for r in search.position_search(position, 100).collect()] == [1, 2]
    assert [r.game_id for r in search.position_search(position, 100, offset=1).collect()] == [2]
    assert [r.game_id for r in search.position_search(position, 100, limit=1).collect()] == [1]
    assert search.count_positions(position, 999).first().n == 0


def test_continuations_and_null_ratings(spark):
    p = played(spark, ("e4 e5 Nf3 Nc6", "1-0", 2500, 2400), ("e4 e5 Nf3 d6", "1/2-1/2", 2300, None), ("e4 e5 Nc3 Nc6", "0-1", None, 2200))
    rows = {r.encoded_move: r for r in stats.opening_stats(p, key_after("e4 e5")).collect()}
    nf3, nc3 = rows[move("e4 e5", "Nf3")], rows[move("e4 e5", "Nc3")]
    assert (nf3.frequency, nf3.white_wins, nf3.draws, nf3.black_wins, nf3.avg_white_elo, nf3.avg_black_elo) == (2, 1, 1, 0, 2400.0, 2400.0)
    assert (nc3.frequency, nc3.black_wins, nc3.avg_white_elo, nc3.avg_black_elo, nc3.elo_weighted_score) == (1, 1, None, 2200.0, 0.0)


def test_transposition_counts_by_any_route(spark):
    p = played(spark, ("Nf3 Nc6 Nc3 Nf6 e4", "1-0", None, None), ("Nc3 Nf6 Nf3 Nc6 e4", "0-1", None, None))
    key = key_after("Nf3 Nc6 Nc3")
    assert search.count_distinct_games(p, key).first().n == 1
    assert [r.frequency for r in stats.opening_stats(p, key).collect()] == [2]
    assert [r.frequency for r in stats.opening_stats(p, key, ids(spark, 1)).collect()] == [1]


def test_terminal_position_has_no_continuations(spark):
    p = played(spark, ("e4 e5", "1-0", None, None))
    assert search.count_distinct_games(p, key_after("e4 e5")).first().n == 1
    assert stats.opening_stats(p, key_after("e4 e5")).count() == 0


def test_weighted_score(spark):
    p = played(spark, ("Nf3", "1-0", 2500, 2500), ("Nf3", "1/2-1/2", 2000, 2000), ("Nf3", "0-1", 1500, 1500))
    assert stats.opening_stats(p, key_after()).first().elo_weighted_score == 1000 / 6000


def test_elo_buckets_fill_gaps(spark):
    p = played(spark, ("Nf3", "1-0", 1400, 1400), ("Nf3", "0-1", 2400, 2400))
    rows = stats.elo_distribution(p, key_after(), 100).collect()
    assert len(rows) == 11 and sum(r.game_count == 0 for r in rows) == 9
    with pytest.raises(ValueError):
        stats.elo_distribution(p, key_after(), 0)


def test_tree_counts_repeat_visits(spark):
    p = played(spark, ("Nf3 Nf6 Ng1 Ng8 Nf3 Nf6 Ng1 Nc6", "1-0", None, None))
    key = key_after("Nf3 Nf6")
    edges = [r.asDict() for r in tree.opening_tree_edges(p, key, 2).collect()]
    root = tree.assemble(edges, key, 2)
    assert [c.edge["frequency"] for c in root.children] == [2]
    assert sorted(c.edge["encoded_move"] for c in root.children[0].children) == sorted([move("Nf3 Nf6 Ng1", "Nc6"), move("Nf3 Nf6 Ng1", "Ng8")])
    assert not root.children[0].children[0].expanded and not tree.assemble(edges, key, 0).expanded
    assert tree.assemble([], key, 3).expanded


def test_tree_boundary_and_expand(spark):
    p = played(spark, ("e4 e5 Nf3 Nc6 Bb5", "1-0", None, None))
    key = key_after("e4")
    node = tree.assemble([r.asDict() for r in tree.opening_tree_edges(p, key, 4).collect()], key, 4)
    for _ in range(4):
        node = node.children[0]
    assert node.edge["encoded_move"] == move("e4 e5 Nf3 Nc6", "Bb5") and not node.expanded
    tree.expand(node, [r.asDict() for r in stats.opening_stats(p, node.zobrist_hash).collect()])
    assert node.expanded and node.children == []
    with pytest.raises(ValueError):
        tree.opening_tree_edges(p, key, 70000)


def test_shared_child_stands_under_both_parents(spark):
    p = played(spark, ("Nf3 Nc6 Nc3", "1-0", None, None), ("Nc3 Nc6 Nf3", "1-0", None, None))
    root = tree.assemble([r.asDict() for r in tree.opening_tree_edges(p, key_after(), 3).collect()], key_after(), 3)
    leaves = [c3 for c1 in root.children for c2 in c1.children for c3 in c2.children]
    assert len(leaves) == 2 and len({x.zobrist_hash for x in leaves}) == 1


def test_attribution_falls_back_and_drops_orphans(spark):
    p = played(spark, ("e4", "1-0", None, None), ("e4", "1-0", None, None), ("d4", "1-0", None, None))
    contexts = spark.createDataFrame([(2, "B00", "King")], "id long, eco string, opening_name string")
    rows = stats.attributed(stats.opening_stats(p, key_after()), contexts).collect()
    assert [(r.sample_id, r.eco, r.opening_name) for r in rows] == [(2, "B00", "King")]


GAMES = [(1, "Carlsen", "Nakamura", 2850, 2780, "1-0", "C40"), (2, "nakamura", "So", 2780, None, "0-1", "B20"), (3, "Łódź", "Carlsen", 1500, 1600, "1/2-1/2", None)]


def test_filters(spark):
    g = spark.createDataFrame(GAMES, "id long, white string, black string, white_elo int, black_elo int, result string, eco string")

    def found(**k):
        return sorted(r.id for r in filtered(g, GameFilter(**k)).collect())

    assert found() == [1, 2, 3]
    assert found(player_name="NAKA") == [1, 2] and found(player_name="naka", player_color="white") == [2] and found(player_name="naka", player_color="black") == [1]
    assert found(eco_prefix="c4") == [1] and found(eco_prefix="_4") == [1] and found(eco_prefix="%2") == [2]
    assert found(min_elo=2000) == [1] and found(max_elo=1700) == [3] and found(result="0-1") == [2]
    assert not GameFilter(position=1, offset=3, player_color="white").has_metadata and GameFilter(eco_prefix="").has_metadata
    assert (page_limit(None), page_limit(0), page_limit(9999)) == (100, 0, 500)


def test_scalars(spark):
    elo = [("2015", 2015), ("?", None), ("40000", None), ("", None), ("+5", None), (" 5", None), ("-0", 0), ("-1", None), ("32767", 32767)]
    df = spark.createDataFrame(elo, "t string, want int")
    assert all(r.got == r.want for r in df.select("want", parse_elo(F.col("t")).alias("got")).collect())
    wide = [0xDEADBEEFCAFEBABE, 0x0123456789ABCDEF, 0xABCDABCDABCDABCD]
    df = spark.createDataFrame([(str(w),) for w in wide], "t string").select("t", hash_text(hash_bits(F.col("t"))).alias("back"))
    assert all(r.t == r.back for r in df.collect())
    df = spark.createDataFrame([("1-0",), ("0-1",), ("*",), ("1/2-1/2",)], "r string").select(result_number(F.col("r")).alias("n"))
    assert [r.n for r in df.collect()] == [1, -1, 0, 0]
    tags = spark.createDataFrame([([("A", "1"), ("A", "2")],)], "tags array<struct<name:string,value:string>>")
    assert tags.select(find_tag(F.col("tags"), "A").alias("a"), find_tag(F.col("tags"), "B").alias("b")).first() == ("1", "")


def test_board_columns(spark):
    df = spark.createDataFrame([(Board().fen(),), ("bad",), (None,)], "fen string")
    assert [None if r.m is None else len(r.m) for r in df.select(legal_moves("fen").alias("m")).collect()] == [20, None, None]
    moves = [move("", "e4")]
    df = spark.createDataFrame([(moves, 0), (moves, 1), (moves, 2)], "moves array<int>, ply int")
    assert [r.f for r in df.select(replay_fen("moves", "ply").alias("f")).collect()][2] is None


def test_clustered_table_keeps_rows(position):
    assert sorted(map(tuple, search.clustered(position, 3).collect())) == sorted(map(tuple, position.collect()))


def test_sample_is_seeded_and_bounded(position):
    a = sorted(r.zobrist_hash for r in search.sample_hashes(position, 4, 1).collect())
    assert a == sorted(r.zobrist_hash for r in search.sample_hashes(position.repartition(3), 4, 1).collect()) and len(a) <= 4


def test_dimension_keeps_first_attributes(spark):
    new = spark.createDataFrame([("A", 1, 2), ("A", 9, 1), ("B", 5, 3), ("C", 7, 4)], "name string, elo int, seq long")
    old = spark.createDataFrame([("B",)], "name string")
    assert sorted(tuple(r) for r in changes.new_dimension_rows(new, old, ["elo"]).collect()) == [("A", 9, 1), ("C", 7, 4)]


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("seq")).repartition(7)
    rows = sorted(tuple(r) for r in changes.with_ids(df, 5, ["seq"]).select("seq", "id").collect())
    assert rows == [(i, i + 5) for i in range(1000)]


def test_notes(spark):
    tags = spark.createDataFrame([(1, 0, "_notes", "old"), (1, 1, "Round", "3"), (2, 0, "_notes", "keep")], GAME_TAG)
    change = spark.createDataFrame([(1, "new"), (3, "first")], "id long, notes string")
    assert sorted(tuple(r) for r in changes.replace_notes(tags, change).collect()) == [(1, 1, "Round", "3"), (1, 2, "_notes", "new"), (2, 0, "_notes", "keep"), (3, 0, "_notes", "first")]
    gone = changes.replace_notes(tags, spark.createDataFrame([(1, "")], "id long, notes string"))
    assert sorted(tuple(r) for r in gone.collect()) == [(1, 1, "Round", "3"), (2, 0, "_notes", "keep")]


def test_migration(spark):
    old = spark.createDataFrame([(1, "1-0")], "id long, result string")
    assert migrated(old, 1).first().asDict() == {"id": 1, "result": "1-0", "source_type": "imported", "source_label": None, "review_status": "new"}
    with pytest.raises(SchemaMismatch):
        migrated(old, 3)


def test_empty_tables(spark):
    p = spark.createDataFrame([], POSITION)
    assert stats.opening_stats(p, 1).count() == 0 and stats.elo_distribution(p, 1).count() == 0 and tree.opening_tree_edges(p, 1).count() == 0
    assert changes.dedup_games(spark.createDataFrame([], GAME + ", seq long"), None).count() == 0
    assert games.game_contexts(spark.createDataFrame([], GAME), spark.createDataFrame([], GAME_TAG)).count() == 0
