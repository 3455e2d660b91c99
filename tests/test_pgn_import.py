import random

import pytest

from plyspark.functions.board import Board, signed
from plyspark.plans.ingest import delete_games, import_pgn, open_bundle, rebuild_positions
from plyspark.sources.bundle import Bundle
from plyspark.sources.pgn import count_events, parse_game, parse_one, read_pgn, split_games, to_pgn
from plyspark.streaming.imports import run_import


def game(event="E", white="W", black="B", moves="1. e4 e5 2. Nf3 Nc6 3. Bb5", result="1-0", extra=""):
    return f'[Event "{event}"]\n[Site "S"]\n[Date "2024.01.02"]\n[White "{white}"]\n[Black "{black}"]\n[Result "{result}"]\n{extra}\n{moves} {result}\n\n'


THREE = (
    game(extra='[WhiteElo "2500"]\n[BlackElo "2400"]\n[ECO "C60"]\n') + game(white="X", moves="1. d4 d5 2. c4 e6", result="0-1", extra='[WhiteElo "2300"]\n') + game(black="Y", moves="1. Nf3 Nf6 2. g3 g6", result="1/2-1/2")
)


@pytest.fixture
def bundle(spark, tmp_path):
    return Bundle.create(spark, str(tmp_path / "bundle"))


def write(path, text):
    path.write_text(text)
    return str(path)


def test_splitting_minds_comments_and_ranges(spark, tmp_path):
    one = game(moves='1. e4 { [Event "Fake"]\n[Event "Fake"] } e5')
    text = "junk\n" + (one + game(event="Two")) * 5
    path = write(tmp_path / "a.pgn", text)
    want = [(o, t.decode()) for o, t in split_games(text.encode())]
    assert len(want) == 10
    for size in (41, 200, 1 << 20):
        assert [(r.byte_offset, r.text) for r in read_pgn(spark, path, size).orderBy("byte_offset").collect()] == want
    assert count_events(spark.read.text(path)).first().n == 20  # the quick count sees comments too


def test_folders_and_missing_files(spark, tmp_path):
    write(tmp_path / "a.pgn", game())
    write(tmp_path / "b.PGN", game() * 2)
    write(tmp_path / "c.txt", game())
    (tmp_path / "empty.pgn").touch()
    assert read_pgn(spark, str(tmp_path)).count() == 3
    with pytest.raises(FileNotFoundError):
        read_pgn(spark, str(tmp_path / "none.pgn"))


def test_parsing_leaves_out_comments_variations_and_glyphs():
    tags, moves, result = parse_game('[Event "A \\"q\\""]\n[Result "1-0"]\n\n1. e4! {c (x)} (1. d4 (1. c4) d5) e5 $3 ; rest 2. Bc4\n2. Nf3?! 2... Nc6 1-0\n')
    assert tags == [("Event", 'A "q"'), ("Result", "1-0")] and moves == ["e4!", "e5", "Nf3?!", "Nc6"] and result == "1-0"
    assert parse_one('[Event "x"\n\n1. e4 *')["status"] == "parse_error"
    assert parse_one('[Event "x"]\n\n*')["status"] == "empty_game"
    assert parse_one('[Event "x"]\n\n1. NotAMove *')["status"] == "parse_error"
    assert parse_one('[Event "x"]\n\n1. e4 -- *')["status"] == "parse_error"


def test_three_games(spark, bundle, tmp_path):
    done = import_pgn(bundle, write(tmp_path / "t.pgn", THREE))
    assert (done.attempted, done.committed, done.skipped, done.errors) == (3, 3, 0, 0)
    assert bundle.table("position").count() == 16
    again = import_pgn(bundle, str(tmp_path / "t.pgn"))
    assert (again.attempted, again.committed, again.skipped, again.errors) == (3, 0, 3, 0)
    assert Bundle.open(spark, bundle.path).manifest["game_count"] == 3


def test_summary_of_duplicates_and_errors(bundle, tmp_path):
    done = import_pgn(bundle, write(tmp_path / "d.pgn", game() + game() + game(white="Q", moves="1. NotAMove")))
    assert (done.attempted, done.committed, done.skipped, done.errors) == (3, 1, 2, 1)
    only = import_pgn(bundle, write(tmp_path / "e.pgn", game(white="Q", moves="1. NotAMove")))
    assert (only.attempted, only.committed, only.skipped, only.errors) == (1, 0, 1, 1)


def test_rebuild_equals_import(bundle, tmp_path):
    import_pgn(bundle, write(tmp_path / "t.pgn", THREE))
    before = sorted(map(tuple, bundle.table("position").collect()))
    rebuild_positions(bundle)
    assert sorted(map(tuple, bundle.table("position").collect())) == before
    assert (signed(Board().hash()), 1, 0, 0, 1, 2500, 2400) in before


def test_delete_keeps_players(bundle, tmp_path):
    import_pgn(bundle, write(tmp_path / "t.pgn", THREE))
    players = bundle.table("player").count()
    assert delete_games(bundle, [1, 77]) == 1
    assert bundle.table("game").count() == 2 and bundle.table("position").count() == 10 and bundle.table("player").count() == players
    assert delete_games(bundle, [2], only_manual=True) == 0


def test_export_round_trip():
    b = Board()
    moves = [b.apply_san(s) for s in ("e4", "e5", "Nf3")]
    text = to_pgn({"id": 7, "white": "W", "black": "B", "result": "1-0", "moves": moves, "white_elo": 2500, "tags": [{"name": "Opening", "value": "King"}]})
    assert text.splitlines()[:4] == ['[Event "?"]', '[Site "?"]', '[Date "????.??.??"]', '[Round "?"]']
    assert text.endswith('[GameId "7"]\n[Opening "King"]\n\n1. e4 e5 2. Nf3 1-0\n')
    assert parse_one(text)["moves"] == moves
    assert to_pgn({"id": 1, "white": "W", "black": "B", "result": "*", "moves": []}).endswith("\n\n*\n")


def test_random_games_replay(spark, bundle, tmp_path):
    rng = random.Random(3)
    texts = []
    for k in range(20):
        b, sans = Board(), []
        for ply in range(rng.randint(1, 30)):
            legal = b.legal_moves()
            if not legal:
                break
            m = rng.choice(legal)
            sans.append((f"{ply // 2 + 1}. " if ply % 2 == 0 else "") + b.san(m))
            b.play(m)
        texts.append(game(white=f"P{k}", moves=" ".join(sans), result="*"))
    done = import_pgn(bundle, write(tmp_path / "r.pgn", "".join(texts)))
    assert done.committed == 20 and done.errors == 0


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "a.pgn", THREE)
    args = (spark, str(folder), str(tmp_path / "b"), str(tmp_path / "c"))
    assert run_import(*args).committed == 3
    assert run_import(*args).attempted == 0
    write(folder / "b.pgn", THREE + game(white="New"))
    second = run_import(*args)
    assert (second.attempted, second.committed, second.skipped) == (4, 1, 3)


def test_checkpoint_file(tmp_path):
    from plyspark.sources import checkpoint as c

    assert c.read(str(tmp_path)) is None
    c.write(str(tmp_path), c.Checkpoint("a.pgn", 10, 2, 7))
    assert c.read(str(tmp_path)) == c.Checkpoint("a.pgn", 10, 2, 7)
    (tmp_path / c.NAME).write_text("[]")
    with pytest.raises(ValueError):
        c.read(str(tmp_path))
    c.delete(str(tmp_path))
    c.delete(str(tmp_path))
    assert c.read(str(tmp_path)) is None


def test_dirty_bundle_is_rebuilt(spark, bundle, tmp_path):
    import_pgn(bundle, write(tmp_path / "t.pgn", THREE))
    bundle.commit(replace={"position": bundle.table("position").limit(1)}, position_index_dirty=True)
    assert open_bundle(spark, bundle.path).table("position").count() == 16
    assert not Bundle.open(spark, bundle.path).manifest["position_index_dirty"]
