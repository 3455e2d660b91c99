import sys

import pytest

from plyspark import api
from plyspark.functions.board import Board
from plyspark.functions.engine import Limits, analyse
from plyspark.sources.bundle import Bundle

PGN = '[Event "E"]\n[White "Ann"]\n[Black "Bob"]\n[Result "1-0"]\n[Opening "King"]\n\n1. e4 e5 2. Nf3 1-0\n'


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    return api.Service(Bundle.create(spark, str(tmp_path_factory.mktemp("s") / "b")))


def test_board_routes():
    assert api.health() == (200, {"status": "ok"})
    assert len(api.legal_moves(Board().fen())[1]["legal_moves"]) == 20
    assert api.legal_moves("x") == (400, {"error": "invalid fen"})
    assert api.apply_move({"fen": Board().fen(), "uci": "e2e4"})[1]["san"] == "e4"
    assert api.apply_move({"fen": Board().fen(), "uci": "e2e5"}) == (400, {"error": "illegal move"})
    assert api.apply_move({"fen": Board().fen(), "uci": "e9"}) == (400, {"error": "invalid uci"})
    assert api.apply_move([]) == (400, {"error": "invalid request body"})
    assert api.position_hash(Board().fen()) == (200, {"hash": str(Board().hash())})


def test_game_routes(service):
    assert service.add_game(PGN) == (201, {"id": 1, "source_type": "manual"})
    assert service.add_game(PGN)[0] == 409
    assert service.add_game("")[0] == 400 and service.add_game('[Event "x"]\n\n*') == (400, {"error": "empty game"})
    status, body = service.list_games({"player": "ann"})
    assert status == 200 and body["total_count"] == 1 and body["games"][0]["white"] == "Ann"
    assert service.list_games({"limit": "0"})[1]["games"] == []
    for bad, message in (({"limit": "x"}, "invalid pagination parameters"), ({"min_elo": "1.5"}, "invalid elo filter"), ({"color": "red"}, "invalid color filter"), ({"position_hash": "-1"}, "invalid position hash")):
        assert service.list_games(bad) == (400, {"error": message})
    assert service.get_game("0")[0] == 400 and service.get_game("9")[0] == 404
    assert service.get_game("1")[1]["tags"] == [{"name": "Opening", "value": "King"}]
    assert service.game_pgn("1")[1].endswith("1. e4 e5 2. Nf3 1-0\n")
    sequence = service.game_positions("1")[1]
    assert sequence["sans"] == ["e4", "e5", "Nf3"] and sequence["starting_hash"] == str(Board().hash()) and len(sequence["hashes"]) == 3
    status, body = service.opening_stats(str(Board().hash()))
    assert status == 200 and body["total_games"] == 1 and [c["san"] for c in body["continuations"]] == ["e4"] and body["continuations"][0]["opening_name"] == "King"
    assert service.opening_stats("zz") == (400, {"error": "invalid zobrist hash"})
    assert len(service.positions(str(Board().hash()))[1]) == 1 and service.positions("1", limit="0") == (200, [])


def test_patch_and_delete(service):
    service.add_game(PGN.replace("Ann", "Cid"))
    number = service.list_games({"player": "cid"})[1]["games"][0]["id"]
    assert service.patch_game(number, {"result": "2-0"}) == (400, {"error": "invalid result"})
    status, body = service.patch_game(number, {"white_name": "Dee", "white_elo": 2100, "eco": "C40", "notes": "n", "review_status": "studied"})
    assert status == 200 and (body["white"], body["white_elo"], body["eco"], body["review_status"]) == ("Dee", 2100, "C40", "studied")
    assert {"name": "_notes", "value": "n"} in body["tags"]
    rows = service.bundle.table("position").where(f"game_id = {number}").collect()
    assert {r.white_elo for r in rows} == {2100}
    assert service.patch_game(number, {"white_name": "Ann"}) == (409, {"error": "duplicate game"})
    assert service.delete_game(number) == (204, None) and service.delete_game(number)[0] == 404


def test_import_sessions(service, tmp_path):
    path = tmp_path / "x.pgn"
    path.write_text(PGN.replace("Ann", "Eve"))
    status, body = service.start_import(str(path))
    service.sessions[body["import_id"]]["thread"].join()
    assert status == 202 and service.import_progress(body["import_id"])[1] == {"phase": "complete", "attempted": 1, "committed": 1, "skipped": 0, "errors": 0}
    assert service.import_progress("none")[0] == 404
    imported = service.list_games({"player": "eve"})[1]["games"][0]["id"]
    assert service.delete_game(imported) == (403, {"error": "not editable"})


def test_counts_rebuilds_uploads_and_events(service, tmp_path):
    n = service.count_games()[1]["count"]
    before = service.bundle.table("position").count()
    assert service.rebuild_positions() == (204, None) and service.bundle.table("position").count() == before
    assert service.start_import(str(tmp_path / "none.pgn")) == (400, {"error": "file not found or not readable"}) and service.start_import(str(tmp_path))[0] == 400
    assert service.upload_import(None) == (400, {"error": "missing file field"})
    status, body = service.upload_import(PGN.replace("Ann", "Fay").encode() + PGN.replace("Ann", "Fay").encode())
    assert status == 202 and service.upload_import(b"x")[0] == 409
    status, events = service.import_events(body["import_id"])
    events = list(events)
    assert status == 200 and {e for e, _ in events[:-1]} == {"progress"} and events[-1][0] == "complete"
    assert {k: events[-1][1][k] for k in ("total_attempted", "committed", "skipped", "errors")} == {"total_attempted": 2, "committed": 1, "skipped": 1, "errors": 0}
    assert service.count_games() == (200, {"count": n + 1})
    assert service.cancel_import(body["import_id"]) == (200, {"status": "cancellation_requested"})
    assert service.cancel_import("none") == service.import_events("none") == (404, {"error": "import not found"})


def test_a_cancelled_import_leaves_nothing(service, tmp_path):
    path = tmp_path / "many.pgn"
    path.write_text("".join(PGN.replace("Ann", f"G{i}") for i in range(3000)))
    n = service.count_games()
    key = service.start_import(str(path))[1]["import_id"]
    while "thread" not in service.sessions[key]:
        pass
    service.sessions[key]["thread"].join(1.0)
    assert service.cancel_import(key)[0] == 200
    service.sessions[key]["thread"].join()
    phase = service.import_progress(key)[1]["phase"]
    assert (phase, service.count_games()) == ("cancelled", n) or phase == "complete"
    assert service.start_import(str(path))[0] == 202
    list(service.import_events(list(service.sessions)[-1])[1])
    assert service.count_games()[1]["count"] == n[1]["count"] + 3000


def test_engine_sessions(service, tmp_path):
    script = tmp_path / "engine.py"
    script.write_text(f"#!{sys.executable}\n" + FAKE)
    script.chmod(0o755)
    fen = Board().fen()
    assert service.start_analysis({"fen": fen, "depth": 3}) == (503, {"error": "no engine configured"})
    assert service.configure_engine({"name": "", "path": "x"}) == (400, {"error": "name and path are required"}) and service.configure_engine([])[0] == 400
    assert service.configure_engine({"name": "fake", "path": str(script)}) == (200, {"status": "ok"})
    assert service.list_engines() == (200, {"engines": [{"name": "fake", "path": str(script)}]})
    for body, message in (
        ({}, "missing fen"), ({"fen": "x", "depth": 1}, "invalid fen"), ({"fen": fen}, "provide exactly one of depth or movetime_ms"), ({"fen": fen, "depth": 1, "movetime_ms": 1}, "provide exactly one of depth or movetime_ms"),
        ({"fen": fen, "depth": 1, "multipv": 6}, "multipv must be between 1 and 5"), ({"fen": fen, "depth": 101}, "depth must be between 1 and 100"), ({"fen": fen, "movetime_ms": 300_001}, "movetime_ms must be between 1 and 300000"), ({"fen": fen, "depth": "1"}, "invalid request body"),
    ):
        assert service.start_analysis(body) == (400, {"error": message})
    key = service.start_analysis({"fen": fen, "depth": 5})[1]["analysis_id"]
    first = list(service.analysis_events(key)[1])
    assert [e for e, _ in first] == ["info", "complete"] and first[0][1]["pv_san"] == ["e4", "e5"] and first[0][1]["score"] == {"type": "cp", "value": 31} and first[1][1] == {"best_move_uci": "e2e4", "ponder_uci": None}
    assert list(service.analysis_events(key)[1]) == first  # told again to whoever asks late
    assert service.stop_analysis(key) == (409, {"error": "analysis already terminal"}) and service.stop_analysis("none") == service.analysis_events("none") == (404, {"error": "analysis not found"})
    service.configure_engine({"name": "gone", "path": str(tmp_path / "none")})
    assert service.start_analysis({"fen": fen, "depth": 1, "engine": "gone"}) == (503, {"error": "engine failed to start"}) and service.start_analysis({"fen": fen, "depth": 1, "engine": "?"})[0] == 503


FAKE = r"""
import sys
for line in sys.stdin:
    w = line.split()
    if w[:1] == ["uci"]: print("uciok")
    elif w[:1] == ["isready"]: print("readyok")
    elif w[:1] == ["go"]:
        print("info depth 5 multipv 1 score cp 31 pv e2e4 e7e5")
        print("bestmove e2e4")
    sys.stdout.flush()
"""


def test_engine_batch(spark, tmp_path):
    script = tmp_path / "engine.py"
    script.write_text(FAKE)
    df = spark.createDataFrame([(Board().fen(),), ("bad",)], "fen string")
    rows = {r.fen: r for r in analyse(df, [sys.executable, str(script)], Limits(depth=5)).collect()}
    assert rows[Board().fen()].pv_san == ["e4", "e5"] and rows[Board().fen()].score == 31 and rows["bad"].error == "invalid fen"
    failed = analyse(df.limit(1), [str(tmp_path / "none")], Limits(depth=5)).first()
    assert failed.error.startswith("engine failed")
    for wrong in ({}, {"depth": 1, "movetime": 1}, {"depth": 1, "multipv": 6}):
        with pytest.raises(ValueError):
            Limits(**wrong)
