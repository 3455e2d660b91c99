"""The service surface as functions: each returns (status, body) with the bodies and errors of its route."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.board import Board, InvalidFen, InvalidMove, replayed
from .functions.columns import move_info, move_san_at
from .functions.engine import Ended, Limits, NotFound, Sessions
from .operators import changes, games, search, stats
from .operators.filters import DEFAULT_LIMIT, GameFilter, page_limit
from .plans import ingest
from .sources.bundle import Bundle
from .sources.pgn import open_path, to_pgn

#: Imports that have ended and are still told of.
KEPT_SESSIONS = 64
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
Response = tuple[int, Any]
_UCI = re.compile(r"[a-h][1-8][a-h][1-8][qrbn]?")


def _error(status: int, message: str) -> Response:
    return status, {"error": message}


def _unsigned(text: Any, bits: int = 64) -> int | None:
    text = str(text)
    return int(text) if re.fullmatch(r"[0-9]+", text, re.A) and int(text) < 1 << bits else None


def _signed32(text: Any) -> int | None:
    text = str(text)
    return int(text) if re.fullmatch(r"-?[0-9]+", text, re.A) and -(1 << 31) <= int(text) < 1 << 31 else None


def _bits(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _text(h: int) -> str:
    return str(h & ((1 << 64) - 1))


def health() -> Response:
    return 200, {"status": "ok"}


# --- positions ---


def legal_moves(fen: str) -> Response:
    try:
        b = Board(fen)
    except InvalidFen:
        return _error(400, "invalid fen")
    keep = ("uci", "san", "from", "to", "promotion")
    return 200, {"fen": b.fen(), "legal_moves": [{k: info[k] for k in keep if info[k] is not None} for info in (move_info(b, m) for m in b.legal_moves())]}


def apply_move(body: Any) -> Response:
    if not isinstance(body, dict) or not all(isinstance(body.get(k, ""), str) for k in ("fen", "uci")):
        return _error(400, "invalid request body")
    if not body.get("fen"):
        return _error(400, "invalid fen")
    if not body.get("uci") or not _UCI.fullmatch(body["uci"]):
        return _error(400, "invalid uci")
    try:
        b = Board(body["fen"])
        info = move_info(b, b.parse_uci(body["uci"]))
    except InvalidFen:
        return _error(400, "invalid fen")
    except InvalidMove:
        return _error(400, "illegal move")
    return 200, {"uci": info["uci"], "san": info["san"], "fen": info["fen"]}


def position_hash(fen: str) -> Response:
    try:
        return 200, {"hash": str(Board(fen).hash())}
    except InvalidFen:
        return _error(400, "invalid fen")


class Service:
    """The routes that need a bundle."""

    def __init__(self, bundle: Bundle):
        self.bundle = bundle
        self.sessions: dict[str, dict] = {}
        self.engines = Sessions()
        self._busy = threading.Lock()

    def _games(self) -> DataFrame:
        return games.game_view(*(self.bundle.table(t) for t in ("game", "player", "event")))

    def positions(self, hash_text: Any, limit: Any = None, offset: Any = None) -> Response:
        key = _unsigned(hash_text)
        if key is None:
            return _error(400, "invalid zobrist hash")
        page = [_unsigned(v) if v is not None else None for v in (limit, offset)]
        if any(v is not None and p is None for v, p in zip((limit, offset), page)):
            return _error(400, "invalid pagination parameters")
        if page[0] == 0:
            return 200, []
        rows = search.position_search(self.bundle.table("position"), _bits(key), page_limit(page[0]), page[1] or 0)
        return 200, [r.asDict() for r in rows.collect()]

    def opening_stats(self, hash_text: Any, f: GameFilter | None = None) -> Response:
        """Continuations with notation, by frequency, then SAN; the weighted score is no part of the body."""
        key = _unsigned(hash_text)
        if key is None:
            return _error(400, "invalid zobrist hash")
        key, position = _bits(key), self.bundle.table("position")
        ids = None
        if f is not None and f.has_metadata:
            ids = games.find_game_ids(games.at_position(self._games(), position, key), f)
        found = stats.opening_stats(position, key, ids)
        contexts = games.game_contexts(self.bundle.table("game"), self.bundle.table("game_tag"))
        named = stats.attributed(found, contexts).join(self.bundle.table("game").select(F.col("id").alias("sample_id"), "moves"), "sample_id")
        named = named.withColumn("san", move_san_at("moves", "sample_ply", "encoded_move"))
        total = search.count_distinct_games(position, key, ids).first().n
        keep = ("san", "frequency", "white_wins", "draws", "black_wins", "avg_white_elo", "avg_black_elo", "eco", "opening_name")
        rows = stats.in_order(named).collect()  # the moves of one position
        out = [{k: r[k] for k in keep} | {"result_hash": _text(r.child_hash)} for r in rows]
        return 200, {"total_games": total, "continuations": out}

    # --- games ---

    def list_games(self, params: dict[str, Any]) -> Response:
        limit, offset = (params.get(k) for k in ("limit", "offset"))
        page = [_unsigned(v) if v is not None else None for v in (limit, offset)]
        if any(v is not None and p is None for v, p in zip((limit, offset), page)):
            return _error(400, "invalid pagination parameters")
        elo = {}
        for k in ("min_elo", "max_elo"):
            if k in params:
                elo[k] = _signed32(params[k])
                if elo[k] is None:
                    return _error(400, "invalid elo filter")
        color = params.get("color", "either")
        if color not in ("either", "white", "black"):
            return _error(400, "invalid color filter")
        key = None
        if "position_hash" in params:
            key = _unsigned(params["position_hash"])
            if key is None:
                return _error(400, "invalid position hash")
        f = GameFilter(params.get("player") or None, color, elo.get("min_elo"), elo.get("max_elo"), params.get("result") or None, params.get("eco") or None, None if key is None else _bits(key), page[1] or 0, DEFAULT_LIMIT if page[0] is None else page[0])
        position = self.bundle.table("position")
        total = games.find_games_count(self._games(), f, position).first().total_count
        rows = [] if f.limit == 0 else games.find_games(self._games(), f, position).collect()
        return 200, {"games": [r.asDict() for r in rows], "total_count": total}

    def _one(self, game_id: Any) -> dict | None:
        number = _unsigned(game_id, 32)
        if not number:
            return None
        rows = games.get_game(self._games(), self.bundle.table("game_tag"), number).collect()
        if not rows:
            return {}
        out = rows[0].asDict(recursive=True)
        sites = self.bundle.table("event").where(F.col("id") == (out["event_id"] or -1)).select("site").collect()
        titles = {r.id: r.title for r in self.bundle.table("player").where(F.col("id").isin(out["white_id"], out["black_id"])).collect()}
        return out | {"site": sites[0].site if sites else None, "white_title": titles.get(out["white_id"]), "black_title": titles.get(out["black_id"]), "tags": out["tags"] or []}

    def get_game(self, game_id: Any) -> Response:
        game = self._one(game_id)
        if game is None:
            return _error(400, "invalid game id")
        return (200, game) if game else _error(404, "not found")

    def game_pgn(self, game_id: Any) -> Response:
        status, game = self.get_game(game_id)
        return (200, to_pgn(game)) if status == 200 else (status, game)

    def game_positions(self, game_id: Any) -> Response:
        status, game = self.get_game(game_id)
        if status != 200:
            return status, game
        hashes, fens, sans = replayed(game["moves"])
        return 200, {"starting_hash": _text(hashes[0]), "fens": fens, "sans": sans, "hashes": [_text(h) for h in hashes[1:]]}

    def add_game(self, pgn: Any) -> Response:
        if not isinstance(pgn, str) or not pgn.strip():
            return _error(400, "invalid pgn")
        from .sources.pgn import TEXTS, parse_one

        parsed = parse_one(pgn)
        if parsed["status"] == "empty_game":
            return _error(400, "empty game")
        if parsed["status"] != "ok":
            return _error(400, "invalid pgn")
        names = [t["name"] for t in parsed["tags"] if t["name"] not in ingest.OWN_TAGS]
        if len(set(names)) < len(names):
            return _error(500, "import failed")  # a tag stands once in a game
        first = self.bundle.manifest["next_ids"].get("game", 1)
        texts = self.bundle.spark.createDataFrame([(f"manual-{uuid.uuid4().hex}", 0, pgn)], TEXTS)
        done = ingest.import_texts(self.bundle, texts, source_type="manual")
        return (201, {"id": first, "source_type": "manual"}) if done.committed else _error(409, "duplicate game")

    def delete_game(self, game_id: Any) -> Response:
        number = _unsigned(game_id, 32)
        if not number:
            return _error(400, "invalid game id")
        rows = self.bundle.table("game").where(F.col("id") == number).select("source_type").collect()
        if not rows:
            return _error(404, "not found")
        if rows[0].source_type != "manual":
            return _error(403, "not editable")
        ingest.delete_games(self.bundle, [number], only_manual=True)
        return 204, None

    def patch_game(self, game_id: Any, body: Any) -> Response:
        """Changes of a game entered by hand; players and events are found or added by name."""
        number = _unsigned(game_id, 32)
        if not number:
            return _error(400, "invalid game id")
        if not isinstance(body, dict):
            return _error(400, "invalid request body")
        if body.get("result") is not None and body["result"] not in RESULTS:
            return _error(400, "invalid result")
        if body.get("review_status") is not None and body["review_status"] not in changes.REVIEW:
            return _error(400, "invalid review_status")
        spark, table = self.bundle.spark, self.bundle.table
        rows = table("game").where(F.col("id") == number).collect()
        if not rows:
            return _error(404, "not found")
        if rows[0].source_type != "manual":
            return _error(403, "not editable")
        ids, append, replace, patch = dict(self.bundle.manifest["next_ids"]), {}, {}, {"id": number}

        def named(name: str, kind: str, column: str, schema: str, extra: tuple) -> None:
            known = table(kind).where(F.col("name") == name).select("id").collect()
            if known:
                patch[column] = known[0].id
                return
            own = [r for r in append.get(kind, []) if r[1] == name]
            patch[column] = own[0][0] if own else ids.get(kind, 1)
            if not own:
                append.setdefault(kind, []).append((ids.get(kind, 1), name, *extra))
                ids[kind] = ids.get(kind, 1) + 1

        for side in ("white", "black"):
            if body.get(f"{side}_name"):
                named(body[f"{side}_name"], "player", f"{side}_id", "", (body.get(f"{side}_elo"), None, None))
        if body.get("event"):
            named(body["event"], "event", "event_id", "", (body.get("site"), None))
        fields = {"white_elo": "int", "black_elo": "int", "date": "string", "result": "string", "eco": "string", "source_label": "string", "review_status": "string", "white_id": "long", "black_id": "long", "event_id": "long"}
        patch |= {k: body[k] for k in fields if body.get(k) is not None and k not in patch}
        frame = spark.createDataFrame([(number, *(patch.get(k) for k in fields))], "id long, " + ", ".join(f"{k} {t}" for k, t in fields.items()))
        changed = changes.patch_games(table("game"), frame, list(fields))
        twin = changes.dedup_games(changed.where(F.col("id") == number).withColumn("seq", F.lit(0)), changed.where(F.col("id") != number))
        if not twin.limit(1).count():
            return _error(409, "duplicate game")
        replace["game"] = changed
        if body.get("white_elo") is not None or body.get("black_elo") is not None or body.get("result") is not None:
            synced = changes.sync_elo(table("position"), frame)
            if body.get("result") is not None:
                value = {"1-0": 1, "0-1": -1}.get(body["result"], 0)
                synced = synced.withColumn("result", F.when(F.col("game_id") == number, F.lit(value)).otherwise(F.col("result")).cast("byte"))
            replace["position"] = synced
        if body.get("notes") is not None:
            replace["game_tag"] = changes.replace_notes(table("game_tag"), spark.createDataFrame([(number, body["notes"])], "id long, notes string"))
        schemas = {"player": "id long, name string, elo int, title string, country string", "event": "id long, name string, site string, date string"}
        self.bundle.commit(replace=replace, append={k: spark.createDataFrame(v, schemas[k]) for k, v in append.items()}, next_ids=ids)
        return self.get_game(number)

    def count_games(self) -> Response:
        return 200, {"count": self.bundle.table("game").count()}

    def rebuild_positions(self) -> Response:
        try:
            ingest.rebuild_positions(self.bundle)
        except Exception:  # whatever failed, the old table is current still
            return _error(500, "position store rebuild failed")
        return 204, None

    # --- imports ---

    def start_import(self, path: Any) -> Response:
        """Runs an import of a readable file to its end in a thread; one at a time."""
        if not isinstance(path, str) or not path:
            return _error(400, "invalid request body")
        try:
            fs, inner = open_path(path)
            found = fs.get_file_info(inner).type == pafs.FileType.File
        except (OSError, ValueError):
            found = False
        return self._import(path) if found else _error(400, "file not found or not readable")

    def upload_import(self, content: bytes | None) -> Response:
        """The same of bytes that a client sends; they stay in the bundle's folder while the import runs."""
        if content is None:
            return _error(400, "missing file field")
        path = f"{self.bundle.path}/_uploads/{uuid.uuid4().hex}.pgn"
        fs, inner = open_path(path)
        try:
            fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with fs.open_output_stream(inner) as out:
                out.write(content)
        except OSError:
            return _error(500, "failed to write temporary file")
        return self._import(path, after=lambda: fs.delete_file(inner))

    def _import(self, path: str, after: Callable[[], None] = lambda: None) -> Response:
        if not self._busy.acquire(blocking=False):
            after()
            return _error(409, "import already running")
        key, context = uuid.uuid4().hex, self.bundle.spark.sparkContext
        session = self.sessions[key] = {"phase": "ingesting", "began": time.monotonic(), "cancelled": False}
        for old in [k for k, v in self.sessions.items() if "ended" in v][:-KEPT_SESSIONS]:
            del self.sessions[old]

        def run() -> None:
            try:
                context.addJobTag(f"import-{key}")
                done = ingest.import_pgn(self.bundle, path)
                session.update(vars(done), phase="complete")
            except Exception as e:  # the session tells
                session.update(phase="cancelled") if session["cancelled"] else session.update(phase="failed", error=str(e)[:500])
            finally:
                context.removeJobTag(f"import-{key}")
                session["ended"] = time.monotonic()
                self._busy.release()
                after()

        session["thread"] = threading.Thread(target=run, daemon=True)
        session["thread"].start()
        return 202, {"import_id": key}

    def import_progress(self, key: str) -> Response:
        session = self.sessions.get(key)
        hidden = ("thread", "began", "ended", "cancelled")
        return (200, {k: v for k, v in session.items() if k not in hidden}) if session else _error(404, "import not found")

    def import_events(self, key: str, poll: float = 0.25, longest: float = 1800.0) -> Response:
        """(event, data) pairs of an import: progress every `poll` seconds, then complete or error."""
        session = self.sessions.get(key)
        if not session:
            return _error(404, "import not found")

        def events() -> Iterator[tuple[str, dict]]:
            end = time.monotonic() + longest
            while True:
                ended = "ended" in session
                done = {k: session.get(k, 0) for k in ("attempted", "committed", "skipped", "errors")}
                seconds = session.get("ended", time.monotonic()) - session["began"]
                yield "progress", {"games_processed": done["attempted"], "games_committed": done["committed"], "games_skipped": done["skipped"], "elapsed_seconds": round(seconds, 3), "phase": "idle" if ended else session["phase"]}
                if ended and session["phase"] == "failed":
                    yield "error", {"error": f"import failed: {session['error']}"}
                    return
                if ended:
                    yield "complete", {"total_attempted": done.pop("attempted")} | done | {"elapsed_ms": int(seconds * 1000)}
                    return
                if time.monotonic() >= end:
                    yield "error", {"error": "timed out waiting for import"}
                    return
                session["thread"].join(poll)

        return 200, events()

    def cancel_import(self, key: str) -> Response:
        """Ends the import's Spark jobs; as tables are committed at once, nothing of it stays."""
        session = self.sessions.get(key)
        if not session:
            return _error(404, "import not found")
        if "ended" not in session:
            session["cancelled"] = True
            self.bundle.spark.sparkContext.cancelJobsWithTag(f"import-{key}")
        return 200, {"status": "cancellation_requested"}

    # --- engines ---

    def configure_engine(self, body: Any) -> Response:
        if not isinstance(body, dict) or not all(isinstance(body.get(k, ""), str) for k in ("name", "path")):
            return _error(400, "invalid request body")
        if not body.get("name") or not body.get("path"):
            return _error(400, "name and path are required")
        self.engines.configure(body["name"], body["path"])
        return 200, {"status": "ok"}

    def list_engines(self) -> Response:
        return 200, {"engines": [{"name": n, "path": p} for n, p in self.engines.engines.items()]}

    def start_analysis(self, body: Any) -> Response:
        """Checks in the order of the fields' meaning: the board, then one of depth and time, lines, and their ranges."""
        if not isinstance(body, dict) or not isinstance(body.get("fen", ""), str):
            return _error(400, "invalid request body")
        numbers = {k: body.get(k) for k in ("depth", "movetime_ms", "multipv")}
        if any(v is not None and type(v) is not int for v in numbers.values()):
            return _error(400, "invalid request body")
        if not body.get("fen"):
            return _error(400, "missing fen")
        try:
            Board(body["fen"])
        except InvalidFen:
            return _error(400, "invalid fen")
        if (numbers["depth"] is None) == (numbers["movetime_ms"] is None):
            return _error(400, "provide exactly one of depth or movetime_ms")
        for k, low, high in (("multipv", 1, 5), ("depth", 1, 100), ("movetime_ms", 1, 300_000)):
            if numbers[k] is not None and not low <= numbers[k] <= high:
                return _error(400, f"{k} must be between {low} and {high}")
        try:
            key = self.engines.start(body["fen"], Limits(numbers["depth"], numbers["movetime_ms"], numbers["multipv"] or 1), body.get("engine") or None)
        except NotFound:
            return _error(503, "no engine configured")
        except (OSError, RuntimeError):
            return _error(503, "engine failed to start")
        return 202, {"analysis_id": key}

    def analysis_events(self, key: str) -> Response:
        """(event, data) pairs: info, then complete or error."""
        try:
            return 200, self.engines.events(key)
        except NotFound:
            return _error(404, "analysis not found")

    def stop_analysis(self, key: str) -> Response:
        try:
            self.engines.stop(key)
        except NotFound:
            return _error(404, "analysis not found")
        except Ended:
            return _error(409, "analysis already terminal")
        return 204, None
