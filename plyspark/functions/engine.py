"""Analysis of many positions by UCI engines: one engine process for each task."""

from __future__ import annotations

import re
import subprocess
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..session import importable
from .board import Board, InvalidFen, pv_to_san

ANALYSIS = "fen string, multipv int, depth int, score_type string, score int, pv array<string>, pv_san array<string>, best_move string, error string"
_INFO = re.compile(r"\bdepth (\d+)\b.*?\bscore (cp|mate) (-?\d+)\b.*?\bpv (.+)$")
_MULTI = re.compile(r"\bmultipv (\d+)\b")
#: What an info event tells beside depth, score and line.
_COUNTS = {"seldepth": re.compile(r"\bseldepth (\d+)"), "nodes": re.compile(r"\bnodes (\d+)"), "nps": re.compile(r"\bnps (\d+)"), "time_ms": re.compile(r"\btime (\d+)")}


@dataclass(frozen=True)
class Limits:
    """Depth or time in ms, one of the two; 1 to 5 lines."""

    depth: int | None = None
    movetime: int | None = None
    multipv: int = 1

    def __post_init__(self):
        if (self.depth is None) == (self.movetime is None) or min(v for v in (self.depth, self.movetime) if v is not None) <= 0:
            raise ValueError("exactly one of depth and movetime must be given")
        if not 1 <= self.multipv <= 5:
            raise ValueError("multipv must be 1 to 5")


class Engine:
    """A UCI process."""

    def __init__(self, command: list[str]):
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        self._send("uci")
        self._until("uciok")

    def _send(self, line: str) -> None:
        self.process.stdin.write(line + "\n")
        self.process.stdin.flush()

    def _until(self, word: str) -> Iterator[str]:
        lines = []
        for line in self.process.stdout:
            lines.append(line.strip())
            if lines[-1].startswith(word):
                return lines
        raise RuntimeError("the engine ended")

    def analyse(self, fen: str, limits: Limits) -> list[dict]:
        """The last line of each rank."""
        self._send(f"setoption name MultiPV value {limits.multipv}")
        self._send("isready")
        self._until("readyok")
        self._send(f"position fen {fen}")
        self._send(f"go depth {limits.depth}" if limits.depth else f"go movetime {limits.movetime}")
        lines, found = self._until("bestmove"), {}
        words = lines[-1].split()
        best = words[1] if len(words) > 1 else None
        for line in lines:
            if m := _INFO.search(line):
                rank = int(n[1]) if (n := _MULTI.search(line)) else 1
                pv = m[4].split()
                found[rank] = {"fen": fen, "multipv": rank, "depth": int(m[1]), "score_type": m[2], "score": int(m[3]), "pv": pv, "pv_san": pv_to_san(fen, pv), "best_move": best, "error": None}
        return [found[k] for k in sorted(found)]

    def follow(self, fen: str, limits: Limits, tell: Callable[[str, dict], None]) -> None:
        """Analyses and tells each line as it comes: info events, then complete."""
        self._send(f"setoption name MultiPV value {limits.multipv}")
        self._send(f"position fen {fen}")
        self._send(f"go depth {limits.depth}" if limits.depth else f"go movetime {limits.movetime}")
        for line in self.process.stdout:
            words = line.split()
            if m := _INFO.search(line):
                pv = m[4].split()
                counts = {k: int(n[1]) if (n := p.search(line)) else None for k, p in _COUNTS.items()}
                tell("info", {"depth": int(m[1]), "multipv": int(n[1]) if (n := _MULTI.search(line)) else 1, "score": {"type": m[2], "value": int(m[3])}, "pv_uci": pv, "pv_san": pv_to_san(fen, pv)} | counts)
            elif words[:1] == ["bestmove"]:
                tell("complete", {"best_move_uci": words[1] if len(words) > 1 else None, "ponder_uci": words[3] if words[2:3] == ["ponder"] and len(words) > 3 else None})
                return
        raise RuntimeError("the engine ended")

    def stop(self) -> None:
        """Asks for the best move now."""
        self._send("stop")

    def close(self) -> None:
        self.process.kill()
        self.process.wait()


def analyse(positions: DataFrame, command: list[str], limits: Limits) -> DataFrame:
    """Rows of ANALYSIS for each distinct FEN of positions(fen); an invalid FEN, or an engine that fails, gives a row with its error."""
    importable(positions.sparkSession)
    columns = [c.split()[0] for c in ANALYSIS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = None
        try:
            for batch in batches:
                rows = []
                for fen in batch["fen"]:
                    try:
                        Board(fen)
                        engine = engine or Engine(command)
                        rows += engine.analyse(fen, limits)
                    except InvalidFen:
                        rows.append({"fen": fen, "error": "invalid fen"})
                    except (OSError, RuntimeError) as e:
                        rows.append({"fen": fen, "error": f"engine failed: {e}"})
                        if engine:
                            engine.close()
                            engine = None
                out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="Int32" if c in ("multipv", "depth", "score") else object) for c in columns})
                yield out
        finally:
            if engine:
                engine.close()

    return positions.select("fen").where("fen is not null").distinct().mapInPandas(run, ANALYSIS)


class NotFound(KeyError):
    """No such engine or analysis."""


class Ended(RuntimeError):
    """The analysis has ended already."""


@dataclass
class _Analysis:
    events: list[tuple[str, dict]] = field(default_factory=list)
    changed: threading.Condition = field(default_factory=threading.Condition)
    engine: Engine | None = None
    ended: bool = False


class Sessions:
    """Engines by name, the first of which is the default, and analyses that run in threads of their own.

    Events of an analysis are kept, so whoever asks late gets them all, in order.
    """

    def __init__(self):
        self.engines: dict[str, str] = {}
        self._analyses: dict[str, _Analysis] = {}

    def configure(self, name: str, path: str) -> None:
        self.engines[name] = path

    def start(self, fen: str, limits: Limits, engine: str | None = None) -> str:
        """The key of a new analysis; NotFound if there is no such engine."""
        if not self.engines or (engine and engine not in self.engines):
            raise NotFound(engine or "no engine")
        command = [self.engines[engine] if engine else next(iter(self.engines.values()))]
        key, made = uuid.uuid4().hex, _Analysis()
        made.engine = Engine(command)
        self._analyses[key] = made

        def tell(kind: str, data: dict) -> None:
            with made.changed:
                if not made.ended:
                    made.events.append((kind, data))
                    made.ended = kind != "info"
                    made.changed.notify_all()

        def run() -> None:
            try:
                made.engine.follow(fen, limits, tell)
            except (OSError, RuntimeError, ValueError) as e:
                tell("error", {"message": f"engine failed: {e}"})
            finally:
                made.engine.close()

        threading.Thread(target=run, daemon=True).start()
        return key

    def events(self, key: str) -> Iterator[tuple[str, dict]]:
        """All events of an analysis, from its first to its last."""
        if key not in self._analyses:
            raise NotFound(key)
        found = self._analyses[key]

        def follow() -> Iterator[tuple[str, dict]]:
            at = 0
            while True:
                with found.changed:
                    found.changed.wait_for(lambda: len(found.events) > at or found.ended, timeout=0.25)
                    new, ended = found.events[at:], found.ended
                yield from new
                at += len(new)
                if ended and at == len(found.events):
                    return

        return follow()

    def stop(self, key: str) -> None:
        if key not in self._analyses:
            raise NotFound(key)
        found = self._analyses[key]
        if found.ended:
            raise Ended(key)
        try:
            found.engine.stop()
        except OSError:
            raise Ended(key) from None
