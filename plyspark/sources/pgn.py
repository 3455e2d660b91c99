"""PGN text: splitting files into games, parsing, export.

A game begins at a line that starts with [Event " outside a brace comment; braces do not nest.  So the
only state that crosses a cut in a file is whether the last brace before it opened a comment, and large
files are split into byte ranges: one parallel pass finds the last brace of each range, the driver carries
the state over the ranges (a row each), and a second pass cuts out the games that begin in each range.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.board import Board, InvalidMove, replay, signed
from ..session import importable

EVENT = b'[Event "'
RANGE_BYTES = 16 << 20
TEXTS = "file string, byte_offset long, text string"
MAX_PLIES = 65535
_TAG = re.compile(r'^\s*\[\s*(\w+)\s+"((?:[^"\\]|\\.)*)"\s*\]\s*$')
_TOKEN = re.compile(r"\{[^}]*\}?|;[^\n]*|\(|\)|\$\d+|\d+\.(?:\.\.)?|\.\.\.|1-0|0-1|1/2-1/2|\*|[^\s{}();]+")
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def in_comment(data: bytes, inside: bool) -> bool:
    """The comment state behind data, from the state before it: the last brace tells."""
    at = max(data.rfind(b"{"), data.rfind(b"}"))
    return inside if at < 0 else data[at : at + 1] == b"{"


def game_starts(data: bytes, inside: bool) -> list[int]:
    """Offsets in data, which begins at a line's start, of lines that begin a game."""
    out, at, done = [], 0, 0
    while (at := data.find(EVENT, at)) >= 0:
        if at == 0 or data[at - 1 : at] == b"\n":
            inside = in_comment(data[done:at], inside)
            done = at
            if not inside:
                out.append(at)
        at += 1
    return out


def split_games(data: bytes) -> list[tuple[int, bytes]]:
    """(offset, text) of each game of a whole file; what stands before the first is skipped."""
    starts = game_starts(data, False)
    return [(a, data[a:b]) for a, b in zip(starts, [*starts[1:], len(data)])]


def parse_game(text: str) -> tuple[list[tuple[str, str]], list[str], str]:
    """Tags in order, SAN moves of the main line, result.  Comments, variations, glyphs and numbers are left out;
    ValueError where a tag does not end."""
    tags, lines = [], text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i].strip()
        if line.startswith("["):
            m = _TAG.match(lines[i])
            if not m:
                raise ValueError("tag does not end")
            tags.append((m[1], re.sub(r"\\(.)", r"\1", m[2])))
        elif line and not line.startswith("%"):
            break
        i += 1
    moves, depth, result = [], 0, ""
    for token in _TOKEN.findall("\n".join(lines[i:])):
        if token == "(":
            depth += 1
        elif token == ")":
            depth = max(0, depth - 1)
        elif depth or token[0] in "{;$" or re.fullmatch(r"\d+\.(?:\.\.)?|\.\.\.", token):
            continue
        elif token in RESULTS:
            result = token
            break
        elif not re.fullmatch(r"[!?]+", token):
            moves.append(token)
    tagged = next((v for k, v in tags if k == "Result"), "")
    return tags, moves, result or (tagged if tagged in RESULTS else "*")


def _ranges(files: Iterable[str], size: int) -> list[tuple[str, int, int]]:
    out = []
    for path in files:
        fs, inner = open_path(path)
        infos = [fs.get_file_info(inner)]
        if infos[0].type == pafs.FileType.Directory:
            infos = [i for i in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if i.is_file and i.path.lower().endswith(".pgn")]
        elif infos[0].type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        base = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        out += [(base + i.path, a, min(a + size, i.size)) for i in sorted(infos, key=lambda i: i.path) for a in range(0, i.size, size)]
    return out


def _last_brace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            fs, inner = open_path(path)
            with fs.open_input_file(inner) as f:
                data = f.read_at(b - a, a)
            at = max(data.rfind(b"{"), data.rfind(b"}"))
            found.append(None if at < 0 else data[at : at + 1] == b"{")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.bool_())], names=["file", "a", "b", "open"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, a, b, inside in zip(*(c.to_pylist() for c in batch.columns)):
            fs, inner = open_path(path)
            with fs.open_input_file(inner) as f:
                size, end, step = f.size(), b, 1 << 16
                before = f.read_at(1, a - 1) if a else b"\n"
                data = f.read_at(b - a, a)
                while True:  # until the first game of a later range begins, or the file ends
                    shift = 0 if before == b"\n" else data.find(b"\n") + 1 or len(data)
                    starts = [s + shift for s in game_starts(data[shift:], in_comment(data[:shift], inside))]
                    if end >= size or any(s >= b - a for s in starts):
                        break
                    more = f.read_at(min(step, size - end), end)
                    data, end, step = data + more, end + len(more), step * 2
            ends = [*starts[1:], len(data)]
            pairs = [(s, e) for s, e in zip(starts, ends) if s < b - a]
            starts = [s for s, _ in pairs]
            texts = [data[s:e].decode("utf-8", "replace") for s, e in pairs]
            for low in range(0, len(texts), 1000):
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts[low : low + 1000])), pa.array([a + s for s in starts[low : low + 1000]], pa.int64()), pa.array(texts[low : low + 1000])], names=["file", "byte_offset", "text"])


def read_pgn(spark: SparkSession, files: str | list[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, byte_offset, text of each game of the files (or folders of .pgn files)."""
    importable(spark)
    ranges = _ranges([files] if isinstance(files, str) else files, range_bytes)
    if not ranges:
        return spark.createDataFrame([], TEXTS)
    rows = spark.createDataFrame(ranges, "file string, a long, b long").repartition(max(1, len(ranges)), "file", "a")
    states, inside, last = [], False, None
    for path, a, b, opened in sorted(rows.mapInArrow(_last_brace, "file string, a long, b long, open boolean").collect()):  # a row per range
        inside = False if path != last else inside
        states.append((path, a, b, inside))
        inside, last = inside if opened is None else opened, path
    dealt = spark.createDataFrame(states, "file string, a long, b long, inside boolean").repartition(len(states), "file", "a")
    return dealt.mapInArrow(_cut, TEXTS)


def count_events(lines: DataFrame) -> DataFrame:
    """A quick count of [Event " in lines of text (column value), for progress; those in comments count too."""
    return lines.agg(F.coalesce(F.sum(((F.length("value") - F.length(F.replace(F.col("value"), F.lit('[Event "'), F.lit("")))) / 8).cast("long")), F.lit(0)).alias("n"))


PARSED = (
    "file string, byte_offset long, status string, tags array<struct<name:string,value:string>>, result string, "
    "moves array<int>, hashes array<long>"
)


def parse_one(text: str) -> dict:
    """status: ok, parse_error or empty_game; moves and hashes of the replayed main line."""
    out = {"status": "parse_error", "tags": [], "result": "*", "moves": None, "hashes": None}
    try:
        tags, sans, result = parse_game(text)
    except ValueError:
        return out
    out |= {"tags": [{"name": k, "value": v} for k, v in tags], "result": result}
    if not sans:
        return out | {"status": "empty_game"}
    if len(sans) > MAX_PLIES:
        return out
    b = Board()
    moves, hashes = [], [signed(b.hash())]
    try:
        for s in sans:
            moves.append(b.apply_san(s))
            hashes.append(signed(b.hash()))
    except InvalidMove:
        return out
    return out | {"status": "ok", "moves": moves, "hashes": hashes}


def parse_games(texts: DataFrame) -> DataFrame:
    """Parses rows of TEXTS; a bad game is a row with its status and nothing else is lost."""
    importable(texts.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]
        for batch in batches:
            rows = [parse_one(t or "") for t in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), *(pa.array([r[n] for r in rows], schema.field(n).type) for n in names[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    tag = pa.struct([("name", pa.string()), ("value", pa.string())])
    schema = pa.schema([("file", pa.string()), ("byte_offset", pa.int64()), ("status", pa.string()), ("tags", pa.list_(tag)), ("result", pa.string()), ("moves", pa.list_(pa.int32())), ("hashes", pa.list_(pa.int64()))])
    return texts.select("file", "byte_offset", "text").mapInArrow(parse, PARSED)


#: Tags of an export in order; those of NAMED follow the game's columns, the rest its tag list.
NAMED = ("Event", "Site", "Date", "Round", "White", "Black", "Result", "WhiteElo", "BlackElo", "WhiteTitle", "BlackTitle", "ECO")


def to_pgn(game: dict, id_tag: str = "GameId") -> str:
    """PGN of a game with event, site, date, white, black, result, ratings, titles, eco, id, tags and moves.

    Values stand as they are, without escaping, and moves on one line.
    """
    values = {"Event": game.get("event") or "?", "Site": game.get("site") or "?", "Date": game.get("date") or "????.??.??", "Round": "?", "White": game["white"], "Black": game["black"], "Result": game["result"]}
    values |= {"WhiteElo": game.get("white_elo"), "BlackElo": game.get("black_elo"), "WhiteTitle": game.get("white_title"), "BlackTitle": game.get("black_title"), "ECO": game.get("eco")}
    lines = [f'[{k} "{values[k]}"]' for k in NAMED if values[k] is not None]
    lines.append(f'[{id_tag} "{game["id"]}"]')
    lines += [f'[{t["name"]} "{t["value"]}"]' for t in game.get("tags") or []]
    words, b = [], Board()
    for ply, m in enumerate(game.get("moves") or []):
        if ply % 2 == 0:
            words.append(f"{ply // 2 + 1}.")
        words.append(b.san(m))
        b.play(m)
    return "\n".join(lines) + "\n\n" + " ".join([*words, game["result"]]) + "\n"


def _plain(name: str, value):
    """A pandas cell as a plain value: missing numbers are NaN there, arrays numpy's."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    if name in ("moves", "tags"):
        return [int(v) if name == "moves" else v for v in value]
    return int(value) if name in ("id", "white_elo", "black_elo") else value


def pgn_column(game: Column, id_tag: str = "GameId") -> Column:
    """`to_pgn` of a struct column."""
    @F.pandas_udf(T.StringType())
    def render(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([to_pgn({k: _plain(k, v) for k, v in r.items()}, id_tag) for r in rows.to_dict("records")], dtype=object)

    return render(game)


def game_board(moves: list[int], ply: int) -> Board:
    """The board of a game at a ply, clamped to the game's length."""
    return replay(moves, min(max(ply, 0), len(moves)))
