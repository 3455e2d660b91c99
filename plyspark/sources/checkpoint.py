"""The position of an import in a file, as JSON beside its bundle: for tools that do not use the stream's own checkpoint."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import pyarrow.fs as pafs

from .pgn import open_path

NAME = "import_checkpoint.json"


@dataclass(frozen=True)
class Checkpoint:
    source_path: str
    byte_offset: int
    games_committed: int
    last_game_id: int


def write(folder: str, checkpoint: Checkpoint) -> None:
    fs, inner = open_path(folder)
    with fs.open_output_stream(f"{inner}/{NAME}.new") as f:
        f.write(json.dumps(asdict(checkpoint)).encode())
    fs.move(f"{inner}/{NAME}.new", f"{inner}/{NAME}")


def read(folder: str) -> Checkpoint | None:
    """None if there is none; ValueError if it is no checkpoint."""
    fs, inner = open_path(folder)
    if fs.get_file_info(f"{inner}/{NAME}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{inner}/{NAME}") as f:
        try:
            return Checkpoint(**json.loads(f.read()))
        except (TypeError, ValueError) as e:
            raise ValueError("not a checkpoint") from e


def delete(folder: str) -> None:
    fs, inner = open_path(folder)
    if fs.get_file_info(f"{inner}/{NAME}").type != pafs.FileType.NotFound:
        fs.delete_file(f"{inner}/{NAME}")
