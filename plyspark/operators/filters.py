"""Game filters: a condition for each parameter that is set."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 100, 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class GameFilter:
    """player_color: either, white or black.  Position, offset and limit are no metadata."""

    player_name: str | None = None
    player_color: str = "either"
    min_elo: int | None = None
    max_elo: int | None = None
    result: str | None = None
    eco_prefix: str | None = None
    position: int | None = None
    offset: int = 0
    limit: int = DEFAULT_LIMIT

    @property
    def has_metadata(self) -> bool:
        return any(v is not None for v in (self.player_name, self.min_elo, self.max_elo, self.result, self.eco_prefix))


def _folded(c: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(c, _UPPER, _LOWER)


def _holds(name: Column, part: str) -> Column:
    return _folded(name).contains(_folded(F.lit(part)))


def conditions(f: GameFilter) -> list[Column]:
    """Conditions on columns white, black, white_elo, black_elo, result, eco."""
    out = []
    if f.player_name is not None:
        sides = {"white": ["white"], "black": ["black"], "either": ["white", "black"]}[f.player_color]
        out.append(reduce(Column.__or__, [_holds(F.col(s), f.player_name) for s in sides]))
    if f.result is not None:
        out.append(F.col("result") == f.result)
    if f.eco_prefix is not None:  # % and _ in the prefix are wildcards, case of A-Z is none
        out.append(_folded(F.col("eco")).like(f.eco_prefix.translate(str.maketrans(_UPPER, _LOWER)).replace("\\", "\\\\") + "%"))
    if f.min_elo is not None:
        out.append((F.col("white_elo") >= f.min_elo) & (F.col("black_elo") >= f.min_elo))
    if f.max_elo is not None:
        out.append((F.col("white_elo") <= f.max_elo) & (F.col("black_elo") <= f.max_elo))
    return out


def filtered(games: DataFrame, f: GameFilter) -> DataFrame:
    found = conditions(f)
    return games.where(reduce(Column.__and__, found)) if found else games


def page_limit(given: int | None) -> int:
    """What a request's limit means: the default if none is given, at most MAX_LIMIT; 0 asks for no rows."""
    return DEFAULT_LIMIT if given is None else min(given, MAX_LIMIT)
