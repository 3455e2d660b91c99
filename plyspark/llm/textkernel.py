"""Vectorised word, shingle and window hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; these bytes never occur inside a
UTF-8 character, so byte scanning is exact.  Null texts count as empty.  Hashes are 64-bit
polynomials over a random byte table, finalised with a bijective mixer; `seed` selects an
independent family.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEP = np.zeros(256, bool)
SEP[[32, *range(9, 14)]] = True
#: Texts are hashed in slices of about this many bytes (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Family:
    """One hash family: byte table, multiplier and its powers."""

    def __init__(self, seed: int, lower: bool):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 3

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """base^i and base^-i for i up to n; kept, as slices are of one size."""
        return _powers(self.base, n) if n > SLICE_BYTES else _kept_powers(self.base)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Polynomial hash of values[start:end] for each pair, independent of where it stands."""
        run = np.zeros(len(values) + 1, U)
        run[1:] = values
        return self._spans(run, starts, ends)

    def byte_spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same over the byte table's values of data."""
        run = np.zeros(len(data) + 1, U)
        np.take(self.table, data, out=run[1:])
        return self._spans(run, starts, ends)

    def _spans(self, run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        power, inverse = self.powers(len(run) - 1)
        with np.errstate(over="ignore"):
            run[1:] *= power[: len(run) - 1]
            np.cumsum(run, out=run)
            return mix((run[ends] - run[starts]) * inverse[starts] + (ends - starts).astype(U))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[U(1)], np.full(n, x % (1 << 64), U)]), dtype=U) for x in (base, _inverse(base)))


@lru_cache(maxsize=2)
def _kept_powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """16 MB each; of few bases, as a worker goes from one operator to the next."""
    return _powers(base, SLICE_BYTES)


_families: dict[tuple[int, bool], Family] = {}


def family(seed: int = 7, lower: bool = False) -> Family:
    return _families.setdefault((seed, lower), Family(seed, lower))


@dataclass
class Words:
    """Words of a slice of texts: byte spans in `data`, and the first word of each text in `first`."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # length n + 1
    bounds: np.ndarray | None = None  # bytes at which texts begin and end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 7, lower: bool = False) -> np.ndarray:
        return family(seed, lower).byte_spans(self.data, self.starts, self.ends)

    def windows(self, k: int, hashes: np.ndarray, seed: int = 7, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words with the text index of each; short: a text of 1 to k - 1 words gives one."""
        n = self.counts
        number = np.maximum(n - k + 1, (n > 0).astype(n.dtype) if short else 0)
        text = np.repeat(np.arange(len(n)), number)
        at = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number) + self.first[text]
        return family(seed).spans(hashes, at, np.minimum(at + k, self.first[text + 1])), text


    def distinct_words(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words of the slice, and for each word the place of its like among them."""
        _, where, inverse = np.unique(self.hashes(), return_index=True, return_inverse=True)
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[where].tolist(), self.ends[where].tolist(), strict=True)], inverse


def text_column(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def slices(column: pa.Array, limit: int = SLICE_BYTES, separators: np.ndarray = SEP) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, Words) for row ranges of bounded bytes."""
    column = text_column(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        high = min(high, n)
        yield low, high, split(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], separators)
        low = high


def split(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SEP) -> Words:
    word = ~separators[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word
    before[offsets] = False  # a text begins here
    starts = np.flatnonzero(word & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = word
    after[offsets] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


def distinct(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, ascending, and the offsets of the n texts."""
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[keep], text[keep]
    return values, np.searchsorted(text, np.arange(n + 1))
