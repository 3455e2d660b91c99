"""CRC-32C (Castagnoli) of many buffers at once, and the masked form of length-delimited record files."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_POLY = 0x82F63B78  # reflected Castagnoli polynomial
_BLOCK = 64


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLY), table >> 1).astype(np.uint32)
    return table


TABLE = _byte_table()
#: The same for two bytes at a time.
WIDE = TABLE[np.arange(1 << 16) & 255]
WIDE = TABLE[(WIDE ^ (np.arange(1 << 16, dtype=np.uint32) >> np.uint32(8))) & 255] ^ (WIDE >> np.uint32(8))


@lru_cache(maxsize=64)
def _advance(power: int) -> np.ndarray:
    """Tables that move a register over _BLOCK * 2**power zero bytes: four lookups by register byte."""
    if power < 0:
        reg = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
        for _ in range(_BLOCK):
            reg = TABLE[reg & 255] ^ (reg >> 8)
        return reg
    half = _advance(power - 1) if power else None
    return _advance(-1) if power == 0 else _apply(half, half)


def _apply(tables: np.ndarray, reg: np.ndarray) -> np.ndarray:
    return tables[0][reg & 255] ^ tables[1][(reg >> 8) & 255] ^ tables[2][(reg >> 16) & 255] ^ tables[3][reg >> 24]


def crc32c_many(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each buffer, as uint32.  Buffers are cut into blocks that advance side by side."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    if not len(parts):
        return np.zeros(0, np.uint32)
    if sizes.min() < 4:
        return np.array([_plain(p) for p in parts], np.uint32)
    blocks = -(-sizes // _BLOCK)
    ends = np.cumsum(blocks) * _BLOCK
    data = np.zeros(int(ends[-1]), np.uint8)
    at = ends - sizes  # zeros in front of a buffer leave a zero register as it is
    for p, a, e in zip(parts, at.tolist(), ends.tolist(), strict=True):
        data[a:e] = np.frombuffer(p, np.uint8)
    for i in range(4):
        data[at + i] ^= 255  # the initial register
    columns = np.ascontiguousarray(data.view("<u2").reshape(-1, _BLOCK // 2).T)
    reg = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        reg = WIDE[(reg ^ column) & 65535] ^ (reg >> 16)
    first = np.cumsum(blocks) - blocks
    behind = np.repeat(first + blocks, blocks) - 1 - np.arange(len(reg))
    for power in range(int(blocks.max() - 1).bit_length()):
        rows = np.flatnonzero((behind >> power) & 1)
        reg[rows] = _apply(_advance(power), reg[rows])
    return np.bitwise_xor.reduceat(reg, first) ^ np.uint32(0xFFFFFFFF)


def _plain(p: bytes) -> int:
    reg = 0xFFFFFFFF
    for b in p:
        reg = int(TABLE[(reg ^ b) & 255]) ^ (reg >> 8)
    return reg ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotation plus constant, so that a checksum of data holding checksums stays sound."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
