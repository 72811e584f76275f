"""Vectorised tokenising and hashing of whole Arrow string columns.

Words and other runs are found on the UTF-8 bytes with table look-ups; a token's 64-bit hash comes from
prefix sums of a random-table polynomial modulo 2**64, so no Python object is made per token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240521)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_powers = {"n": 0}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 0 white space, 1 letters, digits and all non-ASCII bytes, 2 other ASCII
CLASS = np.full(256, 2, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
WORDS = (CLASS != 0).astype(np.uint8)
#: bytes hashed at once; a longer single text is a block of its own
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.cumprod(up), down=np.cumprod(down))
    return _powers["up"], _powers["down"]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and int64 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def blocks(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have about ``limit`` bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Tokens:
    """Tokens of some texts: ``start`` and ``end`` in ``data``, ``hash``, and ``offs`` with each text's first token."""

    __slots__ = ("data", "start", "end", "hash", "offs", "cls")

    def __init__(self, data: np.ndarray, offs: np.ndarray, classes: np.ndarray = WORDS, lower: bool = False):
        base = int(offs[0])
        data = data[base : int(offs[-1])]
        offs = offs - base
        if lower:
            data = LOWER[data]
        n = len(data)
        cls = classes[data]
        edge = np.empty(n + 1, bool)
        edge[:1] = edge[-1:] = True
        np.not_equal(cls[1:], cls[:-1], out=edge[1:n])
        edge[offs] = True
        cuts = np.flatnonzero(edge)
        start, end = cuts[:-1], cuts[1:]
        kind = cls[start] if n else np.zeros(0, np.uint8)
        keep = kind != 0
        self.data, self.start, self.end, self.cls = data, start[keep], end[keep], kind[keep]
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.offs = np.searchsorted(self.start, offs)

    def owner(self) -> np.ndarray:
        """The text that each token is in."""
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))


def windows(tokens: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``width`` tokens within one text, and the index of each run's first token."""
    m = len(tokens.hash)
    if m < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _power(m + 1)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(tokens.hash * up[:m], out=sums[1:])
    first = np.arange(m - width + 1)
    last = np.repeat(tokens.offs[1:], np.diff(tokens.offs))[: m - width + 1]
    first = first[first + width <= last]
    return mix((sums[first + width] - sums[first]) * down[first] + np.uint64(width)), first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
