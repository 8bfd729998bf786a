"""Hashes of words and of runs of words, for many texts in one numpy step.

A run's hash is a polynomial of its symbols modulo 2^64 with an odd base, taken from
prefix sums, so all runs of a length cost one subtraction and one product each; a
final mix spreads it. Symbols are random 64-bit values of bytes, or mixed hashes of words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
BLANKS = (0x20, *range(0x09, 0x0E))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


class Sums:
    """Prefix sums of a sequence of symbols."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]) -> None:
        up, self.down = powers(base, len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def byte_symbols(lower: bool) -> np.ndarray:
    table = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_SYMBOLS = {lower: byte_symbols(lower) for lower in (False, True)}
IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANKS)] = False


#: Longer words are not kept from one step to the next: in scripts without blanks a word may be a whole paragraph.
LONGEST = 64


def forget_long(kept: dict, words: list) -> None:
    """Removes words that were kept for one step alone, so that a table is bounded in bytes by its number of words."""
    for w in words:
        if len(w) > LONGEST:
            del kept[w]


@dataclass
class Words:
    """Words of a column of texts: hash of each, and the first word of each text (one more at the end)."""

    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def starts(self, k: int) -> np.ndarray:
        """All word numbers at which a run of k words of one text starts."""
        n = np.maximum(self.counts() - k + 1, 0)
        return np.repeat(self.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of texts on end, a null's empty, and the first byte of each text (one more at the end)."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds(inside: np.ndarray, offsets: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each run of bytes ``inside``; none goes on over a text's end or a place in ``more``."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if more is not None:
        edge[more] = True
    edge[[0, -1]] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    runs = inside[at[:-1]]
    return at[:-1][runs], at[1:][runs]


def different(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different words among runs that hold all bytes ``inside``, and the number of each run's word."""
    places = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=places[1:])
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(data[inside])]).dictionary_encode()
    return runs.dictionary.to_pylist(), runs.indices.to_numpy()


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words are runs of bytes other than ASCII blanks; with ``lower``, A-Z count as a-z. A null has none."""
    data, offsets = bytes_of(column)
    starts, ends = bounds(IS_WORD[data], offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64))
    return Words(Sums(_SYMBOLS[lower][data]).runs(starts, ends), np.searchsorted(starts, offsets))
