"""Words of a batch of texts as numpy arrays.

Texts stay UTF-8 bytes in one Arrow buffer; words are byte ranges, found for all texts of a
slice at once, with 64-bit hashes. Slices keep the temporary arrays small whatever the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


class Texts(NamedTuple):
    """Texts ``lo .. hi`` of a batch: bytes, and where each text begins (one more at the end)."""

    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Byte ranges of words; ``first[t]`` is the number of the first word of text ``t``."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def byte_set(*ranges: tuple[int, int], inverse: bool = False) -> np.ndarray:
    """Table of 256 flags for the given inclusive ranges of bytes."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a:b + 1] = True
    return ~table if inverse else table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z, in UTF-8
ITEM_WORD = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), inverse=True)
#: bytes of ``[^\x20\x09-\x0D]``
SPACED_WORD = byte_set((0x20, 0x20), (0x09, 0x0D), inverse=True)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of rows of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, at, raw = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        bounds = offsets[lo:hi + 1]
        yield Texts(lo, hi, data[bounds[0]:bounds[-1]], bounds - bounds[0])
        lo = hi


def find_words(texts: Texts, member: np.ndarray) -> Words:
    """Maximal runs of bytes of ``member`` that do not cross from one text to the next."""
    inside = member[texts.data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = texts.bounds[(texts.bounds > 0) & (texts.bounds < len(inside))]
    begins[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begins)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, texts.bounds))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = 1 << int(n + 1).bit_length()
        for name, base in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Gives 64-bit hashes of byte ranges: polynomials of the bytes, from running sums."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts])


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hasher(data)(starts, ends)


def hash_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (also across texts)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = mix(out + hashes[j:j + n]) if size <= 2 else (
            out * BASE + hashes[j:j + n])
    return mix(out)


def window_starts(words: Words, size: int) -> np.ndarray:
    """Flags for word numbers at which a window of ``size`` words of one text begins."""
    total = int(words.first[-1])
    room = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(total)
    return room >= size


def spread(begins: np.ndarray, lengths: np.ndarray | int, total: int) -> np.ndarray:
    """Flags of ``total`` places that lie in any of the given runs."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, begins, 1)
    np.add.at(steps, begins + lengths, -1)
    return np.cumsum(steps[:total]) > 0
