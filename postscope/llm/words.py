"""Words and hashes of whole Arrow text columns, in numpy.

A chunk is a run of texts of a batch whose UTF-8 bytes lie side by side. Texts are
never cut: a chunk holds at least one whole text, and more only up to a size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Numpy holds some 50 bytes for each of these at once.
CHUNK_BYTES = 1 << 18

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(int(STEP), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Texts ``first`` to ``last`` (excluded) of a batch; bounds are relative to data."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def texts(self) -> int:
        return self.last - self.first


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The chunks of a text column; a null text is an empty one."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield Chunk(at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def word_bounds(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and where each text's words start (one more at the end)."""
    full = ~SPACES[chunk.data]
    edge = chunk.bounds[:-1][chunk.bounds[:-1] < len(full)]
    before = np.empty_like(full)
    before[1:] = full[:-1]
    before[edge] = False
    starts = np.flatnonzero(full & ~before)
    after = np.empty_like(full)
    after[:-1] = full[1:]
    ends = chunk.bounds[1:][chunk.bounds[1:] > 0] - 1
    after[ends] = False
    stops = np.flatnonzero(full & ~after) + 1
    return starts, stops, np.searchsorted(starts, chunk.bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    first = np.zeros(len(data), np.int64)
    first[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(first)
    power = powers(STEP, int(lengths.max()))
    values = BYTE_VALUES[data]
    inside = ~SPACES[data]
    values = np.where(inside, values, np.uint64(0))
    values[inside] *= power[place[inside]]
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64; a table of moderate size is kept."""
    have = _powers.get(int(base))
    if have is None or len(have) <= n:
        have = np.full(n + 1, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[int(base)] = have
    return have[: n + 1]


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` neighbouring values (none if there are fewer)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(STEP, len(values))[:-1], out=total[1:])
    return mix((total[size:] - total[:-size]) * powers(STEP_INVERSE, n)[:-1])


def windows_inside(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``size`` that stay in one text, and each start's text."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return np.arange(len(text)) - skip[text] + bounds[:-1][text], text


def sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in each stretch between bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
