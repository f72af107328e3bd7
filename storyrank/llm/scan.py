"""Words, lines and their hashes of a batch of texts, as numpy arrays over its UTF-8 bytes.

Texts are taken in pieces of about ``PIECE`` bytes (a longer text is a piece of its own),
so temporaries stay small beside the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)  # fixed values: finaliser of MurmurHash3
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark) -> None:
    """Texts go to Python a few MB at a time, so that a batch, its copies and the JVM's buffers
    stay small beside an executor's heap. Values that the session has set itself stay."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)


def give_back() -> None:
    """Memory that numpy has let go of goes back to the system, as a worker that waits for its
    next task would keep it beside the executor's heap."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


@dataclass(frozen=True)
class Piece:
    """Consecutive texts: ``data`` holds their bytes with one line feed after each."""

    first: int  # row of the batch
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[Piece]:
    """The column's texts in order; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1] or bytes(8), dtype=wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    raw = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        part = offsets[row:stop + 1]
        n = stop - row
        lengths = np.diff(part)
        starts = part[:-1] - part[0] + np.arange(n)
        data = np.full(int(part[-1] - part[0]) + n, 0x0A, dtype=np.uint8)
        inside = np.ones(len(data), dtype=bool)
        inside[starts + lengths] = False
        data[inside] = raw[part[0]:part[-1]]
        yield Piece(row, data, starts, starts + lengths)
        row = stop


def spans(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes outside ``separator`` (a mask of bytes)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], separator[data], [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.empty(n, dtype=np.uint64)
    down = np.empty(n, dtype=np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    for out, base in ((up, _BASE), (down, inverse)):
        out[0] = 1
        done, step = 1, base
        while done < n:
            more = min(done, n - done)
            out[done:done + more] = out[:more] * np.uint64(step)
            step = step * step % (1 << 64)
            done += more
    return up, down


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(_MIX[0])
    h ^= h >> np.uint64(33)
    h *= np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(33))


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of ``values`` (unsigned 64 bits): a polynomial, then mixed."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(1 << max(12, int(len(values)).bit_length()))
    total = np.empty(len(values) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((values + np.uint64(1)) * up[:len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return sequence_hashes(data.astype(np.uint64), starts, ends)


def per_row(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
