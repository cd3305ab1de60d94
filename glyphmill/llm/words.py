"""Vectorised word hashing over Arrow text buffers.

A word is a run of bytes other than ASCII white space.  Word and window hashes
are polynomial sums modulo 2**64 taken from prefix sums and then mixed, so the
cost per word doesn't depend on the window's length.
"""

from __future__ import annotations

import ctypes
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_M, _MINV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_W, _WINV = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
BLOCK = 1 << 18
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def settle() -> None:
    """Once a Python worker: freed arrays go back to the system, as many workers share an executor's memory."""
    if os.environ.get("GLYPHMILL_SETTLED") != str(os.getpid()):
        os.environ["GLYPHMILL_SETTLED"] = str(os.getpid())
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 16 << 20)  # M_TRIM_THRESHOLD
            libc.mallopt(-8, 1)  # M_ARENA_MAX
        except (OSError, AttributeError):  # another C library
            pass


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 1)
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int, inverse: int) -> np.ndarray:
    """Mixed polynomial hash of values[start:end] for each span."""
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * powers(base, len(values)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


class Words:
    """hashes, byte starts and ends of all words of a batch of texts; first[k]:first[k+1] are those of text k."""

    def __init__(self, column: pa.Array, fold: np.ndarray | None = None, separator: np.ndarray = SEPARATOR):
        settle()
        data, at = buffers(column)
        lo, hi = int(at[0]), int(at[-1])
        data, at = data[lo:hi], at - lo
        self.data, self.at = data, at
        solid = ~separator[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]]))) if len(data) else np.zeros(0, np.int64)
        ends = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) + 1 if len(data) else np.zeros(0, np.int64)
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, at)
        out = np.empty(len(starts), U)
        k = 0
        while k < len(starts):  # in blocks, which bounds the temporary arrays whatever a text's length
            stop = max(k + 1, int(np.searchsorted(ends, starts[k] + BLOCK, "right")))
            a, b = int(starts[k]), int(ends[stop - 1])
            piece = data[a:b]
            if fold is not None:
                piece = fold[piece]
            out[k:stop] = span_sums(piece, starts[k:stop] - a, ends[k:stop] - a, _M, _MINV)
            k = stop
        self.hashes = out

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text."""
        counts = np.diff(self.first)
        return np.repeat(self.first[1:], counts) - np.arange(len(self.hashes))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a whole window of n words starts, and the windows' hashes."""
        starts = np.flatnonzero(self.room() >= n)
        return starts, window_hashes(self.hashes, starts, starts + n)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of hashes[start:end] for sorted spans, block by block."""
    out = np.empty(len(starts), U)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + BLOCK, "right")))
        a, b = int(starts[k]), int(ends[stop - 1])
        out[k:stop] = span_sums(hashes[a:b], starts[k:stop] - a, ends[k:stop] - a, _W, _WINV)
        k = stop
    return out


def chunks(batch: pa.RecordBatch, column: int, most: int = 3 << 20):
    """Slices of a batch of at most so many bytes of text, whole rows each."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    k = 0
    while k < batch.num_rows:
        stop = max(k + 1, int(np.searchsorted(at, at[k] + most, "right")) - 1)
        yield batch.slice(k, stop - k)
        k = stop


def gather(blobs: list[bytes], kind) -> np.ndarray:
    settle()
    return np.concatenate([np.frombuffer(b, kind) for b in blobs]) if blobs else np.zeros(0, kind)
