"""Whole-batch text hashing in numpy.

Texts of a batch lie end to end in one byte array; words are found and hashed by
array operations, never one by one.  64-bit hashes, equal on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at a time, unless one text alone is longer.
CHUNK = 1 << 20
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(4)
def byte_values(fold: bool) -> np.ndarray:
    """A random value per byte; with ``fold`` A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=U) * U(_BASE))
    if fold:
        values[65:91] = values[97:123]
    return values


class _Powers:
    """Powers of the base and of its inverse, grown as longer chunks come."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), CHUNK + 1024)
            self.up, self.down = (np.concatenate([np.ones(1, U), np.full(size, b, U)]).cumprod(dtype=U) for b in (_BASE, _INVERSE))
        return self.up, self.down


_powers = _Powers()


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of each buf[start:end]; equal bytes have equal hashes wherever they lie."""
    up, down = _powers.get(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(byte_values(fold)[buf] * down[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * up[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that fewer texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def chunks(lengths: np.ndarray) -> Iterator[slice]:
    """Slices of rows of about CHUNK bytes together, one row at least."""
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > CHUNK:
            yield slice(first, i)
            first, held = i, 0
        held += int(n) + 1
    if first < len(lengths):
        yield slice(first, len(lengths))


def joined(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as bytes with a newline after each; where each begins (and the end)."""
    raw = [x.encode("utf-8", "surrogatepass") for x in batch]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=starts[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8), starts


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are not ASCII white space."""
    return runs(~_SPACE[buf])


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edge[::2], edge[1::2]


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n hashes in a row; fewer than n give none."""
    if len(h) < n:
        return np.empty(0, U)
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mix(out * U(_BASE) + h[k : len(h) - n + 1 + k])
    return out


def whole(h: np.ndarray) -> np.ndarray:
    """One hash of the whole sequence."""
    out = U(len(h))
    with np.errstate(over="ignore"):
        for x in h:
            out = mix(np.array([out * U(_BASE) + x]))[0]
    return np.array([out])


def strings(values: list[str | bytes]) -> np.ndarray:
    """The hash that ``span_hashes`` gives these strings."""
    raw = [v if isinstance(v, bytes) else v.encode() for v in values]
    ends = np.cumsum([len(v) for v in raw])
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(v) for v in raw], ends)
