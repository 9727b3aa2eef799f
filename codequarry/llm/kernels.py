"""Numpy kernels on the UTF-8 buffers of Arrow text columns.

Tasks get whole texts as Arrow batches. ``slices`` cuts a batch so that a kernel
sees about ``SLICE_BYTES`` of text (one document at least), which bounds its
memory. Nothing here knows Spark; partitioning and shuffles are the callers'.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: White space of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser of each value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _grown(table: np.ndarray, base: np.uint64, n: int) -> np.ndarray:
    if len(table) >= n:
        return table
    steps = np.full(max(n, SLICE_BYTES), base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, mod 2^64."""
    global _powers, _inverses
    _powers, _inverses = _grown(_powers, _BASE, n), _grown(_inverses, _BASE_INVERSE, n)
    return _powers[:n], _inverses[:n]


def slices(batches: Iterable[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of batches with at most ``limit`` bytes in column ``text``, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after the other, and the row bounds; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each maximal run of bytes outside ``gap``; no run crosses a row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inner = np.zeros(len(data) + 1, bool)
    inner[:-1] = ~gap[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.empty_like(inner)
    before[0] = False
    before[1:] = inner[:-1]
    starts = np.flatnonzero(inner & (~before | first))
    ends = np.flatnonzero(before & (~inner | first))
    return np.searchsorted(bounds, starts, "right") - 1, starts, ends


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit Rabin-Karp hashes of ``codes[start:end]`` from prefix sums, mixed with the length."""
    power, inverse = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * power[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` codes, first to last start."""
    starts = np.arange(max(0, len(codes) - size + 1))
    return span_hashes(codes, starts, starts + size)


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` values, by doubling."""
    span, out = 1, values
    while span < size:
        step = min(span, size - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
