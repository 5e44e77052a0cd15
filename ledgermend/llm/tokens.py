"""Array kernels on Arrow text: words, rolling hashes and window minima.

Everything here works on one slice of a batch at a time (``slices``), so memory
follows the slice size and the longest single text, not the table.
"""

from __future__ import annotations

import ctypes
from functools import wraps

import numpy as np
import pyarrow as pa

#: Arrays of eight bytes a byte of text are made of a slice, so this bounds a task's memory.
SLICE_BYTES = 1 << 19
#: The word pattern of all operators is [^\x20\x09-\x0D]+.
SPACES = (9, 10, 11, 12, 13, 32)
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
U64 = np.uint64


def give_back() -> None:
    """Freed memory to the system: a worker lives on for later tasks, beside an executor's other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A task's function over batches that gives its memory back at its end."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; computed once in a task for the longest slice."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1), base, U64)
        known[:1] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
    return known[:n]


def inverse(base: int) -> int:
    """Of an odd number modulo 2**64."""
    return pow(base, -1, 1 << 64)


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES):
    """``(rows, data, offsets)`` of consecutive rows holding about ``budget`` bytes; null is empty."""
    text = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_binary(text.type) or pa.types.is_large_binary(text.type):
        text = text.cast(pa.large_binary())
    else:
        text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null(b"" if pa.types.is_large_binary(text.type) else "")
    n = len(text)
    if not n:
        return
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = int(np.searchsorted(ends, ends[at] + budget, "right")) - 1
        stop = min(max(stop, at + 1), n)
        lo, hi = ends[at], ends[stop]
        yield slice(at, stop), data[lo:hi], ends[at : stop + 1] - lo
        at = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_spans(data: np.ndarray, offsets: np.ndarray):
    """Start and end byte of every word, and the index of each text's first word (with a closing entry)."""
    white = np.zeros(256, bool)
    white[list(SPACES)] = True
    solid = ~white[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(base, len(data)), out=total[1:])
    back = powers(inverse(base), len(data) + 1)
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(U64))


def gram_hashes(units: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """The hash of ``width`` consecutive units from each start; empty if there are fewer."""
    n = len(units) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.empty(len(units) + 1, U64)
    total[0] = 0
    np.cumsum(units * powers(base, len(units)), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(inverse(base), n))


def within(firsts: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of ``width`` units that lie inside one text; ``firsts`` has a closing entry."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    return ranges(firsts[:-1], counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each pair, one after the other."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts.astype(np.int64) - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def seed_positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each start of ``width`` consecutive hashes, the position of the least one, the leftmost on ties.

    Equal stretches of text choose the same relative position, so the chosen
    gram is a key that all copies of a window share.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = max(len(hashes).bit_length(), 1)
    low = U64((1 << bits) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=U64)
    done = 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    return (least & low).astype(np.int64)


def marked(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """True where any of the half-open spans covers."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
