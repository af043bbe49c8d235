"""Whole texts as byte buffers: words, hashes of spans and of word runs, for use inside Arrow tasks.

A task works on slices of a few megabytes of text (`slices`), never on prefixes. Hashes are 64-bit
polynomial hashes, read off one running sum per slice, so every span costs the same.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000


pa.set_memory_pool(pa.system_memory_pool())
_LIBC = ctypes.CDLL(None)
if hasattr(_LIBC, "mallopt"):                        # the GNU library only
    _LIBC.mallopt(-3, 1 << 25)                       # M_MMAP_THRESHOLD and
    _LIBC.mallopt(-1, 1 << 28)                       # M_TRIM_THRESHOLD: large arrays are used again within a task


def return_memory() -> None:
    """Give freed memory back to the system at the end of a task: a worker lives through many stages, and by
    default it keeps the most that any of them needed."""
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:                       # doubling: the next block is this one times base**done
                table[done:2 * done] = table[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _tables[name] = table
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: np.ndarray) -> np.ndarray:
    """Running sum from which `span_hash` reads the hash of any run of the values."""
    up, _ = _powers(len(values) + 1)
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts])


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return running(_BYTE[buf])


def run_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive values."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    sums = running(values)
    _, down = _powers(len(sums))
    return mix((sums[n:] - sums[:-n]) * down[:len(sums) - n] + np.uint64(n))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 row bounds; NULL is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text; a longer text comes alone and whole.

    At its end a task gives the memory of its slices back, so a worker does not carry it into later stages.
    """
    for batch in batches:
        bytes_of = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(bytes_of + 64)             # empty rows count a little, so that they are cut too
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + size, "right")))
            yield batch.slice(at, end - at)
            at = end
    return_memory()


class Words:
    """Words of a slice: byte spans in the buffer, document bounds in words, and their hashes."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, letter: np.ndarray):
        inside = letter[buf]
        n = len(buf)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[bounds[bounds < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = bounds[1:][bounds[1:] > 0]
        after[ends - 1] = False
        self.buf = buf
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        return span_hash(byte_sums(self.buf), self.starts, self.ends)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def byte_table(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


# Any byte but ASCII white space, as in [^\x20\x09-\x0D]+.
NOT_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# Digits, ASCII letters and everything beyond ASCII.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def within(counts: np.ndarray, n: int) -> np.ndarray:
    """For every position of concatenated groups: whether a run of n from here stays in its group."""
    total = int(counts.sum())
    kind = np.int32 if total < 2**31 else np.int64
    return np.repeat(np.cumsum(counts).astype(kind), counts) - np.arange(total, dtype=kind) >= n


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Positions inside any run of n that begins at one of the starts."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, total), -1)
    return np.cumsum(step[:-1]) > 0


def run_bounds(mask: np.ndarray, group_starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal true runs; runs are cut at group starts."""
    before = np.zeros(len(mask), bool)
    before[1:] = mask[:-1]
    after = np.zeros(len(mask), bool)
    after[:-1] = mask[1:]
    if group_starts is not None:
        inner = group_starts[(group_starts > 0) & (group_starts < len(mask))]
        before[inner] = False
        after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
