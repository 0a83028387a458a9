"""Vectorised word and n-gram hashing over Arrow text columns.

All kernels work on slices of bounded size, so a worker's memory follows the slice (or the
longest single text), not the Arrow batch.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the exact word definition ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = (0x20, *range(0x09, 0x0E))


def separators(kind: str) -> np.ndarray:
    """256 flags. ``space``: ASCII white space. ``alnum``: every ASCII byte but digits and letters."""
    flags = np.zeros(256, bool)
    if kind == "space":
        flags[list(SPACE_BYTES)] = True
        return flags
    flags[:128] = True
    for first, last in ((48, 57), (65, 90), (97, 122)):
        flags[first : last + 1] = False
    return flags


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of ``column`` holding about ``limit`` bytes each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets within them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (with the total as last)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~flags[raw]
    here = inside[1:-1]
    opens, closes = here & ~inside[:-2], here & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    cuts = edges[here[edges] & here[edges - 1]]
    opens[cuts], closes[cuts - 1] = True, True
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift)."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def multipliers(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64), salt) | np.uint64(1)


#: Bytes of a word that are told apart exactly, and how many longer words a hasher remembers.
EXACT, REMEMBERED = 7, 200_000


class _LongWords(dict):
    """64-bit BLAKE2b of byte strings, kept for those of moderate length."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 256:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


class WordHasher:
    """64-bit hashes of byte ranges. Ranges of up to ``EXACT`` bytes go through a bijection, so no two of them
    collide; longer ones are hashed by BLAKE2b, for which no collisions can be constructed at will.

    ``quick`` mixes ranges of up to ``LANES`` words of eight bytes in numpy instead. Its collisions could be constructed, so
    it is for hashes whose hits are compared byte by byte (or by digest) afterwards, and for statistics.
    """

    LANES = 4

    def __init__(self, quick: bool = False):
        self.long, self.quick = _LongWords(), quick
        self.keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        first, last = int(starts[0]), int(ends[-1])
        padded = np.zeros(last - first + 8, np.uint8)
        padded[: last - first] = raw[first:last]
        lanes = np.ndarray((last - first + 1,), "<u8", padded, strides=(1,))
        at, size = starts - first, ends - starts
        short = np.minimum(size, EXACT)
        out = mix((lanes[at] & self.keep[short]) | (short.astype(np.uint64) << np.uint64(56)))
        rest = np.flatnonzero(size > EXACT)
        if self.quick:
            for k in range(self.LANES):
                done = EXACT + 8 * k
                rest = rest[size[rest] > done]
                out[rest] = mix((out[rest] ^ (lanes[at[rest] + done] & self.keep[np.minimum(size[rest] - done, 8)])) + size[rest].astype(np.uint64), 5 + k)
            rest = rest[size[rest] > EXACT + 8 * self.LANES]
        if len(rest):
            data, of = padded.tobytes(), self.long
            out[rest] = [of[data[a:b]] for a, b in zip(at[rest].tolist(), (at + size)[rest].tolist(), strict=True)]
        return out


def grams(words: np.ndarray, n: int, salt: int = 1) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, rows ignored; see ``within_rows``."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factors = multipliers(n, salt)
    size = len(words) - n + 1
    total = words[:size] * factors[0]
    for k in range(1, n):
        total += words[k : k + size] * factors[k]
    return mix(total)


def within_rows(first_word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the runs of ``n`` words that stay in one row, and the row of each."""
    counts = np.maximum(np.diff(first_word) - n + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    skip = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(len(rows)) - np.repeat(skip, counts) + np.repeat(first_word[:-1], counts), rows


def release() -> None:
    """Hand freed memory back to the system; Python workers outlive their tasks."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to hand back
        pass


def tidy(function: Callable) -> Callable:
    """A batch function that releases memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def tidy_group(function: Callable) -> Callable:
    """The same for functions of one or two group tables, after large groups only."""

    def one(table: pa.Table) -> pa.Table:
        out = function(table)
        if table.nbytes > 4 << 20:
            release()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left, right)

    return two if function.__code__.co_argcount == 2 else one
