"""Vectorised splitting and hashing of the words of an Arrow batch.

A batch's texts are seen as one byte array with document offsets.  Words are
maximal runs of bytes outside `[\\x20\\x09-\\x0D]`; no word crosses a document.
Hashes are polynomials modulo 2**64 over random byte values, taken from prefix
sums, so that a word, or a window of words, costs a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = b" \t\n\x0b\x0c\r"
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True
#: Blanks where words are runs of letters and digits; bytes of non-ASCII characters count as letters.
IS_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

_tables: dict[int, np.ndarray] = {}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets by document); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole documents with about `target` bytes each, to keep arrays small."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + target, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def byte_values(seed: int) -> np.ndarray:
    if seed not in _tables:
        _tables[seed] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))
    return _tables[seed]


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, for n positions."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 21)
        base = (int(byte_values(seed)[255]) | 5) & (2**64 - 1)
        columns = []
        for b in (base, pow(base, -1, 2**64)):
            column = np.full(size, b, np.uint64)
            column[0] = 1
            columns.append(np.multiply.accumulate(column))
        have = _powers[seed] = tuple(columns)
    return have[0][:n], have[1][:n]


def _sums(values: np.ndarray, seed: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(seed, len(values))[0], out=out[1:])
    return out


@dataclass
class Words:
    starts: np.ndarray  #: byte position of each word
    ends: np.ndarray
    offsets: np.ndarray  #: first word of each document, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def split_words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = IS_BLANK) -> Words:
    solid = ~blank[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (cut[:n] | ~before))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (cut[1:] | ~after)) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


class SpanHashes:
    """Hashes of spans of one byte array; the prefix sums are made once."""

    def __init__(self, data: np.ndarray, seed: int = SEEDS[0]):
        self.sums = _sums(byte_values(seed)[data], seed)
        self.inverse = powers(seed, len(data) + 1)[1]

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """A hash of the bytes of each span."""
    return SpanHashes(data, seed)(starts, ends)


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int, seed: int = SEEDS[0]) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of `size` words inside a document."""
    sums = _sums(hashes, seed)
    last = np.repeat(offsets[1:], np.diff(offsets))
    first = np.flatnonzero(np.arange(len(hashes)) + size <= last)
    inverse = powers(seed, len(hashes) + 1)[1]
    return first, mixed((sums[first + size] - sums[first]) * inverse[first])


def span_hash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEEDS[0]) -> np.ndarray:
    """Hash of each run of word hashes; equal runs have equal hashes wherever they are."""
    sums = _sums(hashes, seed)
    return mixed((sums[ends] - sums[starts]) * powers(seed, len(hashes) + 1)[1][starts] + (ends - starts).astype(np.uint64))


_lowered = np.arange(256, dtype=np.uint8)
_lowered[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes unchanged."""
    return _lowered[data]
