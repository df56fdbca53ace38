"""Words of a document as integers, equal exactly where the words are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .lexing import slices, text_bytes


def word_lists(column: pa.Array, target: int = 1 << 20) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, words of each row) by runs of rows; bytes.split cuts at [\\x20\\x09-\\x0D], as the contract's words do."""
    data, offsets = text_bytes(column)
    for a, b in slices(data, offsets, target):
        yield a, [data[offsets[k] : offsets[k + 1]].tobytes().split() for k in range(a, b)]


def numbered(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(id of each word, first word of each document and the end); documents have no ids in common, later ones larger ids."""
    ids, base = [], 0
    for own in words:
        known = {w: k for k, w in enumerate(dict.fromkeys(own), base)}
        ids.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        base += len(known)
    return np.concatenate(ids) if ids else np.zeros(0, np.int64), np.cumsum([0, *map(len, words)])


def named_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of each pair, pairs of each name): equal pairs, equal names, without hashing."""
    _, names, counts = np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True, return_counts=True)
    return names, counts
