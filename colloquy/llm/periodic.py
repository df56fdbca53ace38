"""Periodic run detection by longest previous factors.

The words of a slice of documents are numbered, exactly and without ids that
two documents share, so that one set of arrays serves them all.  Prefix
doubling gives the suffix array; its rank tables compare any two blocks of
2**k words, and so give common extensions, and the LCP of neighbours.  Where
two suffixes share enough for a run, the suffix array and LCP give the longest
previous factor of every position, hence the blocks of the Lempel-Ziv
factorisation.  Runs that touch a block's boundary are found there, by
extending both ways from the boundary for each period that the two blocks
allow (Main); runs inside a block are copied from its earlier occurrence, out
of buckets by start.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .wordids import numbered, word_lists

Run = tuple[int, int, int]  #: start, end (exclusive), period
PAIRS = 1 << 20  #: of boundary and period that are extended at a time
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class Factors:
    """Suffix array, LCP and common extensions of the words of several documents."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray):
        n = len(ids)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        counts = np.bincount(ids, minlength=1)
        rank = (np.cumsum(counts) - counts)[ids]
        active, size = np.flatnonzero(counts[ids] > 1), 1
        #: tables[k][i] == tables[k][j] where the 2**k words from i and j on are equal; the last entry is of no position.
        self.tables = [np.append(rank, -1).astype(np.int32)]
        while len(active):
            after = active + size
            own = rank[active]
            key = own * (n + 1) + np.where(after < ends[active], rank[np.minimum(after, n - 1)] + 1, 0)
            order = np.argsort(key)
            key, own, active = key[order], own[order], active[order]
            fresh = np.append(True, key[1:] != key[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
            group = np.maximum.accumulate(np.where(np.append(True, own[1:] != own[:-1]), np.arange(len(key)), 0))
            rank = rank.copy()
            rank[active] = own + first - group
            single = fresh & np.append(fresh[1:], True)
            active, size = np.sort(active[~single]), 2 * size
            self.tables.append(np.append(rank, -1).astype(np.int32))
        self.rank, self.order = rank, np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        self.lcp = np.zeros(n, np.int64)  #: of each suffix and the one before it
        near = np.flatnonzero(self.tables[0][self.order[1:]] == self.tables[0][self.order[:-1]]) + 1
        self.lcp[near] = self.forward(self.order[near - 1], self.order[near])

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words from two places of one document on; the document's end stops them, as others share no ids."""
        length = np.zeros(len(x), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            t = self.tables[k]
            length += (t[x + length] == t[y + length]).astype(np.int64) << k
        return length

    def backward(self, x: np.ndarray, y: np.ndarray, begin: int) -> np.ndarray:
        """Equal words before x and before y, where x < y, not beyond `begin`."""
        length = np.zeros(len(x), np.int64)
        for k in range(len(self.tables) - 1, -1, -1):
            t, at = self.tables[k], x - length - (1 << k)
            inside = at >= begin
            length += (inside & (t[np.where(inside, at, 0)] == t[np.where(inside, y - length - (1 << k), 0)])).astype(np.int64) << k
        return length


def previous_factors(order: list[int], lcp: list[int], n: int) -> tuple[list[int], list[int]]:
    """(longest previous factor, a place of it) of each position, from a suffix array and the LCP of neighbours.

    Positions leave the suffix order from the last on, so that a position's
    neighbours are those before it in the text.
    """
    lcp = [*lcp, 0]
    lcp[0] = 0
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    longest, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = rank[i]
        low, high, left = before[r], after[r], lcp[r]
        right = lcp[high]
        if left >= right:
            if left:
                longest[i], source[i] = left, order[low]
            lcp[high] = right
        else:
            longest[i], source[i] = right, order[high]
            lcp[high] = left
        if low >= 0:
            after[low] = high
        if high < n:
            before[high] = low
    return longest, source


def _boundary_runs(factors: Factors, begin: int, blocks: np.ndarray, n: int, least: int) -> Iterator[np.ndarray]:
    """(3, runs) start, end and period of stretches that touch a boundary, in parts; those of multiple periods too."""
    sizes = np.diff(np.append(blocks, n))
    left = np.minimum(np.append(sizes, 0)[1:] + sizes, np.append(blocks, n)[1:])  # periods left of the next boundary
    edges = np.concatenate([blocks, np.append(blocks, n)[1:]])
    most = np.concatenate([np.minimum(sizes, n - blocks), left])
    backwards = np.concatenate([np.zeros(len(blocks), np.int64), np.ones(len(blocks), np.int64)])
    bigrams = factors.tables[1]
    ends = np.cumsum(most)
    for low in range(0, int(ends[-1]), PAIRS):
        pair = np.arange(low, min(low + PAIRS, int(ends[-1])))
        at = np.searchsorted(ends, pair, "right")
        period = pair - (ends[at] - most[at]) + 1
        x = begin + edges[at] - period * backwards[at]
        # of the `least` words half or more are equal to others a period away, on one side of the boundary
        ahead, behind = bigrams[x] == bigrams[x + period], (x - 2 >= begin)
        behind &= bigrams[np.maximum(x - 2, 0)] == bigrams[np.maximum(x - 2, 0) + period]
        some = ahead | behind
        x, period = x[some], period[some]
        before, length = factors.backward(x, x + period, begin), factors.forward(x, x + period)
        good = before + length >= np.maximum(period, least - period)
        yield np.stack([x - before - begin, x + period + length - begin, period])[:, good]


def document_runs(factors: Factors, begin: int, end: int, least: int) -> list[Run]:
    """All runs of `least` words or more of the document at begin:end, by start, then period."""
    n = end - begin
    order, lcp = factors.order[begin:end], factors.lcp[begin:end]
    if n < least or int(lcp[1:].max(initial=0)) * 2 < least:
        return []  # a run repeats half of its words or more
    longest, source = previous_factors((order - begin).tolist(), lcp.tolist(), n)
    blocks, at = [], 0
    while at < n:
        blocks.append(at)
        at += max(1, longest[at])
    found = np.concatenate(list(_boundary_runs(factors, begin, np.array(blocks, np.int64), n, least)), 1)
    found = found[:, np.lexsort(found[::-1])]
    fresh = np.append(True, (found[0, 1:] != found[0, :-1]) | (found[1, 1:] != found[1, :-1])) if found.shape[1] else np.zeros(0, bool)
    runs = list(map(tuple, found[:, fresh].T.tolist()))
    for block in blocks:
        size, back = longest[block], block - source[block]
        if size < least + 2:
            continue
        k = bisect_right(runs, (block - back, n + 1, 0))
        while k < len(runs) and runs[k][0] < block - back + size:
            start, stop, period = runs[k]
            if stop < block - back + size:
                insort(runs, (start + back, stop + back, period))
            k += 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of(words: list[list[bytes]], least: int = 12) -> list[list[Run]]:
    """The runs of each document: maximal stretches of `least` words or more that repeat their smallest period twice or more."""
    if least < 5:
        raise ValueError("runs are found from 5 words on")
    ids, offsets = numbered(words)
    if not len(ids):
        return [[] for _ in words]
    factors = Factors(ids, offsets)
    return [document_runs(factors, int(a), int(b), least) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _without(words: list[bytes], runs: list[Run]) -> list[bytes]:
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    spans = np.array(runs)
    np.add.at(gone, spans[:, 0] + spans[:, 2], 1)
    np.add.at(gone, spans[:, 1], -1)
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def collapse_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """docs with their texts collapsed, and `runs`: an array of (start, length, period), by start, then period.

    A run is a stretch of `least` words or more (5 at least), and of two periods
    or more, that repeats its smallest period and that no word beside it
    extends.  Of each run the words after its first period go, also where it
    overlaps others; the words left are joined by one blank.  Words are runs of
    bytes outside `[\\x20\\x09-\\x0D]`, numbered from 0.  A null text stays null,
    with no runs, as do texts without words, which become empty.  Every row
    stands for itself, so ids may repeat or be null; an empty table gives an
    empty one.  An input column named runs is replaced.  A text is held whole:
    its tables take four bytes a word for each doubling of its longest repeat.
    """
    docs = docs.drop("runs").withColumn(text_col, F.col(text_col).cast("string"))
    names, at = docs.columns, docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("runs", RUNS)])
    arrow = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = batch.column(at).is_valid().to_pylist()
            for first, words in word_lists(batch.column(at)):
                found = runs_of(words, least)
                texts = [b" ".join(_without(w, r)) if valid[first + k] else None for k, (w, r) in enumerate(zip(words, found, strict=True))]
                columns = batch.slice(first, len(words)).columns
                columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
                rows = [[{"start": a, "length": b - a, "period": p} for a, b, p in r] for r in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, arrow)], [*names, "runs"])

    return docs.mapInArrow(collapsed, schema)
