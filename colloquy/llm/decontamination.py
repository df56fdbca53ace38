"""Benchmark decontamination: pigeonhole edit matching with Myers verification.

Texts are normalised: lower-cased, every run of ASCII non-alphanumerics one
blank.  An item of m bytes may differ in e = floor(error_rate * m) bytes, and is
split into e + 1 pieces: a passage within e edits holds at least one piece
unchanged.  Tasks find exact piece hits by keys of 8 bytes, or of the whole of a
shorter piece, and verify the stretch around each with Myers' bit-parallel
distance.  Short items are looked for with the blanks around them, as whole words.  Documents are read once and
never shuffled; the items, in blocks of bounded size, travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexing import IS_MARK, slices, text_bytes
from .storage import stage

KEY = 8  #: bytes of a piece's key
FILTER_BITS = 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the lower-cased texts with each run of marks as one blank, and one blank at both ends."""
    blank = pa.scalar(" ", pa.large_string())
    low = pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "")
    data, offsets = text_bytes(pc.binary_join_element_wise(blank, low, blank, pa.scalar("", pa.large_string())))
    mark = IS_MARK[data]
    keep = ~mark
    keep[1:] |= ~mark[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    places = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=places[1:])
    return np.where(mark, np.uint8(32), data)[keep], places[offsets]


def keys_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one integer; zeros follow the end."""
    flat = np.concatenate([data, np.zeros(KEY, np.uint8)])
    return np.ndarray((len(data),), "<u8", flat, strides=(1,)).copy()


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * _FACTOR) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


@dataclass
class Pattern:
    item: int
    size: int
    errors: int
    masks: dict[int, int]

    @classmethod
    def of(cls, item: int, text: bytes, errors: int) -> Pattern:
        masks: dict[int, int] = {}
        for i, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << i
        return cls(item, len(text), errors, masks)

    def distance(self, text: bytes) -> int:
        """Least edit distance of the pattern to any part of the text (Myers, one long word)."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, score = full, 0, self.size
        best, get = score, self.masks.get
        for c in text:
            eq = get(c, 0)
            xh = (((eq & up) + up) ^ up) | eq
            ph, mh = down | (full & ~(xh | up)), up & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                best = min(best, score)
            ph, mh = (ph << 1) & full, (mh << 1) & full
            xv = eq | down
            up, down = mh | (full & ~(xv | ph)), ph & xv
        return best


class PieceIndex:
    """Pieces of a bounded block of items, looked up by their first 8 bytes or, if shorter, by all of them."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, whole_words_below: int):
        self.patterns: list[Pattern] = []
        pieces = []
        for item, text in items:
            data, _ = normalised(pa.array([text], pa.string()))
            body = data.tobytes().strip()
            if not body:
                continue
            errors = int(len(body) * error_rate)
            if len(body) < whole_words_below:
                body = b" " + body + b" "
            p = Pattern.of(item, body, errors)
            cuts = [k * p.size // (errors + 1) for k in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                n = min(KEY, b - a)
                pieces.append((n, *(int.from_bytes(body[i : i + n], "little") for i in (a, b - n)), len(self.patterns), a, b - a))
            self.patterns.append(p)
        pieces.sort()
        column = lambda k, t: np.array([p[k] for p in pieces], t)
        self.key_size, self.first, self.last = column(0, np.int64), column(1, np.uint64), column(2, np.uint64)
        self.pattern, self.offset, self.length = (column(k, np.int64) for k in (3, 4, 5))
        self.groups = []  #: of one key size: (mask, pieces from, pieces to, filter)
        for n in np.unique(self.key_size).tolist():
            low, high = np.searchsorted(self.key_size, [n, n + 1]).tolist()
            some = np.zeros(1 << FILTER_BITS, bool)
            some[_slot(self.first[low:high])] = True
            self.groups.append((np.uint64((1 << 8 * n) - 1), low, high, some))

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every exact piece in the text with these keys."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for mask, low, high, some in self.groups:
            own = keys if mask == ~np.uint64(0) else keys & mask
            at = np.flatnonzero(some[_slot(own)])
            first = self.first[low:high]
            a, b = np.searchsorted(first, own[at], "left"), np.searchsorted(first, own[at], "right")
            many = b - a
            position = np.repeat(at, many)
            piece = low + np.repeat(a, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            end = position + self.length[piece] - self.key_size[piece]
            good = position + self.length[piece] <= len(keys)
            position, piece, end = position[good], piece[good], end[good]
            good = (keys[end] & mask) == self.last[piece]
            found.append((position[good], piece[good]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def passages(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, distance) of the items that a row holds within their error budgets."""
        for a, b in slices(*text_bytes(column), 1 << 21):
            part, at = normalised(column.slice(a, b - a))
            position, piece = self.hits(keys_at(part))
            if not len(position):
                continue
            row = np.searchsorted(at, position, "right") - 1
            inside = position + self.length[piece] <= at[row + 1]
            row, piece = row[inside], piece[inside]
            pattern, start = self.pattern[piece], position[inside] - self.offset[piece]
            order = np.lexsort((start, pattern, row))
            found: dict[tuple[int, int], int] = {}
            span: list[int] = []
            for r, p, s in zip(row[order].tolist(), pattern[order].tolist(), start[order].tolist(), strict=True):
                e = self.patterns[p].errors
                low, high = max(int(at[r]), s - e), min(int(at[r + 1]), s + self.patterns[p].size + e)
                if span and span[:2] == [r, p] and low <= span[3]:
                    span[3] = max(high, span[3])
                    continue
                self._verify(part, span, found)
                span = [r, p, low, high]
            self._verify(part, span, found)
            yield from ((a + r, self.patterns[p].item, d) for (r, p), d in found.items())

    def _verify(self, data: np.ndarray, span: list[int], found: dict[tuple[int, int], int]) -> None:
        if span:
            r, p, low, high = span
            d = self.patterns[p].distance(data[low:high].tobytes())
            if d <= self.patterns[p].errors:
                found[r, p] = min(d, found.get((r, p), d))


def _blocks(items: DataFrame, item_col: str, text_col: str, error_rate: float, whole_words_below: int, block_bytes: int) -> Iterator[PieceIndex]:
    """Indexes over blocks of about block_bytes of item text: what a task holds doesn't grow with the benchmark."""
    known = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        block = known.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).distinct()
        yield PieceIndex(sorted((r.item, r.text) for r in block.toLocalIterator()), error_rate, whole_words_below)


def find_passages(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = 0.08, whole_words_below: int = 25, block_bytes: int = 8 << 20,
) -> DataFrame:
    """(doc_id, item_id, distance) for every item found in a document, with its least distance in bytes.

    Items under whole_words_below bytes after normalisation are contained in
    longer words by chance and are searched for with a blank on either side.
    These blanks are bytes like others: an item of 13 bytes or more, whose
    budget is an edit, may spend it on one of them.  An index of block_bytes is
    in the driver and the tasks at a time; each block is a pass over docs.
    items with a null id or text, or without a letter or digit, are in no text.
    A null or empty document holds none; long texts are searched whole.  Rows
    that share a doc_id count as one document; of rows with an equal item id
    each text is searched for.  No items or no documents give no rows.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("distance", T.LongType())])
    out, held = docs.sparkSession.createDataFrame([], schema), None
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for index in _blocks(items, item_col, item_text_col, error_rate, whole_words_below, block_bytes):

        def search(batches: Iterator[pa.RecordBatch], index: PieceIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(index.passages(batch.column(1)))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2))], schema.names)

        if held is not None:  # of a block before: its rows are written before its index goes
            out = out.unionByName(stage(held, "passages").df)
        held = chosen.mapInArrow(search, schema)
    out = out if held is None else out.unionByName(held)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def drop_contaminated(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = 0.08, whole_words_below: int = 25, block_bytes: int = 8 << 20,
) -> DataFrame:
    """docs without the rows that hold an item, as find_passages finds them; one pass per block of items, no shuffle.

    Where there are several blocks the rows that are left are written after each.
    """
    out, written, before = docs, None, 0
    place = docs.columns.index(text_col)
    for index in _blocks(items, item_col, item_text_col, error_rate, whole_words_below, block_bytes):

        def keep(batches: Iterator[pa.RecordBatch], index: PieceIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _, _ in index.passages(batch.column(place))]] = False
                yield batch.filter(pa.array(clean))

        if before:
            last, written = written, stage(out, "uncontaminated")
            out = written.df
            if last:
                last.drop()
        out, before = out.mapInArrow(keep, docs.schema), before + 1
    return out
