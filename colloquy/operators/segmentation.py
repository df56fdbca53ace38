"""Search tokens of texts whose words have no blanks between them, by the words of a dictionary table."""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.text import search_tokens
from ..sources.shared import temporary_folder

#: Characters that are written without blanks; a run of them is cut by the dictionary.
UNSPACED = "㐀-䶿一-鿿豈-﫿"
#: Bytes of a dictionary that each task gets whole; a larger one is asked for what a block of messages may hold.
DICTIONARY_BYTES = 64 << 20
BLOCK_BYTES = 16 << 20  #: of messages that ask together
MARKS, STRETCH = 1 << 28, 1 << 16  #: bits of the table of hashes at most, and those that are marked together
CHARACTER_BITS = 21
AT_ONCE = 1 << 16  #: characters whose words are found at once
SHORTER = (2, 3)  #: lengths of the words that are emitted from inside a longer one

_tries: dict[str, Words] = {}


class Words:
    """A dictionary as a prefix trie in two sorted arrays, 16 bytes a node.

    A node but the root has one edge that leads to it: edge k leads to node
    k + 1, and edges are in order of (node, character), which is one number.
    """

    def __init__(self, words: Iterable[tuple[str, float]], total: float):
        pairs = list(words)
        self._build(pa.array([w for w, _ in pairs], pa.large_string()), np.array([c for _, c in pairs], float), total)

    @classmethod
    def of(cls, words: pa.Array, counts: np.ndarray, total: float | None = None) -> Words:
        """The same from columns, which holds no word as an object; total: of all counts, if these are a part."""
        made = cls.__new__(cls)
        made._build(words.cast(pa.large_string()), counts, counts.sum() if total is None else total)
        return made

    def _build(self, texts: pa.Array, counts: np.ndarray, total: float) -> None:
        self.unknown = -math.log(max(total, 1))  # a character that is no word counts as seen once
        sizes = pc.utf8_length(texts).to_numpy().astype(np.int64)
        at = np.cumsum(sizes) - sizes
        letters = np.concatenate([_letters(texts.slice(k, 1 << 16)) for k in range(0, len(texts), 1 << 16)] or [np.zeros(0, np.int32)])
        weights = np.fromiter(map(math.log, np.maximum(counts, 1)), float, len(counts)) + self.unknown
        node, own, levels, ends, first = np.zeros(len(sizes), np.int64), np.arange(len(sizes)), [], [], 0
        for depth in range(int(sizes.max(initial=0))):  # nodes of a level are numbered in order of their edges
            longer = sizes[own] > depth
            node, own = node[longer], own[longer]
            edges, place = np.unique((node << CHARACTER_BITS) | letters[at[own] + depth], return_inverse=True)
            node = first + 1 + place
            first += len(edges)
            weight, last = np.full(len(edges), np.nan), sizes[own] == depth + 1
            weight[place[last]] = weights[own[last]]
            levels.append(edges)
            ends.append(weight)
        self.edges, self.weights = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((levels, np.int64), (ends, float)))

    def found(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, weight) of all words in characters, by start, shorter ones first; no word goes over a -1."""
        starts, node, out = np.arange(len(letters)), np.zeros(len(letters), np.int64), []
        for depth in range(len(letters)):
            inside = starts + depth < len(letters)
            starts, node = starts[inside], node[inside]
            wanted = (node << CHARACTER_BITS) | letters[starts + depth]
            place = np.searchsorted(self.edges, wanted)
            held = place < len(self.edges)
            held[held] = self.edges[place[held]] == wanted[held]
            starts, node = starts[held], place[held] + 1
            if not len(starts):
                break
            word = ~np.isnan(self.weights[node - 1])
            out.append((starts[word], starts[word] + depth + 1, self.weights[node[word] - 1]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        start, end, weight = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(start, kind="stable")
        return start[order], end[order], weight[order]

    def _steps(self, n: int, starts: list[int], ends: list[int], weights: list[float]) -> tuple[list[tuple[int, int]], set[tuple[int, int]]]:
        """(start, end) of the words of the heaviest path, and of all words in the run; of paths that weigh the same the one whose first word is longer."""
        best, step, k = [0.0] * (n + 1), [0] * n, len(starts) - 1
        for start in range(n - 1, -1, -1):
            own, far = -math.inf, 0
            while k >= 0 and starts[k] == start:  # longer ones first
                if (weight := weights[k] + best[ends[k]]) > own:
                    own, far = weight, ends[k]
                k -= 1
            alone = self.unknown + best[start + 1]
            best[start], step[start] = (own, far) if own >= alone else (alone, start + 1)
        out, at = [], 0
        while at < n:
            out.append((at, step[at]))
            at = step[at]
        return out, set(zip(starts, ends, strict=True))

    def _walked(self, runs: list[str]) -> Iterator[tuple[list[tuple[int, int]], set[tuple[int, int]]]]:
        """`_steps` of each run; all words of about AT_ONCE characters are found at once."""
        sizes = np.array([len(r) + 1 for r in runs], np.int64)
        ends = np.cumsum(sizes)
        groups = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE)) + 1 if len(runs) else []
        for a, b in itertools.pairwise(np.unique([0, *groups, len(runs)]).tolist()):
            letters, bases = _letters(pa.array([r + "\0" for r in runs[a:b]], pa.large_string())).copy(), ends[a:b] - sizes[a:b] - (ends[a] - sizes[a])
            letters[bases + sizes[a:b] - 1] = -1
            own = self.found(letters)
            cuts = np.append(np.searchsorted(own[0], bases), len(own[0])).tolist()
            for k, base in enumerate(bases.tolist()):
                part = slice(cuts[k], cuts[k + 1])
                yield self._steps(len(runs[a + k]), (own[0][part] - base).tolist(), (own[1][part] - base).tolist(), own[2][part].tolist())

    def path(self, run: str) -> list[str]:
        """The words of the heaviest path."""
        return [run[a:b] for a, b in next(self._walked([run]))[0]]

    def tokens(self, runs: list[str]) -> Iterator[list[str]]:
        """Of each run the words of two characters or more, each after the shorter words inside it."""
        for run, (steps, held) in zip(runs, self._walked(runs), strict=True):
            out = []
            for a, b in steps:
                for size in SHORTER:
                    if b - a > size:
                        out += [run[k : k + size] for k in range(a, b - size + 1) if (k, k + size) in held]
                if b - a > 1:
                    out.append(run[a:b])
            yield out


def _letters(texts: pa.Array) -> np.ndarray:
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.int32)


def _pieces(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; runs without blanks are pieces of their own."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), f"([{UNSPACED}]+)", " $1 "), r"[^\p{L}\p{N}]+"), lambda p: p != "")


def _by_trie(messages: DataFrame, dictionary: DataFrame, text: Column, out_col: str) -> DataFrame:
    table = dictionary.toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    held, name, run = messages.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), uuid.uuid4().hex, re.compile(f"[{UNSPACED}]")

    @F.pandas_udf("array<string>")
    def cut(pieces):  # of pandas series; rows without a run are null and cost nothing
        if name not in _tries:
            known = pa.ipc.open_stream(held.value).read_all()
            _tries.clear()
            _tries[name] = Words.of(known.column("word").combine_chunks(), known.column("freq").to_numpy())
        words = _tries[name]
        found = words.tokens([p for own in pieces if own is not None for p in own if run.match(p)])
        tokens = lambda own: [t for p in own for t in (next(found) if run.match(p) else [p] if len(p) > 1 else [])]
        return pieces.map(tokens, na_action="ignore")

    found = cut(F.when(F.rlike(text, F.lit(f"[{UNSPACED}]")), _pieces(text)))
    return messages.withColumn(out_col, F.coalesce(found, search_tokens(text)))


def _hashes(sums: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """64-bit hashes of stretches of characters, wherever they stand; sums: `_sums` of all characters."""
    out = (sums[ends] - sums[starts]) * _POWERS[1][starts]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD1342543DE82EF95
_POWERS = np.ones((2, 1), np.uint64)  #: of the base, and of its inverse


def _sums(letters: np.ndarray) -> np.ndarray:
    global _POWERS
    if _POWERS.shape[1] <= len(letters):
        _POWERS = np.stack([_powers(b, len(letters) + AT_ONCE) for b in (_BASE, pow(_BASE, -1, 1 << 64))])
    out = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters.astype(np.uint64) * _POWERS[0][: len(letters)], out=out[1:])
    return out


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, freq) to (hash, word, freq)."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column(0)).to_numpy().astype(np.int64))
        hashes = _hashes(_sums(_letters(batch.column(0))), np.append(0, ends[:-1]) if len(ends) else ends, ends)
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *batch.columns], ["hash", "word", "freq"])


def _marked(bits: int):
    """The hashes of a group as bits: a row for each of the stretches of STRETCH bits."""

    def mark(group: pa.Table) -> pa.Table:
        held = np.zeros(STRETCH, bool)
        held[(group.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) % STRETCH] = True
        return pa.table({"stretch": group.column("stretch").slice(0, 1), "marks": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    return mark


def _runs(pieces: pa.Array) -> list[str]:
    run = re.compile(f"[{UNSPACED}]")
    return [p for own in pieces.to_pylist() if own is not None for p in own if run.match(p)]


def _asked(marks: Broadcast, bits: int, lengths: list[int]):
    """(block, pieces) to (block, hash): of all stretches of runs that may be words, once a batch."""

    def candidates(runs: list[str]) -> Iterator[np.ndarray]:
        held = np.frombuffer(marks.value, np.uint8)
        sizes = np.array([len(r) + 1 for r in runs], np.int64)
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE)) + 1 if len(runs) else []
        for a, b in itertools.pairwise(np.unique([0, *cuts, len(runs)]).tolist()):
            sums = _sums(_letters(pa.array([r + "\0" for r in runs[a:b]], pa.large_string())))
            left = np.repeat(ends[a:b], sizes[a:b]) - 1 - (ends[a] - sizes[a]) - np.arange(len(sums) - 1)  # characters to the end of the run
            for n in lengths:
                if n >= len(sums):
                    break
                found = _hashes(sums, slice(0, len(sums) - n), slice(n, len(sums)))
                place = found >> np.uint64(64 - bits)
                hit = held[(place >> np.uint64(3)).view(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                yield np.unique(found[hit.view(bool) & (left[: len(found)] >= n)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            firsts = np.flatnonzero(np.diff(blocks, prepend=-1))
            for a, b in itertools.pairwise([*firsts.tolist(), batch.num_rows]):
                found = list(candidates(_runs(batch.column(1).slice(a, b - a))))
                hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), blocks[a])), pa.array(hashes.view(np.int64))], ["block", "hash"])

    return ask


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a number that BLOCK_BYTES of them share, before them."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = np.cumsum(np.full(batch.num_rows, batch.nbytes / max(1, batch.num_rows)))
        yield pa.RecordBatch.from_arrays([pa.array(number + (sizes // BLOCK_BYTES).astype(np.int64)), *batch.columns], ["__block", *batch.schema.names])
        number += int(sizes[-1] // BLOCK_BYTES) + 1 if len(sizes) else 0


def _cut(total: float):
    """The rows of a block, and the dictionary's words that are in them, to the rows with their tokens."""

    def cut(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.group_by("word").aggregate([("freq", "max")])  # a block that is read in several batches asks in each
        words = Words.of(known.column("word").combine_chunks(), known.column("freq_max").to_numpy(), total)
        pieces = rows.column("__pieces").combine_chunks()
        found, run = words.tokens(_runs(pieces)), re.compile(f"[{UNSPACED}]")
        tokens = [None if own is None else [t for p in own for t in (next(found) if run.match(p) else [p] if len(p) > 1 else [])] for own in pieces.to_pylist()]
        return rows.drop_columns(["__block", "__pieces"]).append_column("__tokens", pa.array(tokens, pa.list_(pa.string())))

    return cut


def _by_block(messages: DataFrame, dictionary: DataFrame, text: Column, out_col: str) -> DataFrame:
    """A block of messages asks for the words that may be in it, by their hashes, and is cut by those that it is told: no task holds the dictionary.

    Which stretches of characters may be words is seen in a table of bits, of
    MARKS bits at most however large the dictionary; those that are none find
    nothing in the join.
    """
    spark, kept = messages.sparkSession, messages.columns
    n, total = dictionary.agg(F.count("*"), F.coalesce(F.sum("freq"), F.lit(0.0))).first()
    lengths = sorted(r.n for r in dictionary.select(F.length("word").alias("n")).distinct().collect())  # of which there are few
    bits = min(MARKS, max(2 * STRETCH, 64 * n)).bit_length() - 1
    hashed = dictionary.mapInArrow(_hashed_words, "hash long, word string, freq double")
    marks = np.zeros(1 << bits - 3, np.uint8).reshape(-1, STRETCH >> 3)
    stretches = hashed.select("hash", F.shiftrightunsigned("hash", 64 - bits + STRETCH.bit_length() - 1).alias("stretch")).groupBy("stretch")
    for r in stretches.applyInArrow(_marked(bits), "stretch long, marks binary").toLocalIterator():
        marks[r.stretch] = np.frombuffer(r.marks, np.uint8)
    at = temporary_folder(spark, "blocks")
    messages.mapInArrow(_blocks, StructType([StructField("__block", LongType()), *messages.schema.fields])).write.option("compression", "zstd").parquet(at)
    held = spark.read.schema(StructType([StructField("__block", LongType()), *messages.schema.fields])).parquet(at)
    pieces = F.when(F.rlike(text, F.lit(f"[{UNSPACED}]")), _pieces(text)).alias("__pieces")
    asked = held.select("__block", pieces).mapInArrow(_asked(spark.sparkContext.broadcast(marks.tobytes()), bits, lengths), "block long, hash long")
    told = asked.join(hashed, "hash").select("block", "word", "freq")
    rows = held.select("*", pieces).groupBy("__block").cogroup(told.groupBy("block"))
    cut = rows.applyInArrow(_cut(total), StructType([*messages.schema.fields, StructField("__tokens", ArrayType(StringType()))]))
    return cut.select(*kept, F.coalesce("__tokens", search_tokens(text)).alias(out_col))


def with_terms(messages: DataFrame, dictionary: DataFrame, *keys: str, text_col: str = "content", out_col: str = "terms") -> DataFrame:
    """messages with their search tokens, an array in text order.

    dictionary: (word, freq).  Runs of characters that are written without
    blanks become the words of the heaviest path, each after the shorter
    dictionary words inside it; all else is as in `search_tokens`.  Null words
    and counts are no words; of a repeated word the largest count holds.  A
    null text has null terms.  A dictionary of up to DICTIONARY_BYTES goes to
    every task; a larger one is joined, for which `keys` must tell messages
    apart.
    """
    known = dictionary.filter("word <> '' AND freq IS NOT NULL").groupBy(F.lower("word").alias("word")).agg(F.max("freq").cast("double").alias("freq"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0))).first()[0]
    messages, text = messages.drop(out_col), F.col(text_col)
    if size <= DICTIONARY_BYTES:
        return _by_trie(messages, known.orderBy("word"), text, out_col)
    return _by_block(messages, known, text, out_col)
