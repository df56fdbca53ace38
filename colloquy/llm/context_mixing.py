"""Language-model scoring by online logistic context mixing.

A text is coded as binary decisions, along Huffman codes of a byte after each
byte, which take less than half as many as plain bits would.  Six hashed contexts
each predict a decision from how often either way was taken there in all
training texts: the last two, three, four and five bytes, the word so far, and
the word so far after the word before.  A logistic mixer joins the predictions
in the stretched domain.  Its weights are gated: which set is used depends on
whether the two contexts of words have been seen, and how surely they speak.
While a text is coded the weights follow the gradient of its coding cost, from
its beginning to its end, and an adaptive map from predicted to observed
probabilities refines the result.  The sum of log2 p is the size of the text in
bits.

The contexts of words grow with the corpus: each has counts of its own, found by
a hash whose bits follow the size of the corpus.  Texts go in slices.  In a
slice a word, and a word after a word, is looked at once however often it comes,
and asked for once, with how often the texts to learn from have it.  Of the word
so far a slice asks by pairs of context and byte, as it does of the first byte
of a word after a word.  For the rest of that it sends the word itself, to the
shard of the word before and the first byte, where all contexts from there on
are.  A shard sums the counts of its range of hashes and tells each slice what
the contexts say of the decisions that lead to its bytes.  No task holds all
counts, and none of them pass the driver.  The contexts of a few bytes, which any corpus fills, are
counted in tables of one size that go to every task.

Texts of a slice are coded side by side, a block of decisions at a time: a block
sees the weights that the blocks before it have left.  Blocks begin small and
depend on the place in the text only, so a text's score doesn't depend on its
neighbours.
"""

from __future__ import annotations

import ctypes
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexing import IS_BLANK, SEEDS, SpanHashes, lower_ascii, mixed, slices, split_words, text_bytes
from .storage import stage

ORDERS = (2, 3, 4, 5)  #: bytes of the contexts that are counted in tables
INPUTS = len(ORDERS) + 2
TABLE_BITS = 21  #: of the slots of an order's table
TABLE_BLOCK, SALTS = 4096, 64  #: slots that are summed together, those of so many tasks first
END = 0xFF  #: a byte that no UTF-8 text has ends every text
GAP = 8
BLOCKS = ((1 << 8, 16), (1 << 12, 64), (1 << 62, 256))  #: decisions of a block, up to a place in the text
STEPS = 16.0  #: of the stretched domain, for one byte from -8 to 8
SURE = 40  #: steps from which on a context has been seen to go one way more than once
RATE, REFINE_RATE = 0.0003, 0.02
#: Weights at first, for each gate and input: no context of words seen; the word so far; the word after a word; that, and sure.
START = ((0.25, 0.35, 0.3, 0.25, 0.25, 0.25), (0.1, 0.2, 0.25, 0.25, 0.15, 0.25), (0.05, 0.1, 0.15, 0.2, 0.2, 0.6), (0.1, 0.1, 0.2, 0.25, 0.25, 0.6))
GATES = len(START)
PRIOR = 0.15  #: added to the counts of either way
CURVE = 33  #: points of the refinement
FILLED, TOGETHER = 1 << 14, 1 << 14  #: places whose inputs are gathered together, and decisions that are mixed together
END_KEY = 1  #: in the counts of tokens, the end of a text; words have other keys
SLICE_BYTES, PART_BYTES = 6 << 20, 1 << 20  #: of text that asks together, and that is coded together
SLICE_ROWS = 1 << 14  #: rows of a slice at most
SHARD_BYTES = 8 << 20  #: of text that a shard has the contexts of
SPARE_BITS = 6  #: of hash for each byte of the corpus
RANGE_KEYS = 1 << 17  #: keys that are merged together
ZSTD = pa.Codec("zstd", 3)
UNITS = "slice long, texts binary"
ASKED = "shard long, slice long, entries binary"
TOLD = "slice long, shard long, said binary"


def _huffman(counts: list[int]) -> list[list[int]]:
    """For each symbol its path from the root: twice the node, plus the bit."""
    heap = [(c + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a + b, 256 + len(children), 256 + len(children)))
        children.append((x, y))
    paths: list[list[int]] = [[] for _ in range(512)]
    for k in range(len(children) - 1, -1, -1):
        for bit, child in enumerate(children[k]):
            paths[child] = [*paths[256 + k], 2 * k + bit]
    return paths[:256]


@dataclass
class Code:
    """Huffman codes of a byte after each byte: by (byte before, byte) the length and the place of its first step."""

    lengths: np.ndarray
    first: np.ndarray
    nodes: np.ndarray  #: of each step
    bits: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray) -> Code:
        """pairs: how often a byte follows a byte, (256, 256)."""
        plain = _huffman([0] * 256)
        paths = [path for row in pairs for path in (_huffman(row.tolist()) if row.any() else plain)]
        lengths = np.array([len(p) for p in paths], np.int32)
        flat = np.array([step for path in paths for step in path], np.int64)
        return cls(lengths, (np.cumsum(lengths) - lengths).astype(np.int32), (flat >> 1).astype(np.uint8), (flat & 1).astype(np.uint8))

    def steps(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first decision of each pair of bytes, and their number; for each decision its pair's place; its step)."""
        lengths = self.lengths[pairs]
        starts = np.zeros(len(pairs) + 1, np.int64)
        np.cumsum(lengths, out=starts[1:])
        of = np.repeat(np.arange(len(pairs), dtype=np.int32), lengths)
        step = (self.first[pairs] - starts[:-1]).astype(np.int32)[of]
        step += np.arange(len(of), dtype=np.int32)
        return starts, of, step


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, places, first place of each text): every text after a gap of zeros and followed by END; places are those to predict."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts = offsets[:-1] + (GAP + 1) * np.arange(n) + GAP
    out = np.zeros(len(data) + (GAP + 1) * n, np.uint8)
    body = np.ones(len(out), bool)
    for k in range(1, GAP + 1):
        body[starts - k] = False
    places = np.flatnonzero(body)
    last = starts + sizes
    out[last] = END
    body[last] = False
    out[body] = data
    return out, places, np.concatenate([[0], np.cumsum(sizes + 1)])


def pairs_at(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The byte before each place and the byte there, as one number."""
    return data[places - 1].astype(np.int32) << 8 | data[places]


def tails(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(order, place): a hash of the last bytes before each place."""
    before = np.ndarray((len(data) - GAP + 1,), "<u8", data, strides=(1,))[places - GAP]
    out = np.empty((len(ORDERS), len(places)), np.uint32)
    for k, order in enumerate(ORDERS):
        out[k] = ((before >> np.uint64(8 * (8 - order))) * np.uint64(SEEDS[0])) >> np.uint64(32)
    return out


def slots(tail: np.ndarray, of: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of each decision in its order's table: those of one context lie side by side, as they are looked up one after another."""
    out = (tail >> np.uint32(32 - TABLE_BITS)).astype(np.int64)[of]
    out ^= node
    return out


@dataclass
class Segments:
    """Words with the blank that ends them, or the end of the text: equal ones have equal contexts at each byte, as have equal ones after equal words."""

    first: np.ndarray  #: of each segment, among the places
    sizes: np.ndarray
    starts: np.ndarray
    before: np.ndarray  #: hash of the word before; of no bytes at the beginning of a text
    spans: SpanHashes

    @classmethod
    def of(cls, data: np.ndarray, places: np.ndarray) -> Segments:
        spans = SpanHashes(data)
        opens = IS_BLANK[data] | (data == 0)
        first = np.flatnonzero(opens[places - 1])
        sizes = np.diff(np.append(first, len(places)))
        starts = places[first]
        word = spans(starts, starts + sizes - 1)
        fresh = np.diff(places, prepend=-1)[first] != 1
        before = np.where(fresh, spans(starts[:1], starts[:1]) if len(starts) else word, np.concatenate([word[:1], word[:-1]]))
        return cls(first, sizes, starts, before, spans)

    def whole(self) -> np.ndarray:
        """Hashes, with the byte before."""
        return self.spans(self.starts - 1, self.starts + self.sizes)

    def after(self, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the first bytes after the word before."""
        return _after(self.spans(self.starts, self.starts + size), self.before)

    def keys(self, unit: np.ndarray, seed: np.ndarray | None, places: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys in ascending order, the key of each place) of the bytes so far, after what `seed` says; they are made for one of equal units only."""
        encoded, model = _named(unit)
        lengths = self.sizes[model]
        ends = np.cumsum(lengths)
        at = _stretches(self.first[model], lengths)
        context = self.spans(np.repeat(self.starts[model], lengths), places[at])
        if seed is not None:
            context = _after(context, np.repeat(seed[model], lengths))
        distinct, key_of = _merged([_keyed(context, low[at], bits)])
        shift = np.repeat((ends - lengths)[encoded] - self.first, self.sizes)
        shift += np.arange(len(places))
        return distinct, key_of[shift]


def _after(context: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed(context + np.uint64(SEEDS[1]) + np.uint64(3) * before)


def _keyed(context: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    return (context >> np.uint64(64 - bits)) << np.uint64(16) | low.astype(np.uint64)


def _named(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each value, from 0 in the order in which they come; place of the first of each)."""
    encoded = pa.array(values.view(np.int64)).dictionary_encode().indices.to_numpy()
    model = np.empty(int(encoded.max(initial=-1)) + 1, np.int64)
    model[encoded[::-1]] = np.arange(len(encoded) - 1, -1, -1)
    return encoded, model


def _stretches(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... as many as lengths[0], and so on."""
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(len(out))
    return out


@dataclass
class Asked:
    """Distinct keys of the contexts of words, and for both of these the entry of each place: of texts that one process holds."""

    keys: np.ndarray  #: those of the first context in order, then those of the second
    cut: int
    entries: list[np.ndarray]

    @classmethod
    def of(cls, data: np.ndarray, places: np.ndarray, bits: int) -> Asked:
        own, low = Segments.of(data, places), pairs_at(data, places)
        word, entries = own.keys(own.whole(), None, places, low, bits)
        after, more = own.keys(_after(own.whole(), own.before), own.before, places, low, bits)
        return cls(np.concatenate([word, after]), len(word), [entries, more + np.int32(len(word))])

    def counts(self, which: np.ndarray) -> np.ndarray:
        """How often each key occurs at the places for which `which` is 1."""
        return sum(np.bincount(e[which], minlength=len(self.keys)) for e in self.entries)


def _merged(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in ascending order, the place there of each value)."""
    every = np.concatenate(runs)
    order = np.argsort(every)
    every = every[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = every[1:] != every[:-1]
    place = np.empty(len(every), np.int32)
    place[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return every[fresh], place


def _ranges(runs: list[np.ndarray], each: int) -> Iterator[list[slice]]:
    """Runs of ascending keys cut at the same contexts, into pieces of about `each` keys together: what is done by keys needs no more memory than that."""
    pieces = sum(map(len, runs)) // each + 1
    top = max((int(r[-1]) >> 16 for r in runs if len(r)), default=0) + 1
    edges = np.array([top * i // pieces << 16 for i in range(1, pieces)], np.uint64)
    cuts = [[0, *np.searchsorted(r, edges).tolist(), len(r)] for r in runs]
    for i in range(pieces):
        yield [slice(c[i], c[i + 1]) for c in cuts]


def _merged_runs(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As `_merged`, of runs that are in ascending order each."""
    firsts = np.cumsum([0, *map(len, runs)])
    place, found, known = np.empty(firsts[-1], np.int32), [], 0
    for pieces in _ranges(runs, RANGE_KEYS):
        keys, of = _merged([r[p] for r, p in zip(runs, pieces, strict=True)])
        of += np.int32(known)
        at = 0
        for first, p in zip(firsts.tolist(), pieces, strict=False):
            n = p.stop - p.start
            place[first + p.start : first + p.stop] = of[at : at + n]
            at += n
        found.append(keys)
        known += len(keys)
    return np.concatenate(found), place


@dataclass
class Part:
    """Texts a to b of a slice; keys: of the word so far, and of the first byte after the word before."""

    a: int
    b: int
    first: np.ndarray
    opens: np.ndarray  #: first place of each segment
    sizes: np.ndarray
    keys: list[np.ndarray]
    entries: list[np.ndarray]  #: of each place among the first keys, of each segment among the second

    def __post_init__(self) -> None:
        self.asked = [len(k) for k in self.keys]


@dataclass
class Slice:
    """What a slice asks.  Units: distinct segments of two bytes or more after a word, in ascending order of their group, the hash of that word and their first byte."""

    parts: list[Part]
    pairs: np.ndarray
    groups: np.ndarray
    at: np.ndarray  #: of each unit's first byte among the pairs
    sizes: np.ndarray
    unit_of: np.ndarray  #: of each segment; of those of one byte any

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, bits: int) -> Slice:
        parts, pairs, names, groups, firsts, known = [], [], [], [], [], 0
        for a, b in slices(data, offsets, PART_BYTES):
            buffer, places, first = laid_out(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            low, own = pairs_at(buffer, places), Segments.of(buffer, places)
            word, entries = own.keys(own.whole(), None, places, low, bits)
            opening, of = _merged([_keyed(own.after(0), low[own.first], bits)])
            parts.append(Part(a, b, first, own.first.astype(np.int32), own.sizes.astype(np.int32), [word, opening], [entries, of]))
            pairs.append(low.astype(np.uint16))
            names.append(own.after(own.sizes))
            groups.append(own.after(1) >> np.uint64(64 - bits))
            firsts.append(own.first + known)
            known += len(places)
        sizes, name, group, first = (np.concatenate(x) for x in ([p.sizes for p in parts], names, groups, firsts))
        del buffer, places, own, low
        longer = np.flatnonzero(sizes > 1)
        encoded, model = _named(name[longer])
        model = longer[model]
        order = np.argsort(group[model], kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        unit_of = np.zeros(len(sizes), np.int32)
        unit_of[longer] = rank[encoded]
        model = model[order]
        return cls(parts, np.concatenate(pairs), group[model], first[model], sizes[model].astype(np.int64), unit_of)

    def runs(self) -> list[np.ndarray]:
        return [run for part in self.parts for run in part.keys]

    def letters(self, a: int, b: int) -> np.ndarray:
        """Bytes of units a to b."""
        return self.pairs[_stretches(self.at[a:b], self.sizes[a:b])].astype(np.uint8)

    def entries(self, place: np.ndarray, keys: int) -> Iterator[list[np.ndarray]]:
        """For each part and both contexts the entry of each place: keys that are asked, whose places `place` has for all runs, then the further bytes of all units."""
        rests = self.sizes - 1
        base = (keys + np.cumsum(rests) - rests - 1).astype(np.int32)
        seen, segments = 0, 0
        for part in self.parts:
            word, opening = part.entries
            own = np.zeros(len(part.sizes), np.int32) if len(base) == 0 else base[self.unit_of[segments : segments + len(part.sizes)]]
            after = np.repeat(own - part.opens, part.sizes)
            after += np.arange(len(after), dtype=np.int32)
            mid = seen + part.asked[0]
            after[part.opens] = place[mid:][opening]
            yield [place[seen:][word], after]
            seen, segments = mid + part.asked[1], segments + len(part.sizes)


def _stretched(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Counts of bit 0 and bit 1 as a stretched probability in steps."""
    return np.clip(np.rint(STEPS * np.log((one + PRIOR) / (zero + PRIOR))), -127, 127).astype(np.int8)


def said(code: Code, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first value of each key, and their number; what its context says of each decision that leads to its byte).

    keys: distinct, ascending, all that are known of each context; counts: in the training texts.
    """
    starts, of, step = code.steps((keys & np.uint64(0xFFFF)).astype(np.int32))
    fresh = np.ones(len(keys) + 1, bool)  # of each context with the byte before, whose code it is
    fresh[1:-1] = (keys[1:] ^ keys[:-1]) >> np.uint64(8) != 0
    bit = code.bits[step].view(bool)
    values = _stretched(0, counts)[of]  # where a context leads to one byte only
    np.negative(values, out=values, where=~bit)
    shared = np.flatnonzero(~(fresh[:-1] & fresh[1:])[of])
    at, step = of[shared], step[shared]
    place = np.cumsum(fresh[:-1])[at] << 8 | code.nodes[step]
    packed = place.view(np.uint64) << np.uint64(32) | np.arange(len(place), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64(0xFFFFFFFF)).view(np.int64)
    firsts = np.flatnonzero(np.diff(packed >> np.uint64(32), prepend=np.uint64(0)))  # no context is 0
    taken, bit = counts[at[order]], code.bits[step[order]].view(bool)
    sums = [np.add.reduceat(np.where(bit == b, taken, 0), firsts) if len(firsts) else np.zeros(0) for b in (False, True)]
    values[shared[order]] = np.repeat(_stretched(*sums), np.diff(np.append(firsts, len(place))))
    return starts, values


def turned(code: Code, pairs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What is said for bit 1 of the decisions that lead to bytes, as what is said for the bit that they take; and back.  Nearly all of it is alike then."""
    out, at = values.copy(), 0
    for a in range(0, len(pairs), FILLED):
        step = code.steps(pairs[a : a + FILLED])[2]
        own = out[at : at + len(step)]
        np.negative(own, out=own, where=code.bits[step] == 0)
        at += len(step)
    return out


def add_to_tables(tables: np.ndarray, code: Code, data: np.ndarray, places: np.ndarray, which: np.ndarray) -> None:
    """Counts in tables (order, slot, bit) how often each way was taken at the places for which `which` is 1.

    In ascending order the bytes before a place, nearest first after its own, are
    next to each other for every order: each is looked at once, and the shorter ones
    are summed from the longer.
    """
    before = np.ndarray((len(data) - GAP + 1,), "<u8", data, strides=(1,))[(places - GAP + 1)[which]]  # with the byte itself, the highest
    before.sort()
    n = np.ones(len(before), np.uint32)
    for k, order in sorted(enumerate(ORDERS), key=lambda x: -x[1]):
        before >>= np.uint64(8 * (7 - order))
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(before)), bool), before[1:] != before[:-1]]))
        n = np.add.reduceat(n, first, dtype=np.uint32) if len(first) else n
        before = before[first]
        tail = (((before & np.uint64((1 << 8 * order) - 1)) * np.uint64(SEEDS[0])) >> np.uint64(32)).astype(np.uint32)
        byte, last = before >> np.uint64(8 * order), before >> np.uint64(8 * (order - 1)) & np.uint64(0xFF)
        _, of, step = code.steps((last << np.uint64(8) | byte).astype(np.int32))
        np.add.at(tables[k].reshape(-1), slots(tail, of, code.nodes[step]) << 1 | code.bits[step], n[of])
        before <<= np.uint64(8 * (7 - order))


class Mixer:
    """Codes texts; keeps nothing between them.  tables: for each order what its slots say."""

    def __init__(self, code: Code, tables: np.ndarray):
        self.code, self.tables = code, tables

    def log2(self, pairs: np.ndarray, first: np.ndarray, tail: np.ndarray, entries: list[np.ndarray], starts: np.ndarray, values: np.ndarray) -> np.ndarray:
        """log2 of the probability of each text, whose places begin at `first`.

        tail: the places' hashes by order; entries: for each context of words the
        key of each place; starts: first of a key's values.
        """
        decided = np.zeros(len(pairs) + 1, np.int64)
        np.cumsum(self.code.lengths[pairs], out=decided[1:])
        inputs = np.zeros((decided[-1] + BLOCKS[-1][1], 8), np.int8)  # of a decision: what each input says, its gate and its bit
        for a in range(0, len(pairs), FILLED):
            own = slice(a, min(a + FILLED, len(pairs)))
            self._fill(inputs[decided[own.start] : decided[own.stop]], pairs[own], tail[:, own], [e[own] for e in entries], starts, values)
        packed = inputs.view(np.int64)[:, 0]
        begin, size = decided[first[:-1]], np.diff(decided[first])
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        weights = np.zeros((len(size), 8, GATES), np.float32)  # for inputs in steps; gate and bit weigh nothing
        weights[:, :INPUTS] = np.array(START, np.float32).T / np.float32(STEPS)
        knots = np.linspace(-8, 8, CURVE, dtype=np.float32)
        curve = np.tile(1 / (1 + np.exp(-knots)), len(size)).astype(np.float32)
        bits_of = np.zeros(len(size))
        windows = {block: np.lib.stride_tricks.sliding_window_view(packed, block) for _, block in BLOCKS}
        at, longest = 0, int(size[0]) if len(size) else 0
        while at < longest:
            block = next(b for end, b in BLOCKS if at < end)
            n = int(np.searchsorted(-size, -at))  # texts that are longer
            for a in range(0, n, TOGETHER // block):
                own = slice(a, min(a + TOGETHER // block, n))
                told = windows[block][begin[own] + at].view(np.int8).reshape(-1, block, 8)
                left = size[own] - at
                bits_of[own] += self._block(told, None if left[-1] >= block else np.arange(block) < left[:, None], weights[own], curve[own.start * CURVE : own.stop * CURVE])
            at += block
        out = np.zeros(len(size))
        out[order] = bits_of
        return out

    @staticmethod
    def _block(told: np.ndarray, live: np.ndarray | None, weights: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """log2 of a block of decisions of each text, whose weights and curve then follow it."""
        n, block, _ = told.shape
        x = told.astype(np.float32)
        bit = x[:, :, 7]
        gate = np.arange(0, n * block * GATES, GATES).reshape(n, block)
        gate += told[:, :, 6]
        z = (x @ weights).reshape(-1)[gate]
        np.minimum(z, np.float32(7.99), out=z)
        np.maximum(z, np.float32(-7.99), out=z)
        scaled = z + np.float32(8)
        scaled *= np.float32((CURVE - 1) / 16)
        point = np.rint(scaled, out=scaled).astype(np.int64)
        point += np.arange(0, n * CURVE, CURVE)[:, None]
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        p = np.reciprocal(z, out=z)
        seen = curve[point]
        final = p + seen
        final *= np.float32(0.5)
        final += bit
        final -= 1
        np.abs(final, out=final)
        np.log2(final, out=final)
        error, move = np.subtract(bit, p, out=p), np.subtract(bit, seen, out=seen)
        if live is not None:
            for own in (final, error, move):
                own *= live
        error *= np.float32(RATE / STEPS)
        gated = np.zeros((n, block, GATES), np.float32)
        gated.reshape(-1)[gate] = error
        weights += x.transpose(0, 2, 1) @ gated
        weights[:, INPUTS:] = 0
        curve += np.float32(REFINE_RATE) * np.bincount(point.ravel(), move.ravel(), n * CURVE).astype(np.float32)
        np.clip(curve, 1e-4, 1 - 1e-4, out=curve)
        return final.sum(1, dtype=np.float64)

    def _fill(self, inputs: np.ndarray, pairs: np.ndarray, tail: np.ndarray, entries: list[np.ndarray], starts: np.ndarray, values: np.ndarray) -> None:
        lengths = self.code.lengths[pairs]
        of = np.repeat(np.arange(len(pairs)), lengths)
        own = self.code.first[pairs]
        step = (own - (np.cumsum(lengths) - lengths))[of]
        step += np.arange(len(of))
        node = self.code.nodes[step]
        for k in range(len(ORDERS)):
            inputs[:, k] = self.tables[k][slots(tail[k], of, node)]
        word, after = (values[(starts[e] - own)[of] + step] for e in entries)
        inputs[:, INPUTS - 2], inputs[:, INPUTS - 1] = word, after
        gate = (word != 0).view(np.int8)
        np.copyto(gate, np.int8(2), where=after != 0)
        np.copyto(gate, np.int8(3), where=np.abs(after) > SURE)
        inputs[:, INPUTS] = gate
        inputs[:, INPUTS + 1] = self.code.bits[step]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words, first word of each text)."""
    low = lower_ascii(data)
    words = split_words(low, offsets)
    return (SpanHashes(low)(words.starts, words.ends) & ~np.uint64(1)).view(np.int64), words.offsets


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): of tokens, kind 0, and of pairs of bytes, kind 1."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for a, b in slices(data, offsets, 1 << 21):
            part = data[offsets[a] : offsets[b]]
            keys, counts = np.unique(_tokens(part, offsets[a : b + 1] - offsets[a])[0], return_counts=True)
            buffer, places, _ = laid_out(part, offsets[a : b + 1] - offsets[a])
            letters = np.bincount(buffer[places - 1].astype(np.int64) << 8 | buffer[places], minlength=1 << 16)
            used = np.flatnonzero(letters)
            columns = np.concatenate([keys, [END_KEY], used]), np.concatenate([counts, [b - a], letters[used]])
            kinds = np.repeat(np.array([0, 1], np.int32), [len(keys) + 1, len(used)])
            yield pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(c.astype(np.int64)) for c in columns)], ["kind", "key", "n"])


def _give_back() -> None:
    """Freed memory goes back to the system; the C library would keep pieces of up to 32 MB, beside the other workers of an executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _squeezed(data: bytes) -> bytes:
    """Compressed, after its size."""
    return len(data).to_bytes(4, "little") + ZSTD.compress(data, asbytes=True)


def _spread(data: bytes) -> bytes:
    return pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd", asbytes=True)


def _packed(rel: np.ndarray, low: np.ndarray, counts: np.ndarray) -> bytes:
    """Entries in ascending order as compressed planes of bytes: gaps between contexts, both bytes, counts."""
    gaps = np.diff(rel, prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T
    many = counts.astype("<u4").view(np.uint8).reshape(-1, 4).T
    planes = np.concatenate([gaps, low.astype("<u2").view(np.uint8).reshape(-1, 2).T, many])
    return _squeezed(planes.tobytes())


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys within the shard, counts)."""
    planes = np.frombuffer(_spread(blob), np.uint8).reshape(10, -1)
    number = lambda part, kind: np.ascontiguousarray(part.T).view(kind)[:, 0]
    keys = np.cumsum(number(planes[:4], "<u4"), dtype=np.uint64) << np.uint64(16)
    keys |= number(planes[4:6], "<u2")
    return keys, number(planes[6:], "<u4")


def _packed_units(groups: np.ndarray, sizes: np.ndarray, counts: np.ndarray, letters: np.ndarray) -> bytes:
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(groups, prepend=np.uint64(0)), sizes, counts)]
    return _squeezed(b"".join([len(sizes).to_bytes(4, "little"), *planes, letters.tobytes()]))


def _unpacked_units(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(groups within the shard, sizes, counts, bytes)."""
    data = _spread(blob)
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(data, np.uint8, 12 * n, 4).reshape(3, 4, n)
    groups, sizes, counts = (np.ascontiguousarray(x.T).view("<u4")[:, 0] for x in planes)
    return np.cumsum(groups, dtype=np.uint64), sizes.astype(np.int64), counts, np.frombuffer(data, np.uint8, offset=4 + 12 * n)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of rows (doc_id, text, held_out), each as one compressed value."""
    number = TaskContext.get().partitionId() << 20
    for batch in batches:
        batch = batch.take(pc.sort_indices(pc.fill_null(pc.binary_length(batch.column(1)), 0)))  # texts of one size are coded best side by side
        cuts = [(i, min(i + SLICE_ROWS, b)) for a, b in slices(*text_bytes(batch.column(1)), SLICE_BYTES) for i in range(a, b, SLICE_ROWS)]
        for a, b in cuts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=ZSTD)) as stream:
                stream.write_batch(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "texts"])
            number += 1


def _read(unit: pa.Buffer) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(the slice's rows, bytes and offsets of their texts)."""
    table = pa.ipc.open_stream(unit).read_all().combine_chunks()
    return table, *text_bytes(table.column("text"))


def _table_rows(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, counts) of the blocks of the tables in which a task has counted something; their shards are negative."""
    salt = TaskContext.get().partitionId() // SALTS % SALTS  # neighbours are summed first
    for block, own in enumerate(counts.reshape(-1, TABLE_BLOCK, 2)):
        if own.any():
            yield -1 - (block * SALTS + salt), _squeezed(own.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _summed(blobs: list[bytes], kind: str, width: int) -> np.ndarray:
    """Sum of counts that lie as planes of bytes."""
    total = np.zeros(2 * TABLE_BLOCK, np.int64)
    for blob in blobs:
        total += np.ascontiguousarray(np.frombuffer(_spread(blob), np.uint8).reshape(width, -1).T).view(kind)[:, 0]
    return total


def _table_block(group: pa.Table) -> pa.Table:
    total = _summed(group.column("said").to_pylist(), "<i8", 8).reshape(-1, 2)
    return pa.table({"block": group.column("block").slice(0, 1), "said": pa.array([_stretched(total[:, 0], total[:, 1]).tobytes()], pa.binary())})


def _by_shard(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of ascending hashes, of which the shard tells all bits but the lowest."""
    shard = hashes >> np.uint64(bits)
    starts = np.flatnonzero(np.diff(shard, prepend=np.uint64(1 << 63)))
    yield from zip(shard[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(shard)], strict=False)


def _asked(bits: int, shard_bits: int, code: Code):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((len(ORDERS), 1 << TABLE_BITS, 2), np.uint32)
        kinds = (pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for number, unit in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table, data, offsets = _read(unit.as_buffer())
                taught = ~np.array(table.column("held_out"))
                del table
                asks, counts, teaches = Slice.of(data, offsets, bits), [], []
                for part in asks.parts:
                    learn = np.repeat(taught[part.a : part.b], np.diff(part.first))
                    teaches.append(learn[part.opens])
                    for run, of in zip(part.keys, (part.entries[0][learn], part.entries[1][teaches[-1]]), strict=True):
                        counts.append(np.bincount(of, minlength=len(run)))
                    add_to_tables(tables, code, *laid_out(data[offsets[part.a] : offsets[part.b]], offsets[part.a : part.b + 1] - offsets[part.a])[:2], learn)
                keys, place = _merged_runs(asks.runs())
                counts = np.bincount(place, np.concatenate(counts), len(keys))
                own = np.bincount(asks.unit_of, np.concatenate(teaches) & (np.concatenate([p.sizes for p in asks.parts]) > 1), len(asks.groups))
                inner, rows = np.uint64((1 << (bits - shard_bits)) - 1), []
                context = keys >> np.uint64(16)
                for s, a, b in _by_shard(context, bits - shard_bits):
                    rows.append((s, number, _packed(context[a:b] & inner, keys[a:b] & np.uint64(0xFFFF), counts[a:b])))
                for s, a, b in _by_shard(asks.groups, bits - shard_bits):
                    rows.append((s | 1 << shard_bits, number, _packed_units(asks.groups[a:b] & inner, asks.sizes[a:b], own[a:b], asks.letters(a, b))))
                del asks, keys, place, counts, own, context, data, offsets
                _give_back()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "slice", "entries"])
        for shard, entries in _table_rows(tables):
            yield pa.RecordBatch.from_arrays([pa.array([shard], kinds[0]), pa.array([-1], kinds[1]), pa.array([entries], kinds[2])], ["shard", "slice", "entries"])

    return ask


def _dealt(pieces: list[slice], of: np.ndarray, starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, out: list[list[bytes]]) -> None:
    """To each slice the values of what it has asked, in its order."""
    at = 0
    for own, p in zip(out, pieces, strict=True):
        mine = of[at : at + p.stop - p.start]
        at += len(mine)
        own.append(values[_stretches(starts[mine], lengths[mine])].tobytes())


def _keys_told(code: Code, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    out: list[list[bytes]] = [[] for _ in parts]
    for pieces in _ranges([k for k, _ in parts], RANGE_KEYS):
        keys, of = _merged([k[p] for (k, _), p in zip(parts, pieces, strict=True)])
        starts, values = said(code, keys, np.bincount(of, np.concatenate([c[p] for (_, c), p in zip(parts, pieces, strict=True)]), len(keys)))
        values = turned(code, (keys & np.uint64(0xFFFF)).astype(np.int32), values)
        _dealt(pieces, of, starts, np.diff(starts), values, out)
    return [_squeezed(b"".join(own)) for own in out]


def _units_told(code: Code, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """What is said of all bytes of units but the first.  Equal units of all slices are one before their contexts are made."""
    out: list[list[bytes]] = [[] for _ in parts]
    ends = [np.concatenate([[0], np.cumsum(sizes)]) for _, sizes, _, _ in parts]
    for pieces in _ranges([g << np.uint64(16) for g, *_ in parts], RANGE_KEYS >> 3):
        groups, sizes, counts = (np.concatenate([part[k][p] for part, p in zip(parts, pieces, strict=True)]) for k in range(3))
        if not len(groups):
            continue
        letters = np.concatenate([part[3][e[p.start] : e[p.stop]] for part, e, p in zip(parts, ends, pieces, strict=True)])
        begin, group = np.cumsum(sizes) - sizes, mixed(groups + np.uint64(1))
        spans = SpanHashes(letters)
        of, model = _named(_after(spans(begin, begin + sizes), group))
        rests = sizes[model] - 1
        at = _stretches(begin[model] + 1, rests)
        low = letters[at - 1].astype(np.int32) << 8 | letters[at]
        context = _after(spans(np.repeat(begin[model], rests), at), np.repeat(group[model], rests))
        keys, key_of = _merged([_keyed(context, low, 48)])
        starts, values = said(code, keys, np.bincount(key_of, np.repeat(np.bincount(of, counts, len(model)), rests), len(keys)))
        lengths = np.diff(starts)[key_of]
        values = turned(code, low, values[_stretches(starts[key_of], lengths)])
        firsts = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(rests)])]
        _dealt(pieces, of, firsts[:-1], np.diff(firsts), values, out)
    return [_squeezed(b"".join(own)) for own in out]


def _told(code: Code, shard_bits: int = 0):
    def tell(group: pa.Table) -> pa.Table:
        if group.column("shard")[0].as_py() < 0:
            total = _summed(group.column("entries").to_pylist(), "<u4", 4)
            planes = _squeezed(total.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())
            return pa.table({"slice": group.column("slice").slice(0, 1), "shard": group.column("shard").slice(0, 1), "said": pa.array([planes], pa.binary())})
        blobs = [e.as_py() for e in group.column("entries")]
        out = _keys_told(code, [_unpacked(x) for x in blobs]) if group.column("shard")[0].as_py() >> shard_bits == 0 else _units_told(code, [_unpacked_units(x) for x in blobs])
        _give_back()
        return pa.table({"slice": group.column("slice"), "shard": group.column("shard"), "said": pa.array(out, pa.binary())})

    return tell


def _scored(code: Code, tables: Broadcast, bits: int, keys: np.ndarray, counts: np.ndarray, end_count: int):
    """keys, counts: frequent tokens in ascending order of key; the keys of other words go along for the join."""
    worth = np.log10(counts + 0.5)
    end_worth = float(np.log10(end_count + 0.5))

    def score(units: pa.Table, told: pa.Table) -> pa.Table:
        mixer = Mixer(code, np.frombuffer(tables.value, np.int8).reshape(len(ORDERS), -1))
        number = units.column("slice")[0].as_py()
        table, data, offsets = _read(units.column("texts")[0].as_buffer())
        asks = Slice.of(data, offsets, bits)
        asked, places = _merged_runs(asks.runs())
        low = np.concatenate([(asked & np.uint64(0xFFFF)).astype(np.uint16), asks.pairs[_stretches(asks.at + 1, asks.sizes - 1)]])
        starts = np.zeros(len(low) + 1, np.int64)
        np.cumsum(code.lengths[low], out=starts[1:])
        values = turned(code, low, np.concatenate([np.frombuffer(_spread(v.as_py()), np.int8) for v in told.sort_by("shard").column("said")]))
        del low
        for part in asks.parts:
            part.keys.clear()
        _give_back()
        out = []
        for part, entries in zip(asks.parts, asks.entries(places, len(asked)), strict=True):
            a, b = part.a, part.b
            buffer, spots, _ = laid_out(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            log2 = mixer.log2(pairs_at(buffer, spots), part.first, tails(buffer, spots), entries, starts, values)
            at = offsets[a : b + 1] - offsets[a]
            found, words = _tokens(data[offsets[a] : offsets[b]], at)
            text = np.repeat(np.arange(b - a), np.diff(words))
            place = np.minimum(np.searchsorted(keys, found), max(0, len(keys) - 1))
            hit = keys[place] == found if len(keys) else np.zeros(len(found), bool)
            known = np.bincount(text[hit], minlength=b - a) + (end_count > 0)
            base = np.bincount(text[hit], worth[place[hit]], b - a) + end_worth
            rare = np.concatenate([[0], np.cumsum(np.bincount(text[~hit], minlength=b - a))]).astype(np.int32)
            out.append(pa.table(
                [
                    pa.array(number * SLICE_ROWS + np.arange(a, b)), *(table.column(c).slice(a, b - a) for c in ("doc_id", "held_out")), pa.array(np.diff(words) + 1), pa.array(known.astype(np.int64)), pa.array(base),
                    pa.ListArray.from_arrays(pa.array(rare), pa.array(found[~hit])), pa.array(log2), pa.array(np.diff(at)),
                ],
                SCORED_NAMES,
            ))
        del asks, starts, values, places, entries, buffer, spots
        _give_back()
        return pa.concat_tables(out)

    return score


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<long>, log2 double, n_bytes long"
SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 18) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    Rows for which held_out is not true are learnt from.  score: log10 of the
    model's probability of the whole text with its end; bits_per_byte: the same
    in bits, a byte (the end counts as one).  Texts are read whole, however long;
    rows with equal texts get equal scores.  base_score: of a unigram model of
    tokens, with add-half smoothing, over the same rows.  The `frequent` most
    frequent tokens go to every task, all others are joined.  A null text is
    an empty one; rows may share an id, and a null id is kept.  With no row to
    learn from every token is unknown.  Words are told apart by 63-bit hashes.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    taught = chosen.filter("NOT held_out").select("text")
    counts = stage(taught.mapInArrow(_counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    tokens = counts.df.filter("kind = 0").drop("kind")
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    letters = np.zeros(1 << 16, np.int64)
    for r in counts.df.filter("kind = 1").collect():  # 2**16 rows at most
        letters[r.key] = r.n
    ends = tokens.filter(F.col("key") == END_KEY).first()
    common = tokens.filter(F.col("key") != END_KEY).orderBy(F.desc("n"), "key").limit(frequent).toArrow().sort_by("key")
    code = Code.of(letters.reshape(256, 256))
    rows, size = chosen.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bits = SPARE_BITS + (rows + size + SHARD_BYTES).bit_length()
    shard_bits = max(0, bits - SPARE_BITS - SHARD_BYTES.bit_length())
    units = stage(chosen.mapInArrow(_units, UNITS), "slices")
    told = stage(units.df.mapInArrow(_asked(bits, shard_bits, code), ASKED).groupBy("shard").applyInArrow(_told(code, shard_bits), TOLD), "told")
    blocks = told.df.filter("slice < 0").select(F.floor((-1 - F.col("shard")) / SALTS).alias("block"), "said").groupBy("block").applyInArrow(_table_block, "block long, said binary")
    tables = np.zeros((len(ORDERS) << TABLE_BITS) // TABLE_BLOCK * TABLE_BLOCK, np.int8).reshape(-1, TABLE_BLOCK)
    for r in blocks.toLocalIterator():  # as many rows as the tables have blocks
        tables[r.block] = np.frombuffer(r.said, np.int8)
    score = _scored(code, docs.sparkSession.sparkContext.broadcast(tables.tobytes()), bits, common.column("key").to_numpy(), common.column("n").to_numpy(), ends.n if ends else 0)
    held = stage(units.df.groupBy("slice").cogroup(told.df.filter("slice >= 0").groupBy("slice")).applyInArrow(score, SCORED), "scored")
    units.drop()
    told.drop()
    rare = held.df.select("row", F.explode("rare").alias("key")).join(tokens, "key", "left")
    rest = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("more_known"))
    joined = held.df.drop("rare").join(rest, "row", "left")
    each = float(np.log10(total + 0.5 * (distinct + 1)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        (F.col("log2") * float(np.log10(2))).alias("score"), (-F.col("log2") / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
