"""Packing of token sequences: best-fit decreasing with a segment tree.

Tasks tokenize whole texts.  An overlong document is cut into full windows
first, of which only place and checksum travel; what is left of each document
is packed best-fit decreasing within groups of about `group_docs` documents,
dealt by a hash of all that a piece is and of how many equal rows its task had
before, so that rows of one id and text are split too.  Where many pieces are over half a window, best fit
alone leaves much slack, so the emptiest windows are then cut up to fill the
slack of the fullest, down to `least_cut` tokens a window.  A group's padding
doesn't depend on the size of the corpus.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters that the tokenizer's pattern sees as white space.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A piece of text from one change of non-space to space to the next.  No token of a
#: byte-level BPE with the public pattern crosses such a place, so pieces encode alone.
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
CUT_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
PACKED_NAMES = [*CUT_NAMES[:5], "sequence_id", "offset"]
CUT_SCHEMA = PIECE_SCHEMA + ", ids binary, again long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes; repeated chunks are encoded once.

    The ids are those of the tokenizer file, the strings of its special tokens
    included, which are one id wherever a text holds them.  Other chunks that
    aren't cached go through tiktoken with the vocabulary of that file, which
    gives the same ids as `tokenizers` in a tenth of its time; the two are
    compared at the start, and on any difference `tokenizers` encodes.
    """

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: struct.pack("<I", i) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.one = self._by_tokenizers
        fast = self._by_ranks(path)
        if fast and all(fast(t) == self._by_tokenizers(t) for t in PROBES):
            self.one = fast
        self.known: dict[str, bytes] = {}
        self.keep = keep

    def _by_tokenizers(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _by_ranks(path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary writes as themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if all(c in byte_of for c in token) and not token.startswith("<|")}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.known) > self.keep:
            self.known.clear()
        for text in texts:
            if any(s in text for s in self.special):
                yield b"".join([self.special.get(part) or self._ordinary(part) for part in self.at_special.split(text)])
            else:
                yield self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        known, one = self.known, self.one
        chunks = CHUNKS.findall(text)
        for c in {c for c in chunks if c not in known}:
            ids = one(c)
            known[c] = struct.pack(f"<{len(ids)}I", *ids)
        out = b"".join([known[c] for c in chunks])
        if len(known) > 2 * self.keep:
            known.clear()
        return out


#: Texts on which both encoders must agree.
PROBES = ("Hello  there,\n\n it's 12345 o'clock\t ", "\u00e9t\u00e9 \u4f60\u597d \U0001f600!\x00\x1c ~~~ <|endof", "  ", "ThWhouedre onerth\r\n\u00df\u00fc\u00f1")

_encoders: dict[str, Encoder] = {}


def _cut(tokenizer: str, end_id: int, window: int):
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        encode = _encoders[tokenizer]
        seen: dict[int, int] = {}  # rows so far by hash: equal rows are told apart by their number, in whatever order they come
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                texts, doc_ids = [t or "" for t in part.column(1).to_pylist()], part.column(0).to_pylist()
                for doc_id, text, ids in zip(doc_ids, texts, encode(texts), strict=True):
                    again = seen[hash((doc_id, text))] = seen.get(hash((doc_id, text)), -1) + 1
                    ids += end
                    n = len(ids) // 4
                    full = n - n % window
                    rows += [(doc_id, i, window, zlib.crc32(ids[4 * i : 4 * (i + window)]), n, None, again) for i in range(0, full, window)]
                    if n > full:
                        rows.append((doc_id, full, n - full, None, n, ids[4 * full :], again))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary()), pa.array(columns[6], pa.int64())], [*CUT_NAMES, "again"])

    return pieces


class OpenWindows:
    """Segment tree over remaining capacities 0..window; a node counts open windows below it."""

    def __init__(self, window: int):
        self.size = 1 << (window + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, bin_id: int) -> None:
        self.open[capacity].append(bin_id)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(capacity, window) of the fullest window that still holds `length`, which is removed."""
        tree, i = self.tree, length + self.size
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.tree[i] += n
            i >>= 1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window index, offset) of each length; lengths come in descending order."""
    bins, offsets, opened, windows = [], [], 0, OpenWindows(window)
    for length in lengths:
        found = windows.take(length)
        if found is None:
            found = (window, opened)
            opened += 1
        capacity, bin_id = found
        bins.append(bin_id)
        offsets.append(window - capacity)
        if capacity > length:
            windows.put(capacity - length, bin_id)
    return bins, offsets


def fill_slack(bins: list[int], lengths: list[int], window: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Cuts the pieces of the emptiest windows into the slack of the fullest.

    Slack under `least` tokens stays as padding, as does that of the last
    window opened.  Returns per piece its parts (window, start in the piece,
    length); windows are numbered without gaps.
    """
    n = max(bins, default=-1) + 1
    used, inside = [0] * n, [[] for _ in range(n)]
    for i, (b, length) in enumerate(zip(bins, lengths, strict=True)):
        used[b] += length
        inside[b].append(i)
    order = sorted(range(n), key=lambda b: (-used[b], b))
    parts: list[list[tuple[int, int, int]]] = [[(b, 0, length)] for b, length in zip(bins, lengths, strict=True)]
    low, high = 0, n - 1
    while low < high:
        slack = window - used[order[low]]
        if slack < least:
            low += 1
            continue
        donor = order[high]
        piece = inside[donor][-1]
        b, start, length = parts[piece].pop()
        moved = min(slack, length)
        parts[piece].append((order[low], start, moved))
        used[order[low]] += moved
        used[donor] -= moved
        if moved < length:
            parts[piece].append((donor, start + moved, length - moved))
        else:
            inside[donor].pop()
            if not inside[donor]:
                high -= 1
    numbers = {b: i for i, b in enumerate(sorted({b for p in parts for b, _, _ in p}))}
    return [[(numbers[b], start, length) for b, start, length in p] for p in parts]


def _pack(window: int, least: int):
    def pack(table: pa.Table) -> pa.Table:
        group = table.column("__group")[0].as_py() << 32
        rows = sorted(zip(*(table.column(c).to_pylist() for c in CUT_NAMES), strict=True), key=lambda r: (-r[2], r[0] is None, r[0], r[1], r[3] or 0, r[5] or b""))
        whole = [r for r in rows if r[5] is None]
        rest = rows[len(whole) :]
        out = [(*r[:5], group + i, 0) for i, r in enumerate(whole)]
        lengths = [r[2] for r in rest]
        filled = [0] * len(rest)
        for (doc_id, start, _, _, n, ids), parts in zip(rest, fill_slack(best_fit_decreasing(lengths, window)[0], lengths, window, least), strict=True):
            for b, at, length in parts:
                out.append((doc_id, start + at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, group + len(whole) + b, filled[b]))
                filled[b] += length
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], PACKED_NAMES)

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, group_docs: int = 2000, least_cut: int = 16) -> DataFrame:
    """Packs the token ids of every text, each followed by end_id, into windows.

    Returns per piece doc_id, start, length, ids_crc32, doc_tokens, sequence_id
    and offset.  A null or empty text is the end id alone; rows are documents of
    their own even if they share an id; a null id is kept.  Pieces of full
    windows get a sequence of their own.  least_cut: a window keeps slack below
    that many tokens as padding rather than take a piece cut so short.
    """
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut(tokenizer, end_id, window), CUT_SCHEMA)
    groups = max(1, -(-docs.count() // group_docs))
    grouped = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32", "ids", "again"), F.lit(groups))).drop("again")
    return grouped.groupBy("__group").applyInArrow(_pack(window, least_cut), PACKED_SCHEMA)
