"""Substring dedup: fixed-block anchors, extended to maximal exact repeats.

Of every document the non-overlapping blocks of 7 words are the reference
blocks.  A run of 13 words or more that two documents share holds a whole block
of either, so every rolling window of 7 words is probed against the blocks.
Probes and blocks travel as 30-bit hashes, dealt by further hash bits to shards
of one size, with their places in 16 bits: six bytes a word.  A slice sends a
hash once, however often it has it, and keeps the other places in its directory,
so that a shard gets a very common window once a slice.  The hits are then
extended: every window of 13 words around one is looked up by 95 bits of hash, and
runs of windows that a document with a smaller id has too are the maximal exact
repeats.  Counts of a window are combined before the shuffle, so a passage in
very many documents is a few rows.  Copies of a whole text are found by a hash of
it: all of such a copy is covered, and only the least id's text is looked into.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexing import SEEDS, SpanHashes, Words, slices, span_hash, split_words, text_bytes, windows
from .storage import free_name, stage

SHARD_BYTES = 8 << 20  #: of text that a shard has the probes of
PROBES = "shard long, slice long, hashes binary, places binary, highs binary, texts binary, again binary"
HITS = "slice long, places binary, ids binary, firsts binary, texts binary, again binary"
SEVERAL, REFERENCE = np.uint32(2), np.uint32(1)  #: of a hash in a slice: it has more places than one; one is a block
SPOTS = "doc_id long, k1 long, k2 long, spots binary"


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = split_words(data, offsets)
    return words, SpanHashes(data, SEEDS[1])(words.starts, words.ends)


def _whole(words: Words, hashes: np.ndarray) -> np.ndarray:
    """(document, 2): two hashes of each document's words."""
    return np.stack([span_hash(hashes, words.offsets[:-1], words.offsets[1:], s) for s in SEEDS], 1).view(np.int64)


def _standing(keys: np.ndarray, reference: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place for each key, its flags, (2, n): every other place and the one that stands for it)."""
    order = np.argsort(keys)
    fresh = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
    starts = np.flatnonzero(fresh)
    one = order[starts]
    flags = np.maximum.reduceat(reference[order].astype(np.uint32), starts) * REFERENCE | (np.diff(np.append(starts, len(order))) > 1) * SEVERAL
    return one, flags.astype(np.uint32), np.stack([order[~fresh], one[(np.cumsum(fresh) - 1)[~fresh]]])


def _probes(shards: int, window: int, block: int):
    """A slice's rolling windows by shard, and the slice's directory: its documents and their first windows."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(data, offsets, 1 << 21):
                words, hashes = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                first, found = windows(hashes, words.offsets, block)
                document = np.searchsorted(words.offsets, first, "right") - 1
                long = words.counts[document] >= window
                first, found, document = first[long], found[long], document[long]
                if not len(first):
                    continue
                reference = (first - words.offsets[document]) % block == 0
                shard = ((found >> np.uint64(32)) % np.uint64(shards)).astype(np.min_scalar_type(shards))
                low = found & np.uint64(0x3FFFFFFF)
                one, flags, again = _standing((shard.astype(np.uint64) << np.uint64(30)) | low, reference)
                entry = np.zeros(len(found), np.uint32)
                entry[one] = low[one].astype(np.uint32) << np.uint32(2) | flags
                place = np.sort(one)
                place = place[np.argsort(shard[place], kind="stable")]
                short = entry[place]
                dealt = shard[place]
                starts = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))  # only of the shards that the slice has windows of
                rows = [(-1 - number, number, ids[a:b].astype("<i8").tobytes(), np.searchsorted(document, np.arange(b - a)).astype("<i8").tobytes(), (first - words.offsets[document]).astype("<u4").tobytes(), _whole(words, hashes).tobytes(), again.astype("<u4").tobytes())]
                for low_end, high_end in zip(starts.tolist(), [*starts[1:].tolist(), len(place)], strict=True):
                    own = place[low_end:high_end]
                    highs = np.searchsorted(own, np.arange(0, own[-1] + 1, 1 << 16)).astype("<u4")
                    rows.append((int(dealt[low_end]), number, short[low_end:high_end].tobytes(), (own & 0xFFFF).astype("<u2").tobytes(), highs.tobytes(), None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)], ["shard", "slice", "hashes", "places", "highs", "texts", "again"])
                number += 1

    return probe


def _hits(group: pa.Table) -> pa.Table:
    """Places of the windows whose hash a reference block and another window have; a directory passes as it is."""
    slice_of, columns = group.column("slice").to_pylist(), [group.column(c).to_pylist() for c in ("hashes", "places", "highs", "texts", "again")]
    if group.column("shard")[0].as_py() < 0:
        return pa.table([pa.array(slice_of, pa.int64()), *(pa.array(columns[k], pa.binary()) for k in (2, 0, 1, 3, 4))], ["slice", "places", "ids", "firsts", "texts", "again"])
    sizes = np.array([len(h) // 4 for h in columns[0]])
    hashes = np.frombuffer(b"".join(columns[0]), "<u4").astype(np.uint64)
    entries = ((hashes >> np.uint64(2)) << np.uint64(34)) | (np.arange(len(hashes), dtype=np.uint64) << np.uint64(2)) | (hashes & np.uint64(3))
    entries.sort()
    key = entries >> np.uint64(34)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    counts = np.diff(np.append(starts, len(key)))
    flags = np.bitwise_or.reduceat((entries & np.uint64(3)).astype(np.uint32), starts)
    shared = ((counts > 1) | (flags & SEVERAL > 0)) & (flags & REFERENCE > 0)
    hit = np.sort(((entries[np.repeat(shared, counts)] >> np.uint64(2)) & np.uint64(0xFFFFFFFF)).astype(np.int64))
    ends = np.cumsum(sizes)
    parts = np.split(hit, np.searchsorted(hit, ends))
    rows = []
    for k, part in enumerate(parts[: len(sizes)]):
        if len(part):
            at = part - (ends[k] - sizes[k])
            high = np.searchsorted(np.frombuffer(columns[2][k], "<u4"), at, "right") - 1
            low = np.frombuffer(columns[1][k], "<u2")[at]
            rows.append((slice_of[k], (high.astype(np.uint32) << np.uint32(16) | low).astype("<u4").tobytes()))
    none = pa.nulls(len(rows), pa.binary())
    return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), none, none, none, none], ["slice", "places", "ids", "firsts", "texts", "again"])


def _spots(group: pa.Table) -> pa.Table:
    """Of one slice: its documents of a window or more, with hashes of their texts and the word positions of hits."""
    directory = next(r for r in group.select(["places", "ids", "firsts", "texts", "again"]).to_pylist() if r["ids"] is not None)
    hits = [h for h, i in zip(group.column("places").to_pylist(), group.column("ids").to_pylist(), strict=True) if i is None]
    at = np.frombuffer(b"".join(hits), "<u4")
    other, standing = np.frombuffer(directory["again"], "<u4").reshape(2, -1)
    at = np.sort(np.concatenate([at, other[np.isin(standing, at)]]).astype(np.int64))
    ids, firsts, position = (np.frombuffer(directory[k], t) for k, t in (("ids", "<i8"), ("firsts", "<i8"), ("places", "<u4")))
    texts = np.frombuffer(directory["texts"], "<i8").reshape(-1, 2)
    ends = np.append(firsts[1:], len(position))
    bounds = np.searchsorted(at, np.append(firsts, len(position)))
    long = np.flatnonzero(ends > firsts)
    spots = [position[at[bounds[d] : bounds[d + 1]]].tobytes() for d in long]
    return pa.table([pa.array(ids[long]), pa.array(texts[long, 0]), pa.array(texts[long, 1]), pa.array(spots, pa.binary())], ["doc_id", "k1", "k2", "spots"])


def _more(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """31 further bits of hash of the windows that begin at `first`."""
    return (span_hash(hashes, first, first + size, SEEDS[1]) >> np.uint64(33)).astype(np.int32)


def _candidates(window: int, block: int):
    """(doc_id, start, hash, more of the hash) of every window of a document that holds a hit."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            spots, ids = batch.column(2).to_pylist(), batch.column(0).to_numpy()
            for a, b in slices(data, offsets, 1 << 21):
                words, hashes = _hashed(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                marks = np.zeros(len(hashes) + 1, bool)
                for d in range(a, b):
                    own = np.frombuffer(b"".join(spots[d]), "<u4")
                    marks[words.offsets[d - a] + own[own < words.counts[d - a]]] = True
                near = np.concatenate([[0], np.cumsum(marks)])
                first, found = windows(hashes, words.offsets, window)
                held = near[first + window - block + 1] > near[first]
                first, found = first[held], found[held]
                more = _more(hashes, first, window)
                document = np.searchsorted(words.offsets, first, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + document]), pa.array((first - words.offsets[document]).astype(np.int32)), pa.array(found.view(np.int64)), pa.array(more)], ["doc_id", "start", "hash", "more"])

    return candidates


def _rewritten(names: list[str], text: int, window: int):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, high - low) for b in batches for low, high in slices(*text_bytes(b.column(text)), 1 << 21)):
            bodies = batch.column(text).cast(pa.binary()).to_pylist()
            repeats, copies = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
            some = np.flatnonzero(batch.column(batch.num_columns - 3).is_valid())
            masks: dict[int, np.ndarray] = {}
            if len(some):
                words, hashes = _hashed(*text_bytes(batch.column(text).take(pa.array(some))))
                whole = _whole(words, hashes).tolist()
                first, found = windows(hashes, words.offsets, window)
                by_word = np.zeros(len(hashes), np.uint64)
                by_word[first] = found
                for k, d in enumerate(some.tolist()):
                    low, n = int(words.offsets[k]), int(words.counts[k])
                    if n >= window and copies[d] and any([c["k1"], c["k2"]] == whole[k] for c in copies[d]):
                        masks[d] = np.zeros(n, bool)
                        continue
                    if not repeats[d].is_valid:
                        continue
                    listed = repeats[d].values
                    start, expected = listed.field(0).to_numpy(), listed.field(1).to_numpy().view(np.uint64)
                    inside = start + window <= n
                    start, expected = start[inside], expected[inside]
                    start = start[by_word[low + start] == expected]
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + window, -1)
                    masks[d] = np.cumsum(cover[:-1]) == 0
            kept, n_words, n_removed = [], [], []
            for d, body in enumerate(bodies):
                own = (body or b"").split()
                rest = list(compress(own, masks[d])) if d in masks else own
                kept.append(None if body is None else b" ".join(rest))
                n_words.append(len(own))
                n_removed.append(len(own) - len(rest))
            columns = [*batch.columns[:-3], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            columns[text] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return rewrite


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int = 7) -> DataFrame:
    """Removes the words covered by a window of 13 words that also starts in a document with a smaller id.

    Returns docs' columns, the text being the kept words joined by one blank,
    with n_words and n_removed (input columns of these names are replaced; any other names are free).
    Words are runs of bytes outside `[\\x20\\x09-\\x0D]`, compared as they are.
    A null text stays null and has no words; rows with a null id are compared
    with nothing; rows that share an id are not compared with each other.  An
    empty table gives an empty one.  2 * block - 1 must not exceed the window.
    """
    if 2 * block - 1 > window:
        raise ValueError("a window must hold a whole block wherever it starts")
    docs = docs.drop("n_words", "n_removed")
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    probes = chosen.mapInArrow(_probes(shards, window, block), PROBES)
    hits = stage(probes.groupBy("shard").applyInArrow(_hits, HITS), "hits")
    long = stage(hits.df.groupBy("slice").applyInArrow(_spots, SPOTS), "spots")
    hits.drop()
    least = long.df.groupBy("k1", "k2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("k1", "k2", "owner")
    copies = stage(long.df.select("doc_id", "k1", "k2").join(least, ["k1", "k2"]).filter("doc_id > owner").drop("owner"), "copies")
    spots = (
        long.df.filter(F.octet_length("spots") > 0).join(copies.df, ["doc_id", "k1", "k2"], "left_anti")
        .groupBy("doc_id").agg(F.collect_list("spots").alias("spots"))
    )
    found = stage(chosen.join(spots.hint("shuffle_hash"), "doc_id").mapInArrow(_candidates(window, block), "doc_id long, start int, hash long, more int"), "windows")
    firsts = found.df.groupBy("hash", "more").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("hash", "more", "owner")
    repeated = found.df.join(firsts, ["hash", "more"]).filter("doc_id > owner").groupBy("doc_id").agg(F.collect_list(F.struct("start", "hash")).alias("__repeats"))
    whole = copies.df.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("__copies"))
    own, repeats, copied = (free_name(n, docs) for n in ("__id", "__repeats", "__copies"))
    marked = stage(repeated.join(whole, "doc_id", "full").select(F.col("doc_id").alias(own), F.col("__repeats").alias(repeats), F.col("__copies").alias(copied)), "repeats")
    for s in (long, copies, found):
        s.drop()
    joined = docs.join(marked.df.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(own), "left").select(*docs.columns, own, repeats, copied)
    schema = T.StructType([*docs.withColumn(text_col, F.col(text_col).cast("string")).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(_rewritten(schema.names, docs.columns.index(text_col), window), schema)
