"""Near-duplicates: improved consistent weighted sampling (ICWS) over TF-IDF shingles.

A document's shingles are its runs of five words (A-Z lower-cased); texts of
one to four words are one shingle.  A shingle weighs its count in the document
times an inverse document frequency, counted over all documents for every
shingle: slices of text send their shingles to shards by hash, once each, and get
back those that other documents have too, so that no task holds all frequencies.
A document keeps its shingles' weights beside its text, a byte each.  The idf is
damped (its fourth root): what thousands of near copies share is frequent
for that very reason, and at full idf a few rare edited words would outweigh it.

Each shingle falls into one of 120 bins by its hash, and each bin takes one
ICWS sample (shingle, t) of its shingles, so a document costs one evaluation a
shingle; empty bins borrow from others.  Two documents agree in a bin with the
probability of their weighted Jaccard similarity.  24 bands of 5 bins make
candidates (similarity 0.8 is missed once in 10**4), which are verified by exact
weighted Jaccard similarity on whole texts.

No task gets a group whole.  Copies of a text are one node first.  Members of a
band's bucket are verified against its least member, and those that this leaves
unconnected against the member with most links.  What is still apart in a bucket
is compared exactly in blocks of bounded size, each member outside the bucket's
main component against all others, so no link is lost; pairs are not emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .lexing import SEEDS, SpanHashes, lower_ascii, mixed, slices, span_hash, split_words, text_bytes, windows
from .storage import Staged, finished, free_name, stage

SHINGLE = 5
BINS, BANDS = 120, 24
DAMPING = 0.25
WANTED_BITS = 23
ID_BITS = 44  #: of a shingle inside a batch; the others number the batch's rows
KEY_BYTES = 6  #: that hold a shingle's ID_BITS
BLOCK, BLOCK_BYTES = 1024, 4 << 20  #: of a block of a bucket's members
SHARD_BYTES = 8 << 20  #: of text that a shard counts the shingles of
SLICED = "slice long, doc_id long, text string"
ASKED = "shard long, slice long, keys binary, counts binary"
TOLD = "slice long, keys binary, codes binary"
SIGNED = "doc_id long, text string, k1 long, k2 long, bands binary, codes binary"
_ID_MASK = np.uint64((1 << ID_BITS) - 1)


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal parts."""
    x = np.concatenate([[0.0], np.geomspace(1e-5, 40, 200_000)])
    return np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), 1 - (1 + x) * np.exp(-x), x)


GAMMA = _gamma_table()
LOG_GAMMA = np.log(GAMMA)
#: Bins in the order in which an empty bin asks the others.
BORROW = np.argsort(mixed(np.arange(1, BINS * BINS + 1, dtype=np.uint64) * np.uint64(SEEDS[1])).reshape(BINS, BINS), axis=1, kind="stable")


def shingle_counts(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, row, shingle, count, and two hashes of each row's words) by runs of rows; rows without words have hashes 0."""
    data, offsets = text_bytes(column)
    for a, b in slices(data, offsets, 1 << 21):
        part, at = lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        words = split_words(part, at)
        hashes = SpanHashes(part)(words.starts, words.ends)
        first, shingles = windows(hashes, words.offsets, size)
        rows = np.searchsorted(words.offsets, first, "right") - 1
        some = np.flatnonzero((words.counts > 0) & (words.counts < size))
        shingles = np.concatenate([shingles, span_hash(hashes, words.offsets[some], words.offsets[some + 1])])
        rows = np.concatenate([rows, some]).astype(np.uint64)
        keys, counts = np.unique((rows << np.uint64(ID_BITS)) | (shingles & _ID_MASK), return_counts=True)
        whole = [np.where(words.counts > 0, span_hash(hashes, words.offsets[:-1], words.offsets[1:], s) | np.uint64(1), np.uint64(0)) for s in SEEDS]
        yield a, b, (keys >> np.uint64(ID_BITS)).astype(np.int64), keys & _ID_MASK, counts, *whole


def _codes(documents: int, frequency: np.ndarray) -> np.ndarray:
    """Damped idf in hundredths, from 1 on: (1 + ln((documents + 1) / (frequency + 1))) ** DAMPING."""
    return np.clip(np.rint(100 * np.maximum(1, 1 + np.log((documents + 1) / (frequency + 1.0))) ** DAMPING), 100, 255).astype(np.uint8)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their slice."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for a, b in slices(*text_bytes(batch.column(1)), 1 << 21):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, number)), *(c.slice(a, b - a) for c in batch.columns)], ["slice", "doc_id", "text"])
            number += 1


def _asked(shards: int):
    """The shingles of a slice, once each, by shard, with the number of its documents that have them."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slice_of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(slice_of)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                for _, _, _, shingles, *_ in shingle_counts(batch.column(2).slice(low, high - low)):
                    keys, counts = np.unique(shingles, return_counts=True)
                    shard = (keys % np.uint64(shards)).astype(np.min_scalar_type(shards))
                    order = np.argsort(shard, kind="stable")
                    keys, counts = keys[order] // np.uint64(shards), counts[order].astype("<u4")
                    shard = shard[order]
                    starts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))  # of the shards that the slice has shingles of
                    parts = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                    rows = [(int(shard[a]), int(slice_of[low]), parts[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(shard)], strict=True) if b > a]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "slice", "keys", "counts"])

    return ask


def _told(shards: int, documents: int):
    """For each slice the codes of its shingles that differ from that of a shingle of one document."""

    def tell(group: pa.Table) -> pa.Table:
        rows = group.column("keys").to_pylist()
        ends = np.cumsum([len(r) // KEY_BYTES for r in rows])
        wide = np.zeros((int(ends[-1]), 8), np.uint8)
        wide[:, :KEY_BYTES] = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, KEY_BYTES)
        keys = wide.view("<u8")[:, 0]
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), "<u4")
        _, of = np.unique(keys, return_inverse=True)
        codes = _codes(documents, np.bincount(of, counts))[of]
        keys = keys * np.uint64(shards) + np.uint64(group.column("shard")[0].as_py())
        some = codes != _codes(documents, np.ones(1))
        told = [(keys[a:b][some[a:b]].astype("<u8").tobytes(), codes[a:b][some[a:b]].tobytes()) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return pa.table({"slice": group.column("slice"), "keys": pa.array([t[0] for t in told], pa.binary()), "codes": pa.array([t[1] for t in told], pa.binary())}).filter(pa.array([bool(t[1]) for t in told]))

    return tell


def _worth(codes: pa.Array, a: int, b: int, counts: np.ndarray) -> np.ndarray:
    """Weights of the shingles of rows a to b; `codes` holds those of each row's shingles in order."""
    return counts * (np.frombuffer(b"".join(codes.slice(a, b - a).to_pylist()), np.uint8) / 100.0)


def icws(rows: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) samples, 0 where a row has no shingle."""
    noise = mixed(shingles * np.uint64(SEEDS[1]))
    part = lambda k: ((noise >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
    r, beta = GAMMA[part(0)], (part(1) + 0.5) / (1 << 16)
    t = np.floor(np.log(weights) / r + beta)
    log_a = LOG_GAMMA[part(2)] - r * (t - beta + 1)
    group = rows * BINS + part(3) % BINS
    least = np.full(n * BINS, np.inf)
    np.minimum.at(least, group, log_a)
    won = log_a == least[group]
    out = np.zeros(n * BINS, np.uint64)
    out[group[won]] = mixed(shingles[won] + t[won].astype(np.int64).astype(np.uint64) * np.uint64(SEEDS[0])) | np.uint64(1)
    out = out.reshape(n, BINS)
    lacking = np.flatnonzero((out == 0).any(1) & (out != 0).any(1))
    filled, own = out[lacking], out[lacking]
    for k in range(BINS):
        empty = filled == 0
        if not empty.any():
            break
        filled = np.where(empty, own[:, BORROW[:, k]], filled)
    out[lacking] = filled
    return out


def _sign(documents: int):
    """Bands of a slice's documents, and the codes of their shingles."""

    def sign(rows_of: pa.Table, told: pa.Table) -> pa.Table:
        known, first = np.unique(np.frombuffer(b"".join(told.column("keys").to_pylist()), "<u8"), return_index=True)
        known_codes = np.frombuffer(b"".join(told.column("codes").to_pylist()), np.uint8)[first]
        alone = _codes(documents, np.ones(1))[0]
        rows_of = rows_of.combine_chunks()
        text = rows_of.column("text").combine_chunks()
        out = []
        for a, b, rows, shingles, counts, k1, k2 in shingle_counts(text):
            codes = np.full(len(shingles), alone, np.uint8)
            if len(known):
                place = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                codes = np.where(known[place] == shingles, known_codes[place], alone).astype(np.uint8)
            samples = icws(rows, shingles, counts * (codes / 100.0), b - a)
            banded = samples.reshape(b - a, BANDS, BINS // BANDS) * (np.arange(BINS // BANDS, dtype=np.uint64) * np.uint64(SEEDS[0]) + np.uint64(SEEDS[1]))
            bands = mixed(banded.sum(2) + np.arange(BANDS, dtype=np.uint64)[None])
            banded_of = [None if blank else v.tobytes() for v, blank in zip(bands, (k1 == 0).tolist(), strict=True)]
            ends = np.searchsorted(rows, np.arange(b - a + 1))
            codes_of = [codes[ends[k] : ends[k + 1]].tobytes() for k in range(b - a)]
            columns = [rows_of.column("doc_id").slice(a, b - a), text.slice(a, b - a), *(pa.array(k.view(np.int64), mask=k == 0) for k in (k1, k2)), pa.array(banded_of, pa.binary()), pa.array(codes_of, pa.binary())]
            out.append(pa.table(columns, ["doc_id", "text", "k1", "k2", "bands", "codes"]))
        return pa.concat_tables(out)

    return sign


def signed_documents(chosen: DataFrame) -> Staged:
    """chosen (doc_id, text) with hashes of the texts, their bands, and their shingles' weights in hundredths, in order of shingle."""
    held = stage(chosen.mapInArrow(_numbered, SLICED), "slices")
    documents, size = held.df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, -(-size // SHARD_BYTES))
    told = stage(held.df.mapInArrow(_asked(shards), ASKED).groupBy("shard").applyInArrow(_told(shards, documents), TOLD), "frequencies")
    signed = stage(held.df.groupBy("slice").cogroup(told.df.groupBy("slice")).applyInArrow(_sign(documents), SIGNED), "signed")
    held.drop()
    told.drop()
    return signed


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], ["key", "node"])


def weighted_jaccard(left: pa.Array, right: pa.Array, left_codes: pa.Array, right_codes: pa.Array) -> np.ndarray:
    """Of the texts in each row, 0 where one has no words; the codes are weights in hundredths, in order of shingle."""
    out = np.zeros(len(left))
    size = np.maximum(1, np.maximum(np.diff(text_bytes(left)[1]), np.diff(text_bytes(right)[1])))
    at = 0
    total = np.concatenate([[0], np.cumsum(size)])
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(total, total[at] + (1 << 20), "right")) - 1)
        sides = []
        for column, known in ((left, left_codes), (right, right_codes)):
            keys, worth = [], []
            for a, b, rows, shingles, counts, *_ in shingle_counts(column.slice(at, end - at)):
                keys.append(((rows + a).astype(np.uint64) << np.uint64(ID_BITS)) | shingles)
                worth.append(_worth(known, at + a, at + b, counts))
            sides.append((np.concatenate(keys), np.concatenate(worth)))
        (ka, wa), (kb, wb) = sides
        _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        row = lambda k: (k >> np.uint64(ID_BITS)).astype(np.int64)
        n = end - at
        both = np.bincount(row(ka[ia]), np.minimum(wa[ia], wb[ib]), n)
        every = np.bincount(row(ka), wa, n) + np.bincount(row(kb), wb, n) - both
        out[at:end] = both / np.maximum(every, 1e-12)
        at = end
    return out


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b), those whose texts are alike.  The joins split where a node has many pairs."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("codes").alias("ca")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("codes").alias("cb")), "b").select("a", "b", "ta", "tb", "ca", "cb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = pa.array(weighted_jaccard(*(batch.column(k) for k in (2, 3, 4, 5))) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(alike), batch.column(1).filter(alike)], ["a", "b"])

    return with_b.mapInArrow(check, "a long, b long")


def _cell_links(threshold: float):
    """Links between a bucket's members of block i outside its main component and all members of block j."""

    def entries(texts: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(rows + a, shingles, _worth(codes, a, b, counts)) for a, b, rows, shingles, counts, *_ in shingle_counts(texts)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = {c: group.column(c).to_numpy() for c in ("i", "j", "block", "node", "component", "main")}
        ask = np.flatnonzero((column["block"] == column["i"]) & (column["component"] != column["main"]))
        told = np.flatnonzero(column["block"] == column["j"])
        texts, codes = group.column("text"), group.column("codes")
        ask_row, ask_shingle, ask_weight = entries(texts.take(pa.array(ask)), codes.take(pa.array(ask)))
        row, shingle, weight = entries(texts.take(pa.array(told)), codes.take(pa.array(told)))
        ask_total, total = np.bincount(ask_row, ask_weight, len(ask)), np.bincount(row, weight, len(told))
        order = np.argsort(shingle, kind="stable")
        row, shingle, weight = row[order], shingle[order], weight[order]
        low = np.searchsorted(shingle, ask_shingle, "left")
        many = np.searchsorted(shingle, ask_shingle, "right") - low
        reach = np.cumsum(np.bincount(ask_row, many, len(ask)))
        first = np.searchsorted(ask_row, np.arange(len(ask) + 1))
        links: list[np.ndarray] = []
        at = 0
        while at < len(ask):  # so many members at a time as meet about 2**21 shingles
            end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + (1 << 21), "right")))
            part = slice(first[at], first[end])
            n = many[part]
            met = np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.repeat(ask_row[part] - at, n) * len(told) + row[met]
            both = np.bincount(pair, np.minimum(np.repeat(ask_weight[part], n), weight[met]), (end - at) * len(told)).reshape(end - at, len(told))
            x, y = np.nonzero(both >= threshold * (ask_total[at:end, None] + total[None] - both))
            links.append(np.stack([ask[x + at], told[y]]))
            at = end
        x, y = np.concatenate(links, 1) if links else np.zeros((2, 0), np.int64)
        apart = column["component"][x] != column["component"][y]
        x, y = column["node"][x[apart]], column["node"][y[apart]]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)}).group_by(["a", "b"]).aggregate([])

    return link


def _residual_links(shared: DataFrame, parts: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of one bucket that are in different components."""
    at = (
        shared.join(parts, "node", "left").join(texts.select(F.col("id").alias("node"), F.octet_length("text").alias("size")), "node")
        .select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    )
    sizes = at.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    mixed_keys = (
        sizes.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("parts"), F.max(F.struct("n", F.col("component").alias("main"))).alias("top"))
        .filter("parts > 1")
        .select("key", F.col("top.main").alias("main"), F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES, F.lit(1))).cast("int").alias("blocks"))
    )
    members = at.select("key", "node", "component").join(mixed_keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    told = F.transform(every, lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    ask = F.transform(every, lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    cells = members.withColumn("cell", F.explode(F.when(F.col("component") != F.col("main"), F.array_union(told, ask)).otherwise(told)))
    rows = cells.select("key", "cell.i", "cell.j", "block", "node", "component", "main").join(texts.withColumnRenamed("id", "node"), "node")
    return rows.groupBy("key", "i", "j").applyInArrow(_cell_links(threshold), "a long, b long").distinct()


def _hub_pairs(shared: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
    """In each bucket, its member with most links and those not connected to it."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    at = (
        shared.select("key", "node").join(parts, "node", "left").join(degrees, "node", "left")
        .select("key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"))
    )
    hubs = at.groupBy("key").agg(F.max(F.struct("degree", F.col("node").alias("hub"), F.col("component").alias("hub_component"))).alias("h")).select("key", "h.hub", "h.hub_component")
    return at.join(hubs, "key").filter("component <> hub_component").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _texts_of(texts: DataFrame, wanted: DataFrame) -> Staged:
    """The rows of texts (id and others) whose ids are wanted.

    A bitmap of hashed ids, of one size (2**WANTED_BITS bits), is asked before
    the join, so that most texts that aren't wanted are not shuffled.
    """
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - WANTED_BITS) + 1  # the bitmap functions count from 1
    parts = wanted.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    bitmap = np.zeros((1 << WANTED_BITS) // 8, np.uint8)
    for r in parts:  # 2**(WANTED_BITS - 15) rows of 4 KB
        bitmap[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, np.uint8)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(batch.num_columns - 1).to_numpy() - 1
            hit = (bitmap[s >> 3] >> (s & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1]).filter(pa.array(hit.astype(bool)))

    return stage(texts.withColumn("__slot", slot).mapInArrow(maybe, texts.schema).join(wanted, "id", "left_semi"), "texts")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id) for every row: the least doc_id of the documents linked to it, directly or through others.

    Two documents are linked if their weighted Jaccard similarity is at least
    `threshold` and they share a band.  Rows that share an id count as one
    document.  A text that is null or has no word is a class of its own, as is
    a row with a null id (class null).  Texts are compared whole, however long;
    equal texts are always of one class.  Of documents that are equally good
    the least doc_id stands for the class.  An empty table gives an empty one.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = signed_documents(chosen)
    known = signed.df.filter("doc_id IS NOT NULL AND k1 IS NOT NULL")
    least = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    copies = stage(known.select("doc_id", "k1", "k2").join(least, ["k1", "k2"]).select("doc_id", "rep"), "copies")
    nodes = known.join(least.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2", "doc_id"], "left_semi")
    bands = nodes.select("doc_id", "bands").mapInArrow(_band_rows, "key long, node long")
    several = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("key", "pivot")
    shared = stage(bands.join(several, "key"), "buckets")
    texts = _texts_of(signed.df.select(F.col("doc_id").alias("id"), "text", "codes"), shared.df.select(F.col("node").alias("id")).distinct())
    pivots = stage(shared.df.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    to_pivots = stage(_verified(pivots.df, texts.df, threshold), "links")
    first = components(to_pivots.df)
    hubs = stage(_hub_pairs(shared.df, to_pivots.df, first.df).join(pivots.df, ["a", "b"], "left_anti"), "pairs")
    to_hubs = stage(_verified(hubs.df, texts.df, threshold), "links")
    links = to_pivots.df.unionByName(to_hubs.df)
    second = components(links)
    rest = stage(_residual_links(shared.df.select("key", "node"), second.df, texts.df, threshold), "links")
    final = components(links.unionByName(rest.df).unionByName(_shared_ids(copies.df)))
    for s in (shared, texts, pivots, to_pivots, first, hubs, to_hubs, second, rest):
        s.drop()
    finished(docs.sparkSession)
    alone = signed.df.filter("doc_id IS NULL OR k1 IS NULL").select("doc_id", F.col("doc_id").alias("rep"))
    every = copies.df.unionByName(alone)
    return every.join(final.df.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("class_id"))


def _shared_ids(copies: DataFrame) -> DataFrame:
    """Links between the representatives of an id that has rows with different texts."""
    least = copies.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("m")).filter("b < m").select("doc_id", "b")
    return copies.join(least, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs without the documents that are not the least id of their class; rows with a null id stay."""
    classes = near_duplicates(docs, id_col, text_col, threshold)
    name = free_name("__gone", docs)
    gone = stage(classes.filter("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone.df.hint("shuffle_hash"), docs[id_col].cast("long") == F.col(name), "left_anti")
