"""Quality rules: counts that any text must meet, and a hashed n-gram log-likelihood ratio.

Tokens are runs of letters and digits, and runs of other marks between blanks;
single tokens and pairs of neighbours are hashed into 2**16 buckets.  Two
multinomials over the buckets are counted: one over the trusted documents, one
over the whole raw corpus, brought to the same total.  A text's score is the
mean over its n-grams of the logarithm of the two shares' ratio, drawn to 0 in
texts of few n-grams, which say little.  What a text
must score is set once, where trusted and untrusted labelled documents that the
trusted counts leave out are told apart best; every document is then judged by
its text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexing import IS_BLANK, IS_MARK, SpanHashes, mixed, slices, text_bytes
from .wordids import named_pairs, numbered

BUCKET_BITS = 16
PRIOR = 2.0  #: added to each bucket's count in both multinomials, at the trusted documents' total
NEUTRAL = 32  #: n-grams of ratio 0 that each text's mean has besides its own
BIN = 1 / 512  #: of the scores among which the threshold is sought
DROPPED_WEIGHT = 8  #: a trusted document below the threshold counts as so many untrusted ones above it
REPEATED = 5  #: words of a window
IS_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def hashed_ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every token and of every pair of neighbours, in order of documents."""
    kind = np.where(IS_BLANK[data], 0, np.where(IS_MARK[data], 1, 2))
    begins = np.ones(len(data), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    document = np.searchsorted(offsets, starts, "right") - 1
    one = SpanHashes(data)(starts, ends)
    beside = np.flatnonzero(document[1:] == document[:-1])
    two = mixed(one[beside] * np.uint64(0x9E3779B97F4A7C15) + one[beside + 1])
    rows, hashes = np.concatenate([document, document[beside]]), np.concatenate([one, two])
    order = np.argsort(rows, kind="stable")
    return rows[order], (hashes[order] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, the buckets of its n-grams, two bytes each), a slice of texts at a time."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(data, offsets):
            rows, buckets = hashed_ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = 2 * np.cumsum(np.bincount(rows, minlength=b - a))
            held = [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(buckets.astype(np.uint16))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.Array.from_buffers(pa.binary(), b - a, held)], ["id", "grams"])


def _counted_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-grams by bucket."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for a, b in slices(data, offsets):
            total += np.bincount(hashed_ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[1], minlength=1 << BUCKET_BITS)
    yield _buckets(total)


def _counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same from what `_coded` gives."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            some = b"".join(batch.column(0).slice(k, 512).to_pylist())
            total += np.bincount(np.frombuffer(some, np.uint16), minlength=1 << BUCKET_BITS)
    yield _buckets(total)


def _buckets(total: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def _summed(counts: DataFrame) -> np.ndarray:
    held, out = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow(), np.zeros(1 << BUCKET_BITS)  # 2**16 rows at most
    out[held.column("bucket").to_numpy()] = held.column("n").to_numpy()
    return out


@dataclass
class Model:
    ratios: np.ndarray  #: log-likelihood ratio of each bucket
    threshold: float = -np.inf

    def scores(self, column: pa.Array) -> np.ndarray:
        """Length-normalised log ratio of each text, 0 without n-grams; a text scores alike wherever it is."""
        data, offsets = text_bytes(column)
        out = np.zeros(len(column))
        for a, b in slices(data, offsets):
            rows, buckets = hashed_ngrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.bincount(rows, minlength=b - a)
            out[a:b] = np.bincount(rows, self.ratios[buckets], b - a) / (n + NEUTRAL)
        return out


def _repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """Per document the words inside windows of five words that it holds twice or more."""
    ids, offsets = numbered(words)
    n, out = len(ids), np.zeros(len(words), np.int64)
    if n < 2:
        return out
    last = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(n) + REPEATED <= last)
    names, counts = ids[at], np.full(int(ids.max()) + 1, 2)
    for k in range(1, REPEATED):  # windows whose first k words aren't repeated go
        held = counts[names] > 1
        at, names = at[held], names[held]
        if not len(at):
            return out
        names, counts = named_pairs(names, ids[at + k])
    at = at[counts[names] > 1]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEATED, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return inside[offsets[1:]] - inside[offsets[:-1]]


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]  # of bytes it strips [\x20\x09-\x0D]
    return len(lines) - len(set(lines))


def features(column: pa.Array) -> np.ndarray:
    """(5, text): the counts named in FEATURES; a null text has none."""
    data, offsets = text_bytes(column)
    out = np.zeros((len(FEATURES), len(column)), np.int64)
    for a, b in slices(data, offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        texts = [part[at[k] : at[k + 1]].tobytes() for k in range(b - a)]
        words = [t.split() for t in texts]
        count = lambda marks, at=at: np.diff(np.concatenate([[0], np.cumsum(marks)])[at])
        out[0, a:b] = [len(w) for w in words]
        out[1, a:b] = count(~IS_BLANK[part] & (part & 0xC0 != 0x80))  # a character's first byte
        out[2, a:b] = count(IS_SYMBOL[part])
        out[3, a:b] = [_duplicate_lines(t) for t in texts]
        out[4, a:b] = _repeated_words(words)
    return out


def _threshold(bins: np.ndarray, trusted: np.ndarray, others: np.ndarray) -> float:
    """The middle of the best cut between bins in ascending order; below all of them where a class is missing."""
    if not trusted.sum() or not others.sum():
        return -np.inf
    kept_others = np.append(others[::-1].cumsum()[::-1], 0) / others.sum()
    lost = np.append(0, trusted.cumsum()) / trusted.sum()
    cost = kept_others + DROPPED_WEIGHT * lost
    best = int(np.argmin(cost))  # everything from bin `best` on is kept
    if best == 0:
        return -np.inf
    return float((bins[best - 1] + 1 + (bins[best] if best < len(bins) else bins[best - 1] + 1)) / 2 * BIN)


def train(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", min_words: int = 10, repeated_percent: int = 20) -> Model:
    """Counts the raw multinomial over all documents, the trusted one over all labelled ones, and sets the threshold by all that are held out.

    No text is shuffled: a label meets its document's n-grams, two bytes each,
    or its score.

    labels: (id_col, label_col 0 or 1), 1 being trusted; of several labels of a
    document the least counts, null labels and ids say nothing.  `held_out`, a
    condition on id_col, has the labelled documents that set the threshold,
    unless they fail the counts, and don't count as trusted.  Each row counts, also where ids repeat.  Without
    trusted documents, or held-out ones of both labels, every text passes.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col)).agg(F.min(label_col).alias("label")).withColumn("held_out", held_out)
    known = known.select(F.col(id_col).cast("long").alias("id"), "label", "held_out").hint("merge")  # at any size, as labels grow with the documents
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    raw = _summed(texts.select("text").mapInArrow(_counted_texts, "bucket long, n long"))
    grams = texts.filter("NOT held_out AND id IS NOT NULL").select("id", "text").mapInArrow(_coded, "id long, grams binary")
    own = _summed(grams.join(known.filter("label = 1 AND NOT held_out").select("id"), "id").select("grams").mapInArrow(_counted_grams, "bucket long, n long"))
    if not own.sum():
        return Model(np.zeros(1 << BUCKET_BITS))
    model = Model(np.log(own + PRIOR) - np.log(raw * (own.sum() / raw.sum()) + PRIOR))

    judged = judge(texts.filter("held_out AND id IS NOT NULL").select("id", "text"), model, "text", min_words, repeated_percent)
    judged = judged.filter("NOT base_failed").select("id", "score").join(known.filter("held_out").select("id", "label"), "id")
    bins = judged.groupBy(F.floor(F.col("score") / BIN).alias("bin")).agg(F.count_if(F.col("label") == 1).alias("trusted"), F.count_if(F.col("label") != 1).alias("others"))
    bins = bins.orderBy("bin").toArrow()  # scores are within 20 of 0
    model.threshold = _threshold(*(bins.column(k).to_numpy() for k in ("bin", "trusted", "others")))
    return model


def judge(docs: DataFrame, model: Model, text_col: str = "text", min_words: int = 10, repeated_percent: int = 20) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept.

    base_failed: fewer than `min_words` words, or more than `repeated_percent`
    of them in windows of five words that the text repeats.  kept: not
    base_failed, and a score of the model's threshold or more.  Every row is
    judged by its whole text alone: equal texts alike, null texts as empty ones
    (they fail), whatever their ids.  An empty table gives an empty one; input
    columns of these names are replaced.
    """
    docs = docs.drop(*FEATURES, "score", "base_failed", "kept").withColumn(text_col, F.col(text_col).cast("string"))
    fields = [T.StructField(n, T.LongType()) for n in FEATURES] + [T.StructField("score", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    schema, at = T.StructType([*docs.schema.fields, *fields]), docs.columns.index(text_col)
    names = schema.names

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, score = features(batch.column(at)), model.scores(batch.column(at))
            failed = (counts[0] < min_words) | (100 * counts[4] > repeated_percent * counts[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, counts), pa.array(score), pa.array(failed), pa.array(~failed & (score >= model.threshold))], names)

    return docs.mapInArrow(judged, schema)
