"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words (runs of letters and digits, lower-cased) and
their beginnings, hashed into 2**18 buckets; a bucket is present or not.  From
a bounded sample of labelled documents a factorization machine learns a weight
for each bucket and a factor vector, whose products stand for pairs of terms:
one that is harmless alone can count beside another.  No bucket is left out for
telling nothing alone.  Scoring is one pass over the texts
with the model in the closure; nothing is shuffled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexing import IS_MARK, SpanHashes, slices, split_words, text_bytes
from .sampling import first_by_hash
from .storage import free_name

BUCKET_BITS = 18
BEGINNINGS = (4, 5, 6)  #: bytes
STEP_DOCS = 128  #: documents of a training step
TERMS = "label double, terms binary"


def hashed_terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each term, bucket of each term) by runs of rows; terms may repeat."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for a, b in slices(data, offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words, hashes = split_words(part, at, IS_MARK), SpanHashes(part)
        rows = words.documents()
        found = [(rows, hashes(words.starts, words.ends))]
        for n in BEGINNINGS:
            longer = words.ends - words.starts > n
            starts = words.starts[longer]
            found.append((rows[longer], hashes(starts, starts + n) + np.uint64(n)))
        yield a, np.concatenate([r for r, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [b""] * batch.num_rows
        for first, rows, buckets in hashed_terms(batch.column(0)):
            pairs = np.unique((rows << BUCKET_BITS) | buckets)
            own, starts = np.unique(pairs >> BUCKET_BITS, return_index=True)
            for row, part in zip(own, np.split(pairs & ((1 << BUCKET_BITS) - 1), starts[1:]), strict=False):
                terms[first + row] = part.astype("<i4").tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(terms, pa.binary())], ["label", "terms"])


@dataclass
class Model:
    index: np.ndarray  #: feature of each bucket, -1 where the bucket has none
    bias: float
    weights: np.ndarray
    factors: np.ndarray  #: (feature, factor)

    def logits(self, n: int, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Of n documents; (row, feature) pairs are distinct."""
        out = self.bias + np.bincount(rows, self.weights[features], n)
        for f in self.factors.T:
            v = f[features]
            out += (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)) / 2
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for first, rows, buckets in hashed_terms(column):
            features = self.index[buckets]
            known = features >= 0
            n_features = len(self.weights) + 1
            pairs = np.unique(rows[known] * n_features + features[known])
            rows, features = pairs // n_features, pairs % n_features
            n = int(rows[-1]) + 1 if len(rows) else 0
            out[first : first + n] = self.logits(n, rows, features)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


@dataclass
class Sample:
    """Labelled documents, each as its distinct buckets."""

    labels: np.ndarray
    offsets: np.ndarray
    buckets: np.ndarray  #: int32; those of document d from offsets[d] on

    def counts(self, weights: np.ndarray | None = None) -> np.ndarray:
        """Documents of each bucket, or their summed weights."""
        own = None if weights is None else np.repeat(weights, np.diff(self.offsets))
        return np.bincount(self.buckets, own, 1 << BUCKET_BITS)

    def batches(self, index: np.ndarray, size: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(labels, features in order, row of each, first place of each feature) of random sets of documents."""
        out, order = [], rng.permutation(len(self.labels))
        for at in range(0, len(order), size):
            docs = order[at : at + size]
            own = [index[self.buckets[self.offsets[d] : self.offsets[d + 1]]] for d in docs]
            flat, rows = np.concatenate(own), np.repeat(np.arange(len(docs), dtype=np.int32), [len(o) for o in own])
            flat, rows = flat[flat >= 0], rows[flat >= 0]
            place = np.argsort(flat, kind="stable")
            flat, rows = flat[place], rows[place]
            out.append((self.labels[docs], flat, rows, np.flatnonzero(np.diff(flat, prepend=-1))))
        return out


def _descend(sample: Sample, index: np.ndarray, factors: int, epochs: int, spread: float, start: float, shrink: tuple[np.ndarray, np.ndarray], rate: float = 0.1, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors of the features in `index` by adaptive gradient descent; each step shrinks weights and whole factor vectors towards zero."""
    rng = np.random.default_rng(seed)
    share, n_features = sample.labels.mean(), int(index.max(initial=-1)) + 1
    bias, w = np.log(share / (1 - share)), np.zeros(n_features, np.float32)
    v = rng.normal(0, spread, (n_features, factors)).astype(np.float32)
    square_b, square_w, square_v = start**2, np.full(n_features, start**2, np.float32), np.full((n_features, 1), start**2, np.float32)
    batches = sample.batches(index, STEP_DOCS, rng)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            labels, features, rows, firsts = batches[k]
            n, own = len(labels), features[firsts]
            vectors = v[features]
            summed = np.stack([np.bincount(rows, vectors[:, f], n) for f in range(factors)], 1).astype(np.float32)
            z = bias + np.bincount(rows, w[features], n) + ((summed**2).sum(1) - np.bincount(rows, (vectors * vectors).sum(1), n)) / 2
            error = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / n).astype(np.float32)
            square_b += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(square_b)
            if not len(firsts):
                continue
            each = error[rows]
            by_weight = np.add.reduceat(each, firsts)
            by_factor = np.add.reduceat(each[:, None] * (summed[rows] - vectors), firsts, axis=0)
            square_w[own] += by_weight**2
            square_v[own, 0] += (by_factor**2).mean(1)
            w[own] -= rate * by_weight / np.sqrt(square_w[own])
            v[own] -= rate * by_factor / np.sqrt(square_v[own])
            w = np.sign(w) * np.maximum(np.abs(w) - rate / np.sqrt(square_w) * shrink[0], 0)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            v *= np.maximum(0, 1 - rate / np.sqrt(square_v) * shrink[1][:, None] / np.maximum(norm, 1e-12))
    return float(bias), w, v


def fit(sample: Sample, factors: int = 8, docs_a_pair: int = 20, min_docs: int = 3, epochs: tuple[int, int] = (5, 25)) -> Model:
    """Learns from distinct buckets per document; 0/1 labels.

    A first pass is over all buckets of `min_docs` documents or more, and
    shrinks what it learns: less where a bucket alone tells the classes apart,
    but a bucket that counts only beside another can keep its factors.  Buckets
    whose weight is left, and those with the largest factors, one for each
    `docs_a_pair` documents, are fitted again without shrinking.  Memory is a few times the sample's buckets.
    """
    n = len(sample.labels)
    share = sample.labels.mean() if n else 0.0
    if not 0 < share < 1:
        odds = np.log((sample.labels.sum() + 0.5) / (n - sample.labels.sum() + 0.5)) if n else -4.0
        return Model(np.full(1 << BUCKET_BITS, -1, np.int32), float(odds), np.zeros(1), np.zeros((1, factors)))
    seen, toxic = sample.counts(), sample.counts(sample.labels)
    known = np.flatnonzero(seen >= min_docs)
    seen, toxic = seen[known], toxic[known]
    chi = (toxic - seen * share) ** 2 / np.maximum(seen * share * (1 - share) * (1 - seen / (n + 1)), 1e-9)
    shrink = np.clip(2 / np.maximum(chi, 1e-9), 0.02, 1).astype(np.float32) / np.sqrt(n)
    _, w, v = _descend(sample, _indexed(known), factors, epochs[0], 0.05, 0.01, (shrink, 0.3 * shrink))
    kept = w != 0
    kept[np.argsort(-np.sqrt((v * v).sum(1) * seen), kind="stable")[: n // docs_a_pair]] = True
    index, none = _indexed(known[kept]), np.zeros(int(kept.sum()), np.float32)
    bias, w, v = _descend(sample, index, factors, epochs[1], 0.02, 0.03, (none, none))
    return Model(index, bias, *((w.astype(float), v.astype(float)) if len(w) else (np.zeros(1), np.zeros((1, factors)))))


def _indexed(buckets: np.ndarray) -> np.ndarray:
    index = np.full(1 << BUCKET_BITS, -1, np.int32)
    index[buckets] = np.arange(len(buckets), dtype=np.int32)
    return index


def _sample(batches: list[pa.RecordBatch]) -> Sample:
    """Rows (label, terms) in an order that doesn't depend on the batches."""
    table = pa.Table.from_batches(batches, pa.schema([("label", pa.float64()), ("terms", pa.binary())])).sort_by([("label", "ascending"), ("terms", "ascending")]).combine_chunks()
    ends = np.cumsum(pc.binary_length(table.column("terms")).to_numpy()) // 4
    buckets = np.concatenate([np.frombuffer(t.as_buffer(), "<i4") for t in table.column("terms")]) if len(ends) else np.zeros(0, np.int32)
    return Sample(table.column("label").to_numpy(), np.concatenate([[0], ends]).astype(np.int64), buckets)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 10_000, factors: int = 8) -> Model:
    """Fits on at most `sample` labelled documents, those with the smallest id hashes; the bound holds at any size.

    Null labels and ids teach nothing; of several labels of a document the
    largest counts; each row of a repeated doc_id teaches, up to twice the
    sample.  With labels of one class only, every score is their share; without
    any, it is 0.02.  One task learns, so that the driver holds the model only.
    """
    own, known = free_name("__id", docs), free_name("__label", docs)
    labelled = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(own)).agg(F.max(label_col).cast("double").alias(known))
    bounded = F.broadcast(first_by_hash(labelled, own, sample))  # at most `sample` rows of two numbers
    rows = docs.join(bounded, docs[id_col] == F.col(own)).select(F.col(text_col).cast("string"), known)

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(_sample(list(batches)), factors))], pa.binary())], ["model"])

    chosen = rows.mapInArrow(_distinct_terms, TERMS).limit(2 * sample)  # one partition
    models = chosen.mapInArrow(learnt, "model binary").toArrow().column("model")
    return pickle.loads(models[0].as_py()) if len(models) else fit(_sample([]), factors)  # no rows, no task


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on); null and empty texts score the model's bias.

    Every row is scored by its text alone, whole however long; rows with equal
    texts or ids score alike and all stay, as do rows with a null id.  An empty
    table gives an empty one.  Input columns named score or predicted are
    replaced.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(names.index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return docs.mapInArrow(scored, schema)
