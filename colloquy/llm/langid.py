"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

Subwords are byte n-grams of the lower-cased text in which every ASCII
non-letter is a blank.  A document's vector is the mean of its subwords'
embeddings; a linear softmax follows.  Both are trained by stochastic gradient
descent in numpy on a bounded sample with a quota for each language.  A part of
the sample is kept for calibration: a temperature that makes probabilities
honest, and the least probability at which a prediction is accepted.  For
prediction embeddings and softmax are folded into one table (bucket x language),
as mean and product commute.
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

from .lexing import slices, text_bytes

UNKNOWN = "und"
BUCKET_BITS = 16
SIZES = (2, 3, 4)
LETTER = r"\p{L}"
_folded = np.arange(256, dtype=np.uint8)
_folded[[b for b in range(128) if not chr(b).isalpha()]] = 32


def subwords(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """(first row, byte offsets, buckets of the n-grams from each byte on) by runs of rows; the last bytes of a row have none, -1."""
    data, offsets = text_bytes(pc.utf8_lower(column.cast(pa.large_string())))
    for a, b in slices(data, offsets):
        codes = _folded[data[offsets[a] : offsets[b]]].astype(np.uint32)
        at = offsets[a : b + 1] - offsets[a]
        found = []
        gram = codes.copy()
        for n in range(2, max(SIZES) + 1):
            gram[: max(0, len(codes) - n + 1)] |= codes[n - 1 :] << np.uint32(8 * (n - 1))
            if n in SIZES:
                buckets = ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
                for k in range(1, n):
                    ends = at[1:] - k
                    buckets[ends[ends >= at[:-1]]] = -1
                found.append(buckets)
        yield a, at, found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(b"", b"")] * batch.num_rows
        for first, at, grams in subwords(batch.column(0)):
            for i in range(len(at) - 1):
                own = np.concatenate([g[at[i] : at[i + 1]] for g in grams])
                buckets, counts = np.unique(own[own >= 0], return_counts=True)
                out[first + i] = (buckets.astype("<u2").tobytes(), counts.astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], ["lang", "buckets", "counts"])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  #: bucket x language
    bias: np.ndarray
    temperature: float
    accept: float  #: least probability of an accepted prediction

    def probabilities(self, column: pa.Array) -> np.ndarray:
        z = np.tile(self.bias, (len(column), 1)).astype(float)
        n_lang = len(self.languages)
        for first, at, grams in subwords(column):
            docs = np.flatnonzero(np.diff(at) > 0)
            if not len(docs):
                continue
            total, count = np.zeros((len(docs), n_lang)), np.zeros(len(docs))
            for g in grams:
                known = g >= 0
                count += np.add.reduceat(known, at[docs], dtype=np.int64)
                for k in range(n_lang):
                    total[:, k] += np.add.reduceat(np.where(known, self.table[g, k], 0), at[docs], dtype=np.float64)
            z[first + docs] += total / np.maximum(count, 1)[:, None]
        return _softmax(z / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(languages: list[str], labels: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], dims: int = 12, epochs: int = 8, rate: float = 0.5, error: float = 0.01, seed: int = 11) -> Model:
    """docs: (distinct buckets, their shares, which sum to 1)."""
    rng = np.random.default_rng(seed)
    n_lang = len(languages)
    emb, out, bias = rng.normal(0, 0.1, (1 << BUCKET_BITS, dims)), rng.normal(0, 0.1, (dims, n_lang)), np.zeros(n_lang)
    order = rng.permutation(len(docs))
    held = order[: len(docs) // 5]
    taught = order[len(docs) // 5 :] if len(docs) >= 5 else order
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for d in rng.permutation(taught):
            buckets, shares = docs[d]
            if not len(buckets):
                continue
            mean = shares @ emb[buckets]
            g = _softmax((mean @ out + bias)[None])[0]
            g[labels[d]] -= 1
            into = out @ g
            out -= step * np.outer(mean, g)
            bias -= step * 0.1 * g
            emb[buckets] -= step * 20 * shares[:, None] * into
    table = (emb @ out).astype(np.float32)
    temperature, accept = 1.0, 0.0
    if len(held) and n_lang > 1:
        z = np.array([docs[d][1] @ table[docs[d][0]] + bias if len(docs[d][0]) else bias for d in held])
        y = labels[held]
        losses = {t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
        temperature = min(losses, key=losses.get)
        p = _softmax(z / temperature)
        best, wrong = p.max(1), p.argmax(1) != y
        for t in np.sort(np.unique(np.append(best, 0.0))):  # the least threshold under which accepted errors are few
            if wrong[best >= t].mean() <= error:
                accept = float(t)
                break
    return Model(languages, table, bias, float(temperature), accept)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 4000) -> Model:
    """Fits on about `sample` documents (twice that at most), the same number of each language where it has so many.

    The bound holds at any size.  Rows with a null text or language teach
    nothing; repeated rows and ids teach as often as they occur.  Without a row
    to learn from the model has no language, and every text is `und`.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    quota = max(1, sample // len(counts))
    languages = sorted(counts)
    unit = F.pmod(F.xxhash64(F.coalesce(F.col(id_col), F.xxhash64(text_col))), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, quota / counts[k]))])[F.col(lang_col)], F.lit(0.0))
    chosen = known.filter(unit < share).select(F.col(text_col).cast("string"), F.col(lang_col))
    rows = chosen.mapInArrow(_counted, "lang string, buckets binary, counts binary").limit(2 * sample).toArrow().sort_by([("lang", "ascending"), ("buckets", "ascending"), ("counts", "ascending")])
    place = {k: i for i, k in enumerate(languages)}
    features = []
    for b, c in zip(rows.column("buckets").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        weights = np.frombuffer(c, "<u4").astype(float)
        features.append((np.frombuffer(b, "<u2").astype(np.int64), weights / max(1.0, weights.sum())))
    return fit(languages, np.array([place[k] for k in rows.column("lang").to_pylist()], np.int64), features)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (its probability) and rejected (the probability is under the calibrated bound).

    A text that is null or has no letter is `und` with score 0, and rejected,
    as is every text if the model has no language.  Ties go to the language
    that is first in alphabetical order.  Texts are read whole; each row is
    predicted from its text alone, so repeated texts get equal answers, and
    rows with a null id stay.  An empty table gives an empty one.  Input
    columns of the three names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    place = docs.columns.index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            if not model.languages:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))], schema.names)
                continue
            p = model.probabilities(column)
            written = pc.fill_null(pc.match_substring_regex(column, LETTER), False).to_numpy(zero_copy_only=False)
            names = np.where(written, np.array(model.languages, object)[p.argmax(1)], UNKNOWN)
            best = np.where(written, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(best), pa.array(~written | (best < model.accept))], schema.names)

    return docs.mapInArrow(predicted, schema)
