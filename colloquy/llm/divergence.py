"""Source divergence audit: how far the sources of a language use different terms.

Terms are encoded as integers: of each language the kept terms are sorted and
cut into chunks of one width, so that a term's id is its place in UTF-8 order.
Documents are counted once, per (language, source, term), combined in the tasks
before anything is shuffled.  A chunk then holds its sorted terms and finds ids
by binary search; one bincount gives the dense counts of every source, of which
all differences of the chunk are array operations.  Values are sums over chunks,
and the order of ids decides ties.  All arithmetic is in integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lexing import text_bytes
from .storage import stage

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE = 1_000_000_000
LONG_TEXT = 1 << 22  #: bytes from which a text's terms are counted in parts
HELD_ENTRIES = 300_000  #: terms that a task holds before it sends their counts
CELLS = 1 << 20  #: (source, term) counts of a chunk
WIDTHS = (64, 8192)  #: fewest and most terms of a chunk
COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in lists of bounded size."""
    if len(text) <= LONG_TEXT:
        yield TERM.findall(text.lower())  # of bytes only A-Z are lower-cased
        return
    at = 0
    while at < len(text):
        end = min(at + LONG_TEXT, len(text))
        if cut := TERM.match(text, end - 1):  # the rest of a term that the cut would split
            end = cut.end()
        yield TERM.findall(text[at:end].lower())
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each term by (lang, source), and a row without a term for the group itself."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    entries = 0
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        data, offsets = text_bytes(batch.column(2))
        for k, group in enumerate(zip(langs, sources, strict=True)):
            counts, docs = groups.setdefault(group, (Counter(), Counter()))
            before, own = len(counts), set()
            for terms in _terms(data[offsets[k] : offsets[k + 1]].tobytes()):
                counts.update(terms)
                own.update(terms)
            docs.update(own)
            entries += len(counts) - before
            if entries >= HELD_ENTRIES:
                yield from _sent(groups)
                groups, entries = {}, 0
    yield from _sent(groups)


def _sent(groups: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in groups.items():
        terms = [None, *counts]
        columns = [
            pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
            pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(docs[t] for t in counts)], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def scaled_shares(counts: np.ndarray, totals: np.ndarray | int) -> np.ndarray:
    """floor(10**9 * counts / totals) for 0 <= counts <= totals < 2**53, in 64-bit integers."""
    out, rest = np.zeros(np.broadcast(counts, totals).shape, np.int64), counts
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, totals)
        out = out * 1000 + whole
    return out


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _exact_bincount(cells: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of integers by cell; the two halves stay below the 53 bits of a double."""
    low, high = np.bincount(cells, n & 0x3FFFFFF, size), np.bincount(cells, n >> 26, size)
    return (high.astype(np.int64) << 26) + low.astype(np.int64)


def _chunk(top: int):
    """One chunk of a language: differences of its sources, and the best terms of each."""

    def differences(rows: pa.Table, directory: pa.Table) -> pa.Table:
        of = directory.slice(0, 1).to_pylist()[0]
        sources, totals, kept_terms = of["sources"], np.array(of["totals"], np.int64), of["kept_terms"]
        place = {s: k for k, s in enumerate(sources)}
        found = np.array(rows.column("term").cast(pa.binary()).to_pylist(), object)
        terms = np.array(sorted(set(found.tolist())), object)
        ids = np.searchsorted(terms, found) if len(found) else np.zeros(0, np.int64)
        group = np.array([place[s] for s in rows.column("source").to_pylist()], np.int64)
        counts = _exact_bincount(group * len(terms) + ids, rows.column("n").to_numpy(), len(sources) * len(terms)).reshape(len(sources), len(terms))
        out: list[tuple] = []
        if len(terms):
            p = 1 + scaled_shares(counts + 2, totals[:, None] + 2 * kept_terms)
            q = 1 + scaled_shares(counts.sum(0) + 2, totals.sum() + 2 * kept_terms)
        for k, source in enumerate(sources):
            values = _differences(p[k], p).sum(1).tolist() if len(terms) else [0] * len(sources)
            out += [(of["lang"], source, "pair", sources[o], values[o]) for o in range(len(sources)) if o != k]
            more = np.flatnonzero((counts[k] > 0) & (p[k] > q)) if len(terms) else []
            if len(more):
                value = _differences(p[k, more], q[more])
                best = np.lexsort((more, -value))[:top]
                out += [(of["lang"], source, "term", terms[more[b]].decode(), int(value[b])) for b in best]
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        columns = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "source", "part", "item", "value"])

    return differences


def _numbered(kept: DataFrame, width: int):
    """A staged table (lang, term, chunk): of each language the terms in UTF-8 order, cut into chunks of `width`."""
    ordered = stage(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("at", F.monotonically_increasing_id()), "terms")
    rows = ordered.df.withColumn("part", F.shiftright("at", 33))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = rows.groupBy("lang", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")).withColumn("before", before).drop("n")
    number = F.col("at") - F.col("first") + F.col("before")
    return ordered, rows.join(firsts, ["lang", "part"]).select("lang", "term", F.floor(number / width).cast("long").alias("chunk"))


def audit_sources(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) that occurs.

    Part `pair` compares it with each other source of the language, over all
    terms that `min_docs` documents of the language hold; part `term` has its
    `top` terms that are more frequent than in the language as a whole.  Larger
    values are larger differences; ties are in UTF-8 order.

    Terms are runs of ASCII letters (A-Z as a-z) and characters beyond ASCII.
    Each row is a document, also where ids or texts repeat; null languages,
    sources and texts count as ''.  A group without terms takes part with counts
    of 0, a language without kept terms gives pairs of value 0, an empty table
    gives no rows.  Other columns aren't read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = stage(chosen.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    groups = counted.df.filter("term IS NULL").select("lang", "source")
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = min(max(CELLS // widest, WIDTHS[0]), WIDTHS[1])
    kept = counted.df.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).select("lang", "term")
    ordered, numbered = _numbered(kept, width)
    rows = stage(counted.df.filter("term IS NOT NULL").join(numbered, ["lang", "term"]).select("lang", "chunk", "source", "term", "n"), "chunked-counts")
    totals = groups.join(rows.df.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("of"))
    sizes = ordered.df.groupBy("lang").agg(F.count("*").alias("kept_terms"))
    last = F.greatest(F.ceil(F.col("kept_terms") / width) - 1, F.lit(0))
    directory = (
        totals.join(sizes, "lang", "left").withColumn("kept_terms", F.coalesce("kept_terms", F.lit(0)))
        .select("lang", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk"), F.col("of.source").alias("sources"), F.col("of.total").alias("totals"), "kept_terms")
    )
    parts = rows.df.groupBy("lang", "chunk").cogroup(directory.groupBy("lang", "chunk")).applyInArrow(_chunk(top), "lang string, source string, part string, item string, value long")
    found = stage(parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")), "divergences")
    for s in (counted, ordered, rows):
        s.drop()
    ranked = found.df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
