"""Line dedup: levelled sorted runs of line hashes, merge-anti-joined batch by batch.

Documents come in batches of descending doc_id.  A batch's line keys become a
run of (key, owner, n_docs), in files by hash of the key, sorted in each.  It is
merge-joined with the runs so far, file by file, none of which is shuffled or
read but for its keys: a key that no run holds is fresh, and its largest document in the batch is
its owner, for good.  The batch then marks what would go: every line of a known
key, and of a fresh one all but the owner's.  Known keys add to n_docs only.
When a level holds `fanout` runs they are compacted into one run of the next;
of a key's rows one has the owner, and the counts are summed.  At the end marks
whose key has enough documents count.  Runs are small tables (16-byte keys),
kept in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexing import BLANKS, slices, text_bytes
from .storage import Bucketed, finished, free_name, stage

RUN_SCHEMA = "key binary, owner long, n_docs long"
BATCH_KEYS, LEAST_BATCHES = 500_000_000, 4  #: line keys of a batch at most
FILE_KEYS, LEAST_FILES = 4_000_000, 4  #: line keys for each file of a run


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped, ASCII-lower-cased line; None for lines under min_chars code points."""
    line = line.strip(BLANKS)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.md5(line.lower(), usedforsecurity=False).digest()


class LineRuns:
    """Levels of sorted runs; level i + 1 holds compacted runs of level i."""

    def __init__(self, spark: SparkSession, fanout: int = 3, files: int = 8):
        self.spark, self.fanout, self.files = spark, fanout, files
        self.levels: list[list[Bucketed]] = []
        self.merged: list[Bucketed] = []  #: into a higher level; deleted at the next batch

    def held(self) -> list[Bucketed]:
        return [r for level in self.levels for r in level]

    def runs(self) -> DataFrame:
        out = self.spark.createDataFrame([], RUN_SCHEMA)
        for run in self.held():
            out = out.unionByName(run.plain)
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (key, doc_id), distinct; returns its marks: the rows that don't own their keys.

        Batches come in descending order of doc_id.  The marks are to be read
        before the next batch.
        """
        self._tidy()
        batch = batch.repartition(self.files, "key")
        run = batch.groupBy("key").agg(F.max("doc_id").alias("owner"), F.count("*").alias("n_docs"))
        flags = []
        for number, held in enumerate(self.held()):
            flags.append(F.col(f"in_{number}"))
            run = run.hint("merge").join(held.df.select("key", F.lit(True).alias(f"in_{number}")), "key", "left")
        owner = F.when(F.coalesce(*flags).isNull(), F.col("owner")) if flags else F.col("owner")
        added = self._written(run.select("key", owner.alias("owner"), "n_docs"))
        self._push(0, added)
        several = added.df.filter("owner IS NULL OR n_docs > 1").select("key", "owner")
        return batch.join(several.hint("merge"), "key").filter("owner IS NULL OR doc_id <> owner").select("key", "doc_id")

    def _written(self, run: DataFrame) -> Bucketed:
        return Bucketed(run, "line-run", "key", self.files)

    def _push(self, level: int, run: Bucketed) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._merged(old))

    def _merged(self, runs: list[Bucketed]) -> Bucketed:
        rows = runs[0].plain
        for r in runs[1:]:
            rows = rows.unionByName(r.plain)
        rows = rows.repartition(self.files, "key").groupBy("key").agg(F.any_value("owner", True).alias("owner"), F.sum("n_docs").alias("n_docs"))
        out = self._written(rows)
        self.merged += runs
        return out

    def _tidy(self) -> None:
        for run in self.merged:
            run.drop()
        self.merged = []

    def compacted(self) -> DataFrame:
        """All runs as one: key, owner, n_docs."""
        if len(every := self.held()) > 1:
            self.levels = [[self._merged(every)]]
        self._tidy()
        return self.runs()


def _keys_of(min_chars: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(*text_bytes(batch.column(1))):
                ids, found = [], []
                for doc_id, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).cast(pa.binary()).to_pylist(), strict=True):
                    if doc_id is None or text is None:
                        continue
                    own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                    ids += [doc_id] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "key"])

    return keys


def _rewritten(text: int, dropped: int, min_chars: int, names: list[str]):
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, high - low) for b in batches for low, high in slices(*text_bytes(b.column(text)))):
            out, lines_in, lines_off = [], [], []
            for body, keys in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column(dropped).to_pylist(), strict=True):
                n = 1 + (body or b"").count(b"\n")
                gone = 0
                if keys and body is not None:
                    keys = set(keys)
                    kept = [line for line in body.split(b"\n") if line_key(line, min_chars) not in keys]
                    gone = n - len(kept)
                    body = b"\n".join(kept)
                out.append(body)
                lines_in.append(n)
                lines_off.append(gone)
            columns = [c for i, c in enumerate(batch.columns) if i != dropped]
            columns[text] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines_in, pa.int64()), pa.array(lines_off, pa.int64())], names)

    return rewrite


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """Drops lines whose key is found in min_docs documents or more, except in the largest doc_id that holds it.

    Returns docs' columns with the text rewritten, and n_lines (before) and
    n_dropped; input columns of these two names are replaced.  A null text
    counts as one empty line and stays null; rows without an id are returned
    as they are and count for nothing; rows that share an id count as one
    document.  An empty table gives an empty one.  Repeated lines of one
    document stay together: all of them stay or all go.  Other columns may have
    any name.  Batches are as many as keep a batch at BATCH_KEYS line keys, four
    at least, unless their number is given.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(_keys_of(min_chars), "doc_id long, key binary")
    shared = docs.groupBy(F.col(id_col).cast("long")).count().filter("count > 1")  # a row's keys are distinct; ids on several rows need more
    held = stage(keys if shared.isEmpty() else keys.distinct(), "line-keys")
    n_keys = held.df.count()
    batches = batches or max(LEAST_BATCHES, -(-n_keys // BATCH_KEYS))
    cuts = sorted(set(held.df.approxQuantile("doc_id", [i / batches for i in range(1, batches)], min(0.01, 0.2 / batches))) if batches > 1 else [], reverse=True)
    runs, marked = LineRuns(spark, fanout, max(LEAST_FILES, -(-n_keys // FILE_KEYS))), []
    for low, high in zip([*cuts, None], [None, *cuts], strict=True):
        marked.append(stage(runs.add(held.df.filter(_within("doc_id", low, high))), "line-marks"))
    held.drop()
    marks = marked[0].df
    for m in marked[1:]:
        marks = marks.unionByName(m.df)
    common = runs.compacted().filter(F.col("n_docs") >= min_docs).select("key")
    own, drop = free_name("__id", docs), free_name("__drop", docs)
    drops = stage(marks.join(common, "key", "left_semi").groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("key").alias(drop)), "line-drops")
    for s in (*marked, *runs.held()):
        s.drop()
    finished(spark)
    joined = docs.join(drops.df.hint("shuffle_hash"), F.col(id_col).cast("long") == F.col(own), "left").select(*docs.columns, drop)
    schema = T.StructType([*docs.withColumn(text_col, F.col(text_col).cast("string")).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_rewritten(docs.columns.index(text_col), len(docs.columns), min_chars, schema.names), schema)


def _within(name: str, low: float | None, high: float | None) -> Column:
    """low <= name < high; None is open."""
    held = F.lit(True)
    if low is not None:
        held = held & (F.col(name) >= int(low))
    if high is not None:
        held = held & (F.col(name) < int(high))
    return held
