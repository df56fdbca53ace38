"""Compression of long sessions as a step of a stream: summarise, store, and replace the recent rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import summary_request
from ..operators.history import compression_text, token_window
from ..sources.shared import exists, names, remove

Summarise = Callable[[list[str]], list[str | None]]
SUMMARIES = "session_id string, current_summary string, summary_updated_at timestamp"


class Compression:
    """Summaries and recent rows below `path`, one folder a batch; `step` is a function for foreachBatch.

    A batch writes three things in order: its summaries, the rows that are kept
    of the sessions that got one, and a marker.  Readers look at marked batches
    only.  A batch that comes again after its marker does nothing; one that
    comes again before it keeps the summaries that are already there, as asking
    a model twice gives two answers, and writes the rest anew.
    """

    def __init__(self, spark: SparkSession, path: str, summarise: Summarise, limit: int = 128_000, low: float = 0.5, high: float = 0.8):
        self.spark, self.path, self.summarise = spark, path.rstrip("/"), summarise
        self.limit, self.low, self.high = limit, low, high

    def _folder(self, table: str, batch: int) -> str:
        return f"{self.path}/{table}/batch={batch}"

    def step(self, recent: DataFrame, batch: int) -> None:
        """recent: (session_id, seq, role, content, token_count, created_at), all recent rows of the sessions of the batch."""
        if exists(self.spark, self._folder("done", batch)):
            return
        windowed = token_window(recent, self.limit, self.low, self.high)
        if not exists(self.spark, self._folder("summaries", batch) + "/_SUCCESS"):
            self._summaries(windowed).write.mode("overwrite").parquet(self._folder("summaries", batch))
        made = self.spark.read.schema(SUMMARIES).parquet(self._folder("summaries", batch))
        kept = windowed.filter("kept").drop("kept", "compress").join(made.select("session_id"), "session_id", "left_semi")
        kept.write.mode("overwrite").parquet(self._folder("recent", batch))
        made.select("session_id").limit(0).write.mode("overwrite").parquet(self._folder("done", batch))

    def _summaries(self, windowed: DataFrame) -> DataFrame:
        """New summaries of the sessions that are over the limit; none where the model fails or says nothing."""
        texts = compression_text(windowed)
        times = windowed.groupBy("session_id").agg(F.max("created_at").cast("timestamp").alias("at"))
        asked = texts.join(times, "session_id").join(self.summaries().select("session_id", "current_summary"), "session_id", "left")
        rows = asked.select(F.col("session_id").cast("string"), "at", summary_request(F.col("text"), F.col("current_summary")).alias("request"))
        summarise = self.summarise

        def answer(requests: list[str]) -> list[str | None]:
            try:
                return list(summarise(requests))
            except Exception:  # a batch with a request that fails is asked one by one
                if len(requests) == 1:
                    return [None]
                return [a for r in requests for a in answer([r])]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                answers = answer(batch.column(2).to_pylist()) if batch.num_rows else []
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), batch.column(1)], ["session_id", "current_summary", "summary_updated_at"])

        return rows.mapInArrow(run, SUMMARIES).filter(F.trim(F.regexp_replace("current_summary", r"\s+", " ")) != "")

    def _read(self, table: str, schema: str) -> DataFrame:
        """The rows of marked batches, with their batch."""
        if not exists(self.spark, f"{self.path}/done"):
            return self.spark.createDataFrame([], f"{schema}, batch long")
        last = max((int(n.rsplit("=", 1)[1]) for n in names(self.spark, f"{self.path}/done") if "=" in n), default=-1)  # batches are marked in order
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/{table}").filter(F.col("batch") <= last)

    def summaries(self) -> DataFrame:
        """(session_id, current_summary, summary_updated_at) of the latest batch that gave the session one."""
        return self._latest(self._read("summaries", SUMMARIES)).drop("batch")

    def recent(self, schema: str = "session_id string, seq long, role string, content string, token_count long, created_at timestamp") -> DataFrame:
        """The rows that replace a session's recent rows, of the latest batch that gave it a summary; a session can be without any."""
        rows = self._read("recent", schema)
        last = self._latest(self._read("summaries", SUMMARIES)).select("session_id", "batch")
        return rows.join(last, ["session_id", "batch"], "left_semi").drop("batch")

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        own = Window.partitionBy("session_id").orderBy(F.desc("batch"))
        return rows.withColumn("__rank", F.row_number().over(own)).filter("__rank = 1").drop("__rank")

    def forget(self, batch: int) -> None:
        """Removes the marker of a batch, so that it can be done again with its summaries."""
        remove(self.spark, self._folder("done", batch))
