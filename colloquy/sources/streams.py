"""File streams, and bounded runs of them that end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..streaming.hot_context import OUTPUT, hot_context, live_context
from .shared import is_folder, remove, temporary_folder

NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(stream: DataFrame, folder: str, run: int, mode: str, no_data: bool, timeout: int | None) -> None:
    """Runs a stream over what its source holds now, which is its end; appends each batch's rows, with its number, so that a repeated batch replaces itself.

    timeout: seconds, if the caller knows how long the source may take; None waits for the end, however much there is.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in (NO_DATA_BATCHES, PROVIDER)}
    spark.conf.set(NO_DATA_BATCHES, str(no_data).lower())
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        write = lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{folder}/rows/part={batch}")
        running = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        try:
            if running.awaitTermination(timeout) is False:
                raise TimeoutError(f"run {run} of the stream has not come to the end of its source")
        finally:
            running.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _own_folder(spark: SparkSession) -> str:
    return temporary_folder(spark, "stream")


def _rows(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", "true").parquet(f"{folder}/rows")


def _last(rows: DataFrame, key: str) -> DataFrame:
    return rows.join(rows.groupBy(key).agg(F.max("batch").alias("batch")), [key, "batch"]).drop("batch")


def run_to_end(spark: SparkSession, stream: DataFrame, schema: str, key: str, no_data: bool = False, timeout: int | None = None) -> DataFrame:
    """Runs an update-mode stream over what its source holds now; returns the last rows of each key.

    With `no_data` it goes on, without data, as long as the watermark's progress has timers to fire.
    """
    folder = _own_folder(spark)
    _run(stream, folder, 0, "update", no_data, timeout)
    return _last(_rows(spark, folder, schema), key)


def run_in_parts(rows: DataFrame, order: str, transform: Callable[[DataFrame], DataFrame], schema: str, parts: int = 3, timeout: int | None = None) -> DataFrame:
    """All rows that a stream sends whose source gets `rows` in `parts` ranges of `order`, one run after the other from one checkpoint."""
    spark, folder = rows.sparkSession, _own_folder(rows.sparkSession)
    bounds = rows.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    step = (high - low) // parts + 1
    for run in range(parts):
        rows.filter((F.col(order) >= low + run * step) & (F.col(order) < low + (run + 1) * step)).write.mode("append").parquet(f"{folder}/source")
        source = spark.readStream.schema(rows.schema).parquet(f"{folder}/source")
        _run(transform(source), folder, run, "append", False, timeout)
    remove(spark, f"{folder}/source")
    return _rows(spark, folder, schema).drop("batch")


def _table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table as a stream of files; path: one file, or a folder of them."""
    read = spark.readStream.schema(schema)
    if is_folder(spark, path):
        return read.parquet(path)
    folder, name = path.rsplit("/", 1)
    return read.option("pathGlobFilter", name).parquet(folder)


def recent_messages(spark: SparkSession, sf_dir: str, size: int = 50) -> DataFrame:
    """(session_id, seq, n) of the newest messages of every user of `events`, read as a stream."""
    path = f"{sf_dir}/events.parquet"
    stream = _table_stream(spark, path, spark.read.parquet(path).schema)
    events = stream.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), F.col("event_type").alias("content"))
    return run_to_end(spark, hot_context(events, size, None), OUTPUT, "session_id").select("session_id", "seq", F.col("n").cast("long").alias("n"))


def live_messages(spark: SparkSession, sf_dir: str, cut: str, size: int = 50, limit: int = 20) -> DataFrame:
    """(session_id, seq, n) of the sessions that are alive at the end of `events`: those from `cut` on come as a stream, the others are stored history."""
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    shaped = lambda rows: rows.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("content"))
    stream = shaped(_table_stream(spark, path, batch.schema)).filter(F.col("created_at") >= F.lit(cut).cast("timestamp")).withWatermark("created_at", "0 seconds")
    stored = shaped(batch).filter(F.col("created_at") < F.lit(cut).cast("timestamp"))
    rows = run_to_end(spark, live_context(stream, stored, size, limit=limit), OUTPUT, "session_id", no_data=True)
    return rows.filter("seq IS NOT NULL").select("session_id", "seq", F.col("n").cast("long").alias("n"))
