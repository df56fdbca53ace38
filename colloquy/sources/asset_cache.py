"""Assets of an object store behind a cache of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_name
from .shared import exists
from .tables import opened


class AssetCache:
    """Files below `root`, named by a hash of their keys, and a table of when each was used.

    fetch(key) gives an object's bytes, or None where there is none; it runs in
    tasks, once for each key that the cache lacks.
    """

    def __init__(self, spark: SparkSession, root: str, fetch: Callable[[str], bytes | None]):
        self.spark, self.root, self.fetch = spark, root.rstrip("/"), fetch

    def read(self, requests: DataFrame, batch: int, now: datetime) -> DataFrame:
        """(request_id, outcome, data, message) of requests (request_id, object_key).

        Outcomes: bad_key for an empty or null key, cached, fetched, not_found,
        or failed with what the store raised; a failure is one key's own.  What
        is read counts as used at `now`; a batch that is read again replaces
        itself.  A key's file is looked for again in the task that would fetch
        it and written under another name first, so a repeated task finds it
        whole or not at all.
        """
        keys = requests.filter("object_key <> ''").select("object_key").distinct().withColumn("name", cache_name(F.col("object_key")))
        files, fetch = f"{self.root}/files", self.fetch

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for key, name in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    outcome, data, message = _loaded(f"{files}/{name}", key, fetch)
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([name]), pa.array([outcome]), pa.array([data], pa.binary()), pa.array([message], pa.string())], ["object_key", "name", "outcome", "data", "message"])

        path = f"{self.root}/reads/batch={batch}"
        keys.mapInArrow(load, "object_key string, name string, outcome string, data binary, message string").write.mode("overwrite").parquet(path)
        read = self.spark.read.parquet(path)
        read.filter("data IS NOT NULL").select("name", F.lit(now).cast("timestamp").alias("used_at")).write.mode("overwrite").parquet(f"{self.root}/uses/batch={batch}")
        found = requests.join(read.drop("name"), "object_key", "left")
        return found.select("request_id", F.coalesce("outcome", F.lit("bad_key")).alias("outcome"), "data", "message")

    def drop_unused(self, now: datetime, seconds: int) -> int:
        """Deletes the files that were last used more than `seconds` before `now`; how many."""
        if not exists(self.spark, f"{self.root}/uses"):
            return 0
        last = self.spark.read.schema("name string, used_at timestamp, batch int").parquet(f"{self.root}/uses").groupBy("name").agg(F.max("used_at").alias("used_at"))
        old = last.filter(F.col("used_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))).select("name")
        files = f"{self.root}/files"

        def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for rows in batches:
                for name in rows.column(0).to_pylist():
                    store, at = opened(f"{files}/{name}")
                    if store.get_file_info(at).type == pa.fs.FileType.File:
                        store.delete_file(at)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return old.mapInArrow(delete, "n long").agg(F.sum("n")).first()[0] or 0


def _loaded(path: str, key: str, fetch: Callable[[str], bytes | None]) -> tuple[str, bytes | None, str | None]:
    store, at = opened(path)
    if store.get_file_info(at).type == pa.fs.FileType.File:
        with store.open_input_stream(at) as stream:
            return "cached", stream.readall(), None
    try:
        data = fetch(key)
    except Exception as e:  # of one object; the others are read
        return "failed", None, f"{type(e).__name__}: {e}"
    if data is None:
        return "not_found", None, None
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    staged = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(staged) as stream:
        stream.write(data)
    store.move(staged, at)
    return "fetched", data, None
