"""Canonical conversation tables, read or derived from parquet."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import asset_kind, object_key, parsed_key, safe_path

EPOCH = 1704067200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str, seconds_per_tick: int = 1, turns_per_tick: int = 1) -> DataFrame:
    """Chat messages: one a turn.  With turns_per_tick over 1 neighbours share a time, as in stores that keep coarse times."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
        F.floor(F.length("text") / 4).cast("long").alias("token_count"),
        F.timestamp_seconds(F.lit(EPOCH) + F.floor(F.col("turn") / turns_per_tick) * seconds_per_tick).alias("created_at"),
    )


def agent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with tool calls and results, made from events by rule: a user's events are a session."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind, e = F.col("event_type"), F.col("event_id")
    call = lambda n: F.struct(F.concat(F.lit("c"), (k + n) % 5).alias("id"), F.concat(F.lit("tool"), k % 3).alias("name"), F.when(e % 6 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("arguments"))
    role = F.when(kind == "view", "user").when(kind == "purchase", "tool").when(kind == "error", "system").otherwise("assistant")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"), e.alias("seq"), role.alias("role"),
        F.when(e % 7 == 0, None).when(e % 11 == 0, "").otherwise(F.concat(kind, F.lit(" "), k)).alias("content"),
        F.when(e % 4 == 0, F.concat(F.lit("r"), k)).alias("reasoning_content"),
        F.when(e % 10 == 0, None).otherwise(k * 3 + 1).alias("token_count"),
        F.when(kind == "click", F.array(call(0), call(1))).alias("tool_calls"),
        F.when(kind == "purchase", F.concat(F.lit("c"), k % 5)).alias("tool_call_id"),
        F.when(e % 2 == 0, F.concat(F.lit("tool"), k % 3)).alias("name"),
        F.when(e % 13 != 0, e % 3 == 0).alias("ephemeral"), F.col("ts").alias("created_at"), (k % 4).cast("int").alias("model_id"),
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream deltas made from events: a user's events are the fragments of one step."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("step"), F.col("event_id").alias("seq"),
        F.when(kind.isin("click", "error"), F.concat(F.lit("r"), k)).alias("reasoning_content"),
        F.when(kind.isin("purchase", "view") & (F.col("user_id") % 3 != 0), F.concat(F.lit("t"), k)).when(kind == "signup", "").alias("content"),
        F.when(kind == "signup", k % 3).alias("slot"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("id"), k)).otherwise("").alias("call_id"),
        F.concat(F.lit("n"), k % 2).alias("call_name"), F.concat(F.lit("a"), k).alias("call_arguments"),
        F.when(F.col("event_id") % 97 == 0, "tool_calls").when(F.col("event_id") % 89 == 0, "").alias("finish_reason"),
    )


def skills(spark: SparkSession) -> DataFrame:
    """A small fixed table; a skill table is a dimension of some hundreds of rows."""
    rows = [
        ("alpha", "Alpha", ["the", "Tion", "", "the"], "1.0", True), ("beta", "Beta", ["es", "de la"], "0.9.0", True),
        ("beta", "Beta", ["es"], "0.10.0", True), ("gamma", "Gamma", ["zzz"], "2", True), ("delta", "Delta", ["ing"], "1", False), ("omega", "Omega", ["HE", "an"], "1", True),
    ]
    return spark.createDataFrame(rows, "skill_id string, display_name string, triggers array<string>, version string, enabled boolean").coalesce(1)


def read_assets(spark: SparkSession, root: str, requests: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """requests (request_id, object_key): the bytes of `<root>/<skill>/<version>/<path>`, else those of stored (object_key, data).

    Keys that leave the skill's folder, or are none, are `bad_key`; what is in neither place is `not_found`.
    Files are listed without their bytes; only those that a request names are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    pattern = r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + r"/([^/]+)/([^/]+)/(.+)$"
    part = lambda n: F.regexp_extract("path", pattern, n)
    parsed = parsed_key(F.col("object_key"))
    good = parsed.isNotNull() & safe_path(parsed["path"]) & safe_path(parsed["skill_id"]) & safe_path(parsed["version"])
    rows = requests.withColumn("__good", F.coalesce(good, F.lit(False)))
    listed = files.select("path", object_key(part(1), part(2), part(3)).alias("object_key"))
    wanted = listed.join(rows.filter("__good").select("object_key").distinct(), "object_key", "left_semi")
    local = wanted.select("object_key", "path").mapInArrow(_contents, "object_key string, __local binary")
    rows = rows.join(local, "object_key", "left")
    rows = rows.join(stored.select("object_key", F.col("data").alias("__stored")), "object_key", "left") if stored is not None else rows.withColumn("__stored", F.lit(None).cast("binary"))
    data = F.when(F.col("__good"), F.coalesce("__local", "__stored"))
    outcome = F.when(~F.col("__good"), "bad_key").when(data.isNull(), "not_found").when(F.col("__local").isNotNull(), "local").otherwise("stored")
    return rows.select("request_id", outcome.alias("outcome"), data.alias("data"))


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if re.match("file:/[^/]", uri) else uri if "://" in uri else "file://" + uri)


def write_assets(assets: DataFrame, root: str) -> int:
    """Writes assets (object_key, data) as files `<root>/<skill>/<version>/<path>`; how many.  Keys that are none, or unsafe, are left out."""
    parsed = parsed_key(F.col("object_key"))
    good = parsed.isNotNull() & safe_path(parsed["path"]) & safe_path(parsed["skill_id"]) & safe_path(parsed["version"])
    files = assets.filter(good).select(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("object_key", "^skills/", "")).alias("path"), "data")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = opened(path)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as stream:
                    stream.write(data or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(object_key, path) to (object_key, bytes), one file at a time; a file that has gone since it was listed is null."""
    for batch in batches:
        for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                files, at = opened(path)
                with files.open_input_stream(at) as stream:
                    data = stream.readall()
            except FileNotFoundError:
                data = None
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([data], pa.binary())], ["object_key", "__local"])


def read_bundles(spark: SparkSession, root: str) -> DataFrame:
    """Files of skill bundles `<root>/<skill>/<version>/...` but SKILL.md: skill_id, version, path, kind, object_key, size_bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    pattern = r"^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + r"/([^/]+)/([^/]+)/(.+)$"
    inner = F.regexp_extract("path", pattern, 3)
    skill, version = F.regexp_extract("path", pattern, 1), F.regexp_extract("path", pattern, 2)
    return files.filter(inner != "SKILL.md").select(
        skill.alias("skill_id"), version.alias("version"), inner.alias("asset_path"), asset_kind(inner).alias("kind"), object_key(skill, version, inner).alias("object_key"), F.col("length").alias("size_bytes")
    )
