"""Topics as files: a data source that writes messages once each, for batches and for streams."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "topic_files"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]  #: relative to the path
    rows: int


class _Files:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def at(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", "file://", 1) if self.path.startswith("file:") else "file://" + self.path)

    def write_rows(self, rows: Iterator[Row]) -> Written:
        """One file for each topic of the task, of a name that no other attempt has."""
        files, root = self.at()
        attempt, open_files, n = uuid.uuid4().hex, {}, 0
        for row in rows:
            if "\n" in row.value:
                raise ValueError("a value holds a line break")
            if row.topic not in open_files:
                name = f"topics/{row.topic}/{attempt}.jsonl"
                files.create_dir(f"{root}/topics/{row.topic}", recursive=True)
                open_files[row.topic] = (name, files.open_output_stream(f"{root}/{name}"))
            open_files[row.topic][1].write(row.value.encode() + b"\n")
            n += 1
        for _, stream in open_files.values():
            stream.close()
        return Written([name for name, _ in open_files.values()], n)

    def mark(self, name: str, messages: list[Written | None]) -> None:
        """The list of what counts; where it exists already, this is a repeated batch, and its files go."""
        files, root = self.at()
        if files.get_file_info(f"{root}/commits/{name}").type != pa.fs.FileType.NotFound:
            self.drop(messages)
            return
        files.create_dir(f"{root}/commits", recursive=True)
        staged = f"{root}/.staged-{uuid.uuid4().hex}"
        with files.open_output_stream(staged) as stream:
            stream.write("".join(json.dumps({"file": f}) + "\n" for m in messages if m for f in m.files).encode())
        files.move(staged, f"{root}/commits/{name}")

    def drop(self, messages: list[Written | None]) -> None:
        files, root = self.at()
        for message in messages:
            for name in message.files if message else []:
                if files.get_file_info(f"{root}/{name}").type != pa.fs.FileType.NotFound:
                    files.delete_file(f"{root}/{name}")


class _BatchWriter(_Files, DataSourceWriter):
    def write(self, iterator: Iterator[Row]) -> Written:
        return self.write_rows(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.mark(f"write-{uuid.uuid4().hex}.json", messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(messages)


class _StreamWriter(_Files, DataSourceStreamWriter):
    def write(self, iterator: Iterator[Row]) -> Written:
        return self.write_rows(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.mark(f"batch-{batchId}.json", messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop(messages)


class TopicFiles(DataSource):
    """Writes rows (topic string, value string) as lines of files by topic below the option `path`.

    Each task writes files of its own; only those that a commit lists are read,
    so that a task or a batch that is done again adds no line twice, and what
    an attempt left behind counts for nothing.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "topic string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _BatchWriter(self.options)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(self.options)


class Topics:
    """Topics below a path; what can't be sent is counted and not raised."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.failures = spark, path, 0
        spark.dataSource.register(TopicFiles)

    def send(self, rows: DataFrame) -> bool:
        """rows: (topic, value), value being JSON; whether they were sent."""
        try:
            rows.select(F.col("topic").cast("string"), F.col("value").cast("string")).write.format(FORMAT).mode("append").option("path", self.path).save()
        except Exception:  # a queue that is away must not stop a turn
            self.failures += 1
            return False
        return True

    def stream(self, rows: DataFrame, checkpoint: str):
        """Starts a query that sends a stream's rows."""
        return rows.select("topic", "value").writeStream.format(FORMAT).option("path", self.path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        """(topic, value) of all that was committed."""
        listed = self.spark.read.schema("file string").json(f"{self.path}/commits")
        lines = self.spark.read.option("recursiveFileLookup", "true").text(f"{self.path}/topics").select(F.regexp_extract("_metadata.file_path", r"(topics/[^/]+/[^/]+)$", 1).alias("file"), "value")
        return lines.join(listed, "file", "left_semi").select(F.split_part("file", F.lit("/"), F.lit(2)).alias("topic"), "value")
