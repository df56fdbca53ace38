"""Tables that cut lineage, in the folder which all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_live: list[Staged] = []


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of a query that ends inside go at once, not at some later garbage collection."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


class Staged:
    """A DataFrame written as Parquet; `df` rereads it, `drop()` deletes it.

    What a returned DataFrame still reads can't be dropped by the operator: it
    goes at the end of the `scratch` block that it was made in, or else when
    the driver's Python ends.
    """

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        _live.append(self)
        with _shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self in _live:
            _live.remove(self)
        self._forget()
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def _forget(self) -> None:
        """What there is besides the files."""


class Bucketed(Staged):
    """A staged table in `buckets` files by hash of a key, sorted in each: joins and sums by the key read it without a shuffle."""

    def __init__(self, df: DataFrame, label: str, key: str, buckets: int):
        self.spark = df.sparkSession
        self.name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        _live.append(self)
        with _shuffles_removed(self.spark):
            df.write.option("compression", "zstd").option("path", self.path).bucketBy(buckets, key).sortBy(key).saveAsTable(self.name)
        self.df = self.spark.table(self.name)
        #: The rows without their buckets, for unions, which aren't to be taken for bucketed.
        self.plain = self.spark.read.schema(self.df.schema).parquet(self.path)

    def _forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base in taken:
        base += "_"
    return base


def stage(df: DataFrame, label: str) -> Staged:
    return Staged(df, label)


def finished(spark: SparkSession) -> None:
    """After a step of many jobs: its plans and generated code leave the driver at once, not when its heap is full."""
    spark._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[Callable[[Staged], Staged]]:
    """Tables that are staged inside and not passed to the yielded function are dropped at the end."""
    before, kept = set(map(id, _live)), set()

    def keep(staged: Staged) -> Staged:
        kept.add(id(staged))
        return staged

    try:
        yield keep
    finally:
        for staged in [s for s in _live if id(s) not in before | kept]:
            staged.drop()


@atexit.register
def _drop_the_rest() -> None:
    for staged in list(_live):
        with suppress(Exception):  # the session may have ended
            staged.drop()
