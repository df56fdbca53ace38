"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own_folder: str | None = None
_temporary: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where none is set a session in one JVM (tests) gets a local folder; on a
    cluster that is an error, as executors don't see each other's files.
    """
    global _own_folder
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="colloquy-")
    return _own_folder


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    files, at = _file_system(spark, path)
    return files.getFileStatus(at).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; one that isn't there is no error."""
    files, at = _file_system(spark, path)
    files.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder."""
    files, at = _file_system(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)]


def temporary_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _temporary.append((spark, path))
    return path


@atexit.register
def _remove_the_rest() -> None:
    for spark, path in _temporary:
        with suppress(Exception):  # the session may have ended
            remove(spark, path)
