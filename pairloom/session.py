"""The package on the executors, and tables in the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()
#: The folder of the innermost ``temporary`` block.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each application.

    Executors that have it installed use it as well; nothing is written but a zip file for
    ``addPyFile``, which Spark serves to them.
    """
    app = spark.sparkContext.applicationId
    with _SHIPPING:  # queries may be started from several threads
        if app not in _SHIPPED:
            root = Path(__file__).resolve().parent
            target = os.path.join(tempfile.mkdtemp(prefix="pairloom-"), "pairloom.zip")
            with zipfile.ZipFile(target, "w") as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            spark.sparkContext.addPyFile(target)
            _SHIPPED.add(app)
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines share: ``spark.checkpoint.dir``.

    Only on one machine (a local master, as in tests) a temporary folder is set where that setting is missing.
    """
    base = _FOLDER.get() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="pairloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str) -> DataFrame:
    """The rows, written as Parquet and read again: this cuts the lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a fresh path in the shared folder and read again."""
    return saved(df, shared_path(df.sparkSession, name))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is written to fresh paths inside the block is deleted at its end.

    A result that is read later must be saved inside the block, at a path taken before it.
    """
    folder = shared_path(spark, "temporary")
    token = _FOLDER.set(folder)
    try:
        yield
    finally:
        _FOLDER.reset(token)
        discard(spark, folder)


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside the block go when it has run, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path, in whatever store it is."""
    files, target = _place(spark, path)
    return files.exists(target)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path, if it is there."""
    files, target = _place(spark, path)
    files.delete(target, True)
