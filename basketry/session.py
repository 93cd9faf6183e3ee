"""Where intermediate results live, and the session settings the jobs expect."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even when the operator above then needs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session, else one inside its warehouse.

    Both outlive executors and can be reached by all of them; a machine's own temporary folder is
    never used. On a cluster whose warehouse is a local folder, a session has to name one.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        if not spark.sparkContext.master.startswith("local") and configured.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()
# Writes under way that remove their shuffle files, and the session's own setting before the first of them.
_cleaners: list[str] = []


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that ends inside go as soon as it is complete; threads may overlap."""
    with _cleaning:
        _cleaners.append(_cleaners[0] if _cleaners else spark.conf.get(_CLEANUP, "false"))
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            before = _cleaners.pop()
            if not _cleaners:
                spark.conf.set(_CLEANUP, before)


def freeze(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The lineage ends there, so lost executors cannot change the rows. Against a checkpoint of the
    rows, later steps read only the columns they need and know the size of the table. The shuffle files
    that led to it are removed, so a chain of steps needs the disk of its largest one.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "stage")
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Paths of a scope, and the one thread whose tables it takes (None: those of all).
_open_scopes: list[tuple[list[str], int | None]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """An unused path for one written table in the shared checkpoint folder."""
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    for paths, thread in _open_scopes:
        if thread in (None, threading.get_ident()):
            paths.append(path)
    return path


@contextmanager
def stage_scope(spark: SparkSession, own_thread: bool = False) -> Iterator[None]:
    """Remove the tables that were stored inside the scope when it ends.

    Results that are still to be read depend on them, so read or write those inside. With
    ``own_thread``, tables that other threads store meanwhile stay.
    """
    paths: list[str] = []
    _open_scopes.append((paths, threading.get_ident() if own_thread else None))
    try:
        yield
    finally:
        _open_scopes[:] = [s for s in _open_scopes if s[0] is not paths]
        for path in paths:
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing will read again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
