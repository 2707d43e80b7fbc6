"""Stage tables: Parquet written once in shared storage and read back.

A written table cuts the lineage, survives the loss of executors and, unlike an
RDD checkpoint, is columnar, so a later pass reads only the columns it needs.
"""

from __future__ import annotations

import atexit
import itertools
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else one below the warehouse, which is shared too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staging"


#: With this set when a command is planned, its shuffle files go once it has ended, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: the table written is what later passes read."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Workspace:
    """One run's folder of stage tables.

    Every call of :meth:`stage` writes a folder of its own, so that a later call with the same
    name leaves earlier results readable. As a context manager it drops its folder at the end.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, run_id: str | None = None):
        self.spark = spark
        self.run_id = run_id or uuid.uuid4().hex
        self.path = f"{(root or staging_root(spark)).rstrip('/')}/claimsieve/{self.run_id}"
        self._calls = itertools.count()

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *exc: object) -> None:
        self.drop()

    def location(self, name: str) -> str:
        return f"{self.path}/{name}"

    def stage(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` to a new folder named after ``name`` and return the table read back. It is compressed well, and the write's shuffle files go with its end."""
        path = self.location(f"{name}-{next(self._calls)}")
        writer = df.write.option("compression", "zstd")
        with _shuffles_dropped(self.spark):
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete this run's tables; call it when nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> Workspace:
    """A workspace for a lazy result: its tables go when the Python process ends."""
    workspace = Workspace(spark)

    def clean() -> None:
        try:
            workspace.drop()
        except Exception:  # noqa: BLE001  the session may have ended first
            pass

    atexit.register(clean)
    return workspace
