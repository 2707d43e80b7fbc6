"""Model metrics: an append-only table, and sets of small CSV files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from claimsieve.operators.reporting import union_all, with_source
from claimsieve.schema import METRICS
from claimsieve.sources.tables import read_strings, write_csv

#: Characters that a path pattern would not take literally.
_GLOB = re.compile(r"[\\{}\[\]*?,]")


#: What one write of metrics replaces as a whole.
_RUN = ["run_id", "model"]


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add rows to the metrics table, creating it on first use.

    A run's rows of a model take the place of those that an earlier try of the same run left, so that a
    retried task or run counts once; other rows stay as they are.
    """
    rows = metrics.select(*METRICS.fieldNames()).repartition(1, *_RUN)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_RUN).parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics table, its run and model as text whatever they look like."""
    return spark.read.schema(METRICS).parquet(path).select(*METRICS.fieldNames())


def write_metric_file(metrics: DataFrame, path: str) -> None:
    """A run's metrics as CSV; the few rows go into one file."""
    write_csv(metrics.coalesce(1), path)


def read_metric_files(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """All metric CSVs of ``folder`` called ``names``, as strings, with ``Source`` naming each.

    Columns are brought together by name, so the files may have them in any order, and one that a file lacks is
    null in its rows. A name nothing is stored under is skipped; if that holds for all, the result is empty.
    """
    found = []
    for name in names:
        path = f"{folder.rstrip('/')}/{_GLOB.sub(r'\\\g<0>', name)}"
        try:
            found.append(with_source(read_strings(spark, path), name))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("Source", T.StringType())]))
    return union_all(found, allow_missing=True)
