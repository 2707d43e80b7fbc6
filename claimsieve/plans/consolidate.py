"""Bring the metrics of several models together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from claimsieve.sources import read_metric_files, write_csv


def consolidate_metrics(spark: SparkSession, folder: str, names: Sequence[str], output: str) -> DataFrame:
    """One CSV of all metric files that exist, each row with its ``Source``; writes none if none do."""
    metrics = read_metric_files(spark, folder, names)
    if metrics.columns != ["Source"]:
        write_csv(metrics.coalesce(1), output)
    return metrics
