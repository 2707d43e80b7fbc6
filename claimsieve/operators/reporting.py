"""Unions and samples for reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame], by_name: bool = True, allow_missing: bool = False) -> DataFrame:
    """All rows of all frames, columns matched by name, or by position as plain union does.

    ``allow_missing`` lets a frame lack columns that another has; they are null in its rows.
    """
    if not by_name:
        return reduce(DataFrame.union, frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def with_source(df: DataFrame, source: str) -> DataFrame:
    """Name where the rows came from."""
    return df.withColumn("Source", F.lit(source))


def first_rows(df: DataFrame, n: int = 50, order_by: Sequence[str] | None = None) -> DataFrame:
    """``n`` rows, not a random sample. Ordered by all columns unless told otherwise, so that the
    same table gives the same rows; an empty ``order_by`` takes any ``n``."""
    keys = df.columns if order_by is None else order_by
    return (df.orderBy(*keys) if keys else df).limit(n)
