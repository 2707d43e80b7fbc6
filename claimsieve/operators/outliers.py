"""Outlier thresholds and flags: z-score, interquartile range, and either of them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from claimsieve.functions import flag, quantiles, sketch_aggregates, sketch_size
from claimsieve.schema import (
    IQR_FACTOR,
    IQR_PREFIX,
    MEASURES,
    MIXED_PREFIX,
    QUANTILE_ERROR,
    RATIO,
    Z_LIMIT,
    Z_PREFIX,
)

_QUARTILES = [0.25, 0.75]
STATS_SCHEMA = "run_id string, column string, mean double, stddev double, q1 double, q3 double"


@dataclass(frozen=True)
class MeasureStats:
    """Location and spread of one measure; a value the data cannot give is None."""

    column: str
    mean: float | None
    stddev: float | None
    q1: float | None
    q3: float | None

    def z_bounds(self, k: float) -> tuple[float, float] | None:
        if self.mean is None or self.stddev is None:
            return None
        return self.mean - k * self.stddev, self.mean + k * self.stddev

    def iqr_bounds(self, m: float) -> tuple[float, float] | None:
        if self.q1 is None or self.q3 is None:
            return None
        spread = self.q3 - self.q1
        return self.q1 - m * spread, self.q3 + m * spread


def mean_stddev(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """Mean and sample standard deviation of all columns as one wide row, in one aggregate."""
    return df.agg(*_moments(columns))


def _moments(columns: Sequence[str]) -> list[Column]:
    return [
        *(F.mean(c).alias(f"{c}_mean") for c in columns),
        *(F.stddev(c).alias(f"{c}_stddev") for c in columns),
    ]


def fit_outlier_stats(
    df: DataFrame, columns: Sequence[str] = MEASURES, rel_err: float = QUANTILE_ERROR
) -> list[MeasureStats]:
    """Statistics of every column, from one pass over the measures whose sketches are merged in two levels.

    Four numbers per column come back; as literals they fold into the generated code, so the
    flags need no join. Exact quartiles (``rel_err`` 0) take a few passes more, and ``df`` should
    then be a stored table.
    """
    if rel_err == 0:
        row = mean_stddev(df, columns).head()
        quartiles = quantiles(df, columns, _QUARTILES, rel_err)
        return [MeasureStats(c, row[f"{c}_mean"], row[f"{c}_stddev"], *quartiles[c]) for c in columns]
    names = {str(i): F.col(f"`{c}`") for i, c in enumerate(columns)}
    part = lambda v: F.struct(F.count(v).alias("n"), F.mean(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"))
    moments = {f"moments_{i}": (part(v), F.collect_list(f"moments_{i}")) for i, v in names.items()}
    found = sketch_aggregates(df, names, dict.fromkeys(names, _QUARTILES), sketch_size(rel_err / 4), moments)
    return [
        MeasureStats(c, *_combined(found[f"moments_{i}"]), *(found[f"q_{i}"] or [None, None])) for i, c in enumerate(columns)
    ]


def _combined(parts: Sequence[Row]) -> tuple[float | None, float | None]:
    """Mean and sample standard deviation from those of some groups of rows."""
    n, mean, m2 = 0, 0.0, 0.0
    for part in parts:
        if part["n"]:
            apart, total = part["mean"] - mean, n + part["n"]
            m2 += part["m2"] + apart * apart * n * part["n"] / total
            mean += apart * part["n"] / total
            n = total
    return (mean if n else None), (math.sqrt(m2 / (n - 1)) if n > 1 else None)


def stats_frame(spark: SparkSession, stats: Sequence[MeasureStats], run_id: str) -> DataFrame:
    """Statistics as a table, one row per measure under the run they came from, to be stored and appended to."""
    return spark.createDataFrame([{"run_id": run_id, **asdict(s)} for s in stats], STATS_SCHEMA)


def stats_from_frame(df: DataFrame, run_id: str, columns: Sequence[str] = MEASURES) -> list[MeasureStats]:
    """The stored statistics of one run, to flag a later batch against them.

    Raises an error where a column of the run has no row, or more than one.
    """
    fields = ["column", "mean", "stddev", "q1", "q3"]
    rows = df.where((F.col("run_id") == run_id) & F.col("column").isin(*columns)).select(*fields).limit(len(columns) + 1).collect()
    found = {r["column"]: r for r in rows}
    if len(found) < len(columns) or len(rows) > len(columns):
        raise ValueError(f"run {run_id} has {len(rows)} rows of statistics for {len(columns)} columns")
    return [MeasureStats(**found[c].asDict()) for c in columns]


def _outside(column: str, bounds: tuple[float, float] | None):
    if bounds is None:
        return F.lit(0)
    low, high = bounds
    return flag((F.col(column) < low) | (F.col(column) > high))


def flag_z(df: DataFrame, stats: Sequence[MeasureStats], k: float = Z_LIMIT) -> DataFrame:
    """1 where a measure lies beyond ``k`` standard deviations from its mean."""
    return df.withColumns({Z_PREFIX + s.column: _outside(s.column, s.z_bounds(k)) for s in stats})


def flag_iqr(df: DataFrame, stats: Sequence[MeasureStats], m: float = IQR_FACTOR) -> DataFrame:
    """1 where a measure lies beyond ``m`` interquartile ranges from its quartiles."""
    return df.withColumns({IQR_PREFIX + s.column: _outside(s.column, s.iqr_bounds(m)) for s in stats})


def flag_mixed(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """1 where either flag is set."""
    return df.withColumns(
        {MIXED_PREFIX + c: F.greatest(F.col(Z_PREFIX + c), F.col(IQR_PREFIX + c)) for c in columns}
    )


def flag_outliers(
    df: DataFrame, stats: Sequence[MeasureStats], k: float = Z_LIMIT, m: float = IQR_FACTOR
) -> DataFrame:
    """All three flags of all measures in ``stats``."""
    return flag_mixed(flag_iqr(flag_z(df, stats, k), stats, m), [s.column for s in stats])


def flag_view(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """Measures, their flags and the charge ratio."""
    flags = [prefix + c for prefix in (Z_PREFIX, IQR_PREFIX, MIXED_PREFIX) for c in columns]
    return df.select(*columns, *flags, RATIO)
