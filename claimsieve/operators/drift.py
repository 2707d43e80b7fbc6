"""Whether the measures of a later batch are spread like those of the batch a run learned from."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsieve.functions.quantiles import counts_between, quantiles
from claimsieve.schema import MEASURES, QUANTILE_ERROR

#: From which population stability index on a column counts as shifted, by common practice.
SHIFTED = 0.2

#: The share that an empty bin is taken to have, so that the index stays finite.
LEAST_SHARE = 1e-4

#: The bin of null and NaN, beside those from 0 on.
MISSING = -1

_REFERENCE_SCHEMA = "run_id string, column string, cuts array<double>, bins array<int>, counts array<long>"


@dataclass(frozen=True)
class Spread:
    """A column's values counted by bin: bin ``k`` is from the ``k``-th cut (from below all) up to the next."""

    column: str
    cuts: tuple[float, ...]
    counts: Mapping[int, int]

    def shares(self, bins: Sequence[int]) -> list[float]:
        total = max(1, sum(self.counts.values()))
        return [max(self.counts.get(k, 0) / total, LEAST_SHARE) for k in bins]


def _spreads(df: DataFrame, cuts: Mapping[str, Sequence[float]]) -> list[Spread]:
    splits = {c: [-math.inf, *x, math.inf] for c, x in cuts.items()}
    rows, counted = counts_between(df, splits)
    return [Spread(c, tuple(cuts[c]), {**counted[c], MISSING: rows - sum(counted[c].values())}) for c in cuts]


def fit_spreads(df: DataFrame, columns: Sequence[str] = MEASURES, bins: int = 10, rel_err: float = QUANTILE_ERROR) -> list[Spread]:
    """Cuts at the quantiles of every column, and the rows in each bin: two passes over the columns.

    Frequent values give fewer cuts, as equal ones count once. A column without values has one cut, 0.
    """
    found = quantiles(df, columns, [k / bins for k in range(1, bins)], rel_err)
    return _spreads(df, {c: sorted({x for x in found[c] if x is not None and math.isfinite(x)}) or [0.0] for c in columns})


def spreads_frame(spark: SparkSession, spreads: Sequence[Spread], run_id: str) -> DataFrame:
    """Spreads as a table, one row per column under the run they came from."""
    rows = [(run_id, s.column, list(s.cuts), sorted(s.counts), [s.counts[k] for k in sorted(s.counts)]) for s in spreads]
    return spark.createDataFrame(rows, _REFERENCE_SCHEMA)


def spreads_from_frame(df: DataFrame, run_id: str) -> list[Spread]:
    """The stored spreads of one run. Raises an error where a column has more than one row, or the run none."""
    rows = df.where(F.col("run_id") == run_id).orderBy("column").collect()  # a row per column
    if not rows or len({r["column"] for r in rows}) < len(rows):
        raise ValueError(f"run {run_id} has {len(rows)} spreads, not one for each column")
    return [Spread(r["column"], tuple(r["cuts"]), dict(zip(r["bins"], r["counts"]))) for r in rows]


def stability_index(old: Spread, new: Spread) -> float:
    """Sum over bins of the difference of shares times the logarithm of their ratio; 0 where they agree."""
    bins = range(MISSING, len(old.cuts) + 1)
    return sum((q - p) * math.log(q / p) for p, q in zip(old.shares(bins), new.shares(bins)))


def drift(df: DataFrame, reference: Sequence[Spread], limit: float = SHIFTED) -> DataFrame:
    """One row per column of a batch: ``column, rows, missing, psi, shifted``; one pass, no shuffle of rows.

    ``psi`` is the population stability index over the reference's bins and the one of missing values.
    Cases: null and NaN are missing; an empty batch has 0 rows, null ``psi`` and is not shifted; infinite values fall to the outer bins.
    """
    found = _spreads(df, {s.column: s.cuts for s in reference})
    rows = []
    for old, new in zip(reference, found):
        n = sum(new.counts.values())
        psi = stability_index(old, new) if n else None
        rows.append((old.column, n, new.counts[MISSING], psi, psi is not None and psi > limit))
    return df.sparkSession.createDataFrame(rows, "column string, rows long, missing long, psi double, shifted boolean")
