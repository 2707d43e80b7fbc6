"""Clean claims, flag outliers, keep consistent charges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from claimsieve.operators.cleaning import (
    drop_duplicates,
    drop_missing_keys,
    fill_medians,
    fill_unknown,
    fit_medians,
    measures_as_double,
    normalise_text,
    rename_columns,
)
from claimsieve.operators.outliers import MeasureStats, fit_outlier_stats, flag_outliers
from claimsieve.operators.rules import add_charge_ratio, cap_ratio, check_range
from claimsieve.schema import IQR_FACTOR, QUANTILE_ERROR, RATIO_LIMIT, Z_LIMIT
from claimsieve.session import wide_shuffle
from claimsieve.sources import read_claims
from claimsieve.staging import Workspace


@dataclass
class Prepared:
    """``cleaned`` is lazy over the staged ``population``, whose statistics set the flags."""

    cleaned: DataFrame
    flagged: DataFrame
    population: DataFrame
    medians: dict[str, float | None]
    stats: list[MeasureStats]


def complete_claims(claims: DataFrame) -> DataFrame:
    """Rows with both keys, measures as double."""
    return measures_as_double(drop_missing_keys(claims))


def stored_claims(spark: SparkSession, csv_path: str, workspace: Workspace) -> DataFrame:
    """Claims of a CSV file under logical names, parsed once and staged; rows without their keys are left out."""
    return workspace.stage(drop_missing_keys(rename_columns(read_claims(spark, csv_path))), "typed")


def prepare_claims(
    claims: DataFrame,
    workspace: Workspace,
    rel_err: float = QUANTILE_ERROR,
    k: float = Z_LIMIT,
    m: float = IQR_FACTOR,
    limit: float = RATIO_LIMIT,
    normalise_first: bool = False,
) -> Prepared:
    """The cleaned table from claims under logical names.

    ``claims`` is a stored table (see :func:`stored_claims` for a CSV file), read twice (or, if it is large, four times) or, for exact medians, a few times more: its
    measures for the medians, then all of it for the duplicate
    removal, the one shuffle of rows, of a large table only of those that may have a copy, as wide as the table's bytes ask for, whose result is staged. Statistics and the final result read the
    staged table. Flags refer to all rows, before the charge rules remove some.
    """
    complete = complete_claims(claims)
    medians = fit_medians(complete, rel_err=rel_err)
    filled = fill_unknown(fill_medians(complete, medians))
    with wide_shuffle(claims):
        population = workspace.stage(normalise_text(drop_duplicates(filled, normalise_first, stored=True)), "population")
    stats = fit_outlier_stats(population, rel_err=rel_err)
    flagged = add_charge_ratio(flag_outliers(population, stats, k, m))
    return Prepared(check_range(cap_ratio(flagged, limit), factor=limit), flagged, population, medians, stats)
