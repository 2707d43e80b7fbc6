"""Profile a cleaned table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.operators.profiling import column_statistics, count_by, mean_by, row_count
from claimsieve.operators.rules import high_charge
from claimsieve.schema import PROFILED_MEASURES
from claimsieve.sources import describe_schema, preview
from claimsieve.staging import Workspace


@dataclass
class Profile:
    schema: DataFrame
    first_rows: DataFrame
    rows: DataFrame
    columns: DataFrame
    measures: DataFrame
    nulls: DataFrame
    mean_charge_by_type: DataFrame
    rows_by_state: DataFrame
    high_charges: DataFrame


def profile_claims(cleaned: DataFrame, workspace: Workspace, n: int = 20, order_by: Sequence[str] | None = None) -> Profile:
    """All profiling outputs; the first ``n`` rows are those of ``order_by``, else whichever the scan meets first.

    Column statistics and null counts, of every column, come from a single pass whose one row
    per column is staged; the description of the measures is a part of it.
    """
    columns = workspace.stage(column_statistics(cleaned), "column_statistics")
    described = columns.drop("nulls")
    return Profile(
        schema=describe_schema(cleaned),
        first_rows=preview(cleaned, n, order_by),
        rows=row_count(cleaned),
        columns=described,
        measures=described.where(F.col("column").isin(*PROFILED_MEASURES)),
        nulls=columns.select("column", "nulls"),
        mean_charge_by_type=mean_by(cleaned),
        rows_by_state=count_by(cleaned),
        high_charges=high_charge(cleaned),
    )
