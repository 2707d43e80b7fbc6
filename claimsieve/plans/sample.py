"""A small CSV of labelled rows to look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from claimsieve.operators.reporting import first_rows
from claimsieve.sources import write_csv


def sample_labelled(
    labelled: DataFrame, output: str, n: int = 50, order_by: Sequence[str] | None = None
) -> None:
    write_csv(first_rows(labelled, n, order_by), output)
