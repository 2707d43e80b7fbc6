"""Charge rules and the label they give."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions import either, flag, ratio
from claimsieve.schema import (
    ALLOWED,
    HIGH_CHARGE,
    LABEL,
    MIXED_PREFIX,
    RATIO,
    RATIO_LIMIT,
    SUBMITTED,
)


def add_charge_ratio(df: DataFrame, numerator: str = SUBMITTED, denominator: str = ALLOWED) -> DataFrame:
    """Submitted over allowed amount; null where nothing was allowed."""
    return df.withColumn(RATIO, ratio(numerator, denominator))


def cap_ratio(df: DataFrame, limit: float = RATIO_LIMIT) -> DataFrame:
    """Rows up to the limit; those without a ratio go too."""
    return df.where(F.col(RATIO) <= limit)


def check_range(
    df: DataFrame, numerator: str = SUBMITTED, denominator: str = ALLOWED, factor: float = RATIO_LIMIT
) -> DataFrame:
    """Rows whose submitted amount is at least the allowed one and at most ``factor`` times it."""
    allowed = F.col(denominator)
    return df.where(F.col(numerator).between(allowed, factor * allowed))


def high_charge(df: DataFrame, column: str = SUBMITTED, threshold: float = HIGH_CHARGE) -> DataFrame:
    return df.where(F.col(column) > threshold)


def fraud_rules() -> list[Column]:
    """A flagged amount of any of three kinds, or a ratio beyond the cap.

    After ``cap_ratio`` the last one cannot fire; it serves tables that were not capped.
    """
    # The measures whose mixed flag counts.
    measures = ["Average_Submitted_Charge", "Average_Medicare_Allowed", "Average_Medicare_Payment"]
    return [F.col(MIXED_PREFIX + m) == 1 for m in measures] + [F.col(RATIO) > RATIO_LIMIT]


def any_rule(rules: Iterable[Column]) -> Column:
    return either(rules)


def label(df: DataFrame, rule: Column, name: str = LABEL) -> DataFrame:
    """1 where the rule holds, else 0, also where it is unknown."""
    return df.withColumn(name, flag(rule))


def label_distribution(df: DataFrame, name: str = LABEL) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("count"))
