"""Label cleaned claims by rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame

from claimsieve.operators.rules import any_rule, fraud_rules, label


def label_claims(cleaned: DataFrame, rules: Iterable[Column] | None = None) -> DataFrame:
    """The cleaned table with ``is_fraud``: a projection, without shuffle."""
    return label(cleaned, any_rule(fraud_rules() if rules is None else rules))
