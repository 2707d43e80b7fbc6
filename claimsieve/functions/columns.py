"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(name: str) -> Column:
    """A measure as double with NaN read as null.

    One NaN would otherwise make mean and standard deviation NaN and flag every row.
    """
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def normalised(name: str) -> Column:
    """Lower case without leading and trailing spaces; tabs stay."""
    return F.trim(F.lower(F.col(name)))


def ratio(numerator: str, denominator: str) -> Column:
    """A quotient that is null, not an error, where the denominator is zero."""
    return F.try_divide(F.col(numerator), F.col(denominator))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def either(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions)

