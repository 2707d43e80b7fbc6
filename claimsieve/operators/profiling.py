"""Counts and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.schema import SUBMITTED

_DESCRIBED = (T.NumericType, T.StringType)

#: Groups of input splits whose sketches are merged ahead of the last merge.
_SPLIT_GROUPS = 512

# Columns per aggregate. Eight buffer fields each keep it below the hundred fields up to which
# Spark generates code for a stage.
_GROUP = 12

# How a text starts that reads as a number. Others would each raise and catch an
# exception in the cast.
_NUMBER_START = r"(?i)^[\x00-\x20]*[+-]?(\.?[0-9]|inf|nan)"


# Most frequent first, then by text.
_BY_COUNT = (
    "(a, b) -> CASE WHEN a.count <> b.count THEN IF(a.count > b.count, -1, 1) WHEN a.item = b.item THEN 0 WHEN a.item < b.item THEN -1 ELSE 1 END"
)

# Rows by which a sketch of frequent items may overstate a count, as a multiple of rows over items held.
_TOP_ERROR = 3.0


def _hll_error(precision: int) -> float:
    """The relative standard error of a sketch with ``2**precision`` registers."""
    return 1.04 / 2 ** (precision / 2)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("count"))


def _is_text(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _number(field: T.StructField) -> Column:
    column = F.col(_quoted(field.name))
    if _is_text(field):
        return F.when(column.rlike(_NUMBER_START), column.try_cast("double"))
    return column.cast("double")


def _statistics(field: T.StructField, place: int) -> str:
    """One column's statistics as a struct, the same type for every column."""
    quoted = _quoted(field.name)
    title = field.name.replace("\\", "\\\\").replace("'", "\\'")
    ends = "min({0}) AS min{1}, max({0}) AS max{1}"
    missing = "CAST(NULL AS {0}) AS min{1}, CAST(NULL AS {0}) AS max{1}"
    if _is_text(field):
        extremes = f"{missing.format('DOUBLE', '')}, {ends.format(quoted, '_text')}"
    else:
        extremes = f"{ends.format(f'_{place}', '')}, {missing.format('STRING', '_text')}"
    return (
        f"struct('{title}' AS column, count({quoted}) AS count, count(*) - count({quoted}) AS nulls,"
        f" mean(_{place}) AS mean, stddev(_{place}) AS stddev, {extremes})"
    )


def _described(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    numbers = [_number(f).alias(f"_{i}") for i, f in enumerate(fields)]
    rows = ", ".join(_statistics(f, i) for i, f in enumerate(fields))
    return df.select(*(_quoted(f.name) for f in fields), *numbers).selectExpr(f"array({rows}) AS rows").selectExpr("inline(rows)")


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric or string column. Every column is read once.

    Numbers and texts, and a few columns at a time, have an aggregate of their own, all in one
    job: one over everything would be too wide for generated code. As in a plain describe, mean
    and deviation of a string column are those of its values that read as numbers, and columns
    of other types are left out. Null counts are 0, not null, for an empty table.
    """
    fields = [df.schema[c] for c in columns] if columns else df.schema.fields
    fields = [f for f in fields if isinstance(f.dataType, _DESCRIBED)]
    kinds = [[f for f in fields if not _is_text(f)], [f for f in fields if _is_text(f)]]
    groups = [kind[i : i + _GROUP] for kind in kinds for i in range(0, len(kind), _GROUP)]
    return reduce(DataFrame.union, [_described(df, group) for group in groups])


def describe_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return column_statistics(df, columns).drop("nulls")


def text_statistics(df: DataFrame, columns: Sequence[str] | None = None, top: int = 20, tracked: int = 2_000, precision: int = 14) -> DataFrame:
    """One row per text column: ``column, count, distinct, distinct_error, top, top_error``, in one pass over all rows.

    ``distinct`` estimates the number of different texts from a HyperLogLog sketch of ``2**precision`` registers;
    ``distinct_error`` is its relative error in all but one of a hundred cases. ``top`` is an array of
    ``(item, count)`` of the most frequent texts, most frequent first, equal counts by text, from a sketch that holds ``tracked`` texts.
    A count in it exceeds the true one by at most ``top_error`` and never falls below it, and no text missing from a list that
    isn't full is more frequent than that; with at most ``tracked`` different texts the counts are exact and ``top_error`` is 0.
    Sketches are merged in two levels, so that the last task has one of each of ``_SPLIT_GROUPS`` groups of splits.
    Cases: nulls count nowhere; a column of nulls has 0 ``distinct`` and an empty ``top``; an empty table gives no rows; columns of
    other types are left out.
    """
    fields = [df.schema[c] for c in columns] if columns else df.schema.fields
    names = [f.name for f in fields if _is_text(f)]
    if not names:
        raise ValueError("no text column to describe")
    groups = F.pmod(F.spark_partition_id(), F.lit(_SPLIT_GROUPS)).alias("_group")
    inner, outer, rows = [], [], []
    for i, name in enumerate(names):
        column = F.col(_quoted(name))
        inner += [
            F.count(column).alias(f"n{i}"),
            F.hll_sketch_agg(column, precision).alias(f"d{i}"),
            F.expr(f"approx_top_k_accumulate({_quoted(name)}, {tracked})").alias(f"t{i}"),
        ]
        outer += [
            F.sum(f"n{i}").alias(f"n{i}"),
            F.hll_union_agg(f"d{i}").alias(f"d{i}"),
            F.expr(f"approx_top_k_combine(t{i}, {tracked})").alias(f"t{i}"),
        ]
        distinct = F.coalesce(F.hll_sketch_estimate(f"d{i}"), F.lit(0).cast("bigint"))
        few = distinct * (1 + 3 * _hll_error(precision)) <= tracked
        # a null may be among the items; all are taken, so that ties at the end go by text
        found = F.expr(f"slice(array_sort(filter(approx_top_k_estimate(t{i}, {tracked}), x -> x.item IS NOT NULL), {_BY_COUNT}), 1, {top})")
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"n{i}").alias("count"),
                distinct.alias("distinct"),
                F.lit(2.6 * _hll_error(precision)).alias("distinct_error"),
                found.alias("top"),
                F.when(few, F.lit(0)).otherwise(F.ceil(F.lit(_TOP_ERROR / tracked) * F.col("_rows"))).cast("bigint").alias("top_error"),
            )
        )
    by_group = df.groupBy(groups).agg(F.count("*").alias("_rows"), *inner)
    # with a key, though all rows have it: an empty table then gives no row, where merging no sketch is an error
    merged = by_group.groupBy(F.lit(0).alias("_all")).agg(F.sum("_rows").alias("_rows"), *outer)
    return merged.select(F.inline(F.array(*rows)))


def null_counts(df: DataFrame) -> DataFrame:
    """One wide row: the number of nulls of every column."""
    return df.agg(*(F.count_if(F.col(_quoted(c)).isNull()).alias(c) for c in df.columns))


def null_counts_long(df: DataFrame) -> DataFrame:
    """The same with one row per column."""
    return null_counts(df).unpivot([], [_quoted(c) for c in df.columns], "column", "nulls")


def mean_by(df: DataFrame, key: str = "Provider_Type", column: str = SUBMITTED) -> DataFrame:
    return df.groupBy(key).agg(F.avg(column).alias(f"avg_{column}"))


def count_by(df: DataFrame, key: str = "Provider_State") -> DataFrame:
    """Rows, not distinct providers, per value of the key."""
    return df.groupBy(key).agg(F.count("*").alias("count"))
