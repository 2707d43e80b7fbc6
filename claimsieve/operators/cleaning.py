"""Renaming, missing values, duplicates and text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.functions import finite, normalised, quantiles
from claimsieve.schema import (
    CRITICAL,
    FILLED_CATEGORICALS,
    MEASURES,
    NORMALISED_TEXT,
    QUANTILE_ERROR,
    RAW_TO_LOGICAL,
    UNKNOWN,
)
from claimsieve.session import MIB, planned_bytes


def rename_columns(df: DataFrame, mapping: Mapping[str, str] = RAW_TO_LOGICAL) -> DataFrame:
    """Keep the mapped columns under their logical names; the scan reads no others."""
    return df.select(*(F.col(raw).alias(logical) for raw, logical in mapping.items()))


def drop_missing_keys(df: DataFrame, keys: Sequence[str] = CRITICAL) -> DataFrame:
    """Rows with a value in every key. NaN counts as missing, as in ``dropna``, whose filter,
    unlike this one, does not reach the Parquet scan."""
    present = [F.col(k).isNotNull() for k in keys]
    present += [~F.isnan(k) for k in keys if isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType))]
    return df.where(reduce(and_, present))


def measures_as_double(df: DataFrame, columns: Sequence[str] = MEASURES) -> DataFrame:
    """Measures as double with NaN as null, whatever type the source gave them."""
    return df.withColumns({c: finite(c) for c in columns})


def fit_medians(
    df: DataFrame, columns: Sequence[str] = MEASURES, rel_err: float = QUANTILE_ERROR
) -> dict[str, float | None]:
    """Medians of all columns in one pass. Each is a value of its column."""
    return {c: values[0] for c, values in quantiles(df, columns, [0.5], rel_err).items()}


def fill_medians(df: DataFrame, medians: Mapping[str, float | None]) -> DataFrame:
    """Replace missing measures; a column without any value stays null."""
    return df.fillna({c: m for c, m in medians.items() if m is not None})


def fill_unknown(df: DataFrame, columns: Sequence[str] = FILLED_CATEGORICALS, value: str = UNKNOWN) -> DataFrame:
    return df.fillna(value, subset=list(columns))


def normalise_text(df: DataFrame, columns: Sequence[str] = NORMALISED_TEXT) -> DataFrame:
    return df.withColumns({c: normalised(c) for c in columns})


#: Bytes of Parquet up to which all rows are shuffled to find copies: two more reads and a broadcast would take longer.
WHOLE_BYTES = 64 * MIB

#: Words of 64 bits in which repeated hashes are marked, some 64 MB where they are broadcast. With five million repeated rows, a seventh of the bits are set, and
#: one in fifty of the other rows is taken for one of them.
_MARK_WORDS = 1 << 20


def _mark(hashed: Column) -> tuple[Column, Column]:
    """The word in which a hash is marked, and its two bits there."""
    bit = lambda low: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, low).bitwiseAND(63).cast("int"))
    return hashed.bitwiseAND(_MARK_WORDS - 1), bit(40).bitwiseOR(bit(50))


def repeated_marks(df: DataFrame) -> DataFrame:
    """``_word, _bits``: marks of all row hashes that ``df`` has more than once, of which only the hashes are shuffled."""
    hashes = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("_hash"))
    word, bits = _mark(F.col("_hash"))
    repeated = hashes.groupBy("_hash").agg(F.count("*").alias("_n")).where("_n > 1")
    return repeated.groupBy(word.alias("_word")).agg(F.bit_or(bits).alias("_bits"))


def split_by_marks(df: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that surely have no copy, and all others: the copies and the few rows whose marks meet those of others."""
    word, bits = _mark(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))
    found = df.withColumns({"_row_word": word, "_row_bits": bits}).join(F.broadcast(marks), F.col("_row_word") == F.col("_word"), "left")
    marked = F.coalesce(F.col("_bits"), F.lit(0).cast("long")).bitwiseAND(F.col("_row_bits")) == F.col("_row_bits")
    alone, others = (found.where(condition).select(*(f"`{c}`" for c in df.columns)) for condition in (~marked, marked))
    return alone, others


def drop_duplicates(df: DataFrame, normalise_first: bool = False, stored: bool = False) -> DataFrame:
    """Remove full-row copies.

    Where ``df`` comes from a ``stored`` table, which gives the same rows each time, and of more than ``WHOLE_BYTES``, it is read three times: once for 64-bit hashes of its rows, which are
    shuffled to find those that come more than once, and then for the rows without a copy, which stay where they are, and for the others, which
    alone are shuffled and compared in full. Rows whose hashes meet by chance are among the others, so none is lost; the more of the rows are
    copies, the nearer this comes to a shuffle of all rows, which any other table gets.

    Each task first folds its own copies, so a row copied any number of times crosses the
    shuffle once per task. Copies that differ in case or outer spaces stay, unless
    ``normalise_first``.
    """
    rows = normalise_text(df) if normalise_first else df
    if not stored or planned_bytes(rows) <= WHOLE_BYTES:
        return rows.dropDuplicates()
    alone, others = split_by_marks(rows, repeated_marks(rows))
    return alone.unionByName(others.dropDuplicates())
