"""Exact comparison of a Spark result with SQL over the same files."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Spark type -> the type the other engine gives.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(frame: pd.DataFrame) -> list[tuple]:
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted(map(tuple, plain.itertuples(index=False)), key=repr)


def compare(
    df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str | None
) -> tuple[int, str | None]:
    """Number of rows, and what differs: names, types, row count or values."""
    found = df.toPandas()
    if sql is None:
        return len(found), None if len(found) else "no rows"
    result = connection.sql(sql)
    types = {name: str(kind) for name, kind in zip(result.columns, result.types)}
    expected = result.df()
    if sorted(found.columns) != sorted(expected.columns):
        return len(found), f"columns {sorted(found.columns)} / {sorted(expected.columns)}"
    wrong = {n: (t, types[n]) for n, t in df.dtypes if TYPES.get(t, t) != types[n]}
    if wrong:
        return len(found), f"types {wrong}"
    if len(found) != len(expected):
        return len(found), f"{len(found)} rows / {len(expected)}"
    names = sorted(found.columns)
    pairs = zip(_rows(found[names]), _rows(expected[names]))
    different = [(a, b) for a, b in pairs if a != b]
    return len(found), f"{len(different)} rows differ, first {different[0]}" if different else None
