"""Session settings that follow the size of the input."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

MIB = 1024 * 1024

#: What a plan says of a leaf without files: the largest long, by default.
_UNKNOWN_SIZE = 1 << 62

#: Bytes of a row in a shuffle for each byte of it in Parquet, where codes and runs are short.
EXPANSION = 4


def settings_for(input_bytes: int, cores: int, partition_bytes: int = 256 * MIB) -> dict[str, str]:
    """Settings for a job over ``input_bytes`` of claims on ``cores`` executor cores.

    The duplicate removal shuffles every row, so shuffle partitions follow the input:
    ``partition_bytes`` each once rows are unpacked, and no fewer than the cores. Adaptive execution joins small
    partitions up to that size and splits the skewed ones of a join. A scan is cut so that every core has a part.
    """
    partitions = max(cores, math.ceil(input_bytes * EXPANSION / partition_bytes))
    split = max(MIB, min(partition_bytes, math.ceil(input_bytes / cores)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.session.timeZone": "UTC",
    }


def planned_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as its plan knows them from their files; 0 for what it can't tell."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(size for size in sizes if size < _UNKNOWN_SIZE)


#: Bytes of Parquet of which a task folds the copies in its memory, where rows take some ten times as much.
FOLD_BYTES = 32 * MIB
_SCAN = "spark.sql.files.maxPartitionBytes"


def narrow_scans(spark: SparkSession) -> None:
    """Scans give a task ``FOLD_BYTES`` at most, or less where the session says so, so that a task's memory does not follow the table's size."""
    if spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() > FOLD_BYTES:
        spark.conf.set(_SCAN, str(FOLD_BYTES))


@contextmanager
def wide_shuffle(df: DataFrame, partition_bytes: int = 256 * MIB) -> Iterator[int]:
    """Shuffles of the rows of ``df`` get as many partitions as their bytes need, or more where the session says so, and scans are narrow."""
    spark, name = df.sparkSession, "spark.sql.shuffle.partitions"
    before = {key: spark.conf.get(key) for key in (name, _SCAN)}
    wanted = max(int(before[name]), math.ceil(planned_bytes(df) * EXPANSION / partition_bytes))
    spark.conf.set(name, str(wanted))
    narrow_scans(spark)
    try:
        yield wanted
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
