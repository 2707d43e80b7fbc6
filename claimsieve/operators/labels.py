"""Category labels ordered by frequency, and the index of each row's label.

The index of a label is its place in its column by descending frequency, ties in order of the
label. The labels are a stored table, however many there are. Up to half a million of them make a broadcast dictionary of
hashes, so that no row is moved; only a column with more has a shuffle, in which neither a
label of the table nor one that it lacks can be hot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.staging import Workspace

_OFFSET_BITS = 33  # monotonically_increasing_id: partition above, row in the partition below

#: Labels of all columns together that the broadcast dictionaries hold: (64-bit hash, 32-bit hash, index), some 48 bytes a label in
#: memory whatever its length, so 24 MB at most.
HEAD = 500_000

#: Places over which the rows with a label outside the head are spread.
_SALTS = 32


def label_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, label), all columns in one pass; nulls are no label."""
    return (
        df.select(*columns)
        .unpivot([], list(columns), "column", "label")
        .where(F.col("label").isNotNull())
        .groupBy("column", "label")
        .count()
    )


def indexed_labels(counts: DataFrame, workspace: Workspace) -> DataFrame:
    """(column, label, count, index, clash), however many labels there are.

    Up to ``HEAD`` labels, a number that is checked, are numbered by a window over each column; a range shuffle orders more, of which
    only the size of each of its partitions is collected. ``clash`` marks the labels whose 64-bit hash another one of their column has.
    """
    counts = workspace.stage(counts, "label_counts")
    if counts.count() <= HEAD:
        place = F.row_number().over(Window.partitionBy("column").orderBy(F.col("count").desc(), "label"))
        return _with_clashes(counts.withColumn("index", place.cast("long") - 1))
    return _with_clashes(_ordered(counts, workspace))


def _with_clashes(labels: DataFrame) -> DataFrame:
    alike = Window.partitionBy("column", F.xxhash64("label"))
    return labels.withColumn("clash", F.count("*").over(alike) > 1)


def _ordered(counts: DataFrame, workspace: Workspace) -> DataFrame:
    order = [F.col("column"), F.col("count").desc(), F.col("label")]
    ordered = workspace.stage(
        counts.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()),
        "ordered_labels",
    )
    part = F.shiftright("place", _OFFSET_BITS)
    row = F.col("place").bitwiseAND((1 << _OFFSET_BITS) - 1)
    # A partition may span two columns: sizes by both give the start of each run.
    sizes = ordered.groupBy("column", part.alias("part")).agg(F.count("*").alias("size"), F.min(row).alias("first"))
    starts, column, reached = [], None, 0
    for r in sorted(sizes.collect(), key=lambda r: (r["column"], r["part"])):
        reached = reached if r["column"] == column else 0
        column = r["column"]
        starts.append((column, r["part"], reached - r["first"]))
        reached += r["size"]
    shifts = counts.sparkSession.createDataFrame(starts, "column string, part long, shift long")
    return (
        ordered.withColumn("part", part)
        .join(F.broadcast(shifts), ["column", "part"])
        .select("column", "label", "count", (row + F.col("shift")).alias("index"))
    )


def _hashes(column: str) -> tuple[Column, Column]:
    return F.xxhash64(column), F.hash(column)


def label_numbers(labels: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many labels each column has."""
    found = {r["column"]: r["size"] for r in labels.groupBy("column").agg(F.count("*").alias("size")).collect()}
    return {c: found.get(c, 0) for c in columns}


def index_by_join(
    df: DataFrame,
    labels: DataFrame,
    columns: Sequence[str],
    head: int = HEAD,
    names: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Add ``<column>_Index``; null and unseen values share the index after the labels.

    The rows are read once. Each column has a broadcast dictionary of its labels of index below ``head`` (or below an
    equal share of ``HEAD``, if all columns together have more), found by 96 bits of hashes, of which 64 are the key; labels that share the key with another one are left out. A column with
    labels beyond its dictionary has a second join, by shuffle, on the text and a salt: rows that are settled or null take part under a label that is
    none, and an unseen label is spread by the salt, however many rows have it. ``names`` are the
    labels in order, for the attribute of the index column.
    """
    sizes = label_numbers(labels, columns)
    if sum(min(n, head) for n in sizes.values()) > HEAD:
        head = HEAD // len(columns)
    own_columns = df.columns
    in_head = (F.col("index") < head) & ~F.col("clash")
    beyond = set()
    if any(n > head for n in sizes.values()) or labels.where("clash").limit(1).count():
        beyond = {r["column"] for r in labels.where(~in_head).select("column").distinct().collect()}
    for place, column in enumerate(columns):
        own = labels.where((F.col("column") == column) & in_head)
        own = own.select(*(h.alias(n) for h, n in zip(_hashes("label"), ("_key", "_check"))), F.col("index").cast("double").alias(f"_index_{place}"))
        key, check = _hashes(f"`{column}`")
        df = df.join(F.broadcast(own), (key == own["_key"]) & (check == own["_check"]) & F.col(f"`{column}`").isNotNull(), "left").drop("_key", "_check")
    for place, column in enumerate(columns):
        if column not in beyond:
            continue
        open_ = F.col(column).isNotNull() & F.col(f"_index_{place}").isNull()
        spread = F.monotonically_increasing_id()
        rest = labels.where((F.col("column") == column) & ~in_head)
        rest = rest.select(
            F.col("label").alias("_key"),
            F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)).cast("array<long>")).alias("_salt"),
            F.col("index").cast("double").alias("_rest"),
        )
        # settled rows have a negative salt, which no row of the labels has
        keys = {"_key": F.when(open_, F.col(column)).otherwise(""), "_salt": F.when(open_, spread % _SALTS).otherwise(-1 - spread)}
        joined = df.withColumns(keys).join(rest, ["_key", "_salt"], "left")
        df = joined.withColumn(f"_index_{place}", F.coalesce(f"_index_{place}", "_rest")).drop("_key", "_salt", "_rest")
    indices = []
    for place, column in enumerate(columns):
        name = f"{column}_Index"
        nominal = {"type": "nominal", "name": name}
        nominal |= {"vals": [*names[column], "__unknown"]} if names else {"num_vals": sizes[column] + 1}
        indices.append(F.coalesce(F.col(f"_index_{place}"), F.lit(float(sizes[column]))).alias(name, metadata={"ml_attr": nominal}))
    return df.select(*own_columns, *indices)
