"""Line deduplication: a line that several documents hold stays in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import BLANKS, ascii_lower, hash128
from claimsieve.staging import Workspace


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def dedup_lines(
    docs: DataFrame,
    workspace: Workspace,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """Drop the lines whose key at least ``min_docs`` documents hold, except in the smallest of them.

    A key is the line without blanks at its ends and with A-Z in lower case; only keys of at least
    ``min_chars`` code points count. All copies within the smallest document stay. Every line is one
    row of an aggregate by the key's 128-bit hash, which folds within each task first; the keys found
    often are joined to the lines again, where Spark splits a hot key's rows.

    Returns all columns and rows of ``docs``, with the text as it is left, and two more (``counts``,
    replacing columns of those names): the number of lines before, and of those dropped.
    Cases: a null text counts as one empty line and becomes empty; rows with the same id are one
    document; a row without id loses no line and counts for no key; the text may end up empty;
    an empty table gives an empty table.
    """
    lines = F.split(F.col("__text"), "\n", -1)
    keyed = docs.withColumns({"__id": F.col(doc_id), "__text": F.coalesce(F.col(text), F.lit(""))})
    keyed = keyed.withColumn("__row", F.xxhash64("__text"))

    def exploded() -> DataFrame:
        a, b = hash128(F.col("__key"))
        return (
            keyed.where(F.col("__id").isNotNull())
            .select("__id", "__row", F.posexplode(lines).alias("__at", "__line"))
            .select("__id", "__row", "__at", line_key(F.col("__line")).alias("__key"))
            .where(F.length("__key") >= min_chars)
            .select("__id", "__row", "__at", a.alias("__a"), b.alias("__b"))
        )

    counted = exploded().groupBy("__a", "__b")
    if min_docs == 2:
        often = counted.agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last")
    else:
        each = exploded().groupBy("__a", "__b", "__id").agg(F.lit(1).alias("__one")).groupBy("__a", "__b")
        often = each.agg(F.min("__id").alias("__first"), F.count("*").alias("__docs")).where(F.col("__docs") >= min_docs)
    often = workspace.stage(often.select("__a", "__b", "__first"), "repeated_lines")
    dropped = (
        exploded()
        .join(often, ["__a", "__b"])
        .where("__id > __first")
        .groupBy("__id", "__row")
        .agg(F.collect_set("__at").alias("__drop"))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__drop")
    rest = F.array_join(F.transform(kept, lambda k: F.element_at("__lines", k + 1)), "\n")
    out = keyed.join(dropped, ["__id", "__row"], "left").withColumn("__lines", lines)
    values = {
        text: F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(rest),
        counts[0]: F.size("__lines").cast("long"),
        counts[1]: F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
    }
    return out.withColumns(values).select(*dict.fromkeys([*docs.columns, *values]))
