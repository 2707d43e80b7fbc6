"""CSV and Parquet tables on any file system that Spark reads, previews and schemas."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimsieve.schema import RAW


def read_claims(spark: SparkSession, path: str, schema: T.StructType = RAW, infer: bool = False) -> DataFrame:
    """Claims from CSV with a header.

    Columns are found by header name, so files may hold more columns or another order; the
    scan parses only those of ``schema``. A value that does not fit its type fails the job, but a record with too few or too many
    fields is taken as it comes; see :func:`read_claims_checked` for files that hold such values or records. ``infer`` takes names and types from the file instead, for a
    pass more over the text; codes like ``00100`` then turn into numbers.
    """
    if infer:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return read_strings(spark, path).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))


def read_claims_checked(
    spark: SparkSession, path: str, schema: T.StructType = RAW, multi_line: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Rows of well-formed records whose values all fit their types, and the others as text.

    The rejected rows have their columns as they were read, ``rejected_columns`` with the names of the columns that
    don't fit, and for a record that is none (see :func:`read_records`) ``rejected_record`` with its whole text; its columns are
    null. Store them, or count them, before going on with the first part alone.
    """
    text = read_records(spark, path, multi_line).select(*(f.name for f in schema.fields), REJECTED_RECORD)
    misfit = {
        f.name: F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
        for f in schema.fields
        if not isinstance(f.dataType, T.StringType)
    }
    refused = reduce(or_, misfit.values(), F.col(REJECTED_RECORD).isNotNull())
    typed = text.where(~refused).select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields))
    names = F.array(*(F.when(misfits, F.lit(name)) for name, misfits in misfit.items()))
    return typed, text.where(refused).withColumn("rejected_columns", F.filter(names, lambda c: c.isNotNull()))


#: The whole text of a record that is rejected as such.
REJECTED_RECORD = "rejected_record"

# In a quoted field "" or a backslash and a quote stand for one. Without these, a whole quoted field is
# a quote, no quotes and a quote, and what still begins a field with a quote is not closed or goes on behind it.
_ESCAPES, _QUOTED, _OPEN = r'\\.|""', r'(^|,)"[^"]*+"(?=,|$)', r'(?:^|,)"'


def _ill_quoted(line: Column) -> Column:
    return F.contains(line, F.lit('"')) & F.regexp_replace(F.regexp_replace(line, _ESCAPES, ""), _QUOTED, "$1").rlike(_OPEN)


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header, every column a string, and ``rejected_record``: the text of a record that is none, else null.

    Rejected, with all columns null, are records with fewer or more fields than the header, and those with a quote that is not closed
    or that something other than a comma follows. Blank lines are skipped. Without ``multi_line`` a record is a line, and files are
    split among tasks; a line end inside quotes then leaves two rejected lines. With it quoted line ends are part of the value, each file is read by one
    task, and an unclosed quote takes in what follows up to the next quote, which is rejected together; a file with an odd number of quotes,
    where one is open to the end, raises an error.
    Every file needs the header of the first, else there is an error. A pass over the text checks that, or the quotes.
    """
    header = spark.read.option("header", True).csv(path).columns
    fields = T.StructType([T.StructField(name, T.StringType()) for name in [*header, REJECTED_RECORD]])
    lines = spark.read.text(path)
    by_file = lines.groupBy(F.input_file_name().alias("file"))
    if multi_line:
        quotes = F.length(F.regexp_replace(F.regexp_replace("value", _ESCAPES, ""), r'[^"]++', ""))
        if odd := by_file.agg(F.sum(quotes).alias("quotes")).where("quotes % 2 = 1").limit(3).collect():
            raise ValueError(f"a quote is not closed in {', '.join(r['file'] for r in odd)}")
        reader = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True)
        rows = reader.option("columnNameOfCorruptRecord", REJECTED_RECORD).schema(fields).csv(path)
        # a quote that was never closed stays in front of its value
        opened = F.exists(F.array(*(f"`{c}`" for c in header)), lambda v: F.startswith(v, F.lit('"')) & F.contains(v, F.lit("\n")))
        whole = F.concat_ws(",", *(F.coalesce(f"`{c}`", F.lit("")) for c in header))
        rows = rows.withColumn(REJECTED_RECORD, F.when(opened, F.coalesce(REJECTED_RECORD, whole)).otherwise(F.col(REJECTED_RECORD)))
        good = F.col(REJECTED_RECORD).isNull()
        return rows.select(*(F.when(good, F.col(f"`{c}`")).alias(c) for c in header), REJECTED_RECORD)
    first = lines.where(F.trim("value") != "").head()
    first_line = first["value"] if first else ""
    lacking = by_file.agg(F.bool_or(F.col("value") == first_line).alias("has")).where(~F.col("has"))
    if odd := lacking.limit(3).collect():
        raise ValueError(f"the header of {', '.join(r['file'] for r in odd)} is not {first_line}")
    lines = lines.where((F.trim("value") != "") & (F.col("value") != first_line))
    parsed = F.from_csv("value", _ddl(fields), {"columnNameOfCorruptRecord": REJECTED_RECORD})
    bad = F.col(f"r.{REJECTED_RECORD}").isNotNull() | _ill_quoted(F.col("value"))
    rows = lines.select("value", parsed.alias("r")).withColumn("bad", bad)
    good = [F.when(~F.col("bad"), F.col("r").getField(c)).alias(c) for c in header]
    return _evaluated(rows.select(*good, F.when(F.col("bad"), F.col("value")).alias(REJECTED_RECORD)))


def _evaluated(df: DataFrame) -> DataFrame:
    """The same rows, as the output of a generator: no filter on them goes below it, where each column that it names would be worked out anew."""
    return df.select(F.explode(F.array(F.struct(*(f"`{c}`" for c in df.columns)))).alias("_row")).select("_row.*")


def _ddl(fields: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in fields)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string. The headers of all files have to agree."""
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, vectors included: the version that was committed last, if :func:`write_stage` wrote it, else all of ``path``."""
    version = Versions(spark, path).current()
    return spark.read.parquet(f"{path}/{version}" if version else path)


def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the table at ``path``, or create it, all at once.

    The rows go into a new folder below ``path``, and only once they are all there the pointer to the current one is swapped. A write that fails,
    or is read meanwhile, leaves the table as it was; the version before the current one stays for those who still read it.
    Read it by :func:`read_stage`.
    """
    versions = Versions(df.sparkSession, path)
    name = f"_v-{uuid.uuid4().hex}"
    try:
        writer = df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{name}")
        versions.commit(name)
    except BaseException:
        versions.delete(name)
        raise


class Versions:
    """The folders below a path that hold a table's versions, and the pointer file that names the current one and the one before it."""

    _POINTER = "_current"

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._root = self._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _names(self) -> list[str]:
        pointer = self._at(self._POINTER)
        if not self._fs.exists(pointer):
            return []
        stream = self._fs.open(pointer)
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).split()
        finally:
            stream.close()

    def current(self) -> str | None:
        return next(iter(self._names()), None)

    def commit(self, name: str) -> None:
        """Make ``name`` the current version by one rename, and delete the one that two others have followed."""
        before = self._names()
        draft = self._at(f"_next-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray("\n".join([name, *before[:1]]).encode()))
        finally:
            stream.close()
        overwrite = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = overwrite
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(draft, self._at(self._POINTER), options)
        for old in before[1:]:
            self.delete(old)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. Outer spaces of a value are kept, which the writer would drop by default."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def preview(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows: in the order of ``order_by``, else whichever the scan meets first."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def describe_schema(df: DataFrame) -> DataFrame:
    """One row per column: name, type, nullable."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")
