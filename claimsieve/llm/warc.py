"""WARC archives: written as text files by Spark, read back by the chain of their record lengths."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimsieve.staging import Workspace

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: The alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base32: each five hex digits are four characters.

    Digest and numbers are variables of lambdas: an expression inside one would be worked out anew for each element, and the payload hashed 32 times.
    """
    letter = lambda number, shift: F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1))
    four = lambda number: F.concat(*(letter(number, shift) for shift in (15, 10, 5, 0)))

    def encoded(digits: Column) -> Column:
        fives = F.array(*(F.conv(F.substring(digits, F.lit(5 * k + 1), F.lit(5)), 16, 10).cast("int") for k in range(8)))
        return F.array_join(F.transform(fives, four), "")

    return F.transform(F.array(F.sha1(data)), encoded)[0]


def header_value(text: Column) -> Column:
    """A value on one line: line ends are percent-encoded."""
    return F.regexp_replace(F.regexp_replace(text, "\r", "%0D"), "\n", "%0A")


def write_warc(
    pages: DataFrame, path: str, workspace: Workspace, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0
) -> None:
    """Write a record for each page to text files below ``path``.

    Of pages with equal payloads of at least ``min_bytes`` bytes that with the smallest id becomes a
    response; the others become revisits that name it and carry the payload's length and digest in
    place of the payload. Equal means the same SHA-256 and length.
    Cases: a null payload is empty; a null url has no header; line ends in a url are percent-encoded;
    pages that share an id and a payload are the same page and are of the same type; a page without
    id is a revisit of a page with one, else a response; an empty table writes no record.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), data.alias("data"))
    rows = rows.withColumn("key", F.sha2("data", 256)).withColumn("size", F.octet_length("data"))
    found = rows.where(F.col("size") >= min_bytes).groupBy("key", "size")
    first = found.agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = workspace.stage(first, "repeated_payloads")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("data"))))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        F.when(F.col("url").isNull(), "").otherwise(line("WARC-Target-URI", header_value(F.col("url")))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        digest,
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", urn(F.col("first"))),
                line("X-Payload-Length", F.col("size").cast("string")),
                line("Content-Length", F.lit("0")),
            ),
        ).otherwise(line("Content-Length", F.col("size").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("data").cast("string")),
    )
    rows.join(first, ["key", "size"], "left").select(record.alias("value")).write.option("lineSep", END).text(path)


def read_warc(
    spark: SparkSession, path: str, workspace: Workspace, summary: Callable[[Column], list[Column]] = lambda payload: [payload.alias("payload")]
) -> DataFrame:
    """The records of the archives below ``path``: file, start, header fields, and what ``summary`` makes of the payload.

    Any task may start in the middle of a file: it takes every magic string as a candidate record,
    and from the candidate's Content-Length follows where the next record has to start. Candidates
    that a file's start reaches over these links are records; magic strings inside payloads are not
    reached, and their parts are put back into the payload. The links are followed by pointer
    jumping: each round doubles the steps, so that a file of n records takes log2(n) rounds over
    a table of a few numbers for each candidate. Payloads are not shuffled, but for those of records
    that a magic string cuts.
    Cases: an empty file or folder gives no rows; a file stops counting at its first broken record.
    """
    found = _scan(spark, path)
    light = found.select("file", "block", "at", "size", *_links(), *_fields(summary))
    light = workspace.stage(light, "warc_parts")
    starts = workspace.stage(_starts(light), "warc_starts")
    reached = _reached(starts.where("next is not null").select("file", "start", "next"), workspace)
    records = starts.join(reached, ["file", "start"], "left_semi")
    # a record has ended where its part ends, unless a magic string in its payload cuts it
    whole = F.col("start") + len(MAGIC) + F.col("size") == F.col("next")
    records = workspace.stage(records.withColumn("whole", whole), "warc_records")
    own = records.where("whole").select("at", "start").join(light.drop("block", "size", "head_size", "length"), "at").drop("at")
    cut = records.where("not whole").select("file", "start", F.col("next").alias("to"))
    if cut.isEmpty():
        return own
    parts = workspace.stage(found.join(cut.select("file").distinct(), "file", "left_semi"), "warc_cut_files")
    again = _starts(parts.select("file", "block", "at", "size", *_links()))
    return own.unionByName(_glued(again, cut, parts).select("file", "start", *_fields(summary)))


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic strings: file, block, order in the block, value, header."""
    meta = F.col("_metadata")
    parts = (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            meta["file_path"].alias("file"),
            meta["file_block_start"].alias("block"),
            F.monotonically_increasing_id().alias("at"),
            "value",
            F.substring_index("value", END, 1).alias("head"),
        )
        .withColumn("size", F.octet_length("value").cast("long"))
    )
    return parts.withColumn("head", F.when(F.octet_length("head") < F.col("size"), F.col("head")))


def _links() -> list[Column]:
    length = F.regexp_extract("head", r"(?im)^Content-Length: *(\d{1,18}) *$", 1)
    return [F.octet_length("head").alias("head_size"), length.alias("length")]


def _starts(parts: DataFrame) -> DataFrame:
    """Where each part starts (all that its block has before it, and all earlier blocks of the file), and the next record."""
    step = F.col("size") + len(MAGIC)
    in_block = Window.partitionBy("file", "block").orderBy("at")
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    blocks = blocks.select(
        "file",
        "block",
        F.coalesce(F.sum("bytes").over(in_file), F.lit(0)).alias("base"),
        (F.sum("bytes").over(Window.partitionBy("file")) - len(MAGIC)).alias("file_bytes"),
    )
    return (
        parts.select("file", "block", "at", "size", "head_size", "length")
        .join(blocks, ["file", "block"])
        .withColumn("start", F.col("base") + F.sum(step).over(in_block) - step - len(MAGIC))
        .withColumn("content", F.when(F.col("length") != "", F.col("length")).cast("long"))
        .withColumn("next", F.col("start") + len(MAGIC) + F.col("head_size") + len(END) + F.col("content") + len(END))
        .where("start >= 0")
        .select("file", "at", "start", "size", F.when(F.col("next") <= F.col("file_bytes"), F.col("next")).alias("next"))
    )


def _reached(links: DataFrame, workspace: Workspace) -> DataFrame:
    """The (file, start) that a file's first byte reaches over the links."""
    state = workspace.stage(links.withColumn("seen", F.col("start") == 0), "warc_links")
    most = state.groupBy("file").count().agg(F.max("count")).head()[0] or 0
    for _ in range(math.ceil(math.log2(most + 1)) if most else 0):
        there = state.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        hit = state.where("seen").select("file", F.col("next").alias("start")).distinct().withColumn("hit", F.lit(True))
        state = (
            state.join(there, ["file", "next"], "left")
            .join(hit, ["file", "start"], "left")
            .select("file", "start", F.col("far").alias("next"), (F.col("seen") | F.col("hit").isNotNull()).alias("seen"))
        )
        state = workspace.stage(state, "warc_links")
    return state.where("seen").select("file", "start")


def _glued(starts: DataFrame, cut: DataFrame, parts: DataFrame) -> DataFrame:
    """Records whose payload holds magic strings: their parts in order, with the magic between."""
    so_far = Window.partitionBy("file").orderBy("start")
    begun = F.when(F.col("to").isNotNull(), F.struct("start", "to"))
    marked = (
        starts.join(cut.select("file").distinct(), "file", "left_semi")
        .join(cut, ["file", "start"], "left")
        .withColumn("owner", F.last(begun, ignorenulls=True).over(so_far))
        .where("start < owner.to")
        .select("at", F.col("start").alias("part"), "owner")
    )
    ordered = F.sort_array(F.collect_list(F.struct("part", "value")))
    joined = marked.join(parts.select("at", "file", "value"), "at").groupBy("file", "owner").agg(ordered.alias("all"))
    value = F.array_join(F.col("all.value"), MAGIC)
    return joined.select("file", F.col("owner.start").alias("start"), F.substring_index(value, END, 1).alias("head"), value.alias("value"))


def _fields(summary: Callable[[Column], list[Column]]) -> list[Column]:
    """Headers and payload of a record's text without its magic."""

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("head", rf"(?im)^{name}: *(.*?)\r?$", 1), F.lit(""))

    data = F.col("value").cast("binary")
    size = field("Content-Length").cast("int")
    payload = F.substring(data, F.octet_length("head") + len(END) + 1, size)
    return [
        field("WARC-Type").alias("type"),
        F.regexp_extract("head", r"(?im)^WARC-Record-ID: *<urn:page:(-?\d*)>", 1).alias("id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_extract("head", r"(?im)^WARC-Refers-To: *<urn:page:(-?\d+)>", 1).alias("refers_to"),
        F.regexp_extract("head", r"(?im)^WARC-Payload-Digest: *sha1:(\w+)", 1).alias("digest"),
        field("X-Payload-Length").cast("long").alias("full_length"),
        *summary(payload),
    ]
