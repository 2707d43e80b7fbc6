"""A corpus from documents to packed training sequences: five stages, each stored before the next."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimsieve.llm import decontaminate, jaccard, language, lines, packing
from claimsieve.staging import scratch

#: A document is rejected if the mean over its words of their largest language probability is under MIN_SURENESS, and by so much that
#: a text of as many words whose words have that mean would be with a chance of ERROR at most.
MIN_SURENESS, ERROR = 0.4, 0.2


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are surely of languages that the labelled ones among them teach, of one or of several.

    A document without a letter goes; one that switches between languages stays, and the fewer its words, the more doubt
    there may be about them. Without a labelled text no document can be judged, and all stay.
    """
    model = language.train(docs.select("text", "lang"))
    if not model.languages:
        return docs
    marked = language.with_language(docs, model, marks=("__lang", "__score"), sureness=("__sure", "__words"))
    # Hoeffding's bound on the mean of as many words
    sure = F.col("__sure") + F.sqrt(F.lit(math.log(1 / ERROR) / 2) / F.col("__words")) >= MIN_SURENESS
    return marked.where((F.col("__lang") != "und") & sure).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line that several documents hold stays in the first; ``n_chars`` follows the text."""
    out = lines.dedup_lines(docs, scratch(spark), counts=("__n_lines", "__n_dropped"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id; rows without id stay."""
    groups = jaccard.link_near_copies(docs.select("doc_id", "text"), scratch(spark))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").withColumn("__place", place)
    return one.where("__place = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    tokens = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(tokens, scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Trained and sketched stages have no SQL; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    workspace = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = workspace.stage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
