"""Exact deduplication by sorting the contents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import ascii_lower
from claimsieve.staging import Workspace

#: Characters of a text that stand for it among the splitters; what follows them counts by its hash.
SPLITTER_CHARS = 64

_RUNS = "__id {id}, __row long, __sha string, __size long, __keep {id}, __part int, __run long, __edge boolean, __text string"


def dedup_exact(docs: DataFrame, workspace: Workspace, doc_id: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """For each document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest
    id stays (``keep="min"``: the smallest). The rows are range-partitioned by sampled splitters of
    (first characters, hash of the text, id), so that a text with very many copies spreads over
    partitions, and each partition is sorted by (first characters, hash, whole text, id), which spills
    to disk where it has to. A task then compares each text with its neighbour in full. Only the first and
    last run of a partition may go on in another; those few are brought together by their full texts.
    Cases: a null text is empty; of rows with equal ids and texts one is kept; a row without
    id sorts before all others, and stays only if no row of its text has an id; an empty table gives an empty
    table. Other columns are not looked at.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    kind = docs.schema[doc_id].dataType.simpleString()
    body = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).alias("__id"), body.alias("__text"))
    rows = rows.withColumns({"__head": F.substring("__text", 1, SPLITTER_CHARS), "__hash": F.xxhash64("__text")})
    order = F.col("__id").desc_nulls_last() if keep == "max" else F.col("__id").asc_nulls_last()
    rows = rows.repartitionByRange("__head", "__hash", order).sortWithinPartitions("__head", "__hash", "__text", order)
    runs = workspace.stage(rows.select("__id", "__text").mapInArrow(_runs, _RUNS.format(id=kind)), "runs")

    # texts that are first or last in some partition: two rows of a partition at most
    best = F.max("__keep") if keep == "max" else F.min("__keep")
    ends = runs.where("__text is not null").select("__part", "__run", "__keep", "__size", "__text")
    all_of = ends.groupBy("__text").agg(best.alias("__best"), F.sum("__size").alias("__total"), F.min(F.struct("__part", "__run")).alias("__head"))
    ends = ends.select("__part", "__run", "__text").join(all_of, "__text").drop("__text")
    ends = workspace.stage(ends, "run_ends")
    joined = runs.drop("__text").join(ends, ["__part", "__run"], "left")
    keep_id = F.coalesce("__best", "__keep")
    # of several rows with the id that stays, the first row of the first run
    first = (F.col("__row") == 0) & (F.col("__head").isNull() | (F.col("__head") == F.struct("__part", "__run")))
    return joined.select(
        F.col("__id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("__total", "__size").alias("group_size"),
        (F.col("__id").eqNullSafe(keep_id) & first).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal neighbours with their run's size and best id; the text with a run at either end.

    A run is let out when the next begins. What it keeps are ids, 8 bytes each, and one text.
    """
    part, number = TaskContext.get().partitionId(), 0
    text, ids = None, []

    def close(edge: bool) -> pa.RecordBatch:
        every = pa.concat_arrays(ids)
        n = len(every)
        row = np.arange(n)
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
        texts = pa.concat_arrays([pa.array([text if edge else None], pa.string()), pa.nulls(n - 1, pa.string())])
        sha = hashlib.sha256(text.encode()).hexdigest()
        return [every, pa.array(row), same(sha, pa.string()), same(n, pa.int64()), same(every[0].as_py(), every.type), same(part, pa.int32()), same(number, pa.int64()), same(edge, pa.bool_()), texts]

    names = [x.split()[0] for x in _RUNS.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("__text")
        changes = np.flatnonzero(~pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)) + 1
        cuts = [0, *changes.tolist(), batch.num_rows]
        done: list[list[pa.Array]] = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            here = texts[a].as_py()
            if text is not None and (k or here != text):
                done.append(close(edge=number == 0))
                number, ids = number + 1, []
            text = here
            ids.append(batch.column("__id")[a:b])
        if done:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*done)], names)
    if text is not None:
        yield pa.RecordBatch.from_arrays(close(edge=True), names)
