"""Ranked lexical search: the best documents for each of a table of texts, exactly, by accumulator-limited term-at-a-time evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimsieve.llm.common import Words, pieces, ragged, release_memory, term_texts
from claimsieve.staging import Workspace

#: What ``common.term_texts`` parts by blanks, as a regular expression over text whose A-Z are in lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Weighting:
    """How much repeats of a term and a document's length count: k1 in tenths and b in hundredths, as scores are whole numbers."""

    repeats: int = 12
    length: int = 25

    def norm(self, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
        return 100 - self.length + (self.length * n * documents) // max(terms, 1)

    def impact(self, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + self.repeats * norm)


@dataclass(frozen=True)
class Block:
    """Some items: ``terms`` are the different terms of all of them, an item's are ``numbers[begin:end]`` with their ``counts``."""

    ids: list
    terms: pa.Array
    numbers: np.ndarray
    counts: np.ndarray
    begins: np.ndarray


def _block(ids: list, texts: list[str]) -> Block:
    words = Words(term_texts(pa.array(texts, pa.large_string())), lower=False)
    number = {x: k for k, x in enumerate(dict.fromkeys(ids))}
    item = np.repeat(np.array([number[x] for x in ids], dtype=np.int64), words.lengths)
    size = max(1, len(words.values))
    both, counts = np.unique(item * size + words.codes, return_counts=True)
    return Block(list(number), words.values, both % size, counts, np.searchsorted(both // size, np.arange(len(number) + 1)))


def _blocks(items: DataFrame, item_id: str, item_text: str, terms_per_block: int) -> Iterator[Block]:
    """The items in blocks of about ``terms_per_block`` words at most, or one item; rows of one id are together."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    ids: list = []
    texts: list[str] = []
    held = 0
    for row in rows.orderBy("i").toLocalIterator():
        if held > terms_per_block and row["i"] != ids[-1]:
            yield _block(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        held += len(row["t"]) // 4
    if ids:
        yield _block(ids, texts)


class Shard:
    """The inverted lists of some documents, and their best for one item after the other."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, counts: np.ndarray, norms: np.ndarray, ranks: np.ndarray, n_terms: int, weighting: Weighting):
        doc = np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(terms, kind="stable")
        self.ranks = ranks
        self.docs = doc[order]
        self.impacts = weighting.impact(tfs[order].astype(np.int64), norms[self.docs])
        self.begins = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, dtype=np.int64)
        some = np.flatnonzero(np.diff(self.begins))
        if len(some):
            self.most[some] = np.maximum.reduceat(self.impacts, self.begins[some])

    def best(self, numbers: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of those that may be among the best ``k`` of all, given that ``k`` others have ``floor`` at least.

        ``numbers`` are the item's terms, the rarest first. While a document that has none of the terms so far could still come in, each of a term's
        documents gets an accumulator. Once what the terms left can give is under the k-th best partial score, no more are
        made; those that can still reach it are updated by all terms left, so that their scores are whole.
        """
        bounds = weights * self.most[numbers]
        left = np.append(np.cumsum(bounds[::-1])[::-1], 0)
        scores = np.zeros(len(self.ranks), dtype=np.int64)
        needed, at = floor, 0
        while at < len(numbers) and left[at] >= max(needed, 1):
            a, b = self.begins[numbers[at]], self.begins[numbers[at] + 1]
            if weights[at] and a < b:
                scores[self.docs[a:b]] += weights[at] * self.impacts[a:b]
            at += 1
            # the k-th score is no more than the largest, so it is looked for only where that could end the search
            if left[at] and left[at] < scores.max(initial=0) and len(scores) > k:
                needed = max(needed, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
        open_ = np.flatnonzero((scores > 0) & (scores + left[at] >= needed))
        partial = scores[open_]
        for j in range(at, len(numbers)):
            a, b = self.begins[numbers[j]], self.begins[numbers[j] + 1]
            if not len(open_):
                break
            if weights[j] and a < b:
                place = np.minimum(np.searchsorted(self.docs[a:b], open_), b - a - 1)
                there = self.docs[a:b][place] == open_
                partial[there] += weights[j] * self.impacts[a:b][place[there]]
        order = np.lexsort((self.ranks[open_], -partial))[:k]
        return open_[order], partial[order]


def _postings(docs: DataFrame, block: Block, doc_id: str, text: str) -> DataFrame:
    """``__id, n, terms, tfs``: how many terms each document has, and how often it has each of the block's terms."""
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    terms = docs.sparkSession.sparkContext.broadcast(block.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        for batch in pieces(batches, "__text"):
            words = Words(term_texts(batch.column("__text")), lower=False)
            number = pc.fill_null(pc.index_in(words.values, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
            found = number >= 0
            both, tf = np.unique(words.text_of_word[found] * len(known) + number[found], return_counts=True)
            counts = np.bincount(both // len(known), minlength=batch.num_rows)
            columns = [batch.column("__id"), pa.array(words.lengths, pa.int64()), ragged(both % len(known), counts, pa.int32()), ragged(tf, counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["__id", "n", "terms", "tfs"])

    return rows.mapInArrow(count, f"__id {kind}, n long, terms array<int>, tfs array<int>")


def search(
    docs: DataFrame,
    items: DataFrame,
    workspace: Workspace,
    k: int = 20,
    weighting: Weighting = Weighting(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    terms_per_block: int = 500_000,
    postings_per_shard: int = 2_000_000,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0, equal scores by ascending id.

    Terms are the longest stretches of ASCII letters, digits and other than ASCII characters, with A-Z in lower case. A document's score for an item is
    the sum over the item's terms, repeats included, of the term's weight by the documents that hold it, times what
    its repeats in the document give for the document's length; all in whole numbers, so that scores
    are the same however the documents are split.
    A first pass counts the items' terms in each document, and Spark brings together in how many documents each is. A second goes through the stored counts in
    shards of ``postings_per_shard``, each with inverted lists in memory: the items' terms are evaluated the rarest first, no accumulators are made once those without
    one can't reach the k-th partial score, and the rest are updated to the end. A task's best scores so far hold for its later shards.
    Only k rows an item and shard leave a task. Items go to the tasks in blocks of about ``terms_per_block`` words, some 50 bytes each, two passes for each block; nothing is cut off.
    Cases: a null, empty or blank text is a document without terms, which doesn't count among the documents; an item without known terms has no
    rows; items of one id are one item with the terms of all its rows, and those without id are left out; documents with the same id are ranked each, and a null id comes first among equals; empty
    tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    arrow_kind = to_arrow_type(items.schema[item_id].dataType)
    out = []
    for block in _blocks(items, item_id, item_text, terms_per_block):
        postings = workspace.stage(_postings(docs, block, doc_id, text), "postings")
        size = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).head()
        # a row for each of the block's terms at most
        held = postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        rare = F.floor(1000 * F.log((2 * F.lit(size["documents"]) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        df, weight = np.zeros(len(block.terms), dtype=np.int64), np.zeros(len(block.terms), dtype=np.int64)
        for row in held.withColumn("w", rare.cast("long")).toLocalIterator():
            df[row["term"]], weight[row["term"]] = row["df"], row["w"]
        sent = spark.sparkContext.broadcast((block, df, weight, size["documents"], size["terms"] or 0))

        def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, df, weight, documents, terms = sent.value
            lists = []
            for a, b in zip(block.begins, block.begins[1:]):
                numbers, counts = block.numbers[a:b], block.counts[a:b]
                order = np.lexsort((numbers, df[numbers]))
                lists.append((numbers[order], (counts * weight[numbers])[order]))
            floors = [0] * len(lists)
            for ids, n, counts, found, tfs in _shards(batches, postings_per_shard):
                order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
                ranks = np.empty(len(order), dtype=np.int64)
                ranks[order] = np.arange(len(order))
                shard = Shard(found, tfs, counts, weighting.norm(n, documents, terms), ranks, len(df), weighting)
                item, rows, scores = [], [], []
                for j, (numbers, weights) in enumerate(lists):
                    who, score = shard.best(numbers, weights, k, floors[j])
                    if len(score) == k:
                        floors[j] = max(floors[j], int(score[-1]))
                    item.append(np.full(len(who), j))
                    rows.append(who)
                    scores.append(score)
                item_, rows_ = np.concatenate(item), pa.array(np.concatenate(rows))
                columns = [pa.array(block.ids, arrow_kind).take(pa.array(item_)), ids.take(rows_), pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "score"])
                del shard, found, tfs
                release_memory()

        found = postings.mapInArrow(evaluate, f"item_id {item_kind}, doc_id {kind}, score long")
        rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
        best = found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out.append(workspace.stage(best, "best"))
        sent.destroy()
    empty = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    return reduce(DataFrame.unionByName, out) if out else empty


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, terms of each, postings of each, their terms, their repeats) of batches brought together until they have ``size`` postings."""
    held: list[pa.RecordBatch] = []
    n = 0

    def together():
        table = pa.Table.from_batches(held).combine_chunks()
        lists = [pa.concat_arrays(table.column(x).chunks) for x in ("terms", "tfs")]
        counts = pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
        return pa.concat_arrays(table.column("__id").chunks), table.column("n").to_numpy(), counts, *flat

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += len(batch.column("terms").flatten())
        if n >= size:
            yield together()
            held, n = [], 0
    if held:
        yield together()
