"""Documents that hold benchmark items, found by embedded windows and verified by edit distance."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import PIECE_BYTES, Words, mix, pieces, window_hashes

#: Word n-grams of the filter ahead of the embedding.
GRAMS = (1, 2, 3)
#: Items of more words are embedded in parts of at most PART words, as the walks drift apart over long windows.
WHOLE, PART = 60, 45


@dataclass(frozen=True)
class Search:
    """``edits``: share of an item's words that may differ. Each of ``walks`` random walks is sampled ``samples`` times, ``bits`` places each."""

    edits: float = 0.2
    walks: int = 4
    samples: int = 5
    bits: int = 5
    seed: int = 11

    def most(self, size: np.ndarray | int) -> np.ndarray | int:
        return np.floor(np.asarray(size) * self.edits + 1e-9).astype(np.int64)


def normal_hashes(words: Words) -> np.ndarray:
    """64-bit hashes of words in lower case without ASCII punctuation at their ends."""
    values = pc.ascii_trim(words.values, string.punctuation)
    hashed = [xxhash.xxh3_64_intdigest(x) for x in values.to_numpy(zero_copy_only=False).tolist()]
    return np.array(hashed, dtype=np.uint64)[words.codes]


def embed(hashes: np.ndarray, begin: np.ndarray, size: int, stop: np.ndarray, search: Search) -> np.ndarray:
    """A bucket key for each window and sample.

    A window of ``size`` words from ``begin`` (no further than ``stop``) is walked in 3 * size steps: each step emits
    the current word, or padding behind the last, and a random bit of step and word says whether to
    move on. Windows with few edits so come to strings with few differing places. A key hashes the
    emitted words of some sampled steps; walk and steps depend on the size and the seed alone.
    """
    n, steps, walks = len(begin), 3 * size, search.walks
    draws = [np.random.default_rng([search.seed, walk, size]) for walk in range(walks)]
    salts = np.stack([x.integers(1, 1 << 63, steps, dtype=np.uint64) for x in draws])
    sampled: dict[int, list[tuple[int, int]]] = {}
    for walk, sample in np.ndindex(walks, search.samples):
        for step in draws[walk].choice(steps, min(search.bits, steps), replace=False).tolist():
            sampled.setdefault(step, []).append((walk, walk * search.samples + sample))
    keys = np.repeat(np.arange(walks * search.samples, dtype=np.uint64)[:, None] + np.uint64(size << 16), n, axis=1)
    end = np.minimum(begin + size, stop)
    at = np.repeat(begin[None], walks, axis=0)
    padded = np.append(hashes, np.uint64(0))
    for step in range(max(sampled) + 1):
        symbol = padded[np.where(at < end, at, len(hashes))]
        for walk, key in sampled.get(step, ()):
            keys[key] = mix(keys[key] ^ symbol[walk])
        at += (((symbol ^ salts[:, step, None]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)).astype(np.int64)
    return keys


class ItemIndex:
    """Some items' words, the buckets of their parts by the parts' size, and the n-grams they hold.

    A short item is one part. Of a long one's parts, at least one has no larger share of edits
    than the whole, so that what leaves out no near part leaves out no near item.
    """

    def __init__(self, ids: list, texts: pa.Array, search: Search):
        words = Words(texts, lower=True)
        self.search, self.hashes, self.ids, self.offsets = search, normal_hashes(words), ids, words.offsets
        counts = np.where(words.lengths > WHOLE, -(-words.lengths // PART), np.minimum(words.lengths, 1))
        self.part_item = np.repeat(np.arange(len(counts)), counts)
        number, of = np.arange(len(self.part_item)) - np.repeat(np.cumsum(counts) - counts, counts), counts[self.part_item]
        length = words.lengths[self.part_item]
        #: where a part begins in its item
        self.part_at = number * length // np.maximum(of, 1)
        sizes = (number + 1) * length // np.maximum(of, 1) - self.part_at
        self.part_size = sizes
        self.sizes = np.unique(sizes)
        self.grams = []
        text = words.text_of_word
        for n in GRAMS:
            grams = window_hashes(self.hashes, n)
            inside = text[: len(grams)] == text[n - 1 :] if len(grams) else np.empty(0, dtype=bool)
            self.grams.append(np.unique(grams[inside]))
        self.buckets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in self.sizes.tolist():
            rows = np.flatnonzero(sizes == size)
            begin = self.offsets[self.part_item[rows]] + self.part_at[rows]
            keys = embed(self.hashes, begin, size, begin + size, search)
            flat, owner = keys.ravel(), np.tile(rows, len(keys))
            order = np.argsort(flat)
            self.buckets[size] = flat[order], owner[order]

    def item(self, row: int) -> np.ndarray:
        return self.hashes[self.offsets[row] : self.offsets[row + 1]]


def _windows(index: ItemIndex, hits: list[np.ndarray], begins: np.ndarray, stops: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size of the items' parts the starts of the windows that hold enough of the items' n-grams.

    A passage within k edits of an item of m words has at least m - n + 1 - n * k of its n-grams, and
    the window from its start at least k less; other windows can't match and are left out. What no
    size of a few neighbouring ones could match is left out first.
    """
    ends = stops[doc]
    every = np.arange(len(doc))

    def enough(starts: np.ndarray, size: int, least: list[int]) -> np.ndarray:
        good = np.ones(len(starts), dtype=bool)
        stop = np.minimum(starts + size, ends[starts])
        for n, upto, few in zip(GRAMS, hits, least):
            if few > 0:
                good &= upto[np.maximum(stop - n + 1, starts)] - upto[starts] >= few
        return starts[good]

    def bounds(size: int) -> list[int]:
        k = int(index.search.most(size))
        return [size - n + 1 - n * k - k for n in GRAMS]

    for at in range(0, len(index.sizes), 8):
        sizes = index.sizes[at : at + 8].tolist()
        maybe = enough(every, sizes[-1], [min(x) for x in zip(*map(bounds, sizes))])
        for size in sizes:
            last = np.maximum(begins, stops - size)
            yield size, enough(maybe[maybe <= last[doc[maybe]]], size, bounds(size))


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of ``item`` to a part of ``text``; that part's start and end."""
    n = len(text)
    if len(item) <= n:
        for at in np.flatnonzero(text[: n - len(item) + 1] == item[0]):
            if np.array_equal(text[at : at + len(item)], item):
                return 0, int(at), int(at) + len(item)
    cost, begin = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    place = np.arange(n + 1)
    for word in item:
        change = cost[:-1] + (text != word)
        now, start = cost + 1, begin.copy()
        better = change <= now[1:]
        now[1:] = np.where(better, change, now[1:])
        start[1:] = np.where(better, begin[:-1], start[1:])
        # words left out of the item's side: the best of all places before
        low = np.minimum.accumulate((now - place) * (n + 1) + place)
        source = low % (n + 1)
        now, begin = low // (n + 1) + place, start[source]
        cost = now
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def _search(index: ItemIndex, words: Words) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of the best match of each text and item."""
    hashes, doc = normal_hashes(words), words.text_of_word
    begins, stops = words.offsets[:-1], words.offsets[1:]
    if not len(hashes):
        return
    hits = []
    for n, grams in zip(GRAMS, index.grams):
        found = window_hashes(hashes, n)
        low = np.zeros(1 << 20, dtype=bool)
        low[grams & np.uint64((1 << 20) - 1)] = True
        maybe = np.flatnonzero(low[found & np.uint64((1 << 20) - 1)])
        hit = np.zeros(len(hashes), dtype=np.int32)
        hit[maybe[np.isin(found[maybe], grams)]] = 1
        hits.append(np.concatenate([[0], np.cumsum(hit)]))
    pairs = []
    for size, starts in _windows(index, hits, begins, stops, doc):
        if not len(starts):
            continue
        flat, owner = index.buckets[size]
        for keys in embed(hashes, starts, size, stops[doc[starts]], index.search):
            low, high = np.searchsorted(flat, keys, "left"), np.searchsorted(flat, keys, "right")
            n = high - low
            if n.any():
                place = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                pairs.append(np.stack([owner[place], np.repeat(starts, n)]))
    if not pairs:
        return
    parts, starts = np.unique(np.concatenate(pairs, axis=1), axis=1)
    # where the item would begin, which may be ahead of its text
    found = np.stack([index.part_item[parts], doc[starts], starts - index.part_at[parts]])
    order = np.lexsort(found[::-1])
    (items, texts, starts), parts = found[:, order], parts[order]
    size = np.diff(index.offsets)[items]
    most = index.search.most(size)
    # a window may begin anywhere in the words of a long item's part
    slack = most + np.where(size > WHOLE, index.part_size[parts], 0)
    # windows of one text and item that lie close together are looked at as one region
    apart = np.ones(len(items), dtype=bool)
    apart[1:] = (items[1:] != items[:-1]) | (texts[1:] != texts[:-1]) | (starts[1:] - starts[:-1] > size[1:])
    edges = np.append(np.flatnonzero(apart), len(items))
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for a, b in zip(edges, edges[1:]):
        item, text, k = int(items[a]), int(texts[a]), int(most[a])
        wide = int(slack[a:b].max())
        low = max(int(starts[a]) - wide, int(begins[text]))
        high = min(int(starts[b - 1]) + int(size[a]) + wide, int(stops[text]))
        own = index.item(item)
        # two-grams that a passage near the item has to share with it
        if np.isin(window_hashes(hashes[low:high], 2), window_hashes(own, 2)).sum() < len(own) - 1 - 2 * k:
            continue
        edits, begin, end = edit_match(own, hashes[low:high])
        if edits <= k:
            found = (edits, low + begin - int(begins[text]), low + end - int(begins[text]))
            best[text, item] = min(found, best.get((text, item), found))
    for (text, item), (edits, begin, end) in sorted(best.items()):
        yield text, item, begin, end, edits


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    search: Search = Search(),
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words_per_block: int = 1_000_000,
) -> DataFrame:
    """One row for each document and item it holds: ``doc_id, item_id, start_word, end_word, edits``.

    A document holds an item if some passage is within ``search.edits`` of the item's words in edits
    of words, compared in lower case and without ASCII punctuation at their ends. Each window as long as an item is mapped by
    random walks to a string in which few edits are few differing places; samples of
    those places are its bucket keys; items of its size in one of its buckets are verified by exact edit distance
    over the region around it. Items of more than 60 words are embedded in parts of 30 to 45 words, any of which opens the
    verification of the whole item, so that recall does not fall with the length. With the default 4 walks of 5 samples of 5 places some 99 % of passages
    with a tenth of their words edited are found, and all unedited ones.
    The items go to the tasks in blocks of at most ``words_per_block`` words (some 30 bytes a word and walk sample), one
    pass over the documents each, so that a task's memory is bounded whatever the benchmark's size. Nothing is shuffled.
    Cases: null or blank texts hold nothing and null or blank items are in nothing; the same text under
    several item ids is found as each; rows with the same doc_id give a row each; an empty
    table gives no rows; other columns are not looked at.
    """
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType
    schema = f"doc_id {kind}, item_id {item_kind.simpleString()}, start_word long, end_word long, edits long"
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))

    def matches(index: ItemIndex, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found = list(_search(index, Words(batch.column("__text"), lower=True)))
        if not found:
            return None
        text_row, item, begin, end, edits = map(list, zip(*found))
        ids = batch.column("__id").take(pa.array(text_row))
        columns = [ids, pa.array([index.ids[x] for x in item]), *(pa.array(x, pa.int64()) for x in (begin, end, edits))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start_word", "end_word", "edits"])

    out = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, search, item_id, item_text, words_per_block):
        out = out.unionByName(rows.mapInArrow(_each(index, "__text", matches), schema))
    return out


def without_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    search: Search = Search(),
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    words_per_block: int = 1_000_000,
) -> DataFrame:
    """The rows of ``docs``, with all columns, that hold no item; see :func:`contaminated`.

    Row by row, so that ids may be null or repeated; a null or blank text stays.
    """
    schema = ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)

    def clean(index: ItemIndex, batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, dtype=bool)
        keep[[x[0] for x in _search(index, Words(batch.column(text), lower=True))]] = False
        return batch.filter(pa.array(keep))

    for index in _blocks(benchmark, search, item_id, item_text, words_per_block):
        docs = docs.mapInArrow(_each(index, text, clean), schema)
    return docs


def _each(index: Broadcast, text: str, f: Callable[[ItemIndex, pa.RecordBatch], pa.RecordBatch | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, 2 * PIECE_BYTES):
            out = f(index.value, batch)
            if out is not None:
                yield out

    return run


def _blocks(benchmark: DataFrame, search: Search, item_id: str, item_text: str, words_per_block: int) -> Iterator[Broadcast]:
    """The benchmark's items in blocks of a bounded number of words (or one item), each sent to the executors."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    context = benchmark.sparkSession.sparkContext
    ids: list = []
    texts: list[str] = []
    held = 0
    for row in items.orderBy("i", "t").toLocalIterator():
        n = len(row["t"].split())
        if texts and held + n > words_per_block:
            yield context.broadcast(ItemIndex(ids, pa.array(texts, pa.string()), search))
            ids, texts, held = [], [], 0
        ids.append(row["i"])
        texts.append(row["t"])
        held += n
    if texts:
        yield context.broadcast(ItemIndex(ids, pa.array(texts, pa.string()), search))
