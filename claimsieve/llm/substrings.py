"""Passages that occur earlier, found by recompression."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimsieve.llm.common import Words, mix, pieces, ragged, window_hashes
from claimsieve.staging import Workspace

#: Rounds of naming runs and pairs. Two make symbols of some two words that depend on some nine.
ROUNDS = 2
#: Farther than any window reaches.
FAR = 1 << 40


def _runs(symbol, begin, end, low, high, text):
    """Name each run of a symbol. Its ends depend on the symbols next to it."""
    n = len(symbol)
    new = np.ones(n, dtype=bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    named = np.where(size > 1, mix(symbol[first] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), symbol[first])
    near_low, near_high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    inner = (first > 0) & (text[before] == text[first])
    near_low = np.where(inner, np.minimum(near_low, low[before]), -FAR)
    near_high = np.where(inner, np.maximum(near_high, high[before]), near_high)
    inner = (last < n - 1) & (text[after] == text[first])
    near_high = np.where(inner, np.maximum(near_high, high[after]), FAR)
    near_low = np.where(inner, np.minimum(near_low, low[after]), near_low)
    return named, begin[first], end[last], near_low, near_high, text[first]


def _pairs(symbol, begin, end, low, high, text, seed: int):
    """Name each pair of a left and a right symbol; a bit of a symbol's hash says which it is."""
    n = len(symbol)
    right = (mix(symbol ^ np.uint64(seed)) >> np.uint64(40)) & np.uint64(1) == 1
    linked = np.zeros(n, dtype=bool)  # to the next symbol of the text
    linked[:-1] = text[1:] == text[:-1]
    joined = np.zeros(n, dtype=bool)
    joined[:-1] = linked[:-1] & ~right[:-1] & right[1:]
    second = np.zeros(n, dtype=bool)
    second[1:] = joined[:-1]
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    # a left symbol looked at the next, a right one at the one before
    has_before = np.zeros(n, dtype=bool)
    has_before[1:] = linked[:-1]
    seen = np.where(right, before, after)
    there = np.where(right, has_before, linked)
    near_low = np.where(there, np.minimum(low, low[seen]), np.where(right, -FAR, low))
    near_high = np.where(there, np.maximum(high, high[seen]), np.where(right, high, FAR))
    named = np.where(joined, mix(symbol * np.uint64(0x9FB21C651E98DF25) + symbol[after] + np.uint64(seed)), symbol)
    keep = ~second
    return named[keep], begin[keep], np.where(joined, end[after], end)[keep], near_low[keep], near_high[keep], text[keep]


def recompress(hashes: np.ndarray, text: np.ndarray, rounds: int = ROUNDS):
    """Symbols of the texts' words: name, begin, end, and from where to where the words decide it.

    Names are hashes, so equal words get equal names everywhere without a table of names. Wherever the words
    from ``low`` to ``high`` occur, the same symbol is found among them.
    """
    at = np.arange(len(hashes))
    state = (hashes, at, at + 1, at, at + 1, text)
    for round_ in range(rounds):
        state = _pairs(*_runs(*state), seed=0xC2B2AE3D + round_)
    return state[:5]


def window_keys(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, key, place of the symbol, hash) of each window of ``size`` words within a text.

    The key is that of one symbol that the window's words decide, the one with the smallest hash of the words it depends
    on; equal windows so have equal keys, and neighbouring windows mostly share one. A window that decides no
    symbol, as in a long run, has a key of its own words.
    """
    hashes, text, lengths = words.hashes(), words.text_of_word, words.lengths
    starts = np.arange(len(hashes) - size + 1) if len(hashes) >= size else np.empty(0, dtype=np.int64)
    starts = starts[text[starts] == text[starts + size - 1]] if len(starts) else starts
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64), starts, np.empty(0, dtype=np.uint64)
    name, begin, _, low, high = recompress(hashes, text)
    near = high - low <= size
    name, begin, low, high = name[near], begin[near], low[near], high[near]
    # hashes of word ranges from sums over powers of an odd number
    base = np.uint64(0xD1342543DE82EF95)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    powers, back = _powers(base, len(hashes) + 1), _powers(inverse, len(hashes) + 1)
    upto = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(hashes) * powers[:-1], dtype=np.uint64)])
    key = mix((upto[high] - upto[low]) * back[low] ^ mix(name + (begin - low).astype(np.uint64)))
    mask = np.uint64((1 << max(24, len(key).bit_length())) - 1)
    order = (key & ~mask) | np.arange(len(key), dtype=np.uint64)
    best = np.full(len(hashes), np.uint64(0xFFFFFFFFFFFFFFFF))
    count = low - (high - size) + 1  # windows that hold what a symbol depends on
    for k in range(int(count.max(initial=0))):
        here = np.flatnonzero((count > k) & (high - size + k >= 0))
        np.minimum.at(best, high[here] - size + k, order[here])
    whole = mix((upto[starts + size] - upto[starts]) * back[starts])
    chosen = best[starts]
    none = chosen == np.uint64(0xFFFFFFFFFFFFFFFF)
    keys, places = mix(whole + np.uint64(1)), -1 - starts
    symbol = (chosen[~none] & mask).astype(np.int64)
    keys[~none], places[~none] = key[symbol], begin[symbol]
    return starts, keys, places, whole


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(max(n, 1 << 20), base, dtype=np.uint64), dtype=np.uint64)])
        _POWERS[int(base)] = known
    return known[:n]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_PARSED = "__id {id}, __n long, __sha string, __a long, __b long, __self boolean, __keys array<long>"


def dedup_substrings(docs: DataFrame, workspace: Workspace, size: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, removed`` for each row of ``docs``.

    A window is ``size`` consecutive words of a text. Each word in a window whose words also start earlier (in a
    document with a smaller id, or before in the same) is removed; ``removed`` has the (begin, end) word spans, and the digest is that of the
    words left, joined by one space. Texts are recompressed: rounds that name runs and pairs of symbols give equal passages
    equal symbols inside. Each window stands under one such symbol, one for several neighbouring windows, and only
    those symbols are shuffled; where two places share one, the windows under it are compared by
    128 bits of hashes of their words, and all but the earliest go. Texts with equal words are
    looked at once.
    Cases: a null or blank text has no words; a text with fewer than ``size`` words stays; rows that share an id
    are no source for each other, beyond what each text repeats of itself; a row without id stays whole and is no
    source; an empty table gives an empty table; other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    schema = _PARSED.format(id=kind)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in pieces(batches, "__text"):
            words = Words(batch.column("__text"), lower=False)
            joined = words.joined().to_pylist()
            sha = [hashlib.sha256(x.encode()) for x in joined]
            valid = batch.column("__id").is_valid().to_numpy(zero_copy_only=False)
            new = np.zeros(len(sha), dtype=bool)
            for k, x in enumerate(sha):
                mark = x.digest()[:16]
                if valid[k] and mark not in seen:
                    new[k] = True
                    seen.add(mark)
            marks = np.frombuffer(b"".join(x.digest()[:16] for x in sha), dtype=np.int64).reshape(-1, 2)
            starts, keys, places, _ = window_keys(words, size)
            owner = words.text_of_word[starts]
            # windows under one symbol give its key once
            head = np.ones(len(keys), dtype=bool)
            head[1:] = places[1:] != places[:-1]
            head &= new[owner]
            keys, owner = keys[head], owner[head]
            again = np.zeros(len(sha), dtype=bool)
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            same = (keys[1:] == keys[:-1]) & (owner[1:] == owner[:-1])
            again[owner[1:][same]] = True
            once = np.concatenate([[True], ~same])[: len(keys)]
            keys, owner = keys[once], owner[once]
            columns = [
                batch.column("__id"),
                pa.array(words.lengths, pa.int64()),
                pa.array([x.hexdigest() for x in sha]),
                pa.array(marks[:, 0]),
                pa.array(marks[:, 1]),
                pa.array(again),
                ragged(_signed(keys), np.bincount(owner, minlength=len(sha)), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    known = workspace.stage(rows.mapInArrow(parsed, schema), "parsed")
    alike = ["__n", "__a", "__b"]
    classes = known.where(f"__n >= {size}").groupBy(*alike).agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
    classes = workspace.stage(classes.where("__first < __last").drop("__last"), "classes")
    copies = known.select("__id", *alike).join(classes, alike).where("__id > __first").select("__id", "__first").distinct()
    copies = workspace.stage(copies, "copies")

    # symbols found in several texts; texts that hold one of their own twice
    by_key = Window.partitionBy("key").orderBy("__id")
    keyed = known.where("__id is not null").select("__id", F.explode("__keys").alias("key"))
    keyed = keyed.withColumns({"before": F.lag("__id").over(by_key), "after": F.lead("__id").over(by_key)})
    shared = keyed.where("before is not null and before != __id or after is not null and after != __id").select("__id", "key")
    alone = known.where("__id is not null and __self").select("__id", F.lit(None).cast("long").alias("key"))
    shared = shared.unionByName(alone).join(copies, "__id", "left")
    shared = shared.groupBy(F.coalesce("__first", "__id").alias("__id")).agg(F.collect_set("key").alias("__shared"))
    texts = workspace.stage(rows.join(shared, "__id"), "texts")

    # a window that its own text has before needs no other text; it goes along under a mark of its own
    window_schema = f"__id {kind}, __at int, __p long, __q long, __own boolean"
    windows = texts.mapInArrow(lambda batches: _windows(batches, size), window_schema)
    earliest = Window.partitionBy("__p", "__q").orderBy("__id", "__at")
    first = F.first("__id").over(earliest)
    later = windows.withColumn("first", first).where("__own or first != __id")
    later = later.groupBy("__id").agg(F.collect_set("__at").alias("__starts"))

    cut_schema = f"__id {kind}, __sha string, __cut long, __kept string, __spans array<struct<begin: int, end: int>>"
    cut = texts.drop("__shared").join(later, "__id").mapInArrow(lambda batches: _cut(batches, size), cut_schema).distinct()
    cut = workspace.stage(cut, "cut")
    out = known.drop("__keys", "__self").join(cut, ["__id", "__sha"], "left").join(classes.withColumnRenamed("__first", "__twin"), alike, "left")
    out = out.withColumn("__copy", F.coalesce(F.col("__id") > F.col("__twin"), F.lit(False)))
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("__n").cast("int").alias("end")))
    return out.select(
        F.col("__id").alias("doc_id"),
        F.col("__n").alias("n_words"),
        F.when(F.col("__copy"), F.col("__n")).otherwise(F.coalesce("__cut", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("__copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("__kept", "__sha")).alias("kept_sha256"),
        F.when(F.col("__copy"), whole).otherwise(F.coalesce("__spans", F.array().cast("array<struct<begin: int, end: int>>"))).alias("removed"),
    )


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The windows under shared symbols, or under symbols that their text has twice, with two hashes."""
    for batch in pieces(batches, "__text"):
        words = Words(batch.column("__text"), lower=False)
        starts, keys, places, whole = window_keys(words, size)
        owner = words.text_of_word[starts]
        lists = batch.column("__shared")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        wanted = np.zeros(len(starts), dtype=bool)
        edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                own = keys[a:b]
                change = np.concatenate([[True], places[a + 1 : b] != places[a : b - 1]])
                values, counts = np.unique(own[change], return_counts=True)
                wanted[a:b] = np.isin(own, np.concatenate([flat[offsets[k] : offsets[k + 1]], values[counts > 1]]))
        starts, whole, owner = starts[wanted], whole[wanted], owner[wanted]
        other = window_hashes(mix(words.hashes() ^ np.uint64(0x8CB92BA72F3D8DD7)), size)[starts] if len(starts) else whole
        order = np.lexsort((starts, other, whole, owner))
        again = np.zeros(len(order), dtype=bool)
        again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (whole[order[1:]] == whole[order[:-1]]) & (other[order[1:]] == other[order[:-1]])
        at = starts - words.offsets[owner]
        whole = np.where(again, mix(whole + starts.astype(np.uint64)), whole)
        columns = [batch.column("__id").take(pa.array(owner)), pa.array(at, pa.int32()), pa.array(_signed(whole)), pa.array(_signed(other)), pa.array(again)]
        yield pa.RecordBatch.from_arrays(columns, ["__id", "__at", "__p", "__q", "__own"])


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Digest, number of words removed and their spans, from the starts of windows that occur earlier."""
    for batch in pieces(batches, "__text"):
        words = Words(batch.column("__text"), lower=False)
        lists = batch.column("__starts")
        counts = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), counts)
        begin = words.offsets[row] + lists.values.to_numpy(zero_copy_only=False)[lists.offsets[0].as_py() :][: len(row)]
        inside = begin + size <= words.offsets[row + 1]  # a start is of this text, not of another with its id
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(covered, begin[inside], 1)
        np.add.at(covered, np.minimum(begin[inside] + size, len(words)), -1)
        gone = np.cumsum(covered[:-1]) > 0
        text = words.text_of_word
        # spans end at a text's end
        new = np.zeros(len(words) + 1, dtype=bool)
        new[words.offsets] = True
        before = np.concatenate([[False], gone[:-1]])[: len(gone)] & ~new[:-1]
        after = np.concatenate([gone[1:], [False]])[: len(gone)] & ~new[1:]
        starts, ends = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        owner = text[starts]
        spans = pa.StructArray.from_arrays([pa.array(starts - words.offsets[owner], pa.int32()), pa.array(ends - words.offsets[owner], pa.int32())], ["begin", "end"])
        span_offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]).astype(np.int32)
        digest = lambda column: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in column.to_pylist()])
        columns = [
            batch.column("__id"),
            digest(words.joined()),
            pa.array(np.bincount(text[gone], minlength=batch.num_rows), pa.int64()),
            digest(words.joined(~gone)),
            pa.ListArray.from_arrays(pa.array(span_offsets), spans),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["__id", "__sha", "__cut", "__kept", "__spans"])
