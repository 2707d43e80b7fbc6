"""Runs of repeated words within a text, found by internal pattern matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import PIECE_BYTES, Words, pieces


class Factors:
    """Suffix array of some texts together with names of all their factors of 2^k words.

    ``names[k][i]`` is the first place in the suffix array of the suffixes that share the 2^k words at ``i``, and
    ``sizes[k][i]`` how many they are. Words of different texts differ, and a factor that its text cuts off is
    alone, so equal names are equal factors within one text. Only factors that are not yet alone are sorted again.
    """

    def __init__(self, codes: np.ndarray, offsets: np.ndarray):
        n = len(codes)
        self.n = n
        lengths = np.diff(offsets)
        text = np.repeat(np.arange(len(lengths)), lengths)
        self.begin, self.end = offsets[:-1][text], offsets[1:][text]
        key = text * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        slots = np.arange(n)
        self.names: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.order = order.copy()
        name, size = np.empty(n + 1, dtype=np.int64), np.ones(n, dtype=np.int64)
        name[n] = -1
        sorted_key = key[order]
        while True:
            new = np.ones(len(order), dtype=bool)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(order)))
            name[order], size[order] = np.repeat(slots[first], count), np.repeat(count, count)
            self.order[slots] = order
            self.names.append(name.astype(np.int32))
            self.sizes.append(size.astype(np.int32))
            several = np.repeat(count > 1, count)
            if not several.any():
                return
            width = 1 << (len(self.names) - 1)
            order, slots = order[several], slots[several]
            then = order + width
            follow = np.where(then < self.end[order], name[np.minimum(then, n)], -1)
            key = name[order] * (n + 1) + follow + 1
            again = np.argsort(key, kind="stable")
            order, sorted_key = order[again], key[again]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on."""
        found = np.zeros(len(i), dtype=np.int64)
        for k in reversed(range(len(self.names))):
            a, b = np.minimum(i + found, self.n), np.minimum(j + found, self.n)
            found += np.where((self.names[k][a] == self.names[k][b]) & (a < self.n), 1 << k, 0)
        return found

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` equal those before ``j``, where ``i < j`` lie in one text."""
        found, begin = np.zeros(len(i), dtype=np.int64), self.begin[i]
        for k in reversed(range(len(self.names))):
            a, b = i - found - (1 << k), j - found - (1 << k)
            inside = a >= begin
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            found += np.where(inside & (self.names[k][a] == self.names[k][b]), 1 << k, 0)
        return found


class WaveletTree:
    """Order statistics of ranges of an array of numbers from 0 on, many queries at once.

    One level for each bit, from the highest; at each the numbers whose bit is 0 go before the others and keep their order.
    """

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]).astype(np.int32))
            values = np.concatenate([values[zero], values[~zero]])

    def less(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers at ``[low, high)`` are under ``x``."""
        beyond = x >= 1 << self.bits
        found = np.zeros(len(x), dtype=np.int64)
        a, b = low, high
        for level, zeros in enumerate(self.zeros):
            one = (x >> (self.bits - 1 - level)) & 1 == 1
            a0, b0 = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            found += np.where(one, b0 - a0, 0)
            a, b = np.where(one, zeros[-1] + a - a0, a0), np.where(one, zeros[-1] + b - b0, b0)
        return np.where(beyond, high - low, found)

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest number at ``[low, high)``, from 0 on. With ``k = less(low, high, x)`` it is the successor of ``x``."""
        found = np.zeros(len(k), dtype=np.int64)
        a, b = low, high
        for level, zeros in enumerate(self.zeros):
            a0, b0 = zeros[a].astype(np.int64), zeros[b].astype(np.int64)
            one = k >= b0 - a0
            k = np.where(one, k - (b0 - a0), k)
            found |= np.where(one, 1 << (self.bits - 1 - level), 0)
            a, b = np.where(one, zeros[-1] + a - a0, a0), np.where(one, zeros[-1] + b - b0, b0)
        return found


def search_windows(min_length: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(k, from, to): a run of period from <= q < to holds an aligned block of 2^k words that is there again q words on.

    Of a run of n words, the first n - q come again; they hold an aligned block if they are at least 2^(k+1) - 1. A window
    has at most 2^k places, so that the places of a block in it, if several, are in arithmetic progression.
    """
    q = 1
    while 2 * q <= longest and max(min_length, 2 * q) <= longest:
        k = (max(min_length, 2 * q) - q + 1).bit_length() - 2
        end = q
        while end - q < 1 << k and (max(min_length, 2 * end) - end + 1).bit_length() - 2 == k:
            end += 1
        yield k, q, end
        q = end


def _candidates(factors: Factors, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and the periods that a run around them may have: from the places of aligned blocks in the windows after them."""
    longest = int((factors.end - factors.begin).max(initial=0))
    windows = [x for x in search_windows(min_length, longest) if x[0] < len(factors.names)]
    starts, periods = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    if not windows:
        return starts[0], periods[0]
    # only suffixes that share the shortest blocks with others are searched
    least = min(k for k, _, _ in windows)
    shared = factors.sizes[least][factors.order] > 1
    number = np.concatenate([[0], np.cumsum(shared)])
    tree = WaveletTree(factors.order[shared])
    blocks: dict[int, np.ndarray] = {}
    for k, near, far in windows:
        if k not in blocks:
            several = np.flatnonzero(factors.sizes[k] > 1)
            blocks[k] = several[(several - factors.begin[several]) & ((1 << k) - 1) == 0]
        i = blocks[k]
        i = i[i + near + (1 << k) <= factors.end[i]]
        if not len(i):
            continue
        name = factors.names[k][i].astype(np.int64)
        low, high = number[name], number[name + factors.sizes[k][i]]
        before = tree.less(low, high, i + near)
        there = tree.less(low, high, i + far) - before
        some = there > 0
        i, low, high, before, there = (x[some] for x in (i, low, high, before, there))
        first = tree.smallest(low, high, before) - i
        step, covered = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=bool)
        more = np.flatnonzero(there > 1)
        if len(more):
            second = tree.smallest(low[more], high[more], before[more] + 1) - i[more]
            step[more] = second - first[more]
            last = first[more] + (there[more] - 1) * step[more]
            # one run of the smaller period holds the block and all its places: their distances are its multiples
            covered[more] = (first[more] % step[more] == 0) & (factors.forward(i[more], i[more] + step[more]) >= last)
        lone = covered & (first == step)
        open_ = ~covered
        count = there[open_]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts += [i[lone], np.repeat(i[open_], count)]
        periods += [first[lone], np.repeat(first[open_], count) + nth * np.repeat(step[open_], count)]
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(codes: np.ndarray, offsets: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of some texts' words, by start, then period; places count over all texts.

    A run is a stretch of words that are the same ``period`` words apart, its smallest period, at least
    ``min_length`` and two periods long, that no word of the text next to it extends.
    """
    factors = Factors(codes, offsets)
    i, q = _candidates(factors, min_length)
    start = i - factors.backward(i, i + q)
    end = i + q + factors.forward(i, i + q)
    long = end - start >= np.maximum(min_length, 2 * q)
    start, end, q = start[long], end[long], q[long]
    # a stretch that comes with several periods has the smallest, the others are its multiples
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], q[new]
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


def with_runs(docs: DataFrame, text: str = "text", min_length: int = 12, marks: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """All columns of ``docs`` and ``marks``: the number of words, the runs, and the text without their repeats.

    ``runs`` has (start, length, period) of every run of the text's words, by start, then period. ``collapsed`` has the words
    that no run holds after its first ``period`` words, joined by one space. A text's
    aligned blocks of 2^k words are looked for in the windows after them whose distance a period may have; the places
    are read from a wavelet tree over the suffix array, and each period they give is extended to both sides.
    Nothing is shuffled. A task holds the words of some texts at a time, or of one long text: up to 300 bytes a word.
    Cases: a null, empty or blank text has no words, no runs and collapsed text ""; rows are looked at one by one, so repeated
    ones and null ids don't matter; runs of equal length are all kept; an empty table gives an empty table; columns named like the marks
    are replaced, others are not looked at.
    """
    rest = [x for x in docs.columns if x not in marks]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{x}` {kinds[x]}" for x in rest)
    schema += f", `{marks[0]}` long, `{marks[1]}` array<struct<start: long, length: long, period: long>>, `{marks[2]}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, PIECE_BYTES // 4):
            words = Words(batch.column(text), lower=False)
            start, end, period = find_runs(words.codes, words.offsets, min_length)
            held = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(held, start + period, 1)
            np.add.at(held, end, -1)
            keep = np.cumsum(held)[:-1] == 0
            row = np.searchsorted(words.offsets, start, side="right") - 1
            counts = np.bincount(row, minlength=batch.num_rows)
            parts = [pa.array(x, pa.int64()) for x in (start - words.offsets[row], end - start, period)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            columns = [*(batch.column(x) for x in rest), pa.array(words.lengths, pa.int64()), runs, words.joined(keep).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, *marks])

    read = docs.select(*rest) if text in rest else docs.select(*rest, text)
    return read.mapInArrow(run, schema)


def longest_run(runs: Column) -> Column:
    """The longest of the runs, of those the first, of those the one of smallest period; null if there is none."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def runs_text(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
