"""Packing tokenised documents into training sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsieve.llm.common import PIECE_BYTES, Words, ascii_lowered, pieces, ragged
from claimsieve.staging import Workspace

#: Words whose ids a worker remembers, some 150 bytes each; beyond it the memory starts anew.
KNOWN_WORDS = 600_000

#: Punctuation at a word's end, which has ids of its own. An apostrophe may belong to what follows it and stays.
PUNCTUATION = r"!#$%&*+,./:;=?@^~-"

#: The mark of a vocabulary's tokens that end a word.
WORD_END = "</w>"


class WordEncoder:
    """Ids of texts from the ids of their words, so that a worker encodes each distinct word once.

    Right for tokenizers that drop white space, lower-case, and part letters from punctuation, as
    ``word_bpe_49k`` does; others are refused. A text that holds the string of an added token, which is looked for
    before all that, is encoded as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what only looks like an added token once it is in lower case is text
        added = sorted(x.content for x in self.whole.get_added_tokens_decoder().values())
        self.added = "|".join(re.escape(x) for x in added)
        self.added_bytes = [x.encode() for x in added]
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        marks = [PUNCTUATION, *PUNCTUATION]
        if any(one(f"Ab{x} \nc{x}") != [*one("ab"), *one(x), *one("c"), *one(x)] for x in marks):
            raise ValueError(f"{path} doesn't encode words one by one")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, dtype=np.uint32)
        self.counts = np.empty(0, dtype=np.int64)

    def learn(self, new: list[str]) -> None:
        """Add words. Those of letters alone are encoded many at a time and parted at their last tokens."""
        letters = [x.lower().isalpha() for x in new]
        simple = [x for x, y in zip(new, letters) if y]
        others = [x for x, y in zip(new, letters) if not y]
        lines = [" ".join(simple[k : k + 500]) for k in range(0, len(simple), 500)]
        found = [np.array(x.ids, dtype=np.uint32) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        ids = np.concatenate([np.empty(0, dtype=np.uint32), *found])
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(simple):
            simple, others, ids, last = [], new, ids[:0], last[:0]
        rest = [x.ids for x in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        tail = np.array([i for x in rest for i in x], dtype=np.uint32)
        self.known.update(zip([*simple, *others], range(len(self.known), len(self.known) + len(new))))
        self.flat = np.concatenate([self.flat, ids, tail])
        self.counts = np.concatenate([self.counts, np.diff(last, prepend=-1), np.array([len(x) for x in rest], dtype=np.int64)])

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``; how many each has."""
        if not self._holds_added(texts):
            return self._ids_by_word(texts, end)
        marked = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, self.added), False).to_numpy(zero_copy_only=False))
        mask = np.zeros(len(texts), dtype=bool)
        mask[marked] = True
        flat, counts = self._ids_by_word(pc.if_else(pa.array(mask), pa.scalar(None, texts.type), texts), end)
        places = np.cumsum(counts) - counts
        found = [self.whole.encode(x, add_special_tokens=False).ids for x in texts.take(pa.array(marked)).to_pylist()]
        sizes = np.array([len(x) for x in found])
        counts[marked] += sizes
        return np.insert(flat, np.repeat(places[marked], sizes), np.array([i for x in found for i in x], dtype=np.uint32)), counts

    def _holds_added(self, texts: pa.Array) -> bool:
        """Whether the bytes of the texts, looked at as one, hold the string of an added token."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        if data is None or not len(texts):
            return False
        ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        chunk = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes()
        return any(x in chunk for x in self.added_bytes)

    def _ids_by_word(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        lower = ascii_lowered(texts)
        words = Words(pc.replace_substring_regex(lower, rf"([a-z])([{PUNCTUATION}]+)([ \t\n\v\f\r]|$)", r"\1 \2\3"), lower=False)
        values = words.values.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        self.learn([x for x in values if x not in self.known])
        index = np.array([*map(self.known.__getitem__, values), len(self.known)], dtype=np.int64)
        codes = index[np.insert(words.codes, words.offsets[1:], len(values))]
        lists = ragged(np.append(self.flat, np.uint32(end)), np.append(self.counts, 1), pa.uint32())
        found = lists.cast(pa.large_list(pa.uint32())).take(pa.array(codes))
        upto = found.offsets.to_numpy()[words.offsets + np.arange(len(words.offsets))]
        return found.flatten().to_numpy(), np.diff(upto)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each worker, with the words that it has seen in earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents as token pieces: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document's ids are those of its text and the id ``end``; only documents longer than
    ``capacity`` are cut, into pieces of that length and a rest. ``tokenizer`` is the path of a file
    that every executor has.
    Cases: a null or empty text is the ``end`` id alone; repeated rows give repeated pieces; an
    empty table gives no pieces; other columns are not looked at.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in pieces(batches, "__text", PIECE_BYTES // 2):
            ids, lengths = encoder.ids(batch.column("__text"), end)
            parts = -(-lengths // capacity)
            row = np.repeat(np.arange(batch.num_rows), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            size = np.minimum(lengths[row] - piece * capacity, capacity)
            data = np.ascontiguousarray(ids, dtype="<u4").data
            edges = np.concatenate([[0], np.cumsum(size)]).tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(edges, edges[1:])]
            columns = [
                batch.column("__id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(piece * capacity, pa.int64()),
                pa.array(size, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if keep_ids:
                columns.append(ragged(ids.astype(np.int32), size, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, schema)


class SumOfSquares:
    """Open bins by residual gap, and the rule that places a piece.

    A piece goes where the sum over gaps of the squared number of open bins with that gap becomes
    smallest: into a bin of some gap, or a new one. Full bins don't count; of equal
    choices the fullest bin is taken.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, dtype=np.int64)
        self.n = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset there."""
        c, open_ = self.capacity, self.open
        gaps = np.flatnonzero(open_[size:c]) + size
        change = open_[gaps - size] - open_[gaps] + 1.0
        if len(gaps) and gaps[0] == size:
            change[0] = 0.5 - open_[size]  # becomes full
        new = 0.5 + open_[c - size] if size < c else 0.0
        best = int(np.argmin(change)) if len(gaps) else -1
        if best >= 0 and change[best] <= new:
            gap = int(gaps[best])
            where = self.bins[gap].pop()
            open_[gap] -= 1
        else:
            gap, where = c, self.n
            self.n += 1
        if gap > size:
            self.bins[gap - size].append(where)
            open_[gap - size] += 1
        return where, c - gap


def pack(tokens: DataFrame, workspace: Workspace, capacity: int = 2048, per_task: int = 100_000) -> DataFrame:
    """Give each piece a place: the columns of ``tokens`` and ``sequence_id, offset``.

    The pieces are dealt by hash to as many tasks as leaves about ``per_task`` for each, and a task
    packs its own from the longest to the shortest, with at most ``capacity`` counts and its open bins in
    memory; more tasks leave a few more sequences unfilled at the end of each. Every sequence
    is filled without gaps from 0.
    Cases: repeated pieces take places of their own; an empty table gives an empty table; pieces longer than
    ``capacity`` raise an error.
    """
    heavy = [name for name, kind in tokens.dtypes if kind.startswith("array")]
    if heavy:  # ids stay where they are while places are found, and are joined to them
        tokens = tokens.withColumn("__row", F.monotonically_increasing_id())
    tokens = workspace.stage(tokens, "pieces")
    n = max(1, round(tokens.count() / per_task))
    light = tokens.select("__row", "doc_id", "piece", "length", "ids_crc32") if heavy else tokens
    names = light.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = SumOfSquares(capacity), TaskContext.get().partitionId() << 40
        for batch in batches:
            sizes = batch.column("length").to_pylist()
            if sizes and max(sizes) > capacity:
                raise ValueError(f"a piece has {max(sizes)} tokens; {capacity} fit")
            places = [bins.place(x) for x in sizes]
            where = np.array(places, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where[:, 0] + first), pa.array(where[:, 1])], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in light.dtypes) + ", sequence_id long, offset long"
    dealt = light.repartition(n, F.xxhash64("doc_id", "piece"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    placed = ordered.mapInArrow(run, schema)
    if not heavy:
        return placed
    placed = workspace.stage(placed.select("__row", "sequence_id", "offset"), "places")
    return tokens.join(placed, "__row").drop("__row")
