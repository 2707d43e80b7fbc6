"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _LIBC = None  # another C library, which has no such call

#: The white space that parts words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: Text bytes a task looks at together. Arrays over its words take some ten times as much.
PIECE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def hash128(*columns: Column) -> list[Column]:
    """Two hashes of the columns that start from different seeds."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(0x9E3779B9), *columns)]


def release_memory() -> None:
    """Give freed memory back to the system: workers live on between tasks, several on a machine."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that the texts of each hold about ``size`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(lengths, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch, lengths, group
        release_memory()


def ascii_lowered(texts: pa.Array) -> pa.Array:
    """A-Z in lower case; null as empty. The texts are copied first, as ``ascii_lower`` misreads slices of arrays."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))


#: What each byte of UTF-8 becomes where terms are looked for: letters and digits in lower case, other ASCII a blank.
_TERM_BYTES = np.array([x if x >= 0x80 else ord(chr(x).lower()) if chr(x).isalnum() else 0x20 for x in range(256)], dtype=np.uint8)


def term_texts(texts: pa.Array) -> pa.Array:
    """The terms of each text, parted by blanks: the longest stretches of ASCII letters, digits and other than ASCII characters, A-Z in lower case."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = texts.take(pa.array(np.arange(len(texts))))  # a copy without an offset
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(_TERM_BYTES[np.frombuffer(data, dtype=np.uint8)]))


class Words:
    """The words of some texts as codes of their distinct words.

    ``codes`` has the word at each place, ``offsets`` where each text starts among them,
    ``values`` the distinct words. A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        texts = ascii_lowered(texts) if lower else pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        encoded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        self.values = encoded.dictionary
        self.codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets = offsets - offsets[0]
        # white space at either end of a text leaves an empty string there
        empty = pc.index(self.values, pa.scalar("", self.values.type)).as_py()
        if empty >= 0:
            keep = self.codes != empty
            before = np.concatenate([[0], np.cumsum(keep)])
            self.codes, self.offsets = self.codes[keep], before[self.offsets]

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the word at each place."""
        hashed = [xxhash.xxh3_64_intdigest(x) for x in self.values.to_numpy(zero_copy_only=False).tolist()]
        return np.array(hashed, dtype=np.uint64)[self.codes]

    def joined(self, keep: np.ndarray | None = None) -> pa.Array:
        """The kept words of each text, joined by one space."""
        codes, offsets = self.codes, self.offsets
        if keep is not None:
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            codes = codes[keep]
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.values.take(pa.array(codes)))
        return pc.binary_join(lists, pa.scalar(" ", self.values.type))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """At each place the hash of the ``n`` values from there; the last ``n - 1`` places have none."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    size = len(hashes) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(3) + hashes[k : k + size]) if k == n - 1 else out * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + size]
    return out


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: ``counts`` values for each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
