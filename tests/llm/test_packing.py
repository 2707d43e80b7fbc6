import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from claimsieve.llm import packing
from claimsieve.llm.common import read_table
from tests.llm.cases import documents, frame

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


ODD = ["it's I'll we've", "a.b, c.", "a,, b.. c.,", "x!. y", "<|endoftext|> a<|startoftext|>b", "A <|endoftext|> B", "a <|EndOfText|> b", "<|endoftext|", "<|endoftext|><|endoftext|>İ x", "İstanbul ǅ ß Σίσυφος", "é ́a", "1,2. 3.4", "a b\x85c\x1cd", "中文。字", "…", "A.\nB,\tC.", "don't,", "a!?., b### c$$$ d*** e'.! f- g&'s i~^", "ab.'s cd/'ll x<|endoftext|>!", "é!! É## ö.", ".", " , ", "﻿z​q"]


@pytest.mark.parametrize("known", [0, 10**6])
def test_ids_of_words_are_those_of_the_text(monkeypatch, known):
    monkeypatch.setattr(packing, "KNOWN_WORDS", known)
    encoder = packing.WordEncoder(PATH)
    texts = [*ODD, None, "", *(x[1] for x in documents())]
    for _ in range(2):
        ids, lengths = encoder.ids(pa.array(texts), 0)
        cut = np.concatenate([[0], np.cumsum(lengths)])
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [plain_ids(t) for t in texts]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def check_packed(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("capacity, per_task", [(2048, 100_000), (64, 10)])
def test_cases_against_plain(spark, workspace, capacity, per_task):
    tokens = packing.token_pieces(frame(spark), PATH, capacity)
    out = packing.pack(tokens, workspace, capacity, per_task).collect()
    expected = Counter()
    for doc, text, *_ in documents():
        ids = plain_ids(text)
        for piece, start in enumerate(range(0, len(ids), capacity)):
            cut = ids[start : start + capacity]
            expected[doc, piece, start, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes()), tuple(cut)] += 1
    assert Counter((*r[:5], tuple(r["ids"])) for r in out) == expected
    check_packed(out, capacity)


def test_few_sequences(spark, workspace):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    out = packing.pack(packing.token_pieces(docs, PATH, keep_ids=False), workspace).collect()
    assert check_packed(out, 2048) <= 1.02 * sum(r["length"] for r in out) / 2048 + 2


def plain_rule(sizes, capacity):
    bins = []
    for size in sizes:
        options = []
        for gap in sorted({capacity - b for b in bins if b < capacity} | {capacity}):
            if gap >= size:
                counts = Counter(capacity - b for b in bins if b < capacity)
                if gap < capacity:
                    counts[gap] -= 1
                if gap > size:
                    counts[gap - size] += 1
                options.append((sum(x * x for x in counts.values()), gap))
        cost, gap = min(options)
        if gap == capacity:
            bins.append(size)
        else:
            bins[[capacity - b for b in bins].index(gap)] += size
    return sorted(bins)


def test_sum_of_squares_rule():
    rng = np.random.default_rng(3)
    for capacity in (5, 12, 30):
        for _ in range(20):
            sizes = rng.integers(1, capacity + 1, 60).tolist()
            packer, filled = packing.SumOfSquares(capacity), Counter()
            for size in sizes:
                where, offset = packer.place(size)
                assert offset == filled[where]
                filled[where] += size
            assert sorted(filled.values()) == plain_rule(sizes, capacity)


def test_no_rows_and_a_piece_too_long(spark, workspace):
    assert packing.pack(packing.token_pieces(frame(spark, []), PATH), workspace).count() == 0
    with pytest.raises(Exception, match="fit"):
        packing.pack(packing.token_pieces(frame(spark), PATH), workspace, 10).count()
