import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimsieve.llm import jaccard
from claimsieve.llm.common import Words, pieces
from tests.llm.cases import documents, frame

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain_links(rows, threshold, n):
    parent = {doc: doc for doc, *_ in rows if doc is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(doc, shingles(text, n)) for doc, text, *_ in rows]
    known = [(doc, s) for doc, s in sets if doc is not None and s]
    for k, (a, s) in enumerate(known):
        for b, t in known[:k]:
            if threshold.of * len(s & t) >= threshold.share * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return Counter((doc, len(s), None if doc is None else find(doc)) for doc, s in sets)


def linked(spark, workspace, rows, threshold, n, **how):
    out = jaccard.link_near_copies(frame(spark, rows, **how), workspace, threshold, n)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(tuple(r) for r in out.collect())


@pytest.mark.parametrize("share, n", [(85, 4), (80, 5)])
def test_cases_against_plain(spark, workspace, share, n):
    threshold = jaccard.Threshold(share)
    assert linked(spark, workspace, documents(), threshold, n) == plain_links(documents(), threshold, n)


def family(seed, size, words, edits):
    """A chain of texts, each some edits away from an earlier one."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(30)}" for _ in range(words)]]
    while len(texts) < size:
        copy = list(rng.choice(texts))
        for _ in range(rng.randint(1, edits)):
            place = rng.randrange(len(copy))
            copy[place : place + rng.randint(0, 1)] = [f"v{rng.randrange(30)}"] * rng.randint(0, 2)
        texts.append(copy)
    return [" ".join(x) for x in texts]


def test_chains_of_near_copies(spark, workspace):
    texts = [t for seed, (words, edits) in enumerate([(8, 1), (12, 1), (20, 1), (60, 2), (150, 3), (700, 12)]) for t in family(seed, 40, words, edits)]
    random.Random(3).shuffle(texts)
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    threshold = jaccard.Threshold(85)
    found = linked(spark, workspace, rows, threshold, 4, extra=False)
    assert found == plain_links(rows, threshold, 4)
    assert len({c for _, _, c in found}) < len(rows) - 30


@pytest.mark.parametrize("block, pairs", [(3, 5), (50, 1 << 20)])
def test_buckets_in_blocks(spark, workspace, monkeypatch, block, pairs):
    """Buckets of several blocks, and pairs a few at a time, give the same links."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "PAIRS", pairs)
    texts = [t for seed, (words, edits) in enumerate([(20, 1), (150, 9), (300, 12)]) for t in family(seed, 60, words, edits)]
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    threshold = jaccard.Threshold(85)
    assert linked(spark, workspace, rows, threshold, 4, extra=False) == plain_links(rows, threshold, 4)


def test_all_pairs_of_a_table(spark, workspace):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    threshold = jaccard.Threshold(85)
    assert linked(spark, workspace, rows, threshold, 4, extra=False) == plain_links(rows, threshold, 4)


def test_folded_sketches_are_compared_like_single_ones():
    rng = np.random.default_rng(4)
    counts = np.array([3, 40, 45, 300, 370, 5000, 1])
    bits = jaccard.bit_sketches(rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64), counts, jaccard.Threshold(85), jaccard.SHORT)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(7), np.arange(7)))
    assert jaccard._Folding(bits).apart(i, j, room=64).tolist() == [jaccard.bits_apart(bits[a], bits[b]) for a, b in zip(i, j)]


def test_sets_that_link_share_a_key():
    rng = np.random.default_rng(5)
    threshold = jaccard.Threshold(85)
    missed = tried = 0
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(30):
            total = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            a, b = total[:size], total[rng.integers(0, max(1, size // 6)) :][: rng.integers(int(size * 0.85), int(size / 0.85) + 1) or 1]
            common = len(np.intersect1d(a, b))
            if 100 * common < 85 * (len(a) + len(b) - common):
                continue
            tried += 1
            values, counts = np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)])
            owner, keys = jaccard.bucket_keys(values, counts, threshold)
            missed += not set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
    assert tried > 500 and missed == 0


def test_weak_sketches_share_a_key_too(monkeypatch):
    """Sets whose sketches agree in empty words alone."""
    monkeypatch.setattr(jaccard, "SKETCHES", 2)
    rng = np.random.default_rng(2)
    threshold = jaccard.Threshold(85)
    for _ in range(4000):
        total = np.sort(rng.integers(0, 1 << 63, 8, dtype=np.uint64))
        owner, keys = jaccard.bucket_keys(np.concatenate([total, total[:7]]), np.array([8, 7]), threshold)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_bands_hold_all_pairs_that_link():
    threshold = jaccard.Threshold(85)
    edges = threshold.bands(3000)
    for a in range(1, 3000):
        b = min(a * 100 // 85, 3000)
        low, high = np.searchsorted(edges, [a, b], side="right") - 1
        assert high - low <= 1
        assert b - a <= threshold.most_apart(edges[high + 1] - 1)


def test_no_rows_and_a_hot_group(spark, workspace):
    assert linked(spark, workspace, [], jaccard.Threshold(), 5) == Counter()
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(base[:k] + ["new"] + base[k:]) if k % 2 else " ".join(base), None, None, None) for k in range(300)]
    found = linked(spark, workspace, rows, jaccard.Threshold(), 5, extra=False)
    assert {c for _, _, c in found} == {0}


@pytest.mark.parametrize("block", [4096, 7])
def test_a_pair_leaves_few_of_the_buckets_it_shares(spark, workspace, monkeypatch, block):
    """All pairs across components leave, near copies with many common buckets but once."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), 1 << 63, 200, dtype=np.int64).tolist()
    members = {k: set(np.flatnonzero(rng.random(30) < 0.6).tolist()) for k in keys[:150]}
    members |= {k: set(rng.choice(np.arange(20, 60), 3, replace=False).tolist()) for k in keys[150:]}
    rows = spark.createDataFrame([(k, d, d // 2) for k, docs in members.items() for d in docs], "key long, doc long, component long")
    sketches = spark.createDataFrame([(d, 100, bytearray(64)) for d in range(60)], "doc long, n long, bits binary")
    dealt = jaccard._open_buckets(rows, workspace).join(sketches, "doc")
    monkeypatch.setattr(type(rows), "distinct", lambda self: self)
    found = [tuple(r) for r in jaccard._close_in_buckets(dealt, jaccard.Threshold(85), "all").collect()]
    want = {(a, b) for docs in members.values() for a in docs for b in docs if a < b and a // 2 != b // 2}
    assert set(found) == want and len(found) < 1.5 * len(want)


def test_words_match_plain_words():
    texts = [None, "", " \t", "Ä b", "\x0bA\x0cb\r\n", "a\x85b\x1cc d e", "x " * 5]
    for lower in (True, False):
        words = Words(pa.array(texts), lower)
        values = words.values.to_pylist()
        found = [[values[c] for c in words.codes[a:b]] for a, b in zip(words.offsets, words.offsets[1:])]
        assert found == [WORD.findall((t or "").translate(LOWER) if lower else t or "") for t in texts]


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 50, None, "b", "c" * 99, "", "d" * 10, "e"])], ["k", "t"])
    cut = list(pieces(iter([batch, batch.slice(0, 0), batch.slice(2, 3)]), "t", 60))
    assert [x for b in cut for x in b.column("k").to_pylist()] == [*range(7), 2, 3, 4]
    assert len(cut) > 3


def test_bits_apart_bound_the_difference():
    rng = np.random.default_rng(8)
    threshold = jaccard.Threshold(85)
    for size in (1, 5, 40, 300, 3000):
        for other in (size, max(1, size * 3 // 4), size * 2):
            total = np.unique(rng.integers(0, 1 << 63, 2 * size + other, dtype=np.uint64))
            rng.shuffle(total)
            a, b = total[:size], total[size // 3 :][:other]
            one, two = jaccard.bit_sketches(np.concatenate([a, b]), np.array([len(a), len(b)]), threshold)
            assert jaccard.bits_apart(one, two) == jaccard.bits_apart(two, one) <= len(np.setxor1d(a, b))
            assert jaccard.bits_apart(one, one) == 0
