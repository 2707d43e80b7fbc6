import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimsieve.llm import substrings
from claimsieve.llm.common import Words
from tests.llm.cases import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_cuts(rows, size):
    texts = {(doc, text or "") for doc, text, *_ in rows if doc is not None}
    first = {}
    for doc, text in texts:
        words = WORD.findall(text)
        for k in range(len(words) - size + 1):
            window = tuple(words[k : k + size])
            first[window] = min(first.get(window, (doc, k)), (doc, k))
    out = Counter()
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - size + 1):
            if doc is not None and first[tuple(words[k : k + size])] < (doc, k):
                gone[k : k + size] = [True] * size
        spans = [m.span() for m in re.finditer("1+", "".join(map(str, map(int, gone))))]
        kept = hashlib.sha256(" ".join(w for w, g in zip(words, gone) if not g).encode()).hexdigest()
        out[doc, len(words), sum(gone), kept, tuple(spans)] += 1
    return out


def cuts(spark, workspace, rows, size, **how):
    out = substrings.dedup_substrings(frame(spark, rows, **how), workspace, size).collect()
    return Counter((r[0], r[1], r[2], r[3], tuple(tuple(s) for s in r["removed"])) for r in out)


@pytest.mark.parametrize("size", [20, 5])
def test_cases_against_plain(spark, workspace, size):
    rows = documents()
    assert cuts(spark, workspace, rows, size) == plain_cuts(rows, size)


def test_periodic_and_shuffled_passages(spark, workspace):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh")
    passages = [[word() for _ in range(rng.randint(20, 70))] for _ in range(6)]
    texts = []
    for k in range(60):
        parts = [[word() for _ in range(rng.randint(0, 30))] for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            parts.insert(rng.randrange(4), passage[rng.randint(0, 5) :])
        if k % 7 == 0:
            parts.append([word() for _ in range(rng.randint(1, 4))] * rng.randint(8, 40))
        texts.append(" ".join(w for p in parts for w in p))
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    found = cuts(spark, workspace, rows, 20, extra=False)
    assert found == plain_cuts(rows, 20)
    assert sum(r[2] for r in found) > 500


def test_no_rows(spark, workspace):
    assert cuts(spark, workspace, [], 20) == Counter()


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(1)
    for letters in (2, 5, 1000):
        passage = [f"w{x}" for x in rng.integers(0, letters, 45)]
        texts = []
        for _ in range(30):
            before, after = ([f"w{x}" for x in rng.integers(0, letters, rng.integers(0, 12))] for _ in range(2))
            texts.append(" ".join(before + passage + after))
        words = Words(pa.array(texts), lower=False)
        starts, keys, _, whole = substrings.window_keys(words, 20)
        seen = {}
        for key, mark in zip(keys.tolist(), whole.tolist()):
            assert seen.setdefault(mark, key) == key


def test_symbols_depend_on_their_stretch_alone():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 6, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)
    text = np.zeros(4000, dtype=np.int64)
    name, begin, end, low, high = substrings.recompress(words, text)
    assert begin[0] == 0 and end[-1] == 4000 and (begin[1:] == end[:-1]).all()
    for k in np.flatnonzero((low > 0) & (high < 4000))[::37]:
        own = words[low[k] : high[k]]
        padded = np.concatenate([rng.integers(1, 1 << 60, 9).astype(np.uint64), own, rng.integers(1, 1 << 60, 9).astype(np.uint64)])
        n2, b2, e2, *_ = substrings.recompress(padded, np.zeros(len(padded), dtype=np.int64))
        at = np.flatnonzero(b2 == begin[k] - low[k] + 9)
        assert len(at) == 1 and n2[at[0]] == name[k] and e2[at[0]] == end[k] - low[k] + 9
