"""Runs of repeated words against a plain search."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from claimsieve.llm import periods, queries
from claimsieve.llm.common import read_table
from tests.llm.cases import CLASHES, frame

BLANKS = " \t\n\x0b\x0c\r"


def split(text):
    for x in BLANKS[1:]:
        text = (text or "").replace(x, " ")
    return [w for w in text.split(" ") if w]


def plain_runs(words, min_length=12):
    """(start, length, period) of every run, by comparing the words at each distance."""
    n, first = len(words), {}
    codes = np.array([first.setdefault(w, len(first)) for w in words], dtype=np.int64)
    stretches = {}
    for q in range(1, n // 2 + 1):
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(min_length, 2 * q):
                stretches.setdefault((a, b - a + q), q)  # the smallest period comes first
    return sorted(((a, n, q) for (a, n), q in stretches.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def found_runs(texts, min_length=12):
    codes = np.array([x for t in texts for x in t], dtype=np.int64)
    offsets = np.cumsum([0, *map(len, texts)])
    start, end, period = periods.find_runs(codes, offsets, min_length)
    out = [[] for _ in texts]
    for a, b, q in zip(start.tolist(), end.tolist(), period.tolist()):
        k = int(np.searchsorted(offsets, a, side="right")) - 1
        out[k].append((a - int(offsets[k]), b - a, q))
    return out


WORD = st.integers(0, 2)
PIECE = st.one_of(
    st.lists(WORD, max_size=25),
    st.builds(lambda x, n, m: (x * n)[: max(0, len(x) * n - m)], st.lists(WORD, min_size=1, max_size=17), st.integers(1, 9), st.integers(0, 5)),
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=6).map(lambda x: sum(x, [])), min_size=1, max_size=4), st.sampled_from([2, 5, 12, 13]))
def test_every_run_is_found(texts, min_length):
    assert found_runs(texts, min_length) == [plain_runs(t, min_length) for t in texts]


def test_nested_long_and_adjacent_runs():
    rng = random.Random(5)
    block = [rng.randrange(40) for _ in range(300)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(k).count("1") % 2 for k in range(512)]
    phase = [0, 1] * 40 + [1, 0] * 40  # squares of many periods around the middle
    texts = [block * 3, [0] * 700, ([0, 1, 0] * 30 + [2]) * 7, fib[-1], thue, phase, block + block[:250], [7], []]
    assert found_runs(texts) == [plain_runs(t) for t in texts]


def test_wavelet_tree_against_sorting():
    rng = np.random.default_rng(3)
    values = rng.permutation(97)
    tree = periods.WaveletTree(values)
    low = rng.integers(0, 97, 400)
    high = low + rng.integers(0, 98 - low)
    x = rng.integers(0, 140, 400)
    less = tree.less(low, high, x)
    assert less.tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(low, high, x)]
    some = less < high - low
    found = tree.smallest(low[some], high[some], less[some])
    assert found.tolist() == [min(v for v in values[a:b].tolist() if v >= c) for a, b, c in zip(low[some], high[some], x[some])]


def test_documents_of_all_cases(spark):
    out = periods.with_runs(frame(spark))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES, "n_words", "runs", "collapsed"]
    rows = out.collect()
    assert len(rows) == frame(spark).count()
    for r in rows:
        words = split(r["text"])
        runs = plain_runs(words)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs and r["collapsed"] == plain_collapsed(words, runs)
    assert any(r["runs"] for r in rows)


def test_no_documents_and_names_that_clash(spark):
    assert periods.with_runs(frame(spark, [])).collect() == []
    df = spark.createDataFrame([("a b " * 9, 1, "x")], "runs string, n_words int, other string")
    row = periods.with_runs(df, text="runs").collect()[0]
    assert row.asDict()["n_words"] == 18 and row["other"] == "x" and [tuple(x) for x in row["runs"]] == [(0, 18, 2)]


def plain_query(docs):
    out = Counter()
    for doc_id, text, *_ in docs:
        words = split(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
        listed = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
        milli = 1000 * best[1] // best[2] if runs else None
        out[doc_id, len(runs), best[0], best[1], best[2], milli, hexed(listed), hexed(plain_collapsed(words, runs))] += 1
    return out


def test_query_against_plain(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = queries.queries()["op11_period_runs"](spark, sf_dir).collect()
    docs = read_table(spark, sf_dir, "documents").collect()
    assert Counter(tuple(r) for r in rows) == plain_query(docs)
    assert sum(r["n_runs"] > 0 for r in rows) > 5
