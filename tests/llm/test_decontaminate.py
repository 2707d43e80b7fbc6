import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimsieve.llm import decontaminate
from claimsieve.llm.common import Words
from tests.llm.cases import documents, frame

ITEMS = "item_id long, text string, doc_id string"


def vocabulary(rng, n=400):
    return ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def edited(words, k, rng, other):
    words = list(words)
    for _ in range(k):
        place, kind = rng.randrange(len(words)), rng.random()
        if kind < 0.5:
            words[place] = rng.choice(other)
        elif kind < 0.75:
            del words[place]
        else:
            words.insert(place, rng.choice(other))
    return words


def planted(edits, n=60, seed=5):
    rng = random.Random(seed)
    words = vocabulary(rng)
    items = [(k, [rng.choice(words) for _ in range(rng.randint(8, 60))]) for k in range(n)]
    docs, truth = [], set()
    for k in range(2 * n):
        text = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if k % 2:
            item, passage = items[k // 2]
            at = rng.randint(0, len(text))
            text[at:at] = edited(passage, int(len(passage) * edits), rng, words)
            truth.add((k, item))
        docs.append((k, " ".join(text), None, None, None))
    return docs, [(k, " ".join(x), "c") for k, x in items], truth


def found(spark, docs, items, **how):
    out = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, ITEMS), **how)
    assert out.columns == ["doc_id", "item_id", "start_word", "end_word", "edits"]
    return out.collect()


@pytest.mark.parametrize("edits, recall", [(0.0, 1.0), (0.1, 0.98), (0.2, 0.9)])
def test_recall_and_no_false_ones(spark, edits, recall):
    docs, items, truth = planted(edits)
    rows = found(spark, docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(got & truth) >= recall * len(truth)
    assert got <= truth


def test_blocks_of_items_find_the_same(spark):
    docs, items, _ = planted(0.1, n=20)
    one, many = found(spark, docs, items), found(spark, docs, items, words_per_block=100)
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def plain_distance(item, text):
    cost = [0] * (len(text) + 1)
    for i, word in enumerate(item, 1):
        now = [i]
        for j, other in enumerate(text, 1):
            now.append(min(cost[j - 1] + (word != other), cost[j] + 1, now[j - 1] + 1))
        cost = now
    return min(cost)


def test_edit_distance():
    rng = np.random.default_rng(3)
    for _ in range(300):
        item, text = rng.integers(0, 4, rng.integers(1, 12)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 20)).astype(np.uint64)
        edits, begin, end = decontaminate.edit_match(item, text)
        assert edits == plain_distance(item.tolist(), text.tolist())
        full = [[max(i, j) if not i or not j else 0 for j in range(end - begin + 1)] for i in range(len(item) + 1)]
        for i in range(1, len(item) + 1):
            for j in range(1, end - begin + 1):
                full[i][j] = min(full[i - 1][j - 1] + int(item[i - 1] != text[begin + j - 1]), full[i - 1][j] + 1, full[i][j - 1] + 1)
        assert full[-1][-1] == edits


def test_the_filter_leaves_no_near_passage_out():
    docs, items, truth = planted(0.2, n=80, seed=9)
    search = decontaminate.Search()
    index = decontaminate.ItemIndex([k for k, *_ in items], pa.array([t for _, t, _ in items]), search)
    words = Words(pa.array([t for _, t, *_ in docs]), lower=True)
    hashes, doc = decontaminate.normal_hashes(words), words.text_of_word
    hits = [np.concatenate([[0], np.cumsum(np.concatenate([np.isin(w := decontaminate.window_hashes(hashes, n), g), np.zeros(len(hashes) - len(w))]))]) for n, g in zip(decontaminate.GRAMS, index.grams)]
    kept = dict(decontaminate._windows(index, hits, words.offsets[:-1], words.offsets[1:], doc))
    for text, item in truth:
        own = index.item(item)
        low, high = words.offsets[text], words.offsets[text + 1]
        edits, begin, _ = decontaminate.edit_match(own, hashes[low:high])
        if edits <= search.most(len(own)):
            start = min(low + begin, max(low, high - len(own)))
            assert start in kept[len(own)]


def test_case_punctuation_and_place(spark):
    item = "Alpha beta, gamma. Delta epsilon zeta eta theta iota kappa"
    docs = [(1, "x y ALPHA (beta) gamma delta 'epsilon' zeta\neta theta iota kappa! z", None, None, None), (2, item[:40], None, None, None)]
    (row,) = found(spark, docs, [(7, item, None)])
    assert tuple(row) == (1, 7, 2, 12, 0)


def test_cases(spark):
    items = [(1, None, None), (2, "", None), (3, " \n", None), (4, documents()[9][1], None), (4, documents()[9][1], None), (None, documents()[9][1], None), (5, "word", None)]
    got = Counter(tuple(r)[:2] for r in found(spark, documents(), items))
    assert got[9, 4] == got[9, None] == 2  # the document and its repetition, each with both ids of the item
    assert got[3, 5] == 1
    assert {item for _, item in got} == {4, 5, None}
    assert found(spark, documents(), []) == [] and found(spark, [], items) == []


def test_rows_without_items_stay(spark):
    docs, items, truth = planted(0.0, n=20)
    df = frame(spark, [*docs, (None, docs[1][1], None, None, None), (None, None, None, None, None)])
    out = decontaminate.without_contaminated(df, spark.createDataFrame(items, ITEMS))
    assert out.columns == df.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({d[0] for d in docs} - {d for d, _ in truth}) and ids.count(None) == 1


@pytest.mark.parametrize("size", [100, 400, 1000])
@pytest.mark.parametrize("edits", [0.1, 0.15, 0.19])
def test_recall_of_long_items(size, edits):
    rng = random.Random(size)
    words = vocabulary(rng, 3000)
    items = [[rng.choice(words) for _ in range(size + k)] for k in range(12)]
    texts = []
    for item in items:
        around = [[rng.choice(words) for _ in range(rng.randint(0, 150))] for _ in range(2)]
        texts.append(" ".join([*around[0], *edited(item, int(size * edits), rng, words), *around[1]]))
    search = decontaminate.Search()
    index = decontaminate.ItemIndex(list(range(len(items))), pa.array([" ".join(x) for x in items]), search)
    words_of = Words(pa.array(texts), lower=True)
    hashes = decontaminate.normal_hashes(words_of)
    truth = {}  # by brute force: each item against each whole text
    for t in range(len(texts)):
        for i in range(len(items)) if t < 2 else [t]:
            distance = decontaminate.edit_match(index.item(i), hashes[words_of.offsets[t] : words_of.offsets[t + 1]])[0]
            if distance <= search.most(len(items[i])):
                truth[t, i] = distance
    got = {(t, i): k for t, i, _, _, k in decontaminate._search(index, words_of)}
    assert len(truth) >= len(items) and len(got.keys() & truth.keys()) >= 0.95 * len(truth)
    assert got.keys() <= truth.keys() and all(truth[x] == k for x, k in got.items())


def test_parts_hold_every_word_of_their_item():
    lengths = [0, 1, 59, 60, 61, 90, 91, 400, 1001]
    index = decontaminate.ItemIndex(list(range(len(lengths))), pa.array([" ".join(f"w{k}" for k in range(n)) for n in lengths]), decontaminate.Search())
    for row, n in enumerate(lengths):
        mine = index.part_item == row
        places = [k for a, m in zip(index.part_at[mine], index.part_size[mine]) for k in range(a, a + m)]
        assert places == list(range(n))
        assert n <= 60 or all(30 <= m <= 45 for m in index.part_size[mine])
