import hashlib
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimsieve.llm import components, content_sort, lines
from tests.llm.cases import documents, frame

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain_lines(rows, min_chars=10, min_docs=2):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = []
    for doc, text, *_ in rows:
        every = (text or "").split("\n")
        gone = [doc is not None and len(holders[key(x)]) >= min_docs and min(holders[key(x)]) < doc for x in every]
        out.append((doc, "\n".join(x for x, y in zip(every, gone) if not y), len(every), sum(gone)))
    return Counter(out)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_against_plain(spark, workspace, min_docs):
    out = lines.dedup_lines(frame(spark), workspace, min_docs=min_docs)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and len(out.columns) == len(set(out.columns))
    found = Counter(tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert found == plain_lines(documents(), min_docs=min_docs)


def test_lines_of_no_rows(spark, workspace):
    assert lines.dedup_lines(frame(spark, []), workspace).count() == 0


def test_a_hot_line(spark, workspace):
    rows = [(k, f"the line that all of them hold\nown line of number {k}", None, None, None) for k in range(300)]
    out = lines.dedup_lines(frame(spark, rows, extra=False, parts=8), workspace)
    assert out.agg(F.sum("n_dropped")).head()[0] == 299
    assert out.where("n_dropped = 0").head()["doc_id"] == 0


def plain_copies(rows, best):
    ids = defaultdict(list)
    for doc, text, *_ in rows:
        ids[(text or "").translate(LOWER)].append(doc)
    out = Counter()
    for text, group in ids.items():
        known = [x for x in group if x is not None]
        keep = best(known) if known else None
        for doc, n in Counter(group).items():
            sha = hashlib.sha256(text.encode()).hexdigest()
            out[doc, keep, len(group), doc == keep, sha] += 1 if doc == keep else 0
            out[doc, keep, len(group), False, sha] += n - (doc == keep)
    return +out


@pytest.mark.parametrize("keep, parts", [("max", 1), ("min", 3), ("max", 40)])
def test_copies_against_plain(spark, workspace, keep, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = content_sort.dedup_exact(frame(spark), workspace, keep=keep)
        assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert Counter(tuple(r) for r in out.collect()) == plain_copies(documents(), max if keep == "max" else min)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_copies_over_many_partitions(spark, workspace):
    rows = [(k, "the same text" if k % 3 else f"text {k}", None, None, None) for k in range(3000)]
    out = content_sort.dedup_exact(frame(spark, rows, extra=False, parts=16), workspace)
    assert out.where("group_size = 2000 and keep_id = 2999").count() == 2000
    assert out.where("kept").count() == 1001


def test_copies_of_no_rows_and_a_wrong_choice(spark, workspace):
    assert content_sort.dedup_exact(frame(spark, []), workspace).count() == 0
    with pytest.raises(ValueError):
        content_sort.dedup_exact(frame(spark, []), workspace, keep="any")


def test_components(spark, workspace):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (300, 300), (None, 5), (7, None), (100, 200)]
    out = components.components(spark.createDataFrame(pairs, "a long, b long"), workspace)
    found = {r["node"]: r["component"] for r in out.collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 150: 100, 200: 100, 300: 300}
    assert components.components(spark.createDataFrame([], "a long, b long"), workspace).count() == 0
