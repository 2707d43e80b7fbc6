"""The registered queries over a whole small table: against SQL, or against plain versions where there is none."""

import re
from collections import Counter

import pytest

from claimsieve.llm import jaccard, queries
from tests.comparing import compare, oracle_connection
from tests.llm.test_near_copies import plain_links
from tests.llm.test_packing import check_packed, plain_ids
from tests.llm.test_substrings import plain_cuts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def found(spark, name):
    return queries.queries()[name](spark, SF_DIR).collect()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_agrees_with_sql(spark, name):
    rows, problem = compare(queries.queries()[name](spark, SF_DIR), oracle_connection(SF_DIR), queries.oracle_sql()[name])
    assert problem is None and rows > 0


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.queries()) == list(range(1, 14))


def test_op1_finds_items_word_for_word(spark, docs):
    items = {r["item_id"]: r["text"].lower().split() for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    strip = lambda words: f" {' '.join(w.strip('!\"#$%&()*+,-./:;<=>?@[]^_`{|}~' + chr(39) + chr(92)) for w in words)} "
    expected = {(d, i) for d, text, *_ in docs for i, words in items.items() if strip(words) in strip((text or "").lower().split())}
    rows = found(spark, "op1_decontaminate")
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["edits"] == 0} == expected
    assert len(expected) > 2


def test_op4_is_right_on_held_out_documents(spark, docs):
    rows = found(spark, "op4_language_crf")
    lang = {d: x for d, _, x, *_ in docs}
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_op5_against_plain(spark, docs):
    rows = found(spark, "op5_recompression")
    assert Counter(tuple(r) for r in rows) == Counter({k[:4]: n for k, n in plain_cuts(docs, 20).items()})


def test_op6_packs_every_id(spark, docs):
    rows = found(spark, "op6_best_fit_packing")
    length = Counter()
    for r in rows:
        length[r["doc_id"]] += r["length"]
    assert dict(length) == {d: len(plain_ids(text)) for d, text, *_ in docs}
    assert check_packed(rows, 2048) <= sum(length.values()) / 2048 * 1.03 + 2


def test_op7_against_plain(spark, docs):
    rows = found(spark, "op7_parity_sketch_join")
    assert Counter(tuple(r) for r in rows) == plain_links(docs, jaccard.Threshold(85), 4)


def test_op9_is_the_article(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in found(spark, "op9_html_main_text"):
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", re.sub(r"</?b>", "", inside)))
        assert r["text"] == " ".join(plain.split()) and r["n_chars"] == len(r["text"])
