import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimsieve.llm import language
from claimsieve.llm.common import read_table
from tests.llm.cases import documents, frame


def plain_marginals(scores, moves):
    forward, message = [], np.ones(scores.shape[1])
    for row in np.exp(scores):
        message = (message @ np.exp(moves)) * row
        message = message / message.sum()
        forward.append(message)
    backward = [np.ones(scores.shape[1])]
    for row in np.exp(scores)[:0:-1]:
        step = np.exp(moves) @ (row * backward[-1])
        backward.append(step / step.sum())
    both = np.array(forward) * np.array(backward[::-1])
    return both / both.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_forward_backward(k):
    rng = np.random.default_rng(k)
    lengths = [0, 1, 31, 32, 33, 64, 0, 65, 500, 2]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    scores, moves = rng.normal(scale=3, size=(offsets[-1], k)).astype(np.float32), rng.normal(size=(k, k)).astype(np.float32)
    found = language.marginals(scores, offsets, moves)
    for a, b in zip(offsets, offsets[1:]):
        if b > a:
            np.testing.assert_allclose(found[a:b], plain_marginals(scores[a:b], moves), atol=2e-4)


def test_features_are_the_words_grams():
    values = pa.array(["ab", "a", "ñu", "ab"])
    features, begins = language._grams(values, 1 << 30)
    each = [set(features[a:b].tolist()) for a, b in zip(begins, begins[1:])]
    # "ab" between marks: 3 two-grams, 2 three-grams, 1 four-gram, and the word
    assert [len(x) for x in each] == [7, 4, 11, 7] and each[0] == each[3]
    assert len(each[0] & each[1]) == 1


@pytest.fixture(scope="module")
def model(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    return language.train(docs.where(~language.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, model):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").where(language.held_out(F.col("doc_id")))
    found = language.with_language(docs, model).select("lang", "lang_pred", "score").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_switches_inside_a_text(spark, model):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").where("length(text) between 600 and 2000")
    docs = docs.where(~F.col("text").rlike(r"(^|\s)[^\p{L}\s]+(\s|$)"))
    first = {r["lang"]: " ".join(r["text"].split()[:40]) for r in docs.dropDuplicates(["lang"]).collect()}
    order = ["en", "de", "fr", "es", "en"]
    mixed = spark.createDataFrame([(" ".join(first[x] for x in order),)], "text string")
    (row,) = language.with_language(mixed, model, spans=True).collect()
    spans = [s for s in row["lang_spans"] if s["words"] > 8]
    assert [s["lang"] for s in spans] == order
    assert all(abs(s["words"] - 40) <= 8 for s in spans)
    assert row["lang_pred"] == "en" and 0.33 < row["score"] < 0.47


def test_cases(spark, model):
    docs = frame(spark)
    found = language.with_language(docs, model, spans=True)
    assert sorted(found.columns) == sorted({*docs.columns, "lang_pred", "score", "lang_spans"})
    found = found.collect()
    assert len(found) == len(documents())
    for r in found:
        none = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == none and (r["score"] == 0) == none
        assert sum(s["words"] for s in r["lang_spans"]) == len((r["text"] or "").split())
    assert language.with_language(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("rows", [[], [(1, "text", None, None, None), (2, None, "en", None, None), (3, "12", "en", None, None)]])
def test_no_labelled_text_gives_no_language(spark, rows):
    model = language.train(frame(spark, rows, extra=False))
    assert model.languages == ()
    out = language.with_language(frame(spark), model, spans=True, sureness=("sure", "words"))
    for r in out.collect():
        assert (r["lang_pred"], r["score"], r["sure"], r["words"]) == ("und", 0, 0, 0)
        assert {s["lang"] for s in r["lang_spans"]} <= {"und"} and sum(s["words"] for s in r["lang_spans"]) == len((r["text"] or "").split())


def test_training_repeats(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    one, two = (language.train(x, rounds=3) for x in (docs, docs.repartition(5)))
    assert one.languages == two.languages and np.array_equal(one.weights, two.weights)


def invented(lang, k, n=30):
    """A text of a language of its own letters; ``k`` makes it differ from others."""
    rng = np.random.default_rng([k, *lang.encode()])
    letters = {"de": "abcdefg", "en": "hijklmn", "fr": "opqrstu"}[lang]
    return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))


@pytest.mark.parametrize("hot", range(4))
def test_copies_do_not_take_the_place_of_other_languages(spark, hot):
    # with the hash alone deciding, one of the hot texts is drawn with all its copies
    texts = [("de", invented("de", k)) for k in range(5)] + [(x, invented(x, k)) for x in ("en", "fr") for k in range(5)]
    texts += [("de", invented("de", hot))] * 200
    docs = spark.createDataFrame([(k, text, lang, None, None) for k, (lang, text) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    model = language.train(docs, docs_per_language=5, rounds=10)
    assert model.languages == ("de", "en", "fr")
    found = language.with_language(docs, model).select("lang", "lang_pred").distinct().collect()
    assert {tuple(r) for r in found} == {(x, x) for x in model.languages}


def test_a_language_of_equal_rows_stays(spark):
    rows = [(invented("en", 1), "en")] * 1000 + [(invented("de", k), "de") for k in range(400)]
    plain = [(invented("en", 1), "en")] + rows[1000:]
    many, one = (language.train(spark.createDataFrame(x, "text string, lang string").repartition(5), rounds=3, docs_per_language=20) for x in (rows, plain))
    assert many.languages == one.languages == ("de", "en")
    assert np.array_equal(many.weights, one.weights)
