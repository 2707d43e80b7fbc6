"""Every stage on its own input against a plain version, and all of them in a row."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimsieve.llm import jaccard, language
from tests.llm.cases import CLASHES, documents, frame
from tests.llm.test_lines_and_copies import plain_lines
from tests.llm.test_near_copies import plain_links
from tests.llm.test_packing import check_packed, plain_ids

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    """The table, the odd cases under other ids, and an item of the benchmark in a document."""
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").orderBy("item_id").head()["text"]
    odd = [(None if d is None else 10_000 + d, *rest) for d, *rest in documents()]
    odd += [(20_000, f"some words before it {item} and some behind", "en", "s", 1)]
    return table.unionByName(frame(spark, odd, extra=False)).withColumns({x: F.lit("extra") for x in CLASHES})


def rows(df):
    return [tuple(r) for r in df.select(COLUMNS).collect()]


def test_stages_are_named_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def test_language_stage(spark, docs):
    out = corpus_pipeline.keep_languages(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    model = language.train(docs.select("text", "lang"))
    marked = language.with_language(docs.select(COLUMNS), model, sureness=("sure", "words")).collect()
    kept = Counter(tuple(r[c] for c in COLUMNS) for r in marked if r["lang_pred"] != "und" and r["sure"] + math.sqrt(math.log(5) / 2 / r["words"]) >= 0.4)
    assert Counter(rows(out)) == kept
    assert len(marked) - 12 < sum(kept.values()) < len(marked)


def test_line_stage(spark, docs):
    out = corpus_pipeline.drop_repeated_lines(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    assert Counter((r[0], r[1]) for r in rows(out)) == Counter({k[:2]: n for k, n in _merged(plain_lines(rows(docs))).items()})
    assert all(r[4] == len(r[1]) for r in rows(out))


def _merged(counter):
    out = Counter()
    for key, n in counter.items():
        out[key[:2]] += n
    return out


def test_near_copy_stage(spark, docs):
    out = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    group = {d: c for d, _, c in plain_links(rows(docs), jaccard.Threshold(80), 5)}
    ids = Counter(r[0] for r in rows(out))
    assert ids == Counter({**{d: 1 for d, c in group.items() if d is not None and d == c}, None: 2})


def test_decontamination_stage(spark, docs):
    out = corpus_pipeline.drop_contaminated(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    gone = Counter(rows(docs)) - Counter(rows(out))
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    whole = Counter(r for r in rows(docs) if any(x in (r[1] or "") for x in items))
    assert gone >= whole and sum(gone.values()) <= sum(whole.values()) + 3


def test_packing_stage(spark, docs):
    out = corpus_pipeline.pack_sequences(spark, docs, SF_DIR).collect()
    expected = Counter()
    for doc, text, *_ in rows(docs):
        expected[doc] += len(plain_ids(text))
    found = Counter()
    for r in out:
        found[r["doc_id"]] += r["length"]
        assert r["length"] == len(r["ids"])
    assert found == expected
    check_packed(out, 2048)


def test_stages_of_no_documents(spark, docs):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF_DIR).count() == 0, name


def test_all_stages(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    stored = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stored = spark.createDataFrame(stage(spark, stored, SF_DIR).collect(), stored.schema)
    expected = Counter((r["doc_id"], len(plain_ids(r["text"]))) for r in stored.collect())
    found = Counter()
    for r in out.collect():
        found[r["doc_id"]] += r["length"]
    assert Counter(found.items()) == expected


def test_language_stage_keeps_mixtures_and_short_documents(spark, monkeypatch):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = language.train(table.select("text", "lang"))
    monkeypatch.setattr(language, "train", lambda *_: model)
    clean = table.where("length(text) between 600 and 4000").orderBy("doc_id").collect()
    first = {r["lang"]: " ".join(r["text"].split()[:40]) for r in reversed(clean)}
    mixed = [" ".join(first[x] for x in order) for order in (["en", "de", "fr"], ["de", "fr", "es"], ["es", "en", "fr", "de"])]
    short = ["qq", "zxj wvk", "жук", "пять слов", "漢字"]
    docs = frame(spark, [(k, text, None, None, None) for k, text in enumerate(mixed + short)], extra=False)
    scores = [r["score"] for r in language.with_language(docs, model).collect()]
    assert min(scores) < corpus_pipeline.MIN_SURENESS
    assert Counter(rows(corpus_pipeline.keep_languages(spark, docs, SF_DIR))) == Counter(rows(docs))


def test_language_stage_without_labels_keeps_all(spark, docs):
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    assert Counter(rows(corpus_pipeline.keep_languages(spark, plain, SF_DIR))) == Counter(rows(plain))


def test_language_stage_rejects_doubt(spark, monkeypatch):
    rng = language.np.random.default_rng(1)
    blank = language.LanguageModel(("a", "b", "c", "d"), rng.normal(size=(64, 4)).astype("float32") * 1e-3, language.np.zeros((4, 4), dtype="float32"))
    monkeypatch.setattr(language, "train", lambda *_: blank)
    docs = frame(spark, [(1, "word " * 100, None, None, None), (2, "word", None, None, None), (3, "1 2", None, None, None)], extra=False)
    assert [r[0] for r in rows(corpus_pipeline.keep_languages(spark, docs, SF_DIR))] == [2]
