"""The FTRL model against a plain one, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimsieve.llm import language, queries, toxicity
from claimsieve.llm.common import Words, read_table, term_texts
from tests.llm.cases import CLASHES, frame

SF_DIR = "/root/testdata/sf0.1"


def plain_fit(rows, bits, settings, seed):
    """FTRL-proximal one coordinate at a time."""
    z, n, size = {}, {}, 1 << bits

    def weight(i):
        l1 = 0.0 if i == size else settings.l1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    rng = np.random.default_rng(seed)
    for _ in range(settings.passes):
        for k in rng.permutation(len(rows)).tolist():
            label, places = rows[k]
            places = [*places.tolist(), size]
            w = {i: weight(i) for i in places}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in places:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / settings.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in range(size + 1)}


def test_fit_is_ftrl_proximal():
    rng = np.random.default_rng(1)
    rows = [(int(k % 3 == 0), np.unique(np.append(rng.integers(0, 60, 8), [61] if k % 3 == 0 else []).astype(np.int64))) for k in range(90)]
    settings = toxicity.Ftrl(l1=0.7, passes=3)
    model, plain = toxicity.fit(rows, 6, settings, seed=5), plain_fit(rows, 6, settings, 5)
    assert model.places.tolist() == [i for i in range(64) if plain[i]]
    assert np.allclose(model.weights, [plain[i] for i in model.places.tolist()], rtol=1e-5) and math.isclose(model.bias, plain[64], rel_tol=1e-9)
    assert 0 < len(model.places) < 40 and model.dense()[61] > 1


def test_features_stay_inside_texts():
    words = Words(term_texts(pa.array(["One, two THREE", None, "one", "two three one"])), lower=False)
    kinds = [list(zip(t.tolist(), p.tolist())) for t, p in toxicity.features(words, 20)]
    assert [[t for t, _ in x] for x in kinds] == [[0, 0, 0, 2, 3, 3, 3], [0, 0, 3, 3], [0, 3]]
    assert kinds[0][0][1] == kinds[0][3][1] and kinds[1][1][1] == kinds[1][2][1] and kinds[2][0][1] != kinds[2][1][1]


def corpus(n=300):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(80)]
    rows, marks = [], []
    for k in range(n):
        bad = k % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        if bad:
            text.insert(rng.randrange(len(text)), rng.choice(["rotten", "vile"]))
        rows.append((k, " ".join(text)))
        marks.append((k, int(bad)))
    return rows, marks


def test_learns_and_handles_all_cases(spark):
    rows, marks = corpus()
    marks += [(0, 0), (None, 1), (7, None), (10**6, 1)]
    docs = spark.createDataFrame([*rows, (None, "vile"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int").withColumn("text", F.lit("vile"))
    model = toxicity.train(docs, labels, settings=toxicity.Ftrl(l1=1.0))
    out = toxicity.with_toxicity(docs, model).collect()
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in out)
    wrong = sum(r["predicted"] != (r["doc_id"] % 4 == 0) for r in out if r["doc_id"] is not None and r["text"])
    assert wrong <= 6
    cases = toxicity.with_toxicity(frame(spark), model)
    assert cases.columns == ["doc_id", "text", "lang", "source", "n_chars", *(x for x in CLASHES if x != "score"), "score", "predicted"]
    scores = {}
    for r in cases.collect():
        scores.setdefault(r["text"], set()).add(r["score"])
    assert all(len(x) == 1 for x in scores.values()) and scores[None] == scores[""]
    assert toxicity.with_toxicity(frame(spark, []), model).collect() == []


def test_copies_of_one_text_count_once(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    copies = docs.unionByName(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit(rows[1][1]).alias("text")))
    more = labels.unionByName(spark.range(1000, 3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("toxic")))
    one, two = toxicity.train(docs, labels), toxicity.train(copies, more)
    assert one.places.tolist() == two.places.tolist() and np.array_equal(one.weights, two.weights)


@pytest.mark.parametrize("marked", [False, True])
def test_no_labels_and_one_label(spark, marked):
    rows, marks = corpus(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k, _ in marks] if marked else [], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.with_toxicity(docs, model).collect()
    assert (model is not None) == marked and all((r["score"] > 0.5 and r["predicted"] == 1) if marked else (r["score"] == 0 and r["predicted"] == 0) for r in found)


def test_query_on_held_out_documents(spark):
    rows = queries.queries()["op12_ftrl_toxicity"](spark, SF_DIR).collect()
    docs = {r["doc_id"]: r["text"] for r in read_table(spark, SF_DIR, "documents").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in read_table(spark, SF_DIR, "labels").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [r for r in held if labels[r["doc_id"]]], [r for r in held if not labels[r["doc_id"]]]
    assert sum(r["predicted"] for r in toxic) >= 0.75 * len(toxic) > 50
    assert sum(r["predicted"] for r in clean) <= 0.005 * len(clean)


def test_labels_of_held_out_documents_are_not_learned(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    labels = read_table(spark, "/root/testdata/sf0.001", "labels").select("doc_id", "toxic")
    held = language.held_out(F.col("doc_id"))
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.train(docs, labels.where(~held)), toxicity.train(docs, other.where(~held))
    assert np.array_equal(one.places, two.places) and np.array_equal(one.weights, two.weights)
