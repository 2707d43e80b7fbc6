"""Sketched text statistics, the sketched area under the ROC curve, and the split by group."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimsieve.operators import learning, profiling


def test_text_statistics_of_odd_columns(spark):
    rows = [(i, "b" if i % 3 else "a", None, f"t{i}", i) for i in range(300)] + [(1, None, None, "", 0)]
    df = spark.createDataFrame(rows, "number int, `n0` string, `a.b``c` string, _rows string, _group int").repartition(5)
    found = {r["column"]: r for r in profiling.text_statistics(df, top=3).collect()}
    assert list(found) == ["n0", "a.b`c", "_rows"]
    assert [tuple(x) for x in found["n0"]["top"]] == [("b", 200), ("a", 100)]
    assert (found["n0"]["count"], found["n0"]["distinct"], found["n0"]["top_error"]) == (300, 2, 0)
    assert (found["a.b`c"]["count"], found["a.b`c"]["distinct"], found["a.b`c"]["top"]) == (0, 0, [])
    assert [x["item"] for x in found["_rows"]["top"]] == ["", "t0", "t1"]  # ties by text


def test_text_statistics_of_no_rows_and_no_texts(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert profiling.text_statistics(empty).collect() == []
    with pytest.raises(ValueError):
        profiling.text_statistics(empty.select("b"))


def test_frequent_texts_among_more_than_are_tracked(spark):
    text = F.when(F.col("id") % 4 == 0, F.lit("hot")).when(F.col("id") % 10 == 1, F.lit("warm")).otherwise(F.concat(F.lit("x"), F.col("id").cast("string")))
    row = profiling.text_statistics(spark.range(0, 60_000, 1, 7).select(text.alias("t")), top=2, tracked=100).head()
    assert [x["item"] for x in row["top"]] == ["hot", "warm"]
    for x, true in zip(row["top"], [15_000, 6_000]):
        assert true <= x["count"] <= true + row["top_error"]
    assert abs(row["distinct"] - 39_002) <= row["distinct_error"] * 39_002


def scored(spark, scores, labels):
    return spark.createDataFrame(list(zip(scores, labels)), "rawPrediction double, label double").repartition(3)


def plain_area(scores, labels):
    kept = [(s, y) for s, y in zip(scores, labels) if s is not None and y is not None and not math.isnan(s)]
    positive, negative = ([s for s, y in kept if y == side] for side in (1.0, 0.0))
    wins = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return wins / (len(positive) * len(negative))


RNG = np.random.default_rng(5)
SCORES = {
    "smooth": RNG.normal(size=800).tolist(),
    "one value": [3.5] * 800,
    "few values": RNG.integers(0, 4, 800).astype(float).tolist(),
    "mostly one": np.where(RNG.random(800) < 0.9, 0.25, RNG.random(800)).tolist(),
    "zeros of both signs": RNG.choice([0.0, -0.0, 1.0], 800).tolist(),
    "infinite": RNG.choice([math.inf, -math.inf, 0.5, 1e308], 800).tolist(),
    "all infinite": RNG.choice([math.inf, -math.inf], 800).tolist(),
    "gaps": [None if x < -1 else math.nan if x > 1 else float(x) for x in RNG.normal(size=800)],
}


@pytest.mark.parametrize("name", SCORES)
def test_sketched_area_is_within_its_error(spark, name):
    scores = SCORES[name]
    labels = [float(RNG.random() < (0.7 if (s or 0) > 0 else 0.3)) for s in scores]
    found = learning.sketched_area_under_roc(scored(spark, scores, labels))
    assert abs(found.value - plain_area(scores, labels)) <= found.error + 1e-12
    if "infinite" not in name:
        assert found.error <= 0.01
    if name in ("one value", "few values", "zeros of both signs"):
        assert found.error == 0


def test_sketched_area_without_both_classes(spark):
    nothing = learning.SketchedArea(None, None)
    assert learning.sketched_area_under_roc(scored(spark, [1.0, 2.0], [1.0, 1.0])) == nothing
    assert learning.sketched_area_under_roc(scored(spark, [1.0, 2.0], [1.0, 1.0]).limit(0)) == nothing


def test_group_split_keeps_near_copies_together(spark, workspace):
    rows = [(i, f"Name {i}", None if i % 5 else "") for i in range(400)]
    copies = [(i, f"  NAME {i}", x) for i, _, x in rows]
    df = spark.createDataFrame(rows + copies, "id int, name string, more string")
    found = learning.group_split(df, workspace)
    train, test = ({r["id"] for r in part.collect()} for part in (found.train, found.test))
    assert not train & test and len(train | test) == 400
    assert found.train.count() + found.test.count() == 800
    assert 0.6 < len(train) / 400 < 0.8
    assert found.cut.count() == 0


def test_group_split_cuts_and_reports_hot_groups(spark, workspace):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("Hot")).when(F.col("id") % 3 == 1, F.lit("hot ")).otherwise(F.col("id").cast("string")).alias("t"))
    found = learning.group_split(df, workspace)
    assert [r["rows"] for r in found.cut.collect()] == [2000]
    assert 0.65 < found.train.count() / 3000 < 0.75
    assert found.train.count() + found.test.count() == 3000
    empty = learning.group_split(df.limit(0), workspace)
    assert (empty.train.count(), empty.test.count(), empty.cut.count()) == (0, 0, 0)
