import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from claimsieve.operators import learning


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x @ [1.0, -2.0, 0.5] + 0.3 + rng.logistic(size=600) > 0).astype(float)
    df = spark.createDataFrame([(row.tolist(), float(label)) for row, label in zip(x, y)], "v array<double>, label double")
    return x, y, df.select(array_to_vector("v").alias("scaled_features"), "label").repartition(4)


def test_logistic_regression_is_the_maximum_likelihood_fit(points):
    x, y, df = points
    model = learning.fit_logistic(df)
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ beta))
        beta += np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]), design.T @ (y - p))
    assert [model.intercept, *model.coefficients] == pytest.approx(beta.tolist(), abs=1e-3)


def test_forest_has_the_wanted_size_and_repeats(points):
    _, _, df = points
    first, second = (learning.fit_forest(df, trees=7, depth=3, seed=9) for _ in range(2))
    assert first.getNumTrees == 7
    assert max(t.depth for t in first.trees) <= 3
    assert first.toDebugString.split("\n", 1)[1] == second.toDebugString.split("\n", 1)[1]


def test_evaluation_matches_the_definition(points):
    x, y, df = points
    scored = learning.score(df, learning.fit_logistic(df))
    found = {r.metric: r.value for r in learning.evaluate(scored, "m", "r").collect()}
    rows = scored.select("probability", "prediction", "label").collect()
    up = np.array([r.probability[1] for r in rows if r.label == 1])
    down = np.array([r.probability[1] for r in rows if r.label == 0])
    wins = (up[:, None] > down).sum() + 0.5 * (up[:, None] == down).sum()
    assert found["areaUnderROC"] == pytest.approx(wins / (len(up) * len(down)), abs=1e-12)
    assert found["accuracy"] == pytest.approx(np.mean([r.prediction == r.label for r in rows]))


def test_random_split_is_a_partition_near_its_weights(spark):
    df = spark.range(30_000)
    train, test = learning.random_split(df, seed=5)
    ids = sorted(r.id for part in (train, test) for r in part.collect())
    assert ids == list(range(30_000))
    assert train.count() == pytest.approx(21_000, rel=0.03)
    assert train.count() == learning.random_split(df, seed=5)[0].count()


def test_stored_split_is_a_partition_near_its_weights(spark, workspace, plan_text):
    df = spark.range(30_000, numPartitions=5).select("id", F.lit(1.0).alias("same"))
    train, test = learning.stored_split(df, workspace, seed=5)
    assert train.columns == ["id", "same"]
    assert sorted(r.id for part in (train, test) for r in part.collect()) == list(range(30_000))
    assert train.count() == pytest.approx(21_000, rel=0.03)
    # Reading a part touches its own files alone, without a sort.
    assert "PartitionFilters: [isnotnull(_part" in plan_text(train) and "Sort" not in plan_text(train)


def test_hash_split_keeps_a_key_together_and_all_rows(spark):
    df = spark.range(5000).select((F.col("id") % 400).alias("a"), F.when(F.col("id") % 3 > 0, "k").alias("b"), "id")
    train, test = learning.hash_split(df, ["a", "b"])
    assert train.count() + test.count() == 5000
    keys = [{(r.a, r.b) for r in part.select("a", "b").distinct().collect()} for part in (train, test)]
    assert not keys[0] & keys[1]
