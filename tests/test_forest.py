import math

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from claimsieve.operators import forest, learning

SLOTS = 9


@pytest.fixture(scope="module")
def points(spark):
    """Four measures, flags, and a slot without values; every other vector is sparse."""
    rng = np.random.default_rng(8)
    x = np.zeros((900, SLOTS))
    x[:, :4] = rng.normal(size=(900, 4)).round(2)
    x[:, 4:8] = (rng.random((900, 4)) < 0.2) * np.array([1.0, 2.5, -1.0, 1.0])
    y = (x[:, 0] + x[:, 4] - x[:, 1] * x[:, 5] > 0.4).astype(float)
    sparse = [Vectors.sparse(SLOTS, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for r in x]
    rows = [(sparse[i] if i % 2 else Vectors.dense(x[i]), float(y[i])) for i in range(900)]
    return x, y, spark.createDataFrame(rows, ["scaled_features", "label"]).coalesce(1)


def _grown(df, workspace, cuts, classes=2, trees=6, depth=3, max_bytes=1 << 20):
    rows = df.select(F.monotonically_increasing_id().alias("id"), "label", F.unwrap_udt("scaled_features").alias("v"))
    binned = workspace.stage(rows.mapInArrow(forest._binned(cuts, SLOTS, classes), "id bigint, class int, codes array<int>"), "binned")
    return forest.grow(binned, cuts, SLOTS, classes, trees, depth, 7, max_bytes), binned


def test_nodes_count_the_drawn_rows_that_reach_them_and_split_best(points, workspace):
    x, y, df = points
    rows = df.select(F.unwrap_udt("scaled_features").alias("v"))
    cuts = forest.find_cuts(rows, 900, 7)
    assert 8 not in cuts.slots and cuts.numbers.tolist() == [31] * 4 + [1] * 4
    trees, _ = _grown(df, workspace, cuts)
    table, ids = forest._poisson_table(), np.arange(900)
    impurity = lambda n: n.sum() * forest.gini(n[None])[0]
    for t, tree in enumerate(trees):
        bits = forest._random_bits(ids, 7 + 1 + t // 4) >> np.uint64(16 * (t % 4))
        weight = table[bits & np.uint64(0xFFFF)].astype(int)
        reached = {0: np.arange(900)}
        for k in sorted(tree.counts):
            here = reached[k]
            counts = lambda some: np.array([weight[some][y[some] == c].sum() for c in (0, 1)])
            assert tree.counts[k] == counts(here).tolist()
            if k not in tree.splits:
                continue
            place, last = tree.splits[k]
            left = x[here, cuts.slots[place]] <= cuts.cuts[place, last]
            reached[2 * k + 1], reached[2 * k + 2] = here[left], here[~left]
            gain = impurity(counts(here)) - impurity(counts(here[left])) - impurity(counts(here[~left]))
            assert gain / counts(here).sum() == pytest.approx(tree.gains[k])
            drawn = np.random.default_rng([7, t, k]).choice(SLOTS, 3, replace=False)
            for p, slot in enumerate(cuts.slots):
                for cut in cuts.cuts[p, : cuts.numbers[p]] if slot in drawn else []:
                    left = x[here, slot] <= cut
                    assert impurity(counts(here[left])) + impurity(counts(here[~left])) >= impurity(counts(here)) - gain - 1e-6


def test_a_row_is_stored_as_its_bins_other_than_zero_whatever_the_trees(points, workspace):
    """MLlib keeps a number for every slot and every tree of each row."""
    x, _, df = points
    cuts = forest.find_cuts(df.select(F.unwrap_udt("scaled_features").alias("v")), 900, 7)
    _, binned = _grown(df, workspace, cuts, trees=1, depth=1)
    assert binned.columns == ["id", "class", "codes"]
    assert max(r.n for r in binned.select(F.size("codes").alias("n")).collect()) <= np.count_nonzero(x, axis=1).max()


def test_rows_are_drawn_once_on_average_and_independently():
    table, ids = forest._poisson_table(), np.arange(200_000)
    bits = forest._random_bits(ids, 3)
    draws = np.stack([table[(bits >> np.uint64(16 * i)) & np.uint64(0xFFFF)] for i in range(4)]).astype(float)
    for k in range(4):
        assert np.mean(draws[0] == k) == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.005)
    assert np.allclose(np.corrcoef(draws), np.eye(4), atol=0.01)
    assert table.mean() == pytest.approx(1, abs=1e-3)


def test_passes_that_hold_one_node_grow_the_same_trees(points, workspace):
    _, _, df = points
    cuts = forest.find_cuts(df.select(F.unwrap_udt("scaled_features").alias("v")), 900, 7)
    wide, narrow = (_grown(df, workspace, cuts, trees=2, depth=2, max_bytes=n)[0] for n in (1 << 20, 0))
    assert wide == narrow


def test_cuts_part_frequent_values_like_mllib():
    assert forest.cut_values([1.0, 2.0, 4.0], [5, 1, 1]) == [1.5, 3.0]
    assert forest.cut_values([0.0, 1.0, 2.0, 3.0, 4.0], [1, 1, 1, 1, 1], most=2) == [1.5, 2.5]


def test_forest_is_as_good_as_mllibs_and_can_be_stored(points, spark, workspace):
    _, _, df = points
    df = df.repartition(3)
    model = learning.fit_forest(df, trees=30, depth=4)
    other = RandomForestClassifier(featuresCol="scaled_features", labelCol="label", numTrees=30, maxDepth=4, seed=42).fit(df)
    areas = [learning.area_under_roc(learning.score(df, m)) for m in (model, other)]
    assert areas[0] == pytest.approx(areas[1], abs=0.02)
    importances = [m.featureImportances.toArray() for m in (model, other)]
    assert np.allclose(*importances, atol=0.12)
    model.write().overwrite().save(workspace.location("forest"))
    loaded = RandomForestClassificationModel.load(workspace.location("forest"))
    assert loaded.toDebugString.split("\n", 1)[1] == model.toDebugString.split("\n", 1)[1]
    assert loaded.getFeaturesCol() == "scaled_features" and loaded.getNumTrees == 30


def test_odd_tables(points, spark):
    _, _, df = points
    one = learning.fit_forest(df.withColumn("label", F.lit(0.0)), trees=2, depth=2)
    assert [t.numNodes for t in one.trees] == [1, 1] and one.numClasses == 1
    three = learning.fit_forest(df.withColumn("label", F.when(F.rand(1) < 0.3, 2.0).otherwise(F.col("label"))), trees=3, depth=2)
    assert three.numClasses == 3
    for bad in (df.limit(0), df.withColumn("label", F.lit(None).cast("double")), df.withColumn("label", F.lit(-1.0))):
        with pytest.raises(ValueError):
            learning.fit_forest(bad, trees=2)
    nan = array_to_vector(F.array(*[F.lit(math.nan)] * SLOTS))
    for vector in (nan, F.when(F.col("label") < 0, F.col("scaled_features"))):
        with pytest.raises(PythonException, match="neither null nor hold NaN"):
            learning.fit_forest(df.limit(5).unionByName(df.limit(5).withColumn("scaled_features", vector)), trees=2)
