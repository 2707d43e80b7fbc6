"""Splits, classifiers, scores and their evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimsieve.functions.columns import normalised
from claimsieve.functions.quantiles import sketch_aggregates, sketch_size
from claimsieve.operators import forest
from claimsieve.schema import DEPTH, TRAIN_TEST, TREES
from claimsieve.staging import Workspace

_BUCKETS = 10_000


def random_split(
    df: DataFrame, weights: Sequence[float] = TRAIN_TEST, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Random parts, drawn anew whenever one is read.

    The seed gives the same parts as long as the table is cut into the same partitions, which a
    cluster that grows or shrinks between two reads does not promise.
    """
    train, test = df.randomSplit(list(weights), seed)
    return train, test


def with_part(df: DataFrame, weights: Sequence[float] = TRAIN_TEST, seed: int = 42) -> DataFrame:
    """A column ``_part``, ``train`` or ``test``, drawn for each row; write the result before reading it twice."""
    share = weights[0] / sum(weights)
    return df.withColumn("_part", F.when(F.rand(seed) < share, F.lit("train")).otherwise(F.lit("test")))


def parts(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both parts of a stored table with ``_part``, best one that is partitioned by it."""
    train, test = (stored.where(F.col("_part") == name).drop("_part") for name in ("train", "test"))
    return train, test


def stored_split(
    df: DataFrame, workspace: Workspace, weights: Sequence[float] = TRAIN_TEST, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Random parts, drawn once and written, so that they stay disjoint and whole whatever happens.

    It costs a write and spares every later read the sort that a random split needs.
    """
    return parts(workspace.stage(with_part(df, weights, seed), "split", partition_by="_part"))


def hash_side(keys: Sequence[str], weights: Sequence[float] = TRAIN_TEST):
    """1 where a hash of the keys falls to the first part, else 0.

    It depends on the key values alone, neither on partitions nor on the engine, and keeps all
    rows of a key together. A key that holds a large share of the rows moves as a whole; use a
    random split there.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    bucket = F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(_BUCKETS))
    share = round(_BUCKETS * weights[0] / sum(weights))
    return F.when(bucket < share, F.lit(1)).otherwise(F.lit(0))


def hash_split(
    df: DataFrame, keys: Sequence[str], weights: Sequence[float] = TRAIN_TEST
) -> tuple[DataFrame, DataFrame]:
    """Two parts by key: a filter each, without sort or shuffle."""
    side = hash_side(keys, weights)
    return df.where(side == 1), df.where(side == 0)


def group_hash(columns: Sequence[str], dtypes: dict[str, str]) -> Column:
    """A hash that rows share which differ in case and outer blanks of their texts alone."""
    values = (normalised(c) if dtypes[c] == "string" else F.col(c).cast("string") for c in columns)
    return F.md5(F.to_json(F.array(*values)))


@dataclass(frozen=True)
class GroupSplit:
    """Both parts, and the groups too large for one part: ``group_hash, rows``."""

    train: DataFrame
    test: DataFrame
    cut: DataFrame


def group_split(
    df: DataFrame, workspace: Workspace, columns: Sequence[str] | None = None, weights: Sequence[float] = TRAIN_TEST, hot_share: float = 0.05, seed: int = 42
) -> GroupSplit:
    """Two parts such that near-equal rows are in the same one, so that no test row has a copy among those trained on.

    Rows are near-equal that have equal ``columns`` (all by default) but for case and outer blanks of texts. A group's part
    follows from its hash, so no row is moved. Only groups with more than ``hot_share`` of all rows are dealt row by
    row, as either part would be theirs alone, and are reported in ``cut``; they are found by counting rows, then hashes, of which at most
    ``1 / hot_share`` can be that frequent. The parts are written once.
    Cases: nulls are equal to each other and differ from empty texts; an empty table gives empty parts.
    """
    columns = list(columns or df.columns)
    hashed = df.withColumn("_group", group_hash(columns, dict(df.dtypes)))
    counted = hashed.groupBy(F.col("_group").alias("group_hash")).agg(F.count("*").alias("rows"))
    cut = workspace.stage(counted.where(F.col("rows") > hot_share * df.count()), "groups")
    hot = [r["group_hash"] for r in cut.collect()]
    share = weights[0] / sum(weights)
    bucket = F.pmod(F.conv(F.substring("_group", 1, 8), 16, 10).cast("long"), F.lit(_BUCKETS))
    train = F.when(F.col("_group").isin(hot), F.rand(seed) < share).otherwise(bucket < round(_BUCKETS * share))
    dealt = hashed.withColumn("_part", F.when(train, F.lit("train")).otherwise(F.lit("test"))).drop("_group")
    return GroupSplit(*parts(workspace.stage(dealt, "split", partition_by="_part")), cut)


def fit_logistic(df: DataFrame, aggregation_depth: int = 2) -> Model:
    """Logistic regression. Deeper aggregation suits wide vectors over many partitions."""
    return LogisticRegression(
        featuresCol="scaled_features", labelCol="label", aggregationDepth=aggregation_depth
    ).fit(df)


def fit_forest(
    df: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 42, max_memory_mb: int = 256
) -> Model:
    """Random forest. More memory lets one pass over the data grow more nodes."""
    settings = RandomForestClassifier(
        featuresCol="scaled_features",
        labelCol="label",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
        maxMemoryInMB=max_memory_mb,
    )
    return forest.fit(df, settings)


def score(df: DataFrame, model: Model) -> DataFrame:
    return model.transform(df)


def area_under_roc(predictions: DataFrame, score_column: str = "rawPrediction", num_bins: int = 0) -> float:
    """Area under the ROC curve, over all distinct scores unless ``num_bins`` says otherwise."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=score_column, labelCol="label", metricName="areaUnderROC", numBins=num_bins
    ).evaluate(predictions)


@dataclass(frozen=True)
class SketchedArea:
    """An area under the ROC curve and how far it may be from the exact one; both None with one class only."""

    value: float | None
    error: float | None


def sketched_area_under_roc(predictions: DataFrame, score_column: str = "rawPrediction", rel_err: float = 0.01) -> SketchedArea:
    """Area under the ROC curve without a sort of all scores: two passes, and no shuffle of rows.

    The first pass sketches the scores of either class; the second counts both classes between the cuts of the two sketches.
    A pair of a positive and a negative row in different bins is told apart by them, a pair in one bin counts a half, as ties do. So
    ``error``, half the pairs within bins of more than one score, is a proven bound, not an estimate. The cuts are set so that it
    comes out under ``rel_err`` for finite scores. A score so frequent that it fills a bin gets one of its own, where a half is exact.
    Cases: rows with a null or NaN score or a null label are left out; an empty table and one with one class give None.
    """
    kind = predictions.schema[score_column].dataType.simpleString()
    value = vector_to_array(score_column)[1] if kind == "vector" else F.col(score_column).cast("double")
    rows = predictions.select((value + F.lit(0.0)).alias("score"), F.col("label").cast("double").alias("label"))
    rows = rows.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("label").isNotNull())
    sides = {"negative": F.when(F.col("label") <= 0.5, F.col("score")), "positive": F.when(F.col("label") > 0.5, F.col("score"))}
    n = math.ceil(2 / rel_err)
    shares = [i / n for i in range(1, n)]
    found = sketch_aggregates(rows, sides, dict.fromkeys(sides, shares), sketch_size(rel_err / 8))
    if found is None or not (found["n_negative"] and found["n_positive"]):
        return SketchedArea(None, None)
    cuts = sorted(x for side in sides for x in found[f"q_{side}"])
    alone = {x for x, y in zip(cuts, cuts[1:]) if x == y and math.isfinite(x)}
    ends = {0.0, *cuts, *(math.nextafter(x, math.inf) for x in alone)}
    splits = [-math.inf, *sorted(x for x in ends if math.isfinite(x)), math.inf]
    binned = Bucketizer(splits=splits, inputCol="score", outputCol="bin").transform(rows)
    counted = binned.groupBy(F.col("bin").cast("int").alias("bin")).agg(F.count_if(F.col("label") <= 0.5).alias("negative"), F.count_if(F.col("label") > 0.5).alias("positive"))
    below, twice, open_pairs = 0, 0, 0
    for k, negative, positive in sorted(map(tuple, counted.collect())):  # a row for each bin
        twice += positive * (2 * below + negative)
        below += negative
        open_pairs += 0 if splits[k] in alone else positive * negative
    pairs = 2 * found["n_negative"] * found["n_positive"]
    return SketchedArea(twice / pairs, open_pairs / pairs)


def evaluate(
    predictions: DataFrame, model_name: str, run_id: str, score_column: str = "rawPrediction", num_bins: int = 0
) -> DataFrame:
    """Metric rows of one model: ``areaUnderROC`` and, under its own name, ``accuracy``.

    The area says nothing where all labels are alike, so it is then null. Accuracy needs a
    ``prediction`` column.
    """
    aggregates = [F.min("label").alias("low"), F.max("label").alias("high")]
    if "prediction" in predictions.columns:
        aggregates.append(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
    summary = predictions.agg(*aggregates).head()
    one_class = summary["low"] == summary["high"]
    rows = [("areaUnderROC", None if one_class else area_under_roc(predictions, score_column, num_bins))]
    if "prediction" in predictions.columns:
        rows.append(("accuracy", summary["accuracy"]))
    return predictions.sparkSession.createDataFrame(
        [(model_name, metric, value, run_id) for metric, value in rows],
        "model string, metric string, value double, run_id string",
    )
