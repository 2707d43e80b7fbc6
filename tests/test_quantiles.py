import math
import sys
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimsieve.functions import exact_quantiles, quantiles, sketch_aggregates

PROBS = [0.25, 0.5, 0.75]


def by_sorting(values, probs=PROBS):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    return [values[max(1, math.ceil(p * len(values))) - 1] if values else None for p in probs]


def frame(spark, values, partitions=4):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(partitions)


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 5, 59])
def test_small_columns_match_sorting(spark, rows):
    values = [float(v) for v in np.random.default_rng(rows).integers(0, 20, rows)]
    assert exact_quantiles(frame(spark, values), ["x"], PROBS)["x"] == by_sorting(values)


@pytest.mark.parametrize("collect_rows", [0, 7, 300])
@pytest.mark.parametrize("hot", [None, 0.0, 500.0, 999.0])
def test_many_rounds_with_a_hot_value(spark, collect_rows, hot):
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.integers(0, 1000, 4000)] + [float(v) for v in rng.normal(500, 1e5, 500)]
    values += [] if hot is None else [hot] * 2500
    found = exact_quantiles(frame(spark, values), ["x"], PROBS, sketch_err=0.02, collect_rows=collect_rows)
    assert found["x"] == by_sorting(values)


def test_bounds_that_miss_only_cost_rounds(spark, monkeypatch):
    values = [float(v) for v in range(5000)]
    monkeypatch.setattr(sys.modules[exact_quantiles.__module__], "_shares", lambda share, err: [0.9, 0.95])
    found = exact_quantiles(frame(spark, values), ["x"], PROBS, sketch_err=0.01, collect_rows=50)
    assert found["x"] == by_sorting(values)
    monkeypatch.setattr(sys.modules[exact_quantiles.__module__], "_shares", lambda share, err: [0.05, 0.1])
    found = exact_quantiles(frame(spark, values), ["x"], PROBS, sketch_err=0.01, collect_rows=50)
    assert found["x"] == by_sorting(values)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: v + 0.0), st.sampled_from([math.inf, -math.inf])), min_size=1, max_size=200))
def test_any_list_matches_sorting(spark, values):
    found = exact_quantiles(frame(spark, values), ["x"], PROBS, sketch_err=0.05, collect_rows=10)
    assert found["x"] == by_sorting(values)


@pytest.mark.parametrize("end", [math.inf, -math.inf])
@pytest.mark.parametrize("share", [0.249, 0.25, 0.5, 0.76, 1.0])
def test_infinite_values_count(spark, end, share):
    values = [end] * int(2000 * share) + [float(k) for k in range(int(2000 * (1 - share)))]
    assert exact_quantiles(frame(spark, values), ["x"], PROBS, sketch_err=0.02, collect_rows=50)["x"] == by_sorting(values)


def test_sketches_are_merged_in_two_levels(spark, plan_text):
    df = spark.range(0, 6000, numPartitions=1500).select(F.col("id").cast("double").alias("x"))
    found = sketch_aggregates(df, {"x": F.col("x")}, {"x": [0.5]}, 200)
    assert abs(found["q_x"][0] - 3000) < 150 and found["n_x"] == 6000
    grouped = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(512)).alias("g")).count()
    assert grouped.count() == 512


def test_exact_values_do_not_depend_on_partitions(spark):
    values = [float(v * 7919 % 10007) / 4 for v in range(10007)]
    found = {tuple(exact_quantiles(frame(spark, values, n), ["x"], PROBS)["x"]) for n in (1, 3, 16)}
    assert found == {tuple(by_sorting(values))}


@pytest.mark.parametrize("partitions", [1, 9, 64])
def test_sketch_stays_within_its_rank_error(spark, partitions):
    values = [float(v) for v in np.random.default_rng(1).lognormal(3, 2, 20_000)]
    found = quantiles(frame(spark, values, partitions), ["x"], PROBS, 0.01)["x"]
    for p, v in zip(PROBS, found):
        rank = sum(1 for x in values if x <= v)
        assert abs(rank - p * len(values)) <= 0.01 * len(values) + 1


@pytest.mark.parametrize("rel_err", [0.0, 0.01])
def test_null_and_nan_are_left_out(spark, rel_err):
    rows = [(float("nan"), None, 1), (1.0, None, 2), (2.0, None, 3), (None, None, 4)]
    df = spark.createDataFrame(rows, "x double, y double, k int")
    found = quantiles(df, ["x", "y", "k"], [0.5], rel_err)
    assert found == {"x": [1.0], "y": [None], "k": [2.0]}


def test_passes_over_a_large_column(spark):
    """Counting jobs: a column beyond the collected size takes one round, not one per probability."""
    df = spark.range(200_000).select(F.col("id").cast("double").alias("x"))
    group = "exact quantiles"
    spark.sparkContext.setJobGroup(group, group)
    exact_quantiles(df, ["x"], PROBS)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 8


def test_one_pass_of_cuts_leaves_few_values(spark, monkeypatch):
    """Four ranks of 200,000 values: a sketch, a count, and the rest is small enough to be collected."""
    module = sys.modules[exact_quantiles.__module__]
    left, counted = [], []
    decide, count = module._decide, module._count_between
    monkeypatch.setattr(module, "_decide", lambda values, targets: (left.extend(t.inside for t in targets), decide(values, targets)))
    monkeypatch.setattr(module, "_count_between", lambda values, splits: (counted.append(1), count(values, splits))[1])
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    probs = [0.1, 0.25, 0.5, 0.999]
    found = exact_quantiles(df, ["x", "y"], probs, collect_rows=2000)
    x = sorted(i * 7919 % 200_003 for i in range(200_000))
    assert found == {"x": [float(x[math.ceil(p * 200_000) - 1]) for p in probs], "y": [0.0, 1.0, 2.0, 4.0]}
    assert len(counted) == 1 and max(left) < 400


def test_negative_zero_and_infinities_alone(spark):
    assert exact_quantiles(frame(spark, [-0.0, 0.0, -0.0]), ["x"], [0.5], collect_rows=0) == {"x": [0.0]}
    assert exact_quantiles(frame(spark, [math.inf, -math.inf, math.inf]), ["x"], [0.1, 0.5], collect_rows=0) == {"x": [-math.inf, math.inf]}


def test_the_last_values_are_found_without_a_condition_for_each_quantile(spark, monkeypatch):
    """What a row costs in the last pass must not follow the number of quantiles; the values are those of sorting."""
    df = spark.range(3000).selectExpr("cast((id * 7919) % 1000 as double) / 3 - 100 as x", "if(id % 5 = 0, null, cast(id as double)) as y")
    plans, collect = [], type(df).collect

    def noting(self):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(df), "collect", noting)
    rows, sizes = [r.asDict() for r in collect(df)], []
    for n in (4, 40):
        probs = [k / n for k in range(1, n)]
        found = exact_quantiles(df, ["x", "y"], probs, collect_rows=3000 if n == 4 else 50)
        for c in ("x", "y"):
            some = sorted(r[c] for r in rows if r[c] is not None)
            assert found[c] == [some[max(1, math.ceil(Fraction(str(p)) * len(some))) - 1] for p in probs]
        sizes.append(plans[-1].upper().count("CASE WHEN") + plans[-1].upper().count("IF ("))
    assert max(sizes) < 20
