"""One test per place where a near-right reading of the rules gives other results."""

import math
from bisect import bisect_left, bisect_right

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from claimsieve.functions import quantiles
from claimsieve.operators import cleaning, encoding, learning, outliers, profiling, reporting, rules
from claimsieve.schema import IQR_PREFIX, MEASURES, MIXED_PREFIX, RATIO, Z_PREFIX
from claimsieve.sources import read_claims


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_zero_allowed_gives_no_ratio_and_is_dropped(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (None, 2.0)], "a double, b double")
    ratio = rules.add_charge_ratio(df, "a", "b")
    assert [r[RATIO] for r in ratio.collect()] == [None, 2.0, None]
    assert rows(rules.cap_ratio(ratio)) == [(2.0, 1.0, 2.0)]


def test_exact_quartiles_ignore_partitioning(spark):
    df = spark.range(1000).select((F.col("id") / 4).alias("x"))
    found = {tuple(quantiles(df.repartition(n), ["x"], [0.25, 0.75], 0.0)["x"]) for n in (1, 2, 7)}
    assert found == {(62.25, 187.25)}


def test_column_without_values_stays_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    medians = cleaning.fit_medians(df, ["x"])
    assert medians == {"x": None}
    assert rows(cleaning.fill_medians(df, medians)) == [(None,), (None,)]


@pytest.mark.parametrize("rel_err", [0.0, 0.01])
def test_nan_does_not_spoil_the_statistics(spark, rel_err):
    values = [float("nan")] + [float(v) for v in range(20)]
    df = cleaning.measures_as_double(spark.createDataFrame([(v,) for v in values], "x double"), ["x"])
    filled = cleaning.fill_medians(df, cleaning.fit_medians(df, ["x"], rel_err))
    stats = outliers.fit_outlier_stats(filled, ["x"], rel_err)
    assert not math.isnan(stats[0].mean)
    assert filled.where("isnan(x) or x is null").count() == 0
    assert outliers.flag_outliers(filled, stats).where(f"{MIXED_PREFIX}x = 1").count() == 0


@pytest.mark.parametrize("rel_err", [0.0, 0.01])
def test_single_row_has_no_deviation_and_no_flag(spark, rel_err):
    df = spark.createDataFrame([(1.0,)], "x double")
    stats = outliers.fit_outlier_stats(df, ["x"], rel_err)
    assert stats[0].stddev is None
    assert rows(outliers.flag_outliers(df, stats)) == [(1.0, 0, 0, 0)]


def test_copies_are_removed_before_case(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("A", 1), (None, 1)], "s string, k int")
    assert cleaning.normalise_text(cleaning.drop_duplicates(df), ["s"]).count() == 3
    assert cleaning.drop_duplicates(cleaning.normalise_text(df, ["s"])).count() == 2


def test_flags_refer_to_rows_before_the_charge_rules(spark, workspace):
    from claimsieve.plans.prepare import prepare_claims

    from tests.micro import claims

    # The rows with a large charge fall to the ratio rule, yet widen the spread of the others.
    table = claims(spark, submitted=[100.0 + i for i in range(30)] + [1e6] * 3, allowed=[90.0] * 33)
    prepared = prepare_claims(table, workspace, rel_err=0.0)
    charge = next(s for s in prepared.stats if s.column == rules.SUBMITTED)
    assert prepared.population.count() == 33
    assert prepared.cleaned.count() == 30
    assert charge.mean > 90_000


def test_ratio_arm_of_the_rule_fires_on_uncapped_rows(spark):
    flags = ", ".join(f"{MIXED_PREFIX}{m} int" for m in MEASURES[3:6])
    data = [(0, 0, 0, 100.0), (0, 0, 0, 10.0), (0, 0, 0, None), (0, 1, 0, None)]
    df = spark.createDataFrame(data, f"{flags}, {RATIO} double")
    labelled = rules.label(df, rules.any_rule(rules.fraud_rules()))
    assert [r.is_fraud for r in labelled.collect()] == [1, 0, 0, 1]


def test_area_and_accuracy_have_their_own_names(spark):
    data = [(0.9, 0.0, 1.0), (0.8, 0.0, 1.0), (0.1, 0.0, 0.0)]
    df = spark.createDataFrame(data, "rawPrediction double, prediction double, label double")
    metrics = {r.metric: r.value for r in learning.evaluate(df, "m", "r").collect()}
    assert metrics["areaUnderROC"] == 1.0
    assert metrics["accuracy"] == pytest.approx(1 / 3)


def test_area_is_exact_unless_binned(spark):
    data = [(float(i * 37 % 5000), float((i * i) % 3 == 0)) for i in range(5000)]
    df = spark.createDataFrame(data, "rawPrediction double, label double")
    up = [s for s, y in data if y]
    down = sorted(s for s, y in data if not y)
    exact = sum(bisect_left(down, s) + bisect_right(down, s) for s in up) / 2 / (len(up) * len(down))
    assert learning.area_under_roc(df) == pytest.approx(exact, abs=1e-12)
    assert learning.area_under_roc(df, num_bins=50) != pytest.approx(exact, abs=1e-12)


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.2, 1.0)], "rawPrediction double, label double")
    assert rows(learning.evaluate(df, "m", "r")) == [("m", "areaUnderROC", None, "r")]


@pytest.fixture
def categories(spark):
    data = [("a", 1.0, 7.0), ("a", 2.0, 7.0), ("b", 3.0, 7.0), ("c", 4.0, 7.0), (None, 5.0, 7.0)]
    return spark.createDataFrame([(*r, 1) for r in data], "cat string, x double, const double, is_fraud int")


@pytest.fixture
def fitted(categories, workspace):
    return encoding.fit_encoder(categories, workspace, ["cat"], ["x", "const"], [])


def test_flags_can_be_left_out_of_the_features(spark, workspace):
    data = [("a", 1.0, 0, 1), ("b", 2.0, 1, 0)]
    df = spark.createDataFrame(data, f"cat string, x double, {MIXED_PREFIX}x int, is_fraud int")
    wide = encoding.encode(df, encoding.fit_encoder(df, workspace, ["cat"], ["x"]))
    narrow = encoding.encode(df, encoding.fit_encoder(df, workspace, ["cat"], ["x"], flags=()))
    assert encoding.slot_names(wide) == ["x", f"{MIXED_PREFIX}x", "cat_OHE_a", "cat_OHE_b"]
    assert encoding.slot_names(narrow) == ["x", "cat_OHE_a", "cat_OHE_b"]


def test_slots_carry_the_names_of_their_labels(categories, fitted):
    encoded = encoding.encode(categories, fitted)
    names = encoding.slot_names(encoded)
    assert names == ["x", "const", "cat_OHE_a", "cat_OHE_b", "cat_OHE_c"]
    flat = encoding.flatten_vector(encoded, "features", names, ["cat_OHE_b", "x"])
    assert flat.columns == ["cat_OHE_b", "x"]
    assert sorted(rows(flat)) == [(0.0, 1.0), (0.0, 2.0), (0.0, 4.0), (0.0, 5.0), (1.0, 3.0)]


def test_null_and_unseen_categories_give_an_empty_block(spark, categories, fitted):
    new = spark.createDataFrame([("z", 1.0, 7.0, 0), (None, 1.0, 7.0, 0), ("b", 1.0, 7.0, 0)], categories.schema)
    vectors = [r.cat_OHE.toArray().tolist() for r in encoding.encode(new, fitted).collect()]
    assert vectors == [[0, 0, 0], [0, 0, 0], [0, 1, 0]]


def test_scaling_divides_indicators_too_and_empties_constants(categories, fitted):
    scaled = [r.scaled_features.toArray().tolist() for r in encoding.encode(categories, fitted).collect()]
    x_dev, b_dev = math.sqrt(2.5), math.sqrt(0.2)
    assert [v[1] for v in scaled] == [0.0] * 5
    assert scaled[2] == pytest.approx([3 / x_dev, 0, 0, 1 / b_dev, 0])


def test_missing_measures_fail_the_assembly(spark, workspace, categories):
    broken = categories.withColumn("x", F.when(F.col("x") > 2, F.col("x")))
    with pytest.raises(Exception, match="(?i)null"):
        encoding.encode(broken, encoding.fit_encoder(broken, workspace, ["cat"], ["x"], [])).collect()


def test_hash_split_ignores_partitioning(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    found = {tuple(sorted(r.k for r in learning.hash_split(df.repartition(n), ["k"])[0].collect())) for n in (1, 5)}
    assert len(found) == 1
    assert len(found.pop()) == pytest.approx(14_000, rel=0.02)


def test_seeded_models_repeat(spark, workspace):
    from claimsieve.plans.train import train_and_score

    x = F.col("id") * 37 % 100
    df = spark.range(400).select(
        (x / 50).alias("x"), (F.col("id") % 3).cast("string").alias("cat"), (x > 60).cast("int").alias("is_fraud")
    )
    stored = workspace.stage(df, "rows")
    encoder = encoding.fit_encoder(stored, workspace, ["cat"], ["x"], [])
    processed = workspace.stage(encoding.to_xy(encoding.encode(stored, encoder)), "xy")
    for model in ("logistic", "forest"):
        params = {"forest": {"trees": 5}}
        runs = [train_and_score(processed, workspace, [model], 3, params)[model].metrics for _ in range(2)]
        a, b = map(rows, runs)
        assert a == b
        assert {r[1] for r in a} == {"areaUnderROC", "accuracy"}
        assert all(0 <= r[2] <= 1 for r in a)


def test_union_matches_columns_by_name(spark):
    a = spark.createDataFrame([("1", "a")], "Accuracy string, Source string")
    b = spark.createDataFrame([("b", "2")], "Source string, Accuracy string")
    assert rows(reporting.union_all([a, b])) == [("1", "a"), ("2", "b")]
    assert rows(reporting.union_all([a, b], by_name=False)) == [("1", "a"), ("b", "2")]


def test_only_listed_columns_are_filled_and_normalised(spark):
    from claimsieve.schema import FILLED_CATEGORICALS, NORMALISED_TEXT

    from tests.micro import claims

    table = claims(spark, submitted=[1.0], allowed=[1.0], text=None)
    done = cleaning.normalise_text(cleaning.fill_unknown(table)).head()
    for name in ("Provider_RUCA_Code", "Medicare_Participation", "Procedure_Description"):
        assert done[name] is None
    assert done["Provider_State"] == "Unknown"
    assert {done[c] for c in NORMALISED_TEXT} == {"unknown"}
    assert set(NORMALISED_TEXT) < set(FILLED_CATEGORICALS)


def test_trim_leaves_tabs(spark):
    df = spark.createDataFrame([(" A\t",)], "s string")
    assert rows(cleaning.normalise_text(df, ["s"])) == [("a\t",)]


def test_empty_table_has_no_nulls(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert rows(profiling.null_counts(df)) == [(0, 0)]
    assert rows(profiling.null_counts_long(df)) == [("a", 0), ("b", 0)]


def test_description_leaves_out_booleans_and_agrees_with_describe(spark):
    data = [("00100", 1, True, 2.0), ("x", 2, None, None), (None, 3, False, 4.5), (" 7 ", 3, False, float("-1"))]
    df = spark.createDataFrame(data, "s string, i int, f boolean, d double")
    plain = {r["summary"]: r for r in df.describe().collect()}
    for row in profiling.describe_table(df).collect():
        name = row["column"]
        assert row["count"] == int(plain["count"][name])
        for statistic in ("mean", "stddev"):
            assert row[statistic] == pytest.approx(float(plain[statistic][name]))
        for end in ("min", "max"):
            if name == "s":
                assert row[f"{end}_text"] == plain[end][name]
            else:
                assert row[end] == float(plain[end][name])
    assert [r["column"] for r in profiling.describe_table(df).collect()] == ["i", "d", "s"]


@pytest.mark.parametrize(
    "text",
    ["nan", "Infinity", "-inf", "+1", ".5", "1e3", "1E-3", " 2", "2d", "x1", "-", "", "12abc", "NaN", "0x1p3"],
)
def test_only_texts_that_read_as_numbers_are_cast(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    guarded, plain = profiling._number(df.schema["s"]), F.col("s").try_cast("double")
    row = df.select(guarded.alias("guarded"), plain.alias("plain")).head()
    assert repr(row["guarded"]) == repr(row["plain"])


def test_mixed_flag_is_the_larger_of_both(spark):
    df = spark.range(500).select((F.col("id") * F.col("id")).cast("double").alias("x"))
    flagged = outliers.flag_outliers(df, outliers.fit_outlier_stats(df, ["x"], 0.0), k=1.5, m=0.1)
    wrong = flagged.where(F.col(MIXED_PREFIX + "x") != F.greatest(Z_PREFIX + "x", IQR_PREFIX + "x"))
    assert wrong.count() == 0
    assert {r[0] for r in flagged.select(MIXED_PREFIX + "x").distinct().collect()} == {0, 1}


def test_bounds_are_strict(spark):
    stats = [outliers.MeasureStats("x", 0.0, 1.0, 0.0, 2.0)]
    df = spark.createDataFrame([(3.0,), (3.1,), (5.0,), (5.1,), (-3.0,), (None,)], "x double")
    assert [r[1:] for r in rows(outliers.flag_outliers(df, stats))] == [
        (0, 0, 0), (1, 0, 1), (1, 0, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0)
    ]


def test_codes_keep_leading_zeros_unless_inferred(spark, workspace):
    path = workspace.location("codes")
    spark.createDataFrame([("HCPCS_Cd",), ("00100",), ("00213",)], "value string").coalesce(1).write.text(path)
    from claimsieve.schema import RAW
    from pyspark.sql.types import StructType

    schema = StructType([RAW["HCPCS_Cd"]])
    assert rows(read_claims(spark, path, schema)) == [("00100",), ("00213",)]
    assert rows(read_claims(spark, path, infer=True)) == [(100,), (213,)]


def test_missing_column_is_reported(spark, workspace):
    path = workspace.location("codes")
    spark.createDataFrame([("HCPCS_Cd",), ("00100",)], "value string").coalesce(1).write.text(path)
    with pytest.raises(AnalysisException):
        read_claims(spark, path)
