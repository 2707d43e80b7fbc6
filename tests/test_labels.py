import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from claimsieve.operators import encoding, labels

COLUMNS = ["a", "b"]


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one label, a fifth have none, the others have a few rows each."""
    i = F.col("id")
    return spark.range(3000).select(
        i.alias("k"),
        F.when(i % 3 == 0, "hot").when(i % 5 == 1, None).otherwise(F.concat(F.lit("v"), (i % 97).cast("string"))).alias("a"),
        F.when(i % 2 == 0, "x").otherwise(F.concat(F.lit("w"), (i % 11).cast("string"))).alias("b"),
    )


def pairs(df):
    return sorted((r.k, r.a_Index, r.b_Index) for r in df.collect())


@pytest.fixture
def known(skewed, workspace):
    return workspace.stage(labels.indexed_labels(labels.label_counts(skewed, COLUMNS), workspace), "labels")


def built_in(df):
    indexer = StringIndexer(inputCols=COLUMNS, outputCols=["a_Index", "b_Index"], handleInvalid="keep").fit(df)
    return pairs(indexer.transform(df)), [list(found) for found in indexer.labelsArray]


@pytest.mark.parametrize("head", [0, 1, 3, labels.HEAD])
def test_indices_are_those_of_the_built_in_indexer(skewed, known, head):
    expected, names = built_in(skewed)
    joined = labels.index_by_join(skewed, known, COLUMNS, head)
    assert pairs(joined) == expected
    assert joined.columns == ["k", "a", "b", "a_Index", "b_Index"]
    assert list(encoding.ordered_names(known, COLUMNS).values()) == names


@pytest.mark.parametrize("head", [0, 2, labels.HEAD])
def test_unseen_values_share_the_index_after_the_labels(spark, known, head):
    new = spark.createDataFrame([(1, "never", None), (2, "hot", "never"), (3, "", "x")], "k int, a string, b string")
    sizes = labels.label_numbers(known, COLUMNS)
    assert pairs(labels.index_by_join(new, known, COLUMNS, head)) == [(1, sizes["a"], sizes["b"]), (2, 0.0, sizes["b"]), (3, sizes["a"], 0.0)]


def test_an_unseen_label_on_half_of_a_later_batch_is_spread(spark, known):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        i = F.col("id")
        batch = spark.range(8000).select(i.alias("k"), F.when(i % 2 == 0, "unseen").otherwise("v7").alias("a"), F.lit("x").alias("b"))
        joined = labels.index_by_join(batch, known, COLUMNS, 1)
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 8000 and max(sizes) < 2500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def many(spark, n=30_000):
    return spark.range(2 * n).select(F.col("id").alias("k"), F.concat(F.lit("label "), (F.col("id") % n).cast("string")).alias("a"), F.lit("x").alias("b"))


def test_many_labels_move_no_row(spark, workspace, plan_text):
    rows = workspace.stage(many(spark), "rows")
    known = workspace.stage(labels.indexed_labels(labels.label_counts(rows, COLUMNS), workspace), "labels")
    joined = labels.index_by_join(rows, known, COLUMNS)
    plan = plan_text(joined).replace("BroadcastExchange", "")
    assert "Exchange" not in plan and "SortMergeJoin" not in plan
    assert "label" not in plan.split("HashedRelationBroadcastMode")[1].split("\n")[0]  # the dictionary holds no text
    found = {(r["a"], r["a_Index"]) for r in joined.collect()}
    assert found == {(r["label"], float(r["index"])) for r in known.where("column = 'a'").collect()} and len(found) == 30_000


def test_labels_that_clash_go_by_their_text(spark, workspace):
    rows = workspace.stage(many(spark, 50), "rows")
    known = workspace.stage(labels.indexed_labels(labels.label_counts(rows, COLUMNS), workspace), "labels")
    assert known.where("clash").count() == 0
    clashing = workspace.stage(known.withColumn("clash", F.col("index") % 7 == 3), "clashing")
    assert pairs(labels.index_by_join(rows, clashing, COLUMNS)) == pairs(labels.index_by_join(rows, known, COLUMNS))


def test_more_labels_than_the_dictionary_holds(spark, workspace, monkeypatch):
    """They are ordered by a range shuffle, and each column has its share of the dictionary."""
    rows = workspace.stage(many(spark, 400), "rows")
    counts = labels.label_counts(rows, COLUMNS)
    plain = workspace.stage(labels.indexed_labels(counts, workspace), "labels")
    expected = pairs(labels.index_by_join(rows, plain, COLUMNS))
    monkeypatch.setattr(labels, "HEAD", 60)
    known = workspace.stage(labels.indexed_labels(counts, workspace), "labels")
    assert sorted(map(tuple, known.collect())) == sorted(map(tuple, plain.collect()))
    assert pairs(labels.index_by_join(rows, known, COLUMNS, 60)) == expected


def test_long_labels_are_not_broadcast(spark, workspace, plan_text):
    df = spark.createDataFrame([(1, "x" * 500, "p"), (2, "y", "p")], "k int, a string, b string")
    known = workspace.stage(labels.indexed_labels(labels.label_counts(df, COLUMNS), workspace), "labels")
    assert pairs(labels.index_by_join(df, known, COLUMNS)) == [(1, 0.0, 0.0), (2, 1.0, 0.0)]


def test_index_table_counts_up_over_any_partitions(spark, workspace):
    df = spark.range(5000).select((F.col("id") % 700).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    table = labels.indexed_labels(labels.label_counts(df, COLUMNS), workspace)
    found = sorted(map(tuple, table.collect()), key=lambda r: (r[0], r[3]))
    expected = sorted(
        ((c, r["label"], r["count"]) for c in COLUMNS for r in df.groupBy(F.col(c).alias("label")).count().collect()),
        key=lambda r: (r[0], -r[2], r[1]),
    )
    assert [r[:3] for r in found] == expected
    assert [r[3] for r in found if r[0] == "a"] == list(range(700))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_rows_are_scanned_once(spark, workspace, plan_text, n):
    columns = [f"c{i}" for i in range(n)]
    rows = workspace.stage(spark.range(500).select("id", *((F.col("id") % (20 + i)).cast("string").alias(c) for i, c in enumerate(columns))), "rows")
    known = workspace.stage(labels.indexed_labels(labels.label_counts(rows, columns), workspace), "labels")
    plan = plan_text(labels.index_by_join(rows, known, columns, head=3))
    scans = [line for line in plan.split("\n") if "FileScan" in line and "id#" in line]
    assert len(scans) == 1
    assert "Union" not in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_any_head_gives_the_same_vectors_and_names(skewed, workspace):
    table = workspace.stage(
        skewed.withColumn("x", F.col("k").cast("double")).withColumn("is_fraud", (F.col("k") % 2).cast("int")), "rows"
    )
    found, names = [], []
    for head in (labels.HEAD, 4):
        encoder = encoding.fit_encoder(table, workspace, COLUMNS, ["x"], [], head=head)
        encoder.save(workspace.location(f"encoder-{head}"))
        encoder = encoding.Encoder.load(table.sparkSession, workspace.location(f"encoder-{head}"))
        encoded = encoding.encode(table, encoder)
        names.append(encoding.slot_names(encoded))
        found.append(sorted((r.k, tuple(r.scaled_features.toArray()), r.label) for r in encoded.select("k", "scaled_features", "label").collect()))
    assert len(found[0]) == 3000
    assert names[0] == names[1] and names[0][:2] == ["x", "a_OHE_hot"]
    for (k, v, y), (k2, v2, y2) in zip(*found):
        assert (k, y) == (k2, y2) and v == pytest.approx(v2, rel=1e-12)


def test_two_encoders_of_one_workspace_both_work(skewed, workspace):
    table = workspace.stage(skewed.withColumn("x", F.lit(1.0)).withColumn("is_fraud", F.lit(1)), "rows")
    first, second = (encoding.fit_encoder(table, workspace, [c], ["x"], []) for c in COLUMNS)
    assert first.transform(table).count() == second.transform(table).count() == 3000


def test_vectors_too_wide_for_the_driver_are_refused(skewed, workspace):
    table = workspace.stage(skewed.withColumn("x", F.lit(1.0)).withColumn("is_fraud", F.lit(1)), "rows")
    with pytest.raises(ValueError, match="slots"):
        encoding.fit_encoder(table, workspace, COLUMNS, ["x"], [], max_slots=50)
