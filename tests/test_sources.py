import time
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from claimsieve.operators.cleaning import rename_columns
from claimsieve.schema import LOGICAL, RAW, RAW_TO_LOGICAL
from claimsieve.sources import (
    append_metrics,
    describe_schema,
    preview,
    read_claims,
    read_claims_checked,
    read_metric_files,
    read_metrics,
    read_records,
    read_stage,
    read_strings,
    write_csv,
    write_metric_file,
    write_stage,
)
from claimsieve.staging import Workspace, staging_root


def rows(df):
    return [tuple(r) for r in df.collect()]


def text_file(spark, path, *lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_columns_are_found_by_header_name(spark, workspace):
    names = ["extra", *reversed(RAW_TO_LOGICAL)]
    values = ["x", *(("7" if RAW[n].dataType.simpleString() != "string" else f"t{i}") for i, n in enumerate(names[1:]))]
    path = text_file(spark, workspace.location("csv"), ",".join(names), ",".join(values))
    claims = rename_columns(read_claims(spark, path))
    assert claims.schema == LOGICAL
    row = claims.head()
    assert row["Provider_ID"] == 7
    assert row["Procedure_Code"] == f"t{names[1:].index('HCPCS_Cd')}"
    assert row["Average_Submitted_Charge"] == 7.0


def test_only_wanted_columns_are_parsed(spark, workspace, plan_text):
    path = text_file(spark, workspace.location("csv"), ",".join([*RAW_TO_LOGICAL, "extra"]), ",".join("1" * 19))
    plan = plan_text(rename_columns(read_claims(spark, path)).select("Provider_ID"))
    assert "ReadSchema: struct<Rndrng_NPI:string>" in plan


def test_files_with_differing_headers_fail(spark, workspace):
    path = workspace.location("csv")
    spark.createDataFrame([("a,b",), ("1,2",)], "value string").coalesce(1).write.text(path)
    spark.createDataFrame([("b,a",), ("2,1",)], "value string").coalesce(1).write.mode("append").text(path)
    with pytest.raises(Exception, match="header does not conform"):
        read_strings(spark, path).collect()


def test_csv_keeps_outer_spaces_quotes_and_nulls(spark, workspace):
    data = [("  A ", 'say "hi", you'), (None, "b")]
    df = spark.createDataFrame(data, "x string, y string")
    write_csv(df, workspace.location("csv"))
    assert sorted(rows(read_strings(spark, workspace.location("csv"))), key=str) == sorted(data, key=str)


def folders(path):
    return sorted(x.name for x in Path(path.removeprefix("file:")).iterdir() if not x.name.startswith("."))


def test_stage_is_overwritten(spark, workspace):
    path = workspace.location("t")
    write_stage(spark.range(5), path)
    old = read_stage(spark, path)
    write_stage(spark.range(2), path)
    assert rows(read_stage(spark, path).orderBy("id")) == [(0,), (1,)]
    assert old.count() == 5  # who read it before still can
    for n in (3, 4):
        write_stage(spark.range(n), path)
    assert len(folders(path)) == 3 and "_current" in folders(path)  # the version before it, and no older one
    write_stage(spark.range(6).withColumn("part", F.col("id") % 2), path, partition_by="part")
    assert sorted(rows(read_stage(spark, path)))[:2] == [(0, 0), (1, 1)]


def test_a_write_that_fails_half_way_leaves_the_old_table(spark, workspace):
    path = workspace.location("t")
    half = spark.range(0, 1000, 1, 4).withColumn("x", F.when(F.col("id") > 900, F.raise_error(F.lit("no more"))).otherwise(F.lit("a")))
    with pytest.raises(PySparkException):
        write_stage(half, path)
    assert "_current" not in folders(path)
    write_stage(spark.range(5), path)
    before = folders(path)
    with pytest.raises(PySparkException):
        write_stage(half, path)
    assert rows(read_stage(spark, path).orderBy("id")) == [(k,) for k in range(5)]
    assert folders(path) == before


def test_a_table_that_was_written_otherwise_is_read_and_replaced(spark, workspace):
    path = workspace.location("t")
    spark.range(7).write.parquet(path)
    assert read_stage(spark, path).count() == 7
    write_stage(spark.range(2), path)
    assert read_stage(spark, path).count() == 2


METRIC_ROW = "value double, model string, metric string, run_id string"


def test_metrics_of_a_run_count_once(spark, workspace):
    path = workspace.location("metrics")
    tries = [(0.25, "m", "auc", "7"), (0.5, "m", "auc", "7"), (0.5, "m", "auc", "8"), (0.75, "n", "auc", "7"), (0.1, "m", "auc", None)]
    for row in tries:
        append_metrics(spark.createDataFrame([row], METRIC_ROW), path)
    found = read_metrics(spark, path)
    assert found.columns == ["model", "metric", "value", "run_id"]
    assert sorted(rows(found), key=str) == [("m", "auc", 0.1, None), ("m", "auc", 0.5, "7"), ("m", "auc", 0.5, "8"), ("n", "auc", 0.75, "7")]


def test_absent_metric_files_are_skipped(spark, workspace):
    for name in ("lr", "rf"):
        write_metric_file(spark.createDataFrame([(name, 0.5)], "model string, value double"), workspace.location(f"{name}.csv"))
    found = read_metric_files(spark, workspace.path, ["lr.csv", "none.csv", "rf.csv"])
    assert sorted(rows(found)) == [("lr", "0.5", "lr.csv"), ("rf", "0.5", "rf.csv")]
    assert rows(read_metric_files(spark, workspace.path, ["lr.csv"])) == [("lr", "0.5", "lr.csv")]
    assert read_metric_files(spark, workspace.path, ["none.csv"]).count() == 0


def test_preview_and_schema(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    assert rows(preview(df, 2, ["k"])) == [(1, "a"), (2, "b")]
    assert preview(df, 2).count() == 2
    assert rows(describe_schema(df)) == [("k", "int", True), ("v", "string", True)]


def test_metric_files_are_brought_together_by_name(spark, workspace):
    frames = {
        "lr.csv": spark.createDataFrame([("lr", "accuracy", 0.5)], "model string, metric string, value double"),
        "rf.csv": spark.createDataFrame([("accuracy", "rf")], "metric string, model string"),
        "odd{1}[a]*,.csv": spark.createDataFrame([("odd",)], "model string"),
    }
    for name, metrics in frames.items():
        write_metric_file(metrics, f"{workspace.path}/{name}")
    found = read_metric_files(spark, workspace.path, ["rf.csv", "none.csv", *frames])
    assert set(found.columns) == {"model", "metric", "value", "Source"}
    got = {(r["model"], r["metric"], r["value"], r["Source"]) for r in found.collect()}
    assert got == {("lr", "accuracy", "0.5", "lr.csv"), ("rf", "accuracy", None, "rf.csv"), ("odd", None, None, "odd{1}[a]*,.csv")}


def test_values_that_do_not_fit_are_kept_apart(spark, workspace):
    names = list(RAW_TO_LOGICAL)
    lines = [",".join("1" for _ in names), ",".join("1x" if n == "Rndrng_NPI" else "1" for n in names), ",".join('"1,200.50"' if n == "Avg_Sbmtd_Chrg" else "" for n in names)]
    path = text_file(spark, workspace.location("csv"), ",".join(names), *lines)
    good, bad = read_claims_checked(spark, path)
    assert good.schema == read_claims(spark, path).schema
    assert [r["Rndrng_NPI"] for r in good.collect()] == [1]
    found = sorted((tuple(r["rejected_columns"]), r["Rndrng_NPI"], r["Avg_Sbmtd_Chrg"]) for r in bad.collect())
    assert found == [(("Avg_Sbmtd_Chrg",), None, "1,200.50"), (("Rndrng_NPI",), "1x", "1")]
    with pytest.raises(PySparkException):
        read_claims(spark, path).collect()


RECORDS = [
    "a,b,c",
    "1,x,y",
    "2,short",
    "3,x,y,long",
    '4,"two',
    'lines",y',
    '5,"unclosed,y',
    '6,x,"last',
    'line"',
    '8,"q, \\"in\\" q",ok',
    "",
    '9,"say "hi" you",z',
    '10,5" pipe,',
    ",,",
    '11,"x" ,y',
]


def test_records_that_are_none_are_rejected_with_their_text(spark, workspace):
    found = rows(read_records(spark, text_file(spark, workspace.location("csv"), *RECORDS)))
    good = [r[:3] for r in found if r[3] is None]
    assert good == [("1", "x", "y"), ("8", 'q, "in" q', "ok"), ("10", '5" pipe', None), (None, None, None)]
    bad = [r for r in found if r[3] is not None]
    assert [r[3] for r in bad] == [x for x in RECORDS[1:] if x and x.split(",")[0] not in ("1", "8", "10", "")]
    assert {r[:3] for r in bad} == {(None, None, None)}


def test_records_of_several_lines(spark, workspace):
    lines = ["a,b,c", "1,x,y", "2,short", '4,"two', 'lines",y', '"5","x\n",z', '6,x,"open', '7,"x",y', '8,x,y"', "9,,"]
    found = rows(read_records(spark, text_file(spark, workspace.location("csv"), *lines), multi_line=True))
    assert [r[:3] for r in found if r[3] is None] == [("1", "x", "y"), ("4", "two\nlines", "y"), ("5", "x\n", "z"), ("8", "x", 'y"'), ("9", None, None)]
    bad = [r for r in found if r[3] is not None]
    assert [r[:3] for r in bad] == [(None, None, None)] * 2 and bad[0][3] == "2,short" and bad[1][3].startswith('6,x,"open\n7,')
    path = text_file(spark, workspace.location("open"), *lines[:2], '6,x,"open', "7,x,y")
    with pytest.raises(ValueError, match="not closed"):
        read_records(spark, path, multi_line=True)


def test_records_of_files_without_the_header_fail(spark, workspace):
    path = text_file(spark, workspace.location("csv"), "a,b", "1,2")
    spark.createDataFrame([("b,a",), ("2,1",)], "value string").coalesce(1).write.mode("append").text(path)
    with pytest.raises(ValueError, match="header"):
        read_records(spark, path)


def test_long_lines_are_checked(spark, workspace):
    line = ",".join(['"' + ("ab" + chr(92) + '"') * 40_000 + '"', "x" * 200_000])
    (row,) = rows(read_records(spark, text_file(spark, workspace.location("csv"), "a,b", line)))
    assert row[2] is None and len(row[0]) == 120_000 and len(row[1]) == 200_000


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_staging_folder_is_the_one_the_session_names():
    assert staging_root(Session(spark_checkpoint_dir="s3://shared/x", spark_master="yarn")) == "s3://shared/x"
    assert Workspace(Session(spark_checkpoint_dir="hdfs:///x/"), run_id="r").location("t") == "hdfs:///x/claimsieve/r/t"


def test_without_that_setting_the_shared_warehouse_is_used():
    session = Session(spark_master="yarn", spark_sql_warehouse_dir="hdfs:///house/")
    assert staging_root(session) == "hdfs:///house/_staging"


def test_staging_a_name_again_leaves_the_first_table_readable(spark, workspace):
    first, second = workspace.stage(spark.range(3), "t"), workspace.stage(spark.range(5), "t")
    assert (first.count(), second.count()) == (3, 5)


def test_stage_cuts_the_lineage_and_can_be_dropped(spark, workspace, plan_text):
    staged = workspace.stage(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "t")
    assert "Exchange" not in plan_text(staged)
    with Workspace(spark) as other:
        path = other.path
        other.stage(spark.range(3), "t")
    with pytest.raises(PySparkException):
        spark.read.parquet(path + "/*")


def test_checked_claims_are_parsed_once_a_pass(spark, tmp_path):
    path = str(tmp_path / "claims.csv")
    spark.createDataFrame([(",".join(f.name for f in RAW.fields),), (",".join("1" for _ in RAW.fields),)], "value string").coalesce(1).write.text(path)
    for part in read_claims_checked(spark, path):
        assert part._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1


def _shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {p for folder in folders for p in Path(str(folder)).rglob("shuffle_*.data")}


def test_a_stored_table_leaves_no_shuffle_files(spark, workspace):
    before = _shuffle_files(spark)
    counts = spark.range(1000).groupBy((F.col("id") % 97).alias("k")).count()
    counts.collect()
    assert _shuffle_files(spark) - before
    before = _shuffle_files(spark)
    workspace.stage(counts, "t")
    until = time.time() + 10
    while _shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)  # they go a moment after the write
    assert not _shuffle_files(spark) - before


def test_a_stored_table_is_compressed_well(spark, workspace):
    workspace.stage(spark.range(10), "t")
    assert list(Path(workspace.path.removeprefix("file:")).rglob("*.zstd.parquet"))
