"""What a query moves and writes must grow no faster than its tables."""

import pytest

from claimsieve.catalog import queries as catalog
from claimsieve.catalog.claims_view import Stages, claims_view
from claimsieve.session import FOLD_BYTES, wide_shuffle
from claimsieve.staging import Workspace

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def recorded(spark):
    """Stages whose staged tables are noted by name with their plans."""
    found = Stages(spark, SF_DIR)
    found.plans, stage = {}, found.workspace.stage

    def noting(df, name, *rest):
        found.plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name, *rest)

    found.workspace.stage = noting
    yield found
    found.workspace.drop()


def _scan_bytes(spark):
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def test_claims_are_joined_the_same_way_at_any_size(spark, plan_text):
    text = plan_text(claims_view(spark, SF_DIR))
    assert text.count("SortMergeJoin") == 2


def test_wide_claims_are_not_dealt_again(recorded):
    recorded.claims()
    assert "RoundRobinPartitioning" not in recorded.plans["claims"]


def test_a_label_costs_no_table(recorded):
    recorded.labelled()
    assert set(recorded.plans) <= {"claims", "population"}


def test_a_fold_reads_no_more_than_its_task_can_hold(spark, monkeypatch):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    try:
        with wide_shuffle(claims_view(spark, SF_DIR)):
            assert _scan_bytes(spark) == FOLD_BYTES
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "128m"
        Stages(spark, SF_DIR)
        assert _scan_bytes(spark) == FOLD_BYTES
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        Stages(spark, SF_DIR)
        assert _scan_bytes(spark) == 1 << 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("multi_line", [False, True])
def test_broken_records_are_written_as_they_lie(spark, recorded, monkeypatch, tmp_path, multi_line):
    monkeypatch.setattr(recorded, "scratch", lambda: Workspace(spark, str(tmp_path)))
    catalog._broken_records(recorded, multi_line)
    files = [p.read_text().split("\n") for p in tmp_path.rglob("part-*.txt")]
    header = ",".join(f.name for f in catalog.RECORD_FIELDS)
    assert files and all(lines[0] == header and lines.count(header) == 1 for lines in files)


def test_scores_are_checked_row_by_row(recorded, plan_text):
    text = plan_text(catalog.queries()["m9_score"](recorded.spark, SF_DIR))
    assert "Generate" not in text


def test_ranks_of_scores_are_not_counted_by_one_task(recorded, plan_text):
    text = plan_text(catalog.queries()["j5_train"](recorded.spark, SF_DIR))
    assert text.count("windowspecdefinition(part") == 2


def test_groups_are_moved_once(recorded, plan_text):
    assert "Expand" not in plan_text(catalog.queries()["m6_group_split"](recorded.spark, SF_DIR))


def test_many_suppliers_do_not_move_the_wide_claims_once_more(spark, plan_text):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert plan_text(claims_view(spark, SF_DIR)).count("SortMergeJoin") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
