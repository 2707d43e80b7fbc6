"""Drift of a later batch against stored spreads."""

import math

import pytest

from claimsieve.operators.drift import MISSING, Spread, drift, fit_spreads, spreads_frame, spreads_from_frame, stability_index


def frame(spark, **columns):
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"`{c}` double" for c in columns)).repartition(3)


def test_equal_batches_have_no_drift(spark):
    df = frame(spark, a=[float(i % 37) for i in range(500)], b=[None if i % 4 else float(i) for i in range(500)])
    found = {r["column"]: r for r in drift(df, fit_spreads(df, ["a", "b"])).collect()}
    assert {c: (r["rows"], r["missing"], r["psi"], r["shifted"]) for c, r in found.items()} == {"a": (500, 0, 0.0, False), "b": (500, 375, 0.0, False)}


def test_index_by_hand(spark):
    old = frame(spark, a=[1.0] * 50 + [2.0] * 50)
    spreads = fit_spreads(old, ["a"], bins=4, rel_err=0)
    assert spreads == [Spread("a", (1.0, 2.0), {1: 50, 2: 50, MISSING: 0})]
    row = drift(frame(spark, a=[1.0] * 20 + [2.0] * 70 + [None] * 5 + [math.nan] * 5), spreads).head()
    expected = (0.2 - 0.5) * math.log(0.2 / 0.5) + (0.7 - 0.5) * math.log(0.7 / 0.5) + (0.1 - 1e-4) * math.log(0.1 / 1e-4)
    assert row["psi"] == pytest.approx(expected)
    assert (row["missing"], row["shifted"]) == (10, True)


def test_columns_without_values_and_empty_batches(spark):
    old = frame(spark, a=[None, math.nan, None], b=[math.inf, -math.inf, 1.0])
    spreads = fit_spreads(old, ["a", "b"])
    assert spreads[0] == Spread("a", (0.0,), {MISSING: 3})
    assert [r["psi"] for r in drift(old, spreads).collect()] == [0.0, 0.0]
    assert [(r["rows"], r["psi"], r["shifted"]) for r in drift(old.limit(0), spreads).collect()] == [(0, None, False)] * 2
    assert drift(frame(spark, a=[5.0] * 3, b=[1.0] * 3), spreads).where("shifted").count() == 2


def test_spreads_are_stored_by_run(spark, tmp_path):
    spreads = [Spread("a", (1.0, 2.5), {0: 3, 2: 4, MISSING: 1}), Spread("b", (0.0,), {MISSING: 2})]
    for run_id in ("one", "two"):
        spreads_frame(spark, spreads, run_id).write.mode("append").parquet(str(tmp_path / "spreads"))
    stored = spark.read.parquet(str(tmp_path / "spreads"))
    assert spreads_from_frame(stored, "two") == spreads
    with pytest.raises(ValueError):
        spreads_from_frame(stored, "three")
    with pytest.raises(ValueError):
        spreads_from_frame(stored.union(stored), "one")
    assert stability_index(spreads[0], spreads[0]) == 0
