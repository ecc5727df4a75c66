"""Cleaning rules on edge rows: NULL, NaN, sentinels, unit slips, ties."""

import pytest
from pyspark.sql import functions as F

from plotwise.functions import numbers as N
from plotwise.operators import clean as C
from plotwise.operators import stats as S
from plotwise.plans.farm_size import clean_plots


def one(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_finite_and_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (float("nan"), 1.0), (float("inf"), 1.0), (None, 1.0)], "a double, b double")
    assert one(df, N.safe_ratio("a", "b")) == [0.5, None, None, None, None]
    assert one(df, N.finite("a")) == [1.0, 1.0, None, None, None]


def test_membership_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "g string")
    assert [r.g for r in C.exclude_values(df, "g", ["a"]).collect()] == ["b", None]


def test_area_rules(spark):
    rows = [
        (999.0, 1.0, 1.0),  # sentinel -> reported
        (5000.0, 0.4, 0.5),  # square metres typed as hectares
        (25.0, 3.0, 3.0),  # 8 times the report and above 20
        (25.0, 6.0, 25.0),  # large, but under five times the report
        (0.0, 2.0, 2.0),
        (150.0, 2.0, 2.0),  # implausible, dropped
        (None, None, None),
        (4.0, None, 4.0),
        (2000.0, 1.5, 0.2),
    ]
    df = spark.createDataFrame([(i, m, r, w) for i, (m, r, w) in enumerate(rows)], "id int, measured_plot_area_ha double, reported_area_ha double, want double")
    for r in clean_plots(df).collect():
        assert r["plot_area_ha"] == pytest.approx(r["want"]) if r["want"] is not None else r["plot_area_ha"] is None


def test_farm_with_unknown_plot_is_left_out(spark):
    rows = [(0.0, 0.0, "A", 2000, "f1", 3, 1.0), (0.0, 0.0, "A", 2000, "f1", 3, 2.0), (0.0, 0.0, "A", 2000, "f2", 3, 1.0), (1.0, 0.0, "A", 2000, "f2", 4, None)]
    df = spark.createDataFrame(rows, "x double, y double, country string, year int, farm_id string, hh_size int, plot_area_ha double")
    assert [(r.farm_id, r.farm_area_ha) for r in S.farm_area(df).collect()] == [("f1", 3.0)]


def test_clip_and_bins_keep_null(spark):
    df = spark.createDataFrame([(None,), (0.5,), (3.0,)], "v double")
    assert one(df, N.clip("v", 1.0, 2.0)) == [None, 1.0, 2.0]
    assert one(df, N.bins("v", [0.5, 1], ["a", "b", "c"])) == [None, "b", "c"]


def test_imputation_uses_exact_median_and_zero(spark, many_chunks):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (float("inf"), None), (10.0, None)], "a double, b double")
    out = C.impute_median(df, ["a", "b"])
    assert sorted(r.a for r in out.collect()) == [1.0, 2.0, 2.0, 10.0] and {r.b for r in out.collect()} == {0.0}


def test_contract_counts_missing_as_broken(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,)], "v double")
    out = dict(map(tuple, S.check_contract(df, ["v", "w"], {"pos": F.col("v") > 0}, min_rows=5).collect()))
    assert out == {"column v": 0, "column w": 1, "pos": 2, "min_rows": 1}


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_quantity > 45").select("l_orderkey", "l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
