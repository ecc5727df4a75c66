"""Results that must not depend on sizes or on how tables are laid out."""

import pytest
from pyspark.sql import functions as F

from plotwise.functions import numbers as N
from plotwise.operators import experiments as X
from plotwise.operators import folds as K
from plotwise.operators import model as M
from plotwise.plans import trajectory as P
from plotwise.sources import tables as A


def test_equal_rows_are_scored_each(spark):
    train = spark.range(200).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 * 2.0).alias("y"))
    model = M.forest(["x"], "y", trees=8, depth=4).fit(train)
    score = train.select("x").unionByName(train.select("x"))
    found = M.quantile_forest(model, train, score, "y", ["id"], [0.1, 0.5, 0.9])
    assert found.count() == 400
    assert found.where("quantiles[0] > quantiles[1] or quantiles[1] > quantiles[2]").count() == 0


@pytest.mark.parametrize("groups", [3, 40, 1500])
def test_group_folds_balance(spark, groups):
    df = spark.range(groups * 10).select((F.col("id") % groups).alias("g")).unionByName(spark.range(50).select(F.lit(None).cast("long").alias("g")))
    found = K.group_folds(df, "g", 5)
    assert found.count() == groups * 10 + 50
    assert found.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n <> 1").count() == 0
    sizes = [r["count"] for r in found.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 50


def test_gathered_partitions_keep_their_column(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "g string, v int")
    A.write_partitioned(rows, f"{tmp_path}/whole", ["g"])
    assert sorted(map(tuple, A.gather_results(spark, f"{tmp_path}/whole").select("g", "v").collect())) == [("a", 1), ("a", 3), ("b", 2)]
    for part in ("a", "b"):
        A.write_partitioned(rows.where(F.col("g") == part), f"{tmp_path}/units/u_{part}", ["g"])
    assert A.gather_results(spark, f"{tmp_path}/units", units=["u_a", "u_b"]).groupBy("g").sum("v").count() == 2
    fallback = A.read_table(spark, f"{tmp_path}/none.parquet", fallback=f"{tmp_path}/whole")
    assert fallback.count() == 3


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r[0] for r in df.select(N.finite("v")).collect()] == [1.0, None, None, None, None]


def test_windows_follow_the_season():
    assert P.windows_of(2019)["mid"] == ("2019-02-01", "2019-02-14")
    assert P.windows_of(2019, {"w": ("2018-12-01", "01-05")}) == {"w": ("2018-12-01", "2019-01-05")}


def test_unknown_village_keeps_its_ward(spark):
    path = ["ward", "village"]
    train = spark.createDataFrame([("w", "v", 4.0), ("w", "v", 4.0), ("u", "x", -4.0), ("u", "x", -4.0)], "ward string, village string, res double")
    tables = M.shrunken_effects(train, path, "res", 2.0)
    test = spark.createDataFrame([("w", "v"), ("w", "new"), ("new", "new")], "ward string, village string")
    found = {(r.ward, r.village): r.group_effect for r in M.add_effects(test, path, tables).collect()}
    assert found["w", "v"] == pytest.approx(3.0) and found["w", "new"] == pytest.approx(2.0) and found["new", "new"] == 0.0


def test_predictor_search_counts_folds(spark):
    df = spark.range(60).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 * 3.0).alias("y"), (F.col("id") % 3).cast("int").alias("fold"))
    found = {r.predictor_set: r for r in X.select_predictors(df, {"x": "x", "none": "missing_column"}, "y", "fold", 3).collect()}
    assert found["x"].n_folds_ok == 3 and found["x"].rmse_mean < 1e-6
    assert found["none"].n_folds_ok == 0 and found["none"].rmse_mean is None


def test_logo_has_no_limit(spark):
    df = spark.range(240).select("id", (F.col("id") % 2).alias("unit"), (F.col("id") % 4).alias("region"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 5 * 2.0).alias("y"))
    found = X.evaluate_logo(df, "unit", "region", "y", ["x"], lambda cols, y: M.ridge(cols, y), ["id"], k=2)
    assert found.count() == 4
