"""Trajectory features on hand-made series against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.operators import distribution as L
from plotwise.operators import folds as K
from plotwise.operators import model as M
from plotwise.operators import trajectory as T

S = T.Series("k", "date", "id", "end")


@pytest.fixture(scope="module")
def series(spark):
    rows = [("a", "2024-01-03", 1, 0.2), ("a", "2024-01-05", 2, 0.6), ("a", "2024-01-05", 3, 0.4), ("a", "2024-01-09", 4, None), ("a", "2024-01-11", 5, 0.6), ("b", "2024-01-04", 6, 0.7), ("c", "2024-01-04", 7, None)]
    df = spark.createDataFrame(rows, "k string, d string, id int, v double")
    return df.select("k", F.to_date("d").alias("date"), "id", "v", F.lit("2024-01-20").cast("date").alias("end"))


def test_stats_take_the_first_peak(series):
    r = {x.k: x for x in T.trajectory_stats(series, S, ["v"]).collect()}
    assert (r["a"].v_peak, r["a"].v_doy_peak, r["a"].v_last, r["a"].v_dtharv) == (0.6, 5.0, 0.6, 9.0)
    assert r["a"].v_std == pytest.approx(np.std([0.2, 0.6, 0.4, 0.6])) and r["c"].v_peak is None and r["c"].v_dtharv is None


def test_integral(series):
    r = {x.k: x.v_integral for x in T.trapezoid(series, S, ["v"]).collect()}
    assert r["a"] == pytest.approx(np.trapezoid([0.2, 0.6, 0.4, 0.6], [3, 5, 5, 11])) and r["b"] == 0.7 and r["c"] is None


def test_last_slope_and_windows(series):
    r = {x.k: x for x in T.window_stats(series, S, ["v"], {"w": ("2024-01-01", "2024-01-05")}).collect()}
    assert r["a"].v_w_slope == pytest.approx((0.4 - 0.6) / 1e-9) and r["b"].v_w_slope is None and r["a"].v_w_max == 0.6
    assert {x.k: x.v_slope for x in T.last_two_slopes(series, S, ["v"]).collect()}["a"] == pytest.approx(0.2 / 6, rel=1e-6)


def test_entropy_and_autocorrelation(spark, many_chunks):
    v = [0.1, 0.5, 0.2, 0.9, 0.9, 0.3, 0.7, 0.2, 0.1, 0.4, 0.6, 0.8]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)] + [("flat", 50 + i, 1.0) for i in range(4)] + [("two", 90 + i, 1.0) for i in range(2)], "k string, id int, v double")
    df = df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("id") % 40)).withColumn("end", F.lit("2024-12-31").cast("date"))
    counts = np.histogram(v, bins=10)[0]
    p = counts[counts > 0] / len(v)
    got = {r.k: r.e for r in T.series_entropy(df, S, "v", out="e").collect()}
    assert got["a"] == pytest.approx(-(p * np.log2(p + 1e-9)).sum()) and abs(got["flat"]) < 1e-6 and "two" not in got
    auto = {r.k: r.r for r in T.autocorr_lag1(df, S, "v", out="r").collect()}
    assert auto["a"] == pytest.approx(np.corrcoef(v[:-1], v[1:])[0, 1])


def test_expansion_and_draws(spark):
    df = spark.createDataFrame([(1, 7, [1.0, 2.0, 4.0, 8.0]), (2, 1, [1.0, 3.0]), (3, 10000, [0.5, 1.5, 9.0])], "c int, n int, q array<double>")
    out = L.expand_population(df, ["c"], "n", "q")
    assert [r[0] for r in out.where("c = 1").orderBy("unit").select("size_ha").collect()] == [1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0]
    assert {r.c: r["count"] for r in out.groupBy("c").count().collect()} == {1: 7, 2: 1, 3: 10000}
    kept = L.expand_population(df, ["c"], "n", "q", keep_max=True).where("c = 1")
    assert kept.count() == 7 and kept.where("size_ha = 8.0").count() == 2
    draws = L.sample_trunc_lognormal(df, ["c"], "n", "q", seed=1).where("c = 3").select("size_ha").toPandas()["size_ha"]
    assert draws.between(0.5, 9.0).all() and draws.nunique() > 9000
    same = L.sample_trunc_lognormal(df, ["c"], "n", "q", seed=1).where("c = 3").select("size_ha").toPandas()["size_ha"]
    assert sorted(same) == sorted(draws)


def test_ks_of_same_and_shifted(spark, many_chunks):
    a = spark.createDataFrame([("g", float(i)) for i in range(50)], "k string, v double")
    b = spark.createDataFrame([("g", float(i) + 25) for i in range(50)], "k string, v double")
    assert L.ks_two_sample(a, a, ["k"], "v").first()["ks_d"] == 0
    r = L.ks_two_sample(a, b, ["k"], "v").first()
    assert r["ks_d"] == 0.5 and r["ks_p"] < 1e-4


def test_folds(spark, many_chunks):
    df = spark.createDataFrame([(i, f"g{min(i // 3, 40)}", float(i % 50)) for i in range(200)], "id int, g string, y double")
    f = K.stratified_folds(df, "y", ["id"], 5)
    sizes = [r["count"] for r in f.groupBy("stratum", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 5 and sum(sizes) == 200
    g = K.group_folds(df, "g", 4)
    assert g.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    got = M.ridge(["a", "b", "c"], "y", 10.0).fit(df).transform(df).select("prediction").toPandas()["prediction"]
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    z = (x - q[1]) / (q[2] - q[0])
    zc, yc = z - z.mean(0), y - y.mean()
    want = y.mean() + zc @ np.linalg.solve(zc.T @ zc + 10 * np.eye(3), zc.T @ yc)
    # the library's quartiles are approximate (0.1 %), hence the tolerance
    assert np.abs(got - want).max() < 0.02


def test_loo_matches_refits(spark):
    rng = np.random.default_rng(2)
    x, e = rng.normal(size=(30, 2)), rng.normal(size=30)
    y = x @ [1.0, 0.3] + e
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    hat = []
    for i in range(30):
        m = np.ones(30, bool)
        m[i] = False
        beta = np.linalg.lstsq(np.c_[np.ones(29), x[m]], y[m], rcond=None)[0]
        hat.append(beta[0] + x[i] @ beta[1:])
    want = 1 - ((y - hat) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert M.loo_r2(df, ["a", "b"], "y").first()["loo_r2"] == pytest.approx(want)


def test_shuffle_is_a_permutation(spark, many_chunks):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "id int, v double")
    out = M.with_shuffled(df, ["v"], ["id"], seed=3).toPandas()
    assert sorted(out["_other_v"]) == sorted(out["v"]) and (out["v"] != out["_other_v"]).all()
