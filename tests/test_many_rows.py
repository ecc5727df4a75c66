"""What large tables need: sets of rows as bits, lanes that grow, work spread by rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotwise.operators import forests as R
from plotwise.operators import model as M


def grown(x, depth, rng):
    """A tree with some leaves above its lowest level."""
    nodes = np.zeros(2 << depth, R.NODE)
    nodes["feature"], nodes["value"] = -1, rng.normal(size=len(nodes))
    for i in range(1, 1 << depth):
        if (i == 1 or nodes["feature"][i // 2] >= 0) and (i < 4 or rng.random() < 0.9):
            f = rng.integers(len(x))
            nodes["feature"][i], nodes["cut"][i] = f, rng.integers(x[f].max() + 2)
    return nodes


@pytest.mark.parametrize("depth", [0, 1, 5, 8, 10])
def test_sets_give_the_places_of_a_walk(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, [[9], [1], [64], [250]], size=(4, 1003)).astype(np.uint8)
    nodes = grown(x, depth, rng)
    reached, sets = R._places(x, nodes, depth), R._Sets(x)
    place, closed = sets.places(nodes, depth, closed=True)
    assert (R._leaves(nodes)[place] == reached).all()
    higher = reached < 1 << depth
    assert (higher == (False if closed is None else np.unpackbits(closed, count=1003) > 0)).all()
    assert (place[~higher] == reached[~higher] - (1 << depth)).all()
    assert R._predicted(x, [{"tree": 0, "nodes": nodes.tobytes()}]) == pytest.approx(nodes["value"][reached])


def test_lanes_grow_with_the_part(spark, monkeypatch):
    """Histograms travel once per lane and tree, so a large part has wider lanes and copies them less often."""
    df = spark.range(2000).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 5 as double) y")
    many = R.pack_lanes(df, "y", ["a"], ["id"], lane_rows=10)
    assert many.number == many.rows.count() == R.LANES and many.slices == R.SHARES // R.LANES
    monkeypatch.setattr(R, "WIDE", 25)
    wide = R.pack_lanes(df, "y", ["a"], ["id"], lane_rows=10)
    assert wide.number == 80 and wide.slices == 2
    assert {r[0] for r in R.pack_lanes(df.limit(0), "y", ["a"], ["id"]).rows.collect()} == set()


def test_rows_are_scored_over_many_batches(spark):
    """Scoring gathers Arrow batches and gives each row its own value."""
    df = spark.range(300).selectExpr("id", "if(id % 50 = 3, null, cast(id % 7 as double)) a", "cast(id % 5 as double) b", "cast(id % 7 * 2 as double) y")
    forest = R.fit_forest(df, "y", ["a", "b"], ["id"], trees=5, depth=3)
    want = {r.id: r.prediction for r in forest.predict(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.id: r.prediction for r in forest.predict(df).collect()}
        assert forest.quantiles(df, [0.5], R.response_values(df, "y")).where("quantiles is null").count() == 6
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and sum(v is None for v in got.values()) == 6


def test_boosting_learns_from_bounded_tasks(spark, monkeypatch):
    """One input partition is dealt to as many tasks as its rows need."""
    seen = []
    monkeypatch.setattr(M.Dealt, "most", 20)
    monkeypatch.setattr(M.Pipeline, "_fit", lambda self, df: seen.append((df.rdd.getNumPartitions(), df.columns, df.count())))
    df = spark.range(900).coalesce(1).selectExpr("id", "cast(id % 7 as double) a", "cast(id % 7 * 2 as double) y")
    M.boosted(["a"], "y", rounds=2).fit(df)
    assert seen == [(45, ["a", "y"], 900)]


def test_supplied_folds_need_no_python(spark):
    df = spark.range(90).selectExpr("id", "cast(id % 3 as int) fold", "cast(id as double) y")
    cv = M.SuppliedFolds(foldCol="fold", numFolds=3)
    for i, (train, held) in enumerate(cv._kFold(df)):
        assert {r.fold for r in held.collect()} == {i} and train.count() == 60
        assert "Python" not in train._jdf.queryExecution().executedPlan().toString()
    for bad in (F.lit(3), F.lit(-1), F.lit(None).cast("int")):
        with pytest.raises(ValueError):
            cv._kFold(df.withColumn("fold", F.when(F.col("id") == 5, bad).otherwise(F.col("fold"))))


def test_shuffled_rows_read_their_input_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        calls.add(1)
        return float(v)

    df = spark.range(50).select("id", counted("id").alias("a"))
    out = M.with_shuffled(df, ["a"], ["id"]).collect()
    assert calls.value == 50 and sorted(r._other_a for r in out) == sorted(r.a for r in out)
