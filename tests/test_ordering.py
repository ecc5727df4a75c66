"""Chunked order operators against plain windows, with ties, NULLs and one hot group."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plotwise.operators import ordering as O
from plotwise.operators import stats as S
from plotwise.operators import windows as W


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else ["a", "b", None][i % 9 // 3]
        value = None if i % 17 == 0 else float(rng.integers(0, 12))  # many ties
        rows.append((key, value, i, f"name{i % 7}"))
    return spark.createDataFrame(rows, "k string, v double, id int, s string").cache()


def same(a, b):
    cols = sorted(b.columns)
    left = sorted(map(str, a.select(cols).collect()))
    assert left == sorted(map(str, b.select(cols).collect()))


@pytest.mark.parametrize("order", [["v", "id"], ["s", "v", "id"], ["id"]])
def test_row_numbers(frame, many_chunks, order):
    w = Window.partitionBy("k").orderBy(*[F.asc_nulls_first(c) for c in order])
    same(O.row_numbers(frame, ["k"], order), frame.withColumn("rn", F.row_number().over(w).cast("long")))


def test_prefix_sums_whole_table(frame, many_chunks):
    got = O.prefix_sums(frame, [], ["v", "id"], ["id"])
    w = Window.orderBy(F.asc_nulls_first("v"), "id").rowsBetween(Window.unboundedPreceding, 0)
    same(got.select("id", "id_run"), frame.select("id", F.sum("id").over(w).alias("id_run")))
    assert {r[0] for r in got.select("id_all").collect()} == {sum(range(600))}


def test_carry(frame, many_chunks):
    w = Window.partitionBy("k").orderBy("id")
    same(O.carry(frame, ["k"], ["id"], {"v": "prev"}, previous=True), frame.withColumn("prev", F.lag("v").over(w)))
    filled = frame.withColumn("full", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same(O.carry(frame, ["k"], ["id"], {"v": "full"}, previous=False), filled)


def test_group_quantiles(frame, many_chunks):
    got = O.group_quantiles(frame, ["k"], "v", {"lo": 0.0, "m": 0.5, "p": 0.95})
    want = frame.where("v is not null").groupBy("k").agg(*[F.percentile("v", p).alias(n) for n, p in {"lo": 0.0, "m": 0.5, "p": 0.95}.items()])
    for a, b in zip(got.orderBy("k").collect(), want.orderBy("k").collect()):
        assert a["k"] == b["k"] and a["lo"] == b["lo"] and abs(a["m"] - b["m"]) < 1e-9 and abs(a["p"] - b["p"]) < 1e-9


def test_quantile_of_one_row_and_empty(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in O.group_quantiles(df, ["k"], "v", {"m": 0.9}).collect()] == [("a", 3.0)]


def test_rank_and_cumulate(frame, many_chunks):
    known = frame.where("v is not null")
    w = Window.partitionBy("k").orderBy(F.desc("v"))
    same(W.rank_desc(known, ["k"], "v"), known.withColumn("rank", F.rank().over(w).cast("long")))


def test_gini_matches_formula(spark, many_chunks):
    x = [0.5, 1.0, 1.0, 2.0, 7.0, 7.0]
    df = spark.createDataFrame([("a", v) for v in x], "k string, v double")
    i = np.arange(1, 7)
    want = 2 * (i * np.sort(x)).sum() / (6 * sum(x)) - 7 / 6
    assert abs(S.gini(df, ["k"], "v").first()["gini"] - want) < 1e-12


def test_collect_sizes_splits_large_cells(spark, many_chunks):
    df = spark.createDataFrame([(1, float(i % 5)) for i in range(23)], "c int, v double")
    parts = S.collect_sizes(df, ["c"], "v", part_size=10).orderBy("part").collect()
    assert [r["n"] for r in parts] == [10, 10, 3]
    assert sum((r["sizes"] for r in parts), []) == sorted(float(i % 5) for i in range(23))
