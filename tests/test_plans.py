"""The end-to-end studies on small made-up tables."""

import numpy as np
from pyspark.sql import functions as F

from plotwise.operators import trajectory as T
from plotwise.plans import selection, trajectory


def test_trajectory_study(spark):
    rng = np.random.default_rng(0)
    obs, labels = [], []
    for k in range(40):
        level = float(rng.uniform(0.2, 0.8))
        labels.append((f"p{k}", 1000 * level + float(rng.normal(0, 5)), "2024-03-20", f"d{k % 6}"))
        for d in range(8):
            obs.append((f"p{k}", k * 100 + d, f"2024-0{1 + d // 3}-{1 + 3 * d:02d}", ["fused", "optical_only", "sar_only"][d % 3], level + 0.02 * d, level / 2))
    o = spark.createDataFrame(obs, "key string, id int, d string, fusion_type string, NDVI double, VH_mean double").withColumn("date", F.to_date("d")).drop("d")
    lab = spark.createDataFrame(labels, "key string, y double, e string, district string").withColumn("end_date", F.to_date("e")).drop("e")
    feats = trajectory.entity_features(o, lab, T.Series("key", "date", "id", "end_date"), 2024)
    out = trajectory.train_ensemble(feats, lab, "key", "y", group="district", k=2, trees=5, rounds=3)
    assert out["predictions"].count() == 40
    scores = {r.model: r.r2_sse for r in out["metrics"].collect()}
    assert set(scores) == {"gbt", "forest", "ridge", "ensemble"} and scores["ensemble"] > 0.5


def test_selection_study(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):
        x, z = rng.normal(size=2)
        rows.append((i, float(1 / (1 + np.exp(-(x + 0.1 * rng.normal())))), float(x), float(z), "ab"[i % 2], f"w{i % 5}"))
    df = spark.createDataFrame(rows, "id int, y double, x double, z double, f string, ward string")
    out = selection.select_and_compare(df, "y", ["x", "z"], ["f"], {"good": "x + f", "poor": "z", "bad": "nowhere"}, ["ward"], ["id"], k=3, trees=5)
    rank = [(r.predictor_set, r.n_folds_ok) for r in out["ranking"].collect()]
    assert rank == [("good", 3), ("poor", 3), ("bad", 0)]
    best = {r.model: r.rmse_mean for r in out["overall"].collect()}
    assert set(best) == {"linear_pooled", "bounded", "forest"} and best["bounded"] < 0.1


def test_selection_study_keeps_folds_as_a_table(spark, monkeypatch):
    """Folds are read some forty times: by column from a table, never as the rows of a checkpoint."""
    df = spark.createDataFrame([(i, 0.1 + i % 7 / 10, float(i % 7), "ab"[i % 2], f"w{i % 3}") for i in range(60)], "id int, y double, x double, f string, ward string")
    monkeypatch.setattr(type(df), "checkpoint", None)
    out = selection.select_and_compare(df, "y", ["x"], ["f"], {"good": "x + f"}, ["ward"], ["id"], k=2, trees=2)
    assert {r.model for r in out["overall"].collect()} == {"linear_pooled", "bounded", "forest"}
