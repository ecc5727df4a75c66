"""Observations to entity features to an ensemble of out-of-fold models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.functions import indices as I
from plotwise.functions import numbers as N
from plotwise.operators import clean as C
from plotwise.operators import folds as K
from plotwise.operators import joins as J
from plotwise.operators import model as M
from plotwise.operators import trajectory as T
from plotwise.session import durable

OPTICAL = ["NDVI", "EVI", "NDRE", "NDWI", "NDMI", "NBR", "CIre", "B04_mean", "B08_mean", "B8A_mean", "B11_mean", "B12_mean", "SAVI", "MSAVI2", "WDRVI", "GNDVI", "RENDVI", "LSWI2"]
RADAR = ["VV_mean", "VH_mean", "RVI", "DpRVI", "CROSS_RATIO_DB", "RFDI", "VH_backscatter_db"]
WINDOWS = {"early": ("01-01", "01-31"), "mid": ("02-01", "02-14"), "late": ("02-15", "03-31")}  # month and day


def windows_of(year: int, windows: dict | None = None) -> dict:
    """The windows as dates of one season; whole dates stay."""
    dated = lambda d: d if len(d) > 5 else f"{year}-{d}"
    return {n: (dated(a), dated(b)) for n, (a, b) in (WINDOWS if windows is None else windows).items()}


def prepare_observations(obs: DataFrame, labels: DataFrame, s: T.Series, year: int) -> DataFrame:
    """Observations of one season up to each entity's end date, with indices."""
    season = obs.where((F.col(s.date) >= F.lit(f"{year}-01-01").cast("date")) & (F.col(s.date) <= F.lit(f"{year}-12-31").cast("date")))
    return I.add_indices(J.guard_until(season, labels, s.key, s.date, s.end))


def entity_features(obs: DataFrame, labels: DataFrame, s: T.Series, year: int, sensor: str = "fusion_type", windows: dict | None = None) -> DataFrame:
    """One row of trajectory and cross-sensor features per entity."""
    ready = prepare_observations(obs, labels, s, year)
    plan = T.FeaturePlan(OPTICAL, RADAR, windows_of(year, windows))
    feats = T.build_trajectory_features(ready, s, plan, N.is_in(sensor, ["fused", "optical_only"]), N.is_in(sensor, ["fused", "sar_only"]))
    return I.add_cross_features(feats)


def feature_matrix(feats: DataFrame, key: str, y: str, keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Constant and sparse columns dropped, the rest imputed and clipped."""
    cols = [c for c in feats.columns if c not in (key, y, *keep)]
    clean = feats.withColumns({c: N.finite(F.col(c).cast("double")) for c in cols})
    clean = C.drop_constant(clean, cols)
    clean = C.drop_sparse(clean, [c for c in cols if c in clean.columns], 0.5)
    cols = [c for c in clean.columns if c in cols]
    full = C.impute_median(clean, cols)
    return full.withColumns({c: N.clip(c, -1e15, 1e15) for c in cols}), cols


def train_ensemble(feats: DataFrame, labels: DataFrame, key: str, y: str, group: str | None = None, k: int = 5, order: list[str] = (), trees: int = 500, rounds: int = 100) -> dict[str, DataFrame]:
    """Out-of-fold predictions of three learners and their weighted ensemble.

    Folds keep whole groups together when a group column is named. Of several
    labels of one entity the first by ``order`` counts, then the smallest.
    """
    kept = list(dict.fromkeys([*order, y, *([group] if group else [])]))
    one = labels.where(F.col(y).isNotNull()).groupBy(key).agg(F.min(F.struct(*kept)).alias("_l"))
    joined = feats.join(one, key).select(*feats.columns, F.col(f"_l.{y}").cast("double").alias(y), *([F.col(f"_l.{group}").alias(group)] if group else []))
    joined = durable(joined)
    matrix, cols = feature_matrix(joined, key, y, keep=[group] if group else [])
    folded = durable(K.group_folds(matrix, group, k) if group else K.random_folds(matrix, [key], k))
    learners = {
        "gbt": M.boosted(cols, y, rounds=rounds),
        "forest": M.forest(cols, y, trees=trees),
        "ridge": M.ridge(cols, y),
    }
    out = folded
    for name, est in learners.items():
        out = durable(M.oof_predict(out, est, "fold", k, out=name, kind="log1p", y=y))
    final = M.ensemble_r2(out, y, list(learners))
    preds = [*learners, "ensemble"]
    long = final.select(y, F.explode(F.array(*[F.struct(F.lit(p).alias("model"), F.col(p).alias("prediction")) for p in preds])).alias("e"))
    scores = M.metrics_of(long.select(y, "e.model", "e.prediction"), y, keys=["model"])
    return {"predictions": M.prediction_table(final, [key], y, preds), "metrics": scores}
