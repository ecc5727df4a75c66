"""Model fitting, out-of-fold prediction and importance on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Normalizer, RFormula, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions import numbers as N
from plotwise.operators import ordering as O
from plotwise.operators.stats import regression_metrics
from plotwise.session import stored


def assembler(cols: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip")


# estimators --------------------------------------------------------------------
def forest(cols: list[str], y: str, trees: int = 500, per_split: str = "sqrt", min_leaf: int = 3, depth: int = 10, seed: int = 0, sample: float = 1.0) -> Pipeline:
    """Random forest; (1500, "4", 10) gives the settings of the grid model."""
    return Pipeline(
        stages=[
            assembler(cols),
            RandomForestRegressor(labelCol=y, numTrees=trees, featureSubsetStrategy=per_split, minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed, subsamplingRate=sample),
        ]
    )


class Dealt(Pipeline):
    """A pipeline that learns from rows dealt to tasks in bounded numbers, whatever the files of the input."""

    most = 500_000  # rows of a task, which holds them in memory

    def _fit(self, df: DataFrame) -> PipelineModel:
        needed = [c for stage in self.getStages() for c in (stage.getInputCols() if isinstance(stage, VectorAssembler) else [stage.getLabelCol()])]
        rows = stored(df.select(*dict.fromkeys(needed)))
        tasks = max(-(-rows.count() // self.most), rows.sparkSession.sparkContext.defaultParallelism)
        return super()._fit(rows.repartition(tasks))


def boosted(cols: list[str], y: str, rounds: int = 100, step: float = 0.1, depth: int = 4, sample: float = 0.8, seed: int = 0) -> Pipeline:
    return Dealt(stages=[assembler(cols), GBTRegressor(labelCol=y, maxIter=rounds, stepSize=step, maxDepth=depth, subsamplingRate=sample, seed=seed)])


class Ridge(Estimator):
    """Ridge on robust-scaled features with a penalty of alpha on the sum of squares.

    The library divides its penalty by the label's sd, so it is given
    alpha * sd(y) / n, known only at fit time.
    """

    def __init__(self, cols: list[str], y: str, alpha: float = 10.0):
        super().__init__()
        self.cols, self.y, self.alpha = cols, y, alpha

    def _fit(self, df: DataFrame) -> Transformer:
        known = df.dropna("any", subset=[*self.cols, self.y])
        row = known.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(self.y).alias("sd")).first()
        penalty = self.alpha * (row["sd"] or 0.0) / max(row["n"], 1)
        return Pipeline(
            stages=[
                assembler(self.cols, "raw"),
                RobustScaler(inputCol="raw", outputCol="features", withCentering=True, withScaling=True),
                LinearRegression(labelCol=self.y, regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal"),
            ]
        ).fit(known)


def ridge(cols: list[str], y: str, alpha: float = 10.0) -> Ridge:
    return Ridge(cols, y, alpha)


def fourier_features(df: DataFrame, cols: list[str], count: int = 32, gamma: float = 0.1, seed: int = 0, prefix: str = "rff") -> DataFrame:
    """Random cosine features whose inner products approximate a radial kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (count, len(cols)))
    b = rng.uniform(0, 2 * np.pi, count)
    scale = float(np.sqrt(2 / count))
    new = {}
    for i in range(count):
        phase = reduce(lambda s, p: s + p, [F.col(c) * float(v) for c, v in zip(cols, w[i])], F.lit(float(b[i])))
        new[f"{prefix}{i}"] = F.cos(phase) * scale
    return df.withColumns(new)


class Radial(Estimator):
    """Radial-kernel regression: standardise, random cosine features, ridge."""

    def __init__(self, cols: list[str], y: str, count: int = 32, gamma: float = 0.1, penalty: float = 1e-3, seed: int = 0):
        super().__init__()
        self.cols, self.y, self.count, self.gamma, self.penalty, self.seed = cols, y, count, gamma, penalty, seed

    def _fit(self, df: DataFrame) -> Transformer:
        known = stored(df.select(*dict.fromkeys([*self.cols, self.y])).dropna("any"))  # read twice
        row = known.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(self.cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(self.cols)]).first()
        centre = {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(self.cols)}
        lift = RadialLift(centre, self.count, self.gamma, self.seed)
        names = [f"rff{i}" for i in range(self.count)]
        stages = [lift, assembler(names, "features"), LinearRegression(labelCol=self.y, regParam=self.penalty, standardization=False)]
        return Pipeline(stages=stages).fit(known)


class RadialLift(Transformer):
    def __init__(self, centre: dict[str, tuple[float, float]], count: int, gamma: float, seed: int):
        super().__init__()
        self.centre, self.count, self.gamma, self.seed = centre, count, gamma, seed

    def _transform(self, df: DataFrame) -> DataFrame:
        scaled = {f"_z{i}": (F.col(c) - m) / s for i, (c, (m, s)) in enumerate(self.centre.items())}
        return fourier_features(df.withColumns(scaled), list(scaled), self.count, self.gamma, self.seed).drop(*scaled)


def radial(cols: list[str], y: str, **kw) -> Radial:
    return Radial(cols, y, **kw)


class Bounded(Estimator):
    """Regression for a response in (0, 1): logit mean, binomial variance."""

    def __init__(self, cols: list[str], y: str, penalty: float = 0.0):
        super().__init__()
        self.cols, self.y, self.penalty = cols, y, penalty

    def _fit(self, df: DataFrame) -> Transformer:
        known = df.dropna("any", subset=[*self.cols, self.y])
        glm = GeneralizedLinearRegression(labelCol=self.y, family="binomial", link="logit", regParam=self.penalty, maxIter=50)
        return Pipeline(stages=[assembler(self.cols), glm, Clip("prediction", 0.001, 0.999)]).fit(known)


class Clip(Transformer):
    def __init__(self, col: str, lo: float, hi: float):
        super().__init__()
        self.col, self.lo, self.hi = col, lo, hi

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.col, N.clip(self.col, self.lo, self.hi))


def bounded(cols: list[str], y: str, penalty: float = 0.0) -> Bounded:
    return Bounded(cols, y, penalty)


def scaling(cols: list[str], normalise: bool = False, out: str = "features") -> Pipeline:
    """Centre and scale, then optionally unit length per row."""
    stages = [assembler(cols, "_raw"), StandardScaler(inputCol="_raw", outputCol="_scaled" if normalise else out, withMean=True, withStd=True)]
    if normalise:
        stages.append(Normalizer(inputCol="_scaled", outputCol=out))
    return Pipeline(stages=stages)


# cross-validation -----------------------------------------------------------------
class SuppliedFolds(CrossValidator):
    """Folds by a comparison instead of a Python call per row; a row outside 0 to k - 1 is an error, as in the library."""

    def _kFold(self, dataset: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        fold, k = F.col(self.getFoldCol()), self.getNumFolds()
        if dataset.where(fold.isNull() | (fold < 0) | (fold >= k)).limit(1).count():
            raise ValueError(f"Fold number must be in range [0, {k}).")
        folds = [(dataset.where(fold != i), dataset.where(fold == i)) for i in range(k)]
        for part in ("training", "validation"):
            if any(pair[part == "validation"].isEmpty() for pair in folds):
                raise ValueError(f"The {part} data at some fold is empty.")
        return folds


def grid_search(df: DataFrame, est: Pipeline, grid: list[dict], y: str, fold: str, k: int, parallelism: int = 4) -> CrossValidatorModel:
    """All settings over supplied folds; keeps the best by R2.

    ``avgMetrics`` of the result averages each setting over folds; their mean
    is the grid-mean R2, their maximum the best model's.
    """
    cv = SuppliedFolds(
        estimator=est, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=y, metricName="r2"),
        foldCol=fold, numFolds=k, parallelism=parallelism,
    )
    return cv.fit(stored(df))


def grid_table(model: CrossValidatorModel, df: DataFrame) -> DataFrame:
    rows = [
        ("; ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(a))
        for m, a in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return df.sparkSession.createDataFrame(rows, "setting string, r2 double")


def oof_predict(df: DataFrame, est: Estimator, fold: str, k: int, out: str = "prediction", kind: str | None = None, y: str | None = None) -> DataFrame:
    """Each row predicted by the model of the other folds.

    ``kind`` names a response transform; ``y`` is then fitted on that scale and
    predictions come back on the original one.  Fits run over the whole data,
    one per fold; rows are scored in place, so no join is needed.
    """
    work = stored(df)
    parts = []
    for i in range(k):
        train = work.where(F.col(fold) != i)
        if kind:
            train = train.withColumn(y, N.transform_response(y, kind))
        scored = est.fit(train).transform(work.where(F.col(fold) == i))
        value = N.invert_response("prediction", kind) if kind else F.col("prediction")
        parts.append(scored.select(*df.columns, value.alias(out)))
    return reduce(DataFrame.unionByName, parts)


def oof_table(df: DataFrame, est: Estimator, y: str, fold: str, k: int, keep: list[str]) -> DataFrame:
    """Out-of-fold and in-sample predictions with residuals in units and percent."""
    oof = oof_predict(df, est, fold, k, out="oof_prediction")
    fitted = est.fit(df).transform(oof).withColumnRenamed("prediction", "fitted")
    residual = F.col(y) - F.col("oof_prediction")
    return fitted.select(*keep, y, "oof_prediction", "fitted", residual.alias("residual"), (100 * N.safe_ratio(residual, y)).alias("residual_pct"))


def prediction_table(df: DataFrame, keep: list[str], y: str, preds: list[str]) -> DataFrame:
    """Observed value, predictions and one residual column per model."""
    return df.select(*keep, y, *preds, *[(F.col(p) - F.col(y)).alias(f"resid_{p}") for p in preds])


def ensemble_weights(df: DataFrame, y: str, preds: list[str]) -> DataFrame:
    """One row of weights: R2 cut at zero and scaled; all to the best when none is positive."""
    row = df.agg(
        *[
            (1 - N.safe_ratio(F.sum((F.col(y) - F.col(p)) * (F.col(y) - F.col(p))), F.var_pop(y) * F.count(y))).alias(p)
            for p in preds
        ]
    )
    positive = {p: F.greatest(F.col(p), F.lit(0.0)) for p in preds}
    total = reduce(lambda a, b: a + b, positive.values())
    best = F.greatest(*preds) if len(preds) > 1 else F.col(preds[0])
    earlier = lambda i: reduce(lambda a, b: a | b, [F.col(q) == best for q in preds[:i]], F.lit(False))
    single = {p: ((F.col(p) == best) & ~earlier(i)).cast("double") for i, p in enumerate(preds)}
    return row.select(*[F.when(total > 0, positive[p] / total).otherwise(single[p]).alias(p) for p in preds])


def ensemble_r2(df: DataFrame, y: str, preds: list[str], out: str = "ensemble") -> DataFrame:
    weights = ensemble_weights(df, y, preds).select(F.struct(*preds)).scalar()
    mix = reduce(lambda a, b: a + b, [F.col(f"_w.{p}") * F.col(p) for p in preds])
    return df.withColumn("_w", weights).withColumn(out, mix).drop("_w")


# importance ---------------------------------------------------------------------------
def feature_importance(model: PipelineModel, cols: list[str], df: DataFrame) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(cols, values)), "variable string, importance double").orderBy(F.desc("importance"), "variable")


def with_shuffled(df: DataFrame, cols: list[str], ids: list[str], seed: int = 0, prefix: str = "_other_") -> DataFrame:
    """Each row beside the values of another row, in seeded hash order.

    Every row takes its predecessor's values and the first row the last one's:
    one permutation of the rows, found without gathering them.
    """
    keyed = stored(df.withColumn("_u", N.uniform_hash(*ids, seed=seed)))  # read for the cut points, the pieces and the wrap
    packed = keyed.withColumn("_pack", F.struct(*cols))
    order = ["_u", *ids]
    wrap = packed.agg(F.max_by("_pack", F.struct(*order))).scalar()
    moved = O.carry(packed, [], order, {"_pack": "_prev"}, previous=True)
    other = F.coalesce(F.col("_prev"), wrap)
    return moved.withColumn("_prev", other).select(*df.columns, *[F.col(f"_prev.{c}").alias(f"{prefix}{c}") for c in cols])


def permutation_importance(model: Transformer, df: DataFrame, cols: list[str], y: str, ids: list[str], seed: int = 0) -> DataFrame:
    """Rise of the RMSE when one column is shuffled, for all columns in one pass.

    Each row appears once per column with that column swapped, is scored in
    bulk and folds into one aggregate.
    """
    both = with_shuffled(df.select(*cols, y, *[i for i in ids if i not in (*cols, y)]), cols, ids, seed)
    plans = F.array(F.lit(""), *[F.lit(c) for c in cols])
    swapped = both.withColumn("variable", F.explode(plans)).select(
        "variable", y, *[F.when(F.col("variable") == c, F.col(f"_other_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    )
    errors = model.transform(swapped).groupBy("variable").agg(F.sqrt(F.avg((F.col("prediction") - F.col(y)) ** 2)).alias("rmse"))
    base = errors.where("variable = ''").agg(F.max("rmse")).scalar()
    return errors.where("variable <> ''").select("variable", "rmse", (F.col("rmse") - base).alias("importance"))


def mean_abs_contribution(model: Transformer, df: DataFrame, cols: list[str], ids: list[str], draws: int = 4, seed: int = 0) -> DataFrame:
    """Mean absolute contribution per feature from sampled coalitions.

    For each row, feature and draw, a hashed coin decides which other features
    keep their own value; the rest take those of another row.  The contribution
    is the change in prediction when the feature joins, averaged over draws.
    """
    both = with_shuffled(df.select(*ids, *[c for c in cols if c not in ids]), cols, ids, seed)
    keys = [f"_id_{i}" for i in ids]
    # rows travel once, before they multiply: what one key gives meets where it is made
    dealt = both.select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], *cols, *[f"_other_{c}" for c in cols]).repartition(*keys)
    tries = dealt.withColumn("variable", F.explode(F.array(*[F.lit(c) for c in cols]))).withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_on", F.explode(F.array(F.lit(1), F.lit(0))))
    own = lambda c: F.when(F.col("variable") == c, F.col("_on") == 1).otherwise(N.uniform_hash(*keys, "_draw", "variable", F.lit(c), seed=seed) < 0.5)
    mixed = tries.select(*keys, "variable", "_on", *[F.when(own(c), F.col(c)).otherwise(F.col(f"_other_{c}")).alias(c) for c in cols])
    sign = F.when(F.col("_on") == 1, F.col("prediction")).otherwise(-F.col("prediction"))
    per_row = model.transform(mixed).groupBy(*keys, "variable").agg((F.sum(sign) / draws).alias("_c"))
    return per_row.groupBy("variable").agg(F.avg(F.abs("_c")).alias("mean_abs"))


# quantile forest -------------------------------------------------------------------------
def leaf_values(model: PipelineModel, train: DataFrame, y: str, ids: list[str], seed: int = 0) -> DataFrame:
    """One training value per (tree, leaf), picked by hash: (tree, leaf, value).

    Keeping one member per leaf is the usual form of the quantile forest; it
    also bounds the table by trees x leaves whatever the training size.
    """
    leafed = _with_leaves(model, train)
    pick = N.uniform_hash(*ids, "tree", seed=seed)
    rows = leafed.select(y, *[i for i in ids if i != y], F.posexplode("_leaves").alias("tree", "leaf"))
    return rows.groupBy("tree", F.col("leaf").cast("int").alias("leaf")).agg(F.min_by(y, F.struct(pick, *ids)).cast("double").alias("value"))


def _with_leaves(model: PipelineModel, df: DataFrame) -> DataFrame:
    trees = model.stages[-1]
    trees.setLeafCol("_leaf_vector")
    out = model.transform(df).withColumn("_leaves", vector_to_array("_leaf_vector")).drop("_leaf_vector")
    trees.setLeafCol("")
    return out


def quantile_forest(model: PipelineModel, train: DataFrame, score: DataFrame, y: str, ids: list[str], probs: list[float], out: str = "quantiles", seed: int = 0) -> DataFrame:
    """Conditional quantiles per row as an array, in the order of ``probs``.

    Each row takes the value kept in its leaf of every tree; quantiles of these
    values are linear between them. Leaves that kept no value are left out. The
    table of kept values is smaller than the model, which every executor holds
    anyway, and is shipped like it.
    """
    table = leaf_values(model, train, y, ids, seed)
    trees = model.stages[-1]
    scored = _with_leaves(model, score)
    rows = table.collect()
    lookup = np.full((trees.getNumTrees, max(r["leaf"] for r in rows) + 1), np.nan)
    for r in rows:
        lookup[r["tree"], r["leaf"]] = r["value"]
    shared = score.sparkSession.sparkContext.broadcast(lookup)

    @F.pandas_udf("array<double>")
    def quantiles(leaves: pd.Series) -> pd.Series:
        if leaves.empty:
            return pd.Series([], dtype=object)
        at = np.vstack(leaves.to_numpy()).astype(int)
        values = np.sort(shared.value[np.arange(at.shape[1])[None, :], at], axis=1)  # NaN last
        spot = np.maximum(np.isfinite(values).sum(axis=1, keepdims=True) - 1, 0) * np.array(probs)
        low = np.take_along_axis(values, np.floor(spot).astype(int), axis=1)
        high = np.take_along_axis(values, np.ceil(spot).astype(int), axis=1)
        return pd.Series(list(low + (high - low) * (spot - np.floor(spot))))

    return scored.select(*score.columns, quantiles("_leaves").alias(out))


def score_grid(model: PipelineModel, cells: DataFrame, bands: list[str], out: str = "prediction") -> DataFrame:
    """Predictions on cells; NULL where any band is missing.

    Missing bands are filled only to keep the row, so cells are scored in place
    with no join back.
    """
    valid = reduce(lambda a, b: a & b, [N.finite(F.col(c).cast("double")).isNotNull() for c in bands])
    kept = [c for c in cells.columns if c not in bands]
    own = F.struct(*bands)
    filled = cells.withColumns({"_valid": valid, "_own": own}).withColumns({c: F.coalesce(N.finite(F.col(c).cast("double")), F.lit(0.0)) for c in bands})
    scored = model.transform(filled)
    return scored.select(*kept, *[F.col(f"_own.{c}").alias(c) for c in bands], F.when(F.col("_valid"), F.col("prediction")).alias(out))


# selection and linear models ------------------------------------------------------------------
def _by_formula(formula: str, make: Callable[[], Estimator] | None) -> Pipeline:
    learner = make() if make else LinearRegression(labelCol="_label")
    return Pipeline(stages=[RFormula(formula=formula, featuresCol="features", labelCol="_label", handleInvalid="keep"), learner])


def formula_fit(df: DataFrame, formula: str, make: Callable[[], Estimator] | None = None) -> PipelineModel:
    """A linear or other model given by a formula."""
    return _by_formula(formula, make).fit(df)


def formula_oof(df: DataFrame, formula: str, y: str, fold: str, k: int, make: Callable[[], Estimator] | None = None) -> DataFrame:
    """Out-of-fold predictions of a linear or other model given by a formula."""
    return oof_predict(df, _by_formula(formula, make), fold, k)


def shrunken_effects(df: DataFrame, path: list[str], value: str, strength: float) -> list[DataFrame]:
    """The effect tables of the levels: what each group adds to the group above it."""
    tables, work = [], df.withColumn("_rest", F.col(value).cast("double"))
    for depth in range(1, len(path) + 1):
        keys = path[:depth]
        means = work.groupBy(*keys).agg(F.avg("_rest").alias("_m"), F.count("_rest").alias("_n"))
        table = means.select(*keys, F.coalesce(F.col("_m") * F.col("_n") / (F.col("_n") + F.lit(float(strength))), F.lit(0.0)).alias("_e"))
        tables.append(table)
        work = O.join_null_safe(work, table, keys).withColumn("_rest", F.col("_rest") - F.col("_e")).drop("_e")
    return tables


def add_effects(df: DataFrame, path: list[str], tables: list[DataFrame], out: str = "group_effect") -> DataFrame:
    """Sum of the known levels' effects; a group that training lacks adds nothing of its own."""
    work = df.withColumn(out, F.lit(0.0))
    for depth, table in enumerate(tables, 1):
        work = O.join_null_safe(work, table, path[:depth], "left").withColumn(out, F.col(out) + F.coalesce("_e", F.lit(0.0))).drop("_e")
    return work


def shrunken_group_means(df: DataFrame, path: list[str], value: str, strength: float, out: str = "group_effect") -> DataFrame:
    """Nested group effects by partial pooling, level by level.

    At each level the mean of what is still unexplained is shrunk by
    n / (n + strength); the sum over levels is the row's effect.  Group tables
    are pre-aggregated and joined back.
    """
    work = df.withColumns({"_rest": F.col(value).cast("double"), out: F.lit(0.0)})
    for depth in range(1, len(path) + 1):
        keys = path[:depth]
        means = work.groupBy(*keys).agg(F.avg("_rest").alias("_m"), F.count("_rest").alias("_n"))
        effect = F.coalesce(F.col("_m") * F.col("_n") / (F.col("_n") + F.lit(float(strength))), F.lit(0.0))
        work = O.join_null_safe(work, means.select(*keys, effect.alias("_e")), keys)
        work = work.withColumns({"_rest": F.col("_rest") - F.col("_e"), out: F.col(out) + F.col("_e")}).drop("_e")
    return work.drop("_rest")


def loo_r2(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """Leave-one-out R2 of a linear model, without refitting.

    One pass gathers the k x k cross products; each left-out error is then
    e / (1 - h) with the row's leverage h.
    """
    known = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(y).cast("double").alias(y)).dropna()
    mid = known.agg(*[F.avg(c).alias(c) for c in [*cols, y]]).first()
    centred = known.select(*[(F.col(c) - mid[c]).alias(c) for c in [*cols, y]])
    k = len(cols)
    sums = centred.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)],
        *[F.sum(F.col(cols[i]) * F.col(y)).alias(f"b{i}") for i in range(k)],
    ).first()
    xtx = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ np.array([sums[f"b{i}"] for i in range(k)])
    fitted = reduce(lambda a, b: a + b, [F.col(c) * float(b) for c, b in zip(cols, beta)])
    leverage = F.lit(1.0 / sums["n"])
    for i in range(k):
        for j in range(k):
            leverage = leverage + F.col(cols[i]) * F.col(cols[j]) * float(inverse[i, j])
    left_out = N.safe_ratio(F.col(y) - fitted, 1 - leverage)
    return centred.agg(
        F.count(F.lit(1)).alias("n"), (1 - N.safe_ratio(F.sum(left_out * left_out), F.sum(F.col(y) * F.col(y)))).alias("loo_r2")
    )


def compare_fits(df: DataFrame, models: dict[str, str], y: str) -> DataFrame:
    """AIC, RMSE and number of parameters of Gaussian models given by formulae."""
    rows = []
    for name, formula in models.items():
        pipe = Pipeline(stages=[RFormula(formula=formula, labelCol="_label"), GeneralizedLinearRegression(labelCol="_label", family="gaussian")])
        fit = pipe.fit(df)
        glm = fit.stages[-1]
        err = F.col("prediction") - F.col("_label")
        rmse = fit.transform(df).agg(F.sqrt(F.avg(err * err))).first()[0]
        rows.append((name, float(glm.summary.aic), float(rmse), int(glm.coefficients.size + 1)))
    return df.sparkSession.createDataFrame(rows, "model string, aic double, rmse double, n_params int").orderBy("aic")


def spatial_baseline(points: DataFrame, value: str, k: int = 8, key: str = "point_id", power: float = 2.0, out: str = "prediction") -> DataFrame:
    """Each point predicted from its k nearest neighbours, weighted by distance."""
    from plotwise.operators.geo import knn

    known = points.where(F.col(value).isNotNull())
    near = knn(known, k, key).join(known.select(F.col(key).alias("neighbour"), F.col(value).alias("_v")), "neighbour")
    w = 1 / (F.pow("dist", F.lit(power)) + N.EPS)
    pred = near.groupBy(key).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(out))
    return points.join(pred, key, "left")


def metrics_of(df: DataFrame, y: str, pred: str = "prediction", keys: list[str] | None = None) -> DataFrame:
    return regression_metrics(df, keys or [], y, pred)
