"""Models and experiments on line items; the response follows quantity and retail price, with the extended price as noise."""

from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from plotwise.catalog.base import POINTS, plots, points, query, rounded
from plotwise.catalog.grids import KNN_SQL, ZONES, grid, zoned
from plotwise.operators import experiments as X
from plotwise.operators import folds as K
from plotwise.operators import forests as R
from plotwise.operators import model as M
from plotwise.session import stored

COLS = ["qty", "disc", "tax", "size", "retail"]
IDS = ["ok", "ln", "pk", "sk"]
# small learners keep the check quick; production settings are parameters
SMALL = {"trees": 8, "depth": 4, "min_leaf": 10}


def forest(cols, y):
    return M.forest(cols, y, seed=1, **SMALL)


def rows(t):
    p = t.part.select(F.col("p_partkey").alias("pk"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"))
    li = t.lineitem.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"),
    )
    return li.join(p, "pk").withColumn("y", F.col("qty") * F.col("retail") / 1200 + F.col("price") / 6000).drop("price")


def folded(t, k=2):
    return K.random_folds(rows(t), IDS, k)


def better_than_mean(fitted, y="y", pred="prediction"):
    """n, and whether predictions are closer than the mean of the response and follow it."""
    spread = F.stddev_pop(y)
    return fitted.agg(
        F.count(pred).alias("n"), (F.sqrt(F.avg((F.col(pred) - F.col(y)) ** 2)) < spread).alias("beats_mean"),
        (F.corr(pred, y) > 0.5).alias("follows"), (F.abs(F.avg(pred) - F.avg(y)) < 0.1 * spread).alias("unbiased"),
    )


LINE = """d AS (SELECT l_orderkey % 3 AS fold, l_returnflag AS flag, l_linestatus AS status, l_quantity AS x, l_quantity * p_retailprice / 1200 + l_extendedprice / 6000 AS y FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FITTED = "SELECT count(*) AS n, true AS beats_mean, true AS follows, true AS unbiased FROM lineitem"


@query("K1_fit_forest", f"SELECT f.*, count(*) AS n_oob, true AS oob_below_fit FROM ({FITTED}) f, lineitem GROUP BY ALL")
def _(t):
    df = rows(t)
    model = R.fit_forest(df, "y", COLS, IDS, trees=500, min_leaf=3, seed=1)
    fitted = stored(model.predict(df).select("y", "prediction"))
    inside = fitted.agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).scalar()
    oob = model.out_of_bag()
    return better_than_mean(fitted).select("*", oob.select("n").scalar().alias("n_oob"), (oob.select("rmse").scalar() >= inside).alias("oob_below_fit"))


@query("K2_fit_extra_forest", f"SELECT f.*, count(*) AS n_oob, true AS oob_positive FROM ({FITTED}) f, lineitem GROUP BY ALL")
def _(t):
    df = rows(t)
    model = R.fit_forest(df, "y", COLS, IDS, trees=300, min_leaf=10, min_split=5, tried=4, rule="random", seed=2)
    oob = model.out_of_bag()
    return better_than_mean(model.predict(df)).select("*", oob.select("n").scalar().alias("n_oob"), (oob.select("r2_corr").scalar() > 0.5).alias("oob_positive"))


@query("K3_fit_gbt", FITTED)
def _(t):
    df = rows(t)
    return better_than_mean(M.boosted(COLS, "y", rounds=20, depth=3, seed=3).fit(df).transform(df))


@query(
    "K4_fit_ridge",
    f"""WITH {LINE}, m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM d), b AS (SELECT *, c / (v + 500 * iqr * iqr / n) AS b FROM m)
SELECT any_value(n) AS n, round(sqrt(avg((my + b * (x - mx) - y) ** 2)), 4) AS rmse, round(pow(corr(my + b * (x - mx), y), 2), 4) AS r2_corr FROM d, b""",
)
def _(t):
    df = rows(t)
    return rounded(M.metrics_of(M.ridge(["qty"], "y", alpha=500.0).fit(df).transform(df), "y").select("n", "rmse", "r2_corr"), 4)


@query("K5_fit_rbf", FITTED)
def _(t):
    df = rows(t)
    return better_than_mean(M.radial(COLS, "y", seed=4).fit(df).transform(df))


@query(
    "K6_scaling",
    "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 5) AS a, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 5) AS b FROM part",
)
def _(t):
    out = M.scaling(["p_size", "p_retailprice"]).fit(t.part).transform(t.part)
    v = vector_to_array("features")
    return rounded(out.select("p_partkey", v[0].alias("a"), v[1].alias("b")), 5)


@query("K7_grid_search", """SELECT 'maxDepth=' || d || '; minInstancesPerNode=' || m AS setting, true AS fits FROM (VALUES ('2'), ('4')) a(d), (VALUES ('5'), ('20')) b(m)""")
def _(t):
    est = forest(COLS, "y")
    rf = est.getStages()[-1]
    grid_ = ParamGridBuilder().addGrid(rf.maxDepth, [2, 4]).addGrid(rf.minInstancesPerNode, [5, 20]).build()
    df = folded(t)
    return M.grid_table(M.grid_search(df, est, grid_, "y", "fold", 2), df).select("setting", F.col("r2").between(0.3, 1).alias("fits"))


@query("K8_oof_predict", "SELECT count(*) AS n, true AS fits, true AS positive FROM lineitem")
def _(t):
    oof = M.oof_predict(folded(t, 3), M.ridge(COLS, "y"), "fold", 3, kind="log1p", y="y")
    return oof.agg(F.count("prediction").alias("n"), (F.corr("prediction", "y") > 0.7).alias("fits"), (F.min("prediction") > -1).alias("positive"))


@query("K9_oof_table", "SELECT l_returnflag AS flag, count(*) AS n, true AS unbiased, true AS in_sample_closer FROM lineitem GROUP BY 1")
def _(t):
    df = M.oof_table(folded(t), M.ridge(COLS, "y"), "y", "fold", 2, ["flag"])
    fitted, held = F.avg((F.col("y") - F.col("fitted")) ** 2), F.avg(F.col("residual") ** 2)
    return df.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), (F.abs(F.avg("residual")) < 0.5).alias("unbiased"), (fitted <= held * 1.01).alias("in_sample_closer"))


@query(
    "K10_ensemble_r2",
    """WITH p AS (SELECT l_returnflag AS flag, l_extendedprice / 1000 AS y, l_quantity * 2 AS a, 50 + l_discount * 100 AS b, 52.0::DOUBLE AS c FROM lineitem), r AS (
 SELECT 1 - sum((y - a) ** 2) / (var_pop(y) * count(*)) AS ra, 1 - sum((y - b) ** 2) / (var_pop(y) * count(*)) AS rb, 1 - sum((y - c) ** 2) / (var_pop(y) * count(*)) AS rc FROM p),
 w AS (SELECT greatest(ra, 0) AS wa, greatest(rb, 0) AS wb, greatest(rc, 0) AS wc, greatest(ra, rb, rc) AS best, ra, rb, rc FROM r), f AS (
 SELECT CASE WHEN wa + wb + wc > 0 THEN wa / (wa + wb + wc) ELSE (ra = best)::INT END AS fa, CASE WHEN wa + wb + wc > 0 THEN wb / (wa + wb + wc) ELSE (rb = best AND ra <> best)::INT END AS fb, CASE WHEN wa + wb + wc > 0 THEN wc / (wa + wb + wc) ELSE (rc = best AND ra <> best AND rb <> best)::INT END AS fc FROM w)
SELECT flag, round(avg(fa * a + fb * b + fc * c), 5) AS ensemble FROM p, f GROUP BY 1""",
)
def _(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 2).alias("a"), (50 + F.col("l_discount") * 100).alias("b"), F.lit(52.0).alias("c"))
    return rounded(M.ensemble_r2(df, "y", ["a", "b", "c"]).groupBy("flag").agg(F.avg("ensemble").alias("ensemble")), 5)


VARIABLES = "(VALUES ('qty'), ('disc'), ('tax'), ('size'), ('retail')) t(variable)"


@query("K11_feature_importance", f"SELECT variable, variable = 'qty' AS first, true AS in_range, true AS sums_to_one FROM {VARIABLES}")
def _(t):
    df = rows(t)
    found = M.feature_importance(forest(COLS, "y").fit(df), COLS, df)
    whole = found.agg(F.struct(F.max("importance").alias("top"), F.sum("importance").alias("all"))).scalar()
    return found.select("variable", (F.col("importance") >= whole["top"] - 1e-9).alias("first"), F.col("importance").between(0, 1).alias("in_range"), (F.abs(whole["all"] - 1) < 1e-9).alias("sums_to_one"))


@query("K12_permutation_importance", f"SELECT variable, variable = 'qty' AS first, true AS in_range FROM {VARIABLES}")
def _(t):
    df = rows(t)
    found = M.permutation_importance(forest(COLS, "y").fit(df), df, COLS, "y", IDS)
    top = found.agg(F.max("importance")).scalar()
    return found.select("variable", (F.col("importance") >= top - 1e-9).alias("first"), (F.col("importance") > -0.5).alias("in_range"))


@query("K13_mean_abs_contribution", f"SELECT variable, variable = 'qty' AS first, true AS in_range FROM {VARIABLES}")
def _(t):
    df = rows(t)
    found = M.mean_abs_contribution(forest(COLS, "y").fit(df), df, COLS, IDS, draws=2)
    top = found.agg(F.max("mean_abs")).scalar()
    return found.select("variable", (F.col("mean_abs") >= top - 1e-9).alias("first"), (F.col("mean_abs") >= 0).alias("in_range"))


@query(
    "K14_quantile_forest",
    """SELECT l_returnflag AS flag, count(*) AS n, 100 AS n_quantiles, 0::BIGINT AS n_crossing, 0::BIGINT AS n_outside, true AS median_follows, true AS covered FROM lineitem GROUP BY 1""",
)
def _(t):
    """100 quantiles per row: in order, within the response's range, the median following it, about 80 % between the tenth and the ninetieth."""
    df = rows(t)
    model = R.fit_forest(df, "y", COLS, IDS, trees=100, depth=7, min_leaf=10, min_split=5, tried=4, rule="random", seed=1)
    values = R.response_values(df, "y")
    q = model.quantiles(df, [k / 100 for k in range(1, 101)], values)
    low = df.agg(F.min("y")).scalar()
    steps = F.col("quantiles")
    falls = F.exists(F.sequence(F.lit(1), F.lit(99)), lambda i: F.get(steps, i) < F.get(steps, i - 1))
    covered = F.avg(F.col("y").between(steps[9], steps[89]).cast("double"))
    return q.groupBy("flag").agg(
        F.count("quantiles").alias("n"), F.max(F.size("quantiles")).alias("n_quantiles"), F.count_if(falls).alias("n_crossing"),
        F.count_if((steps[0] < low) | (steps[99] > F.lit(values[-1]))).alias("n_outside"),
        (F.corr("y", steps[49]) > 0.8).alias("median_follows"), covered.between(0.7, 0.95).alias("covered"),
    )


@query("K15_score_grid", f"WITH {ZONES} SELECT count(*) AS n_cells, count(cropland) AS n_scored FROM grid")
def _(t):
    g = grid(t)
    bands = ["cropland", "rainfall", "elevation"]
    train = g.withColumn("y", F.col("rainfall") / 100 + F.col("elevation") / 50).dropna()
    return M.score_grid(forest(bands, "y").fit(train), g, bands).agg(F.count(F.lit(1)).alias("n_cells"), F.count("prediction").alias("n_scored"))


FORESTS = X.Forests(trees=100, depth=6, seed=3)


def keyed_folds(df, ids, k, **kw):
    return df.withColumn("fold", (F.col("ok") % k).cast("int"))


@query("K16_compare_models", """SELECT l_linestatus AS unit, a AS algorithm, s AS feature_set, count(*) AS n, true AS fits, true AS grid_in_order
 FROM lineitem, (VALUES ('forest'), ('linear')) v(a), (VALUES ('both'), ('covariates'), ('part')) w(s) GROUP BY ALL""")
def _(t):
    sets = {"covariates": ["qty", "disc", "tax"], "part": ["size", "retail"], "both": COLS}
    found = X.compare_models(rows(t), "status", "y", {"linear": X.Linear(), "forest": FORESTS}, sets, IDS, k=2)
    # parts alone explain little of the price, the quantity nearly all
    fits = F.when(F.col("feature_set") == "part", F.col("r2_corr") < 0.3).otherwise(F.col("r2_corr") > 0.7)
    order = (F.col("cv_r2") <= F.col("cv_r2_best")) & (F.coalesce("cv_r2_sd", F.lit(0.0)) >= 0)
    return found.select("unit", "algorithm", "feature_set", "n", fits.alias("fits"), order.alias("grid_in_order"))


@query("K17_evaluate_logo", """SELECT a.l_linestatus AS unit, a.l_returnflag AS region, count(*) AS n, true AS grid_in_order, true AS inside, true AS outside
 FROM lineitem a WHERE l_linestatus IN (SELECT l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1) GROUP BY 1, 2""")
def _(t):
    found = X.evaluate_logo(rows(t), "status", "flag", "y", COLS, FORESTS, IDS, k=2)
    order = (F.col("cv_r2") <= F.col("cv_r2_best")) & (F.col("cv_r2_sd") >= 0)
    return found.select("unit", "region", "n", order.alias("grid_in_order"), (F.col("cv_r2") > 0.7).alias("inside"), (F.col("test_r2") > 0.7).alias("outside"))


@query(
    "K17_evaluate_logo_linear",
    f"""WITH {LINE}, u AS (SELECT status, flag FROM d WHERE status IN (SELECT status FROM d GROUP BY 1 HAVING count(DISTINCT flag) > 1) GROUP BY 1, 2), m AS (
 SELECT u.status, u.flag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM u JOIN d ON d.status = u.status AND d.flag <> u.flag GROUP BY 1, 2), f AS (
 SELECT u.status, u.flag, k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM u, (VALUES (0), (1), (2)) k(fold) JOIN d ON d.status = u.status AND d.flag <> u.flag AND d.fold <> k.fold GROUP BY 1, 2, 3), c AS (
 SELECT f.status, f.flag, f.fold, pow(corr(a + b * x, y), 2) AS r2 FROM f JOIN d ON d.status = f.status AND d.flag <> f.flag AND d.fold = f.fold GROUP BY 1, 2, 3), g AS (SELECT status, flag, avg(r2) AS cv_r2 FROM c GROUP BY 1, 2)
SELECT m.status AS unit, m.flag AS region, count(*) AS n, round(any_value(cv_r2), 6) AS cv_r2, round(any_value(cv_r2), 6) AS cv_r2_best, round(pow(corr(a + b * x, y), 2), 6) AS test_r2, round(sqrt(avg((a + b * x - y) ** 2)), 6) AS rmse
FROM m JOIN d ON d.status = m.status AND d.flag = m.flag JOIN g ON g.status = m.status AND g.flag = m.flag GROUP BY 1, 2""",
)
def _(t):
    found = X.evaluate_logo(rows(t), "status", "flag", "y", ["qty"], X.Linear(), IDS, k=3, folds=keyed_folds)
    return rounded(found.drop("cv_r2_sd"), 6)


@query("K18_transfer_matrix", """WITH p AS (SELECT l_returnflag AS f, 'point' AS grain, count(*) AS n FROM lineitem GROUP BY 1), m AS (
 SELECT l_returnflag AS f, 'location_mean' AS grain, count(*) AS n FROM (SELECT l_returnflag, l_partkey FROM lineitem GROUP BY 1, 2 HAVING count(*) > 9) GROUP BY 1), a AS (SELECT * FROM p UNION ALL SELECT * FROM m)
SELECT x.grain, x.f AS train_unit, y.f AS test_unit, y.n, true AS grid_in_order, CASE WHEN x.grain = 'point' THEN true END AS fits FROM a x JOIN a y ON x.grain = y.grain AND x.f <> y.f""")
def _(t):
    found = X.transfer_matrix(rows(t), "flag", "y", COLS, FORESTS, IDS, location=["pk"], k=2)
    order = F.coalesce(F.col("cv_r2") <= F.col("cv_r2_best"), F.lit(True))
    fits = (F.col("cv_r2") > 0.7) & (F.col("oob_r2") > 0.7) & (F.col("test_r2") > 0.7)
    return found.select("grain", "train_unit", "test_unit", "n", order.alias("grid_in_order"), F.when(F.col("grain") == "point", fits).alias("fits"))


@query("K19_self_evaluation", """SELECT v AS variable, 2::BIGINT AS n_units, CASE WHEN v = 'qty' THEN 1.0::DOUBLE END AS mean_rank, true AS in_range FROM (VALUES ('qty'), ('disc'), ('tax'), ('size'), ('retail')) t(v)""")
def _(t):
    ranks = X.self_evaluation(rows(t), "status", "y", COLS, FORESTS, IDS, k=2)[1]
    return ranks.select("variable", "n_units", F.when(F.col("variable") == "qty", F.col("mean_rank")).alias("mean_rank"), F.col("mean_rank").between(1, len(COLS)).alias("in_range"))


@query("K19_self_evaluation_fits", "SELECT l_linestatus AS unit, count(*) AS n, true AS fits FROM lineitem GROUP BY 1")
def _(t):
    fits = X.self_evaluation(rows(t), "status", "y", COLS, X.Forests(trees=100, depth=6, settings=((None, "best"),)), IDS, k=2)[0]
    return fits.select("unit", "n", ((F.col("cv_r2") > 0.7) & (F.col("r2_corr") > 0.7)).alias("fits"))


@query("K20_leave_one_unit_out", "SELECT l_returnflag AS unit, count(*) AS n, true AS grid_in_order, true AS inside, true AS outside FROM lineitem GROUP BY 1")
def _(t):
    found = X.leave_one_unit_out(rows(t), "flag", "y", COLS, FORESTS, IDS, k=2)
    order = (F.col("in_r2") <= F.col("in_r2_best")) & (F.col("in_r2_sd") >= 0)
    return found.select("unit", "n", order.alias("grid_in_order"), (F.col("in_r2") > 0.7).alias("inside"), (F.col("out_r2") > 0.7).alias("outside"))


@query(
    "K20_leave_one_unit_out_linear",
    f"""WITH {LINE}, u AS (SELECT DISTINCT flag FROM d), m AS (SELECT u.flag, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM u JOIN d ON d.flag <> u.flag GROUP BY 1), f AS (
 SELECT u.flag, k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM u, (VALUES (0), (1), (2)) k(fold) JOIN d ON d.flag <> u.flag AND d.fold <> k.fold GROUP BY 1, 2), c AS (
 SELECT f.flag, f.fold, pow(corr(a + b * x, y), 2) AS r2 FROM f JOIN d ON d.flag <> f.flag AND d.fold = f.fold GROUP BY 1, 2), g AS (SELECT flag, avg(r2) AS in_r2 FROM c GROUP BY 1)
SELECT m.flag AS unit, count(*) AS n, round(any_value(in_r2), 6) AS in_r2, round(pow(corr(a + b * x, y), 2), 6) AS out_r2, round(sqrt(avg((a + b * x - y) ** 2)), 6) AS rmse
FROM m JOIN d ON d.flag = m.flag JOIN g ON g.flag = m.flag GROUP BY 1""",
)
def _(t):
    found = X.leave_one_unit_out(rows(t), "flag", "y", ["qty"], X.Linear(), IDS, k=3, folds=keyed_folds)
    return rounded(found.drop("in_r2_sd", "in_r2_best"), 6)


@query(
    "K21_select_predictors",
    """WITH d AS (SELECT l_orderkey % 3 AS fold, l_quantity * p_retailprice / 1200 + l_extendedprice / 6000 AS y, l_quantity AS a, l_discount AS b, l_returnflag AS g FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT * FROM (VALUES (0), (1), (2)) v(k)), one AS (
 SELECT k, regr_slope(y, a) AS s, regr_intercept(y, a) AS i FROM k JOIN d ON fold <> k GROUP BY 1), two AS (
 SELECT k, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS y2 FROM k JOIN d ON fold <> k GROUP BY 1), grp AS (
 SELECT k, g, avg(y) AS p FROM k JOIN d ON fold <> k GROUP BY 1, 2), e AS (
 SELECT 'one' AS predictor_set, k, sqrt(avg((i + s * a - y) ** 2)) AS rmse FROM one JOIN d ON fold = k GROUP BY 2 UNION ALL
 SELECT 'two', k, sqrt(avg((my + (ay * bb - y2 * ab) / (aa * bb - ab * ab) * (a - ma) + (y2 * aa - ay * ab) / (aa * bb - ab * ab) * (b - mb) - y) ** 2)) FROM two JOIN d ON fold = k GROUP BY 2 UNION ALL
 SELECT 'kinds', d.fold, sqrt(avg((p - y) ** 2)) FROM grp JOIN d ON d.fold = grp.k AND d.g = grp.g GROUP BY 2)
SELECT predictor_set, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_sd, count(*) AS n_folds_ok FROM e GROUP BY 1 UNION ALL SELECT 'broken', NULL, NULL, 0""",
)
def _(t):
    sets = {"one": "qty", "two": "qty + disc", "kinds": "flag", "broken": "absent_column"}
    return rounded(X.select_predictors(keyed_folds(rows(t), IDS, 3), sets, "y", "fold", 3), 6)


@query("K22_fit_bounded", "SELECT f.*, true AS bounded FROM (" + FITTED + ") f")
def _(t):
    df = rows(t).withColumn("share", F.col("y") / 106)
    fitted = M.bounded(["qty", "size"], "share").fit(df).transform(df)
    inside = fitted.agg((F.min("prediction") > 0) & (F.max("prediction") < 1)).scalar()
    return better_than_mean(fitted, "share").select("*", inside.alias("bounded"))


@query(
    "K23_shrunken_group_means",
    """WITH d AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_extendedprice / 1000 - 50 AS v FROM lineitem), a AS (SELECT flag, avg(v) * count(*) / (count(*) + 10.0) AS e FROM d GROUP BY 1),
 b AS (SELECT flag, status, avg(v - e) * count(*) / (count(*) + 10.0) AS e2 FROM d JOIN a USING (flag) GROUP BY 1, 2)
SELECT flag, status, round(e + e2, 6) AS group_effect FROM a JOIN b USING (flag)""",
)
def _(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_extendedprice") / 1000 - 50).alias("v"))
    out = M.shrunken_group_means(df, ["flag", "status"], "v", 10.0)
    return rounded(out.groupBy("flag", "status").agg(F.max("group_effect").alias("group_effect")), 6)


@query(
    "K24_loo_r2",
    """WITH d AS (SELECT p_retailprice AS y, p_size::DOUBLE AS x FROM part), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx FROM d)
SELECT any_value(n) AS n, round(1 - sum(pow((y - my - b * (x - mx)) / (1 - 1.0 / n - (x - mx) ** 2 / sxx), 2)) / sum((y - my) ** 2), 6) AS loo_r2 FROM d, m""",
)
def _(t):
    return rounded(M.loo_r2(t.part, ["p_size"], "p_retailprice"), 6)


@query(
    "K25_compare_fits",
    f"""WITH {LINE}, l AS (SELECT count(*) AS n, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / regr_sxx(y, x) AS dev FROM d), k AS (SELECT count(*) AS n, sum(pow(y - m, 2)) AS dev FROM (SELECT y, avg(y) OVER (PARTITION BY flag) AS m FROM d)), u AS (
 SELECT 'line' AS model, n, dev, 2 AS params FROM l UNION ALL SELECT 'kinds', n, dev, 3 FROM k)
SELECT model, round(n * (ln(dev / n * 2 * pi()) + 1) + 2 + 2 * params, 2) AS aic, round(sqrt(dev / n), 2) AS rmse, params::INTEGER AS n_params FROM u""",
)
def _(t):
    return rounded(M.compare_fits(rows(t), {"line": "y ~ qty", "kinds": "y ~ flag"}, "y"), 2)


@query(
    "K26_spatial_baseline",
    KNN_SQL + " SELECT k.point_id, round(sum(value / (d2 + 1e-9)) / sum(1 / (d2 + 1e-9)), 3) AS prediction FROM k JOIN points p ON k.neighbour = p.point_id GROUP BY 1",
)
def _(t):
    return rounded(M.spatial_baseline(points(t), "value", 4).select("point_id", "prediction"), 3)


@query("K27_prediction_table", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_tax * 100 AS a, l_discount * 100 AS b, l_tax * 100 - l_quantity AS resid_a, l_discount * 100 - l_quantity AS resid_b FROM lineitem")
def _(t):
    df = t.lineitem.withColumns({"a": F.col("l_tax") * 100, "b": F.col("l_discount") * 100})
    return M.prediction_table(df, ["l_orderkey", "l_linenumber", "l_partkey"], "l_quantity", ["a", "b"])


@query(
    "K28_external_validation",
    """WITH a AS (SELECT p_type, p_name, avg(p_retailprice) AS pred FROM part WHERE p_size <= 25 GROUP BY 1, 2), b AS (SELECT p_type, upper(p_name) AS p_name, avg(p_size) AS obs FROM part WHERE p_size > 25 GROUP BY 1, 2), j AS (
 SELECT pred, obs FROM a JOIN b ON jaro_similarity(lower(a.p_type), lower(b.p_type)) >= 0.8 - 1e-12 AND jaro_similarity(lower(a.p_name), lower(b.p_name)) >= 0.8 - 1e-12 WHERE NOT (a.p_name LIKE '%red%' AND lower(b.p_name) NOT LIKE '%red%'))
SELECT count(*) AS n, round(corr(pred, obs), 5) AS r, round(pow(corr(pred, obs), 2), 5) AS r2_corr FROM j""",
)
def _(t):
    a = t.part.where("p_size <= 25").groupBy("p_type", "p_name").agg(F.avg("p_retailprice").alias("pred"))
    b = t.part.where("p_size > 25").groupBy("p_type", F.upper("p_name").alias("p_name")).agg(F.avg("p_size").alias("obs"))
    return rounded(X.external_validation(a, b, ["p_type", "p_name"], "pred", "obs", tokens=["red"]), 5)


@query(
    "K29_admin_agreement",
    """WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS o, avg(o_totalprice) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT count(*) AS n, round(corr(o, p), 5) AS r, round(pow(corr(o, p), 2), 5) AS r2_corr FROM m""",
)
def _(t):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rounded(X.admin_agreement(df, ["c_nationkey"], "c_acctbal", "o_totalprice")[1], 5)
