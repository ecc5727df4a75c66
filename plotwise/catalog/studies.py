"""The three studies, end to end, on the driver's tables; what must hold of their whole results is checked in SQL."""

from pyspark.sql import functions as F

from plotwise.catalog.base import FARMS, plots, query
from plotwise.catalog.grids import GRID, ZONES, grid, polygons
from plotwise.catalog.modelling import COLS, rows
from plotwise.catalog.trajectories import observations
from plotwise.operators import trajectory as T
from plotwise.plans import farm_size, selection, trajectory

CUTS, THRESHOLDS = [1.0, 2.0, 5.0, 10.0, 1000.0], [1.0, 2.0, 5.0]


@query(
    "study_farm_size",
    f"""WITH {ZONES}, {FARMS.removeprefix('WITH ')}, boxed AS (SELECT * FROM farms WHERE x > -18 AND x < 52 AND y > -35 AND y < 38 AND NOT (x = 0 AND y = 0)), kept AS (
  SELECT b.* FROM boxed b JOIN (SELECT country, quantile_cont(farm_area_ha, 0.95) AS lim FROM boxed GROUP BY country) USING (country) WHERE farm_area_ha <= lim), c AS (
  SELECT n_name, count(*) AS n_cells, count(cropland) AS n_scored FROM zoned WHERE n_name IS NOT NULL GROUP BY 1), f AS (SELECT count(*) AS n_farms FROM kept)
SELECT n_name, n_cells, n_scored, n_farms, true AS sizes_in_range, true AS quantiles_in_order, true AS population_complete, true AS classes_add_up, true AS fit_counts_all FROM c, f""",
)
def _(t):
    bands = ["cropland", "rainfall", "elevation"]
    cells = grid(t).withColumns({"land_ha": F.col("cropland") * 5, "zone": F.concat(F.lit("z"), F.col("landcover").cast("string"))})
    settings = farm_size.Prediction(trees=100, depth=6, tried=2)
    s = farm_size.farm_size_study(plots(t), polygons(t), ["n_name"], "n_nationkey", cells, GRID, bands, "land_ha", "zone", CUTS, THRESHOLDS, settings)
    one = lambda df, c: df.agg(c).scalar()
    low, high = one(s["farms"], F.min("farm_area_ha")), one(s["farms"], F.max("farm_area_ha"))
    steps = F.col("sizes")
    falls = F.exists(F.sequence(F.lit(1), F.lit(99)), lambda i: F.get(steps, i) < F.get(steps, i - 1))
    mapped = s["cells"].where("n_name is not null").groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("predicted_ha").alias("n_scored"), F.coalesce(F.sum("nb_farms"), F.lit(0)).alias("_nb"),
        (F.count_if((steps[0] < low) | (steps[99] > high)) == 0).alias("sizes_in_range"), (F.count_if(falls) == 0).alias("quantiles_in_order"),
    )
    virtual = s["population"].groupBy("n_name").agg(F.count("farm_ha").alias("_virtual"))
    classes = s["classes"].groupBy("n_name").agg(F.sum("nb").alias("_classed"))
    both = mapped.join(virtual, "n_name", "left").join(classes, "n_name", "left")
    n_farms, n_fit = one(s["farms"], F.count(F.lit(1))), one(s["fit"], F.sum("n"))
    known = one(s["farms"].where("n_name is not null"), F.count(F.lit(1)))
    listed = one(s["admin_means"].where("n_name is not null"), F.sum("n_farms"))
    return both.select(
        "n_name", "n_cells", "n_scored", n_farms.alias("n_farms"), "sizes_in_range", "quantiles_in_order",
        (F.col("_nb") == F.coalesce("_virtual", F.lit(0))).alias("population_complete"), (F.coalesce("_virtual", F.lit(0)) == F.coalesce("_classed", F.lit(0))).alias("classes_add_up"),
        ((n_fit > 0) & (n_fit <= n_farms) & (known == listed)).alias("fit_counts_all"),
    )


OWN = """(SELECT user_id FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20' + CAST(user_id % 10 AS INTEGER) AND CAST(ts AS DATE) >= DATE '2024-01-01' GROUP BY 1)"""


@query("study_trajectory", f"SELECT model, n, true AS finite, true AS ensemble_near_best FROM (VALUES ('gbt'), ('forest'), ('ridge'), ('ensemble')) m(model), (SELECT count(*) AS n FROM {OWN})")
def _(t):
    obs = observations(t).withColumns(
        {"fusion_type": F.when(F.col("opt") & F.col("sar"), "fused").when(F.col("opt"), "optical_only").otherwise("sar_only"), "NDVI": F.col("v"), "EVI": F.col("v") * F.col("v"), "VH_mean": F.col("v") / 2, "VV_mean": F.col("v") + 0.1}
    )
    labels = obs.groupBy("user_id").agg(F.max("end_date").alias("end_date"), (1000 * F.avg("v") + F.max("v") * 100 + F.min("user_id") % 7).alias("biomass"), F.concat(F.lit("d"), (F.min("user_id") % 12).cast("string")).alias("district"))
    series = T.Series(key="user_id", date="date", tie="event_id", end="end_date")
    windows = {"early": ("01-01", "01-10"), "late": ("01-11", "01-31")}
    feats = trajectory.entity_features(obs.drop("end_date", "opt", "sar", "v"), labels, series, 2024, windows=windows)
    out = trajectory.train_ensemble(feats, labels, "user_id", "biomass", group="district", k=3, trees=20, rounds=10)
    scores = out["metrics"]
    best = scores.where("model <> 'ensemble'").agg(F.max("r2_sse")).scalar()
    near = scores.where("model = 'ensemble'").agg(F.max("r2_sse")).scalar() > best - 0.1
    return scores.select("model", "n", (F.col("rmse") < 1e9).alias("finite"), near.alias("ensemble_near_best"))


@query("study_selection", "SELECT model, 3::BIGINT AS n_folds, true AS fits, 'quantity' AS best_set, 1::BIGINT AS n_failed FROM (VALUES ('linear_pooled'), ('bounded'), ('forest')) m(model)")
def _(t):
    share = F.least(F.greatest(F.col("y") / 70, F.lit(0.001)), F.lit(0.999))
    df = rows(t).withColumn("share", share).select("ok", "ln", "pk", "sk", "share", "flag", "status", *COLS)
    sets = {"quantity": "qty + retail + flag", "part": "size", "broken": "nowhere"}
    out = selection.select_and_compare(df, "share", ["qty", "retail"], ["flag"], sets, ["status", "flag"], ["ok", "ln", "pk", "sk"], k=3, trees=20)
    ranking = out["ranking"]
    best = ranking.agg(F.min_by("predictor_set", F.coalesce("rmse_mean", F.lit(1e9)))).scalar()
    failed = ranking.agg(F.count_if(F.col("n_folds_ok") == 0)).scalar()
    return out["overall"].select("model", F.col("rmse_folds").alias("n_folds"), (F.col("r2_sse_mean") > 0.5).alias("fits"), best.alias("best_set"), failed.alias("n_failed"))
