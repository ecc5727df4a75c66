"""Trajectory features on the events table (key user_id, one index per sensor)."""

from pyspark.sql import functions as F

from plotwise.catalog.base import query, rounded
from plotwise.functions import indices as I
from plotwise.operators import trajectory as T

S = T.Series(key="user_id", date="date", tie="event_id", end="end_date")
WINDOWS = {"early": ("2024-01-01", "2024-01-10"), "mid": ("2024-01-11", "2024-01-20"), "late": ("2024-01-21", "2024-01-30")}

OBS = """obs AS (SELECT user_id, event_id, CAST(ts AS DATE) AS date, DATE '2024-01-20' + CAST(user_id % 10 AS INTEGER) AS end_date,
  event_type IN ('purchase', 'view', 'click') AS opt, event_type IN ('purchase', 'error', 'signup') AS sar, value / 500 AS v, dayofyear(ts) AS doy
  FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-20' + CAST(user_id % 10 AS INTEGER))"""
NDVI = OBS + ", s AS (SELECT * FROM obs WHERE opt)"
VH = OBS + ", s AS (SELECT * FROM obs WHERE sar)"
STATS = """SELECT user_id, round(max(v), 10) AS {c}_peak, round(avg(v), 10) AS {c}_mean, round(stddev_pop(v), 10) AS {c}_std, round(arg_max(v, (date, event_id)), 10) AS {c}_last,
  CAST(any_value(end_date) - max(date) AS DOUBLE) AS {c}_dtharv, CAST(arg_max(doy, (v, -doy)) AS DOUBLE) AS {c}_doy_peak FROM s GROUP BY 1"""
INTEGRAL = """SELECT user_id, round(CASE WHEN count(*) = 1 THEN max(v) ELSE coalesce(sum((doy - pd) * (v + pv) / 2), 0) END, 10) AS {c}_integral FROM (
  SELECT user_id, doy, v, lag(doy) OVER w AS pd, lag(v) OVER w AS pv FROM s WINDOW w AS (PARTITION BY user_id ORDER BY date, event_id)) GROUP BY 1"""
SLOPE = """SELECT user_id, round(CASE WHEN count(*) = 2 THEN (max(v) FILTER (rn = 1) - max(v) FILTER (rn = 2)) / (max(doy) FILTER (rn = 1) - max(doy) FILTER (rn = 2) + 1e-9) END, {d}) AS {n}
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, event_id DESC) AS rn FROM s {where}) WHERE rn <= 2 GROUP BY 1"""


def observations(t):
    e = t.events
    day = F.to_date("ts")
    df = e.select(
        "user_id", "event_id", day.alias("date"),
        F.date_add(F.lit("2024-01-20").cast("date"), (F.col("user_id") % 10).cast("int")).alias("end_date"),
        F.col("event_type").isin("purchase", "view", "click").alias("opt"),
        F.col("event_type").isin("purchase", "error", "signup").alias("sar"),
        (F.col("value") / 500).alias("v"),
    )
    return df.where(F.col("date") <= F.col("end_date"))


def ndvi(t):
    return observations(t).where("opt").withColumnRenamed("v", "NDVI")


def vh(t):
    return observations(t).where("sar").withColumnRenamed("v", "VH_mean")


@query("E8_trajectory_stats", f"WITH {NDVI} " + STATS.format(c="NDVI"))
def _(t):
    return rounded(T.trajectory_stats(ndvi(t), S, ["NDVI"]), 10)


@query("E9_trapezoid", f"WITH {NDVI} " + INTEGRAL.format(c="NDVI"))
def _(t):
    return rounded(T.trapezoid(ndvi(t), S, ["NDVI"]), 10)


@query("E10_last_two_slope", f"WITH {NDVI} " + SLOPE.format(n="NDVI_slope", where="", d=3))
def _(t):
    return rounded(T.last_two_slopes(ndvi(t), S, ["NDVI"]), 3)


def _window_sql():
    parts = [
        f"round(avg(v) FILTER (date BETWEEN '{a}' AND '{b}'), 10) AS NDVI_{w}_mean, round(max(v) FILTER (date BETWEEN '{a}' AND '{b}'), 10) AS NDVI_{w}_max"
        for w, (a, b) in WINDOWS.items()
    ]
    joins = " ".join(
        f"LEFT JOIN ({SLOPE.format(n=f'NDVI_{w}_slope', where=f'''WHERE date BETWEEN '{a}' AND '{b}' ''', d=3)}) USING (user_id)" for w, (a, b) in WINDOWS.items()
    )
    return f"WITH {NDVI} SELECT * FROM (SELECT user_id, {', '.join(parts)} FROM s GROUP BY 1) {joins}"


@query("E11_window_stats", _window_sql())
def _(t):
    df = T.window_stats(ndvi(t), S, ["NDVI"], WINDOWS)
    return rounded(df.withColumns({f"NDVI_{w}_slope": F.round(f"NDVI_{w}_slope", 3) for w in WINDOWS}), 10)


PHENOLOGY = """SELECT user_id, green_up_doy, senescence_doy, ndvi_at_senes, senescence_doy - green_up_doy AS season_length FROM (SELECT user_id, CAST(arg_min(doy, (date, event_id)) FILTER (v >= 0.35) AS DOUBLE) AS green_up_doy,
  CAST(arg_max(doy, (date, event_id)) FILTER (v >= 0.5) AS DOUBLE) AS senescence_doy, round(arg_max(v, (date, event_id)) FILTER (v >= 0.5), 10) AS ndvi_at_senes FROM s GROUP BY 1)"""


@query("E12_phenology", f"WITH {NDVI} " + PHENOLOGY)
def _(t):
    return rounded(T.phenology(ndvi(t), S, "NDVI"), 10)


ENTROPY = """SELECT user_id, round(-sum(p * log2(p + 1e-9)), 5) AS VH_entropy FROM (SELECT user_id, count(*) / any_value(n)::DOUBLE AS p FROM (
  SELECT user_id, n, CASE WHEN b > a THEN least(floor((v - a) / (b - a) * least(10, n)), least(10, n) - 1) ELSE 0 END AS bin FROM (
    SELECT user_id, v, min(v) OVER w AS a, max(v) OVER w AS b, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id)) WHERE n >= 3) GROUP BY user_id, bin) GROUP BY 1"""


@query("E13_series_entropy", f"WITH {VH} " + ENTROPY)
def _(t):
    return rounded(T.series_entropy(vh(t), S, "VH_mean", out="VH_entropy"), 5)


AUTOCORR = """SELECT user_id, round(corr(p, v), 5) AS VH_autocorr_l1 FROM (SELECT user_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY date, event_id) AS p FROM s) GROUP BY 1 HAVING count(*) >= 3"""


@query("E14_autocorr_lag1", f"WITH {VH} " + AUTOCORR)
def _(t):
    return rounded(T.autocorr_lag1(vh(t), S, "VH_mean", out="VH_autocorr_l1"), 5)


COVERAGE = """SELECT user_id, count(*) FILTER (opt) AS n_obs_optical, count(*) FILTER (sar) AS n_obs_sar, count(*) AS n_obs_total, CAST(max(date) - min(date) AS DOUBLE) AS season_span_days FROM obs GROUP BY 1"""


@query("E15_coverage", f"WITH {OBS} " + COVERAGE)
def _(t):
    return T.coverage(observations(t), S, F.col("opt"), F.col("sar"))


def _all_features():
    """Every column of the feature table: both sensors' statistics, integrals, slopes and windows, phenology, entropy, lag, coverage."""
    parts = [COVERAGE]
    for c, view in (("NDVI", "o"), ("VH_mean", "r")):
        inside = {w: f"date BETWEEN '{a}' AND '{b}'" for w, (a, b) in WINDOWS.items()}
        means = ", ".join(f"round(avg(v) FILTER ({x}), 10) AS {c}_{w}_mean, round(max(v) FILTER ({x}), 10) AS {c}_{w}_max" for w, x in inside.items())
        slopes = [SLOPE.format(n=f"{c}_{w}_slope", where=f"WHERE {x}", d=3) for w, x in inside.items()]
        own = [STATS.format(c=c), INTEGRAL.format(c=c), SLOPE.format(n=f"{c}_slope", where="", d=3), *slopes, f"SELECT user_id, {means} FROM s GROUP BY 1"]
        parts += [x.replace("FROM s", f"FROM {view}") for x in own]
    parts += [ENTROPY.replace("FROM s", "FROM r"), AUTOCORR.replace("FROM s", "FROM r"), PHENOLOGY.replace("FROM s", "FROM o")]
    joined = f"({parts[0]})" + "".join(f" LEFT JOIN ({x}) USING (user_id)" for x in parts[1:])
    return f"WITH {OBS}, o AS (SELECT * FROM obs WHERE opt), r AS (SELECT * FROM obs WHERE sar) SELECT * FROM {joined}"


def features(t):
    df = observations(t).withColumns({"NDVI": F.col("v"), "VH_mean": F.col("v")})
    return T.build_trajectory_features(df, S, T.FeaturePlan(["NDVI"], ["VH_mean"], WINDOWS), F.col("opt"), F.col("sar"))


@query("E16_build_trajectory_features", _all_features())
def _(t):
    df = features(t)
    fine = {c: F.round(c, 3) for c in df.columns if c.endswith("_slope")} | {c: F.round(c, 5) for c in ("VH_entropy", "VH_autocorr_l1")}
    return rounded(df.withColumns(fine), 10)


@query(
    "B29_add_cross_features",
    f"""WITH {OBS}, p AS (SELECT user_id, max(v) FILTER (opt) AS o, max(v) FILTER (sar) AS r, arg_max(v, (date, event_id)) FILTER (opt) AS lo, arg_max(v, (date, event_id)) FILTER (sar) AS lr,
  CAST(any_value(end_date) - max(date) FILTER (opt) AS DOUBLE) AS dn, CAST(any_value(end_date) - max(date) FILTER (sar) AS DOUBLE) AS dv FROM obs GROUP BY 1),
 i AS ({INTEGRAL.format(c='NDVI').replace('FROM s', 'FROM (SELECT * FROM obs WHERE opt)')})
SELECT user_id, round(o * o, 12) AS NDVI_peak_sq, round(o / 2 / (abs(o) + 1e-9), 6) AS CCCI_peak, round(2 * o - o, 6) AS EVI_NDVI_gap, round(NDVI_integral * NDVI_integral / 2, 6) AS NDVI_int_x_NDRE_int, round(o * 3 * r, 12) AS VI_SAR_peak,
 round(o / 2 * r / 4, 12) AS NDRE_DpRVI_peak, round(lr * lo, 12) AS VH_NDVI_last, round(r / (r + 0.2 + 1e-9), 6) AS VH_VV_ratio_peak, round(dv - dn, 6) AS SAR_opt_dtharv_diff, round((o - o * 0.7) / (o + o * 0.7 + 1e-9), 6) AS LSWI_peak
FROM p LEFT JOIN i USING (user_id)""",
)
def _(t):
    v = F.col("v")
    bands = {"NDVI": v, "NDRE": v / 2, "EVI": 2 * v, "B8A_mean": v, "B11_mean": v * 0.7, "VH_mean": v, "VV_mean": v + 0.2, "RVI": 3 * v, "DpRVI": v / 4}
    plan = T.FeaturePlan(["NDVI", "NDRE", "EVI", "B8A_mean", "B11_mean"], ["VH_mean", "VV_mean", "RVI", "DpRVI"], WINDOWS)
    built = T.build_trajectory_features(observations(t).withColumns(bands), S, plan, F.col("opt"), F.col("sar"))
    df = I.add_cross_features(built)
    products = ["NDVI_peak_sq", "VI_SAR_peak", "NDRE_DpRVI_peak", "VH_NDVI_last"]  # exact decimals, so many digits avoid halves
    new = [c for c in df.columns if c not in built.columns]
    return rounded(df.select("user_id", *[c if c in products else F.round(c, 6).alias(c) for c in new]), 12)
