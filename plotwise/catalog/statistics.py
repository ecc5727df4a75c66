"""Aggregates, ordered windows, folds and reshaping."""

from pyspark.sql import functions as F

from plotwise.catalog.base import CLEAN, FARMS, PLOTS, POINTS, clean_plots, farms, plots, points, query, rounded
from plotwise.catalog.survey import SIZE_CASE, SIZE_LABELS
from plotwise.functions import numbers as N
from plotwise.operators import folds as K
from plotwise.operators import reshape as R
from plotwise.operators import stats as S
from plotwise.operators import windows as W

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# D: aggregations --------------------------------------------------------------
@query(
    "D1_counts",
    "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS n_distinct FROM orders GROUP BY 1",
)
def _(t):
    n = S.value_counts(t.orders, ["o_orderpriority"])
    return n.join(S.distinct_counts(t.orders, ["o_orderpriority"], "o_custkey"), "o_orderpriority")


@query("D2_farm_area", f"WITH {FARMS} SELECT x, y, country, year, farm_id, hh_size, round(farm_area_ha, 6) AS farm_area_ha FROM farms")
def _(t):
    return rounded(farms(t), 6)


@query(
    "D2_farm_area_strict",
    f"""WITH {CLEAN} SELECT x, y, country, year, farm_id, hh_size, round(sum(measured_plot_area_ha), 6) AS farm_area_ha FROM capped
  WHERE (country, year, farm_id) NOT IN (SELECT (country, year, farm_id) FROM capped WHERE measured_plot_area_ha IS NULL) GROUP BY ALL""",
)
def _(t):
    return rounded(S.farm_area(clean_plots(t), "measured_plot_area_ha"), 6)


@query(
    "D3_profile",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
 round(quantile_cont(l_extendedprice, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return rounded(S.profile(t.lineitem, ["l_returnflag", "l_linestatus"], "l_extendedprice"))


@query(
    "D4_profile_with_total",
    """SELECT coalesce(c_mktsegment, 'TOTAL') AS c_mktsegment, count(*) AS n_obs, round(avg(c_acctbal), 4) AS avg, count(*) FILTER (c_acctbal < 1000) AS n_1000,
 round(quantile_cont(c_acctbal, 0.1), 4) AS q10, round(quantile_cont(c_acctbal, 0.5), 4) AS med, round(100.0 * count(*) FILTER (c_acctbal < 1000) / count(*), 4) AS prct_below_1000
 FROM customer GROUP BY ROLLUP (c_mktsegment)""",
)
def _(t):
    return rounded(S.profile_with_total(t.customer, "c_mktsegment", "c_acctbal", {"q10": 0.1, "med": 0.5}, [1000]))


@query(
    "D5_share_below",
    """SELECT l_shipmode_like AS flag, count(*) AS n, round(sum(v), 2) AS total, count(*) FILTER (v < 5) AS nb_5, round(coalesce(sum(v) FILTER (v < 5), 0), 2) AS sum_5, count(*) FILTER (v < 20) AS nb_20,
 round(coalesce(sum(v) FILTER (v < 20), 0), 2) AS sum_20, round(nb_5 / n::DOUBLE, 6) AS share_nb_5, round(nb_20 / n::DOUBLE, 6) AS share_nb_20,
 round(coalesce(sum(v) FILTER (v < 5), 0) / sum(v), 6) AS share_sum_5, round(coalesce(sum(v) FILTER (v < 20), 0) / sum(v), 6) AS share_sum_20
 FROM (SELECT l_returnflag AS l_shipmode_like, l_quantity AS v FROM lineitem) GROUP BY 1""",
)
def _(t):
    df = S.share_below(t.lineitem.withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_quantity", [5, 20])
    return rounded(df, 6)


@query(
    "D6_levelled_fit",
    f"""WITH {PLOTS}, p AS (SELECT * FROM plots WHERE measured_plot_area_ha IS NOT NULL AND reported_area_ha IS NOT NULL), m AS (
  SELECT 'region' AS level, avg(reported_area_ha) AS o, avg(measured_plot_area_ha) AS p FROM p GROUP BY region UNION ALL
  SELECT 'country', avg(reported_area_ha), avg(measured_plot_area_ha) FROM p GROUP BY region, country UNION ALL
  SELECT 'year', avg(reported_area_ha), avg(measured_plot_area_ha) FROM p GROUP BY region, country, year)
SELECT level, count(*) AS n_units, round(corr(o, p) * corr(o, p), 5) AS r2_corr FROM m GROUP BY 1""",
)
def _(t):
    return rounded(S.levelled_fit(plots(t), ["region", "country", "year"], "reported_area_ha", "measured_plot_area_ha"), 5)


@query(
    "D7_by_each_factor",
    """SELECT l_linestatus, 'l_returnflag' AS grouping_factor, l_returnflag AS group_modality, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL UNION ALL
 SELECT l_linestatus, 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*), round(sum(l_extendedprice), 2) FROM lineitem GROUP BY l_linestatus, l_linenumber""",
)
def _(t):
    df = S.by_each_factor(t.lineitem, ["l_returnflag", "l_linenumber"], ["l_linestatus"], [F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total")])
    return rounded(df, 2)


@query(
    "D8_share_of_total",
    """SELECT l_returnflag, l_linenumber, round(sum(l_extendedprice), 2) AS value, round(sum(sum(l_extendedprice)) OVER (PARTITION BY l_returnflag), 2) AS tot,
 round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    df = S.share_of_total(t.lineitem, ["l_returnflag"], ["l_linenumber"], "l_extendedprice")
    return rounded(df.withColumns({"value": F.round("value", 2), "tot": F.round("tot", 2)}), 6)


@query("D9_location_means", "SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 4) AS l_discount FROM lineitem GROUP BY 1 HAVING count(*) > 9")
def _(t):
    return rounded(S.location_means(t.lineitem, ["l_partkey"], ["l_quantity", "l_discount"]))


@query("D10_collect_sizes", "SELECT o_custkey, 0::BIGINT AS part, count(*) AS n, list(o_totalprice ORDER BY o_totalprice) AS sizes FROM orders GROUP BY 1")
def _(t):
    return S.collect_sizes(t.orders, ["o_custkey"], "o_totalprice")


@query(
    "D11_column_totals",
    "SELECT name, round(total, 2) AS total FROM (SELECT sum(l_quantity) AS l_quantity, sum(l_extendedprice) AS l_extendedprice, sum(l_discount) AS l_discount FROM lineitem) UNPIVOT (total FOR name IN (l_quantity, l_extendedprice, l_discount))",
)
def _(t):
    return rounded(S.column_totals(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), 2)


@query(
    "D12_major_groups",
    """WITH s AS (SELECT p_type, sum(p_retailprice) AS a FROM part GROUP BY 1), r AS (SELECT p_type, a, a / sum(a) OVER () AS rel, sum(a) OVER (ORDER BY a DESC, p_type) / sum(a) OVER () AS cum FROM s)
SELECT p_type, round(a, 2) AS absolute, round(rel, 6) AS relative, round(cum, 6) AS cumulative FROM r WHERE rel > 0.05""",
)
def _(t):
    return rounded(S.major_groups(t.part, "p_type", "p_retailprice").withColumn("absolute", F.round("absolute", 2)), 6)


@query("D13_sum_all", "SELECT l_partkey, round(sum(l_quantity), 4) AS l_quantity, round(sum(l_tax), 4) AS l_tax FROM lineitem GROUP BY 1")
def _(t):
    return rounded(S.sum_all(t.lineitem, ["l_partkey"], ["l_quantity", "l_tax"]))


@query("D14_pearson", f"WITH {PLOTS} SELECT country, count(*) AS n, round(corr(reported_area_ha, measured_plot_area_ha), 5) AS r, round(pow(corr(reported_area_ha, measured_plot_area_ha), 2), 5) AS r2_corr FROM plots WHERE reported_area_ha IS NOT NULL AND measured_plot_area_ha IS NOT NULL GROUP BY 1")
def _(t):
    return rounded(S.pearson(plots(t), ["country"], "reported_area_ha", "measured_plot_area_ha"), 5)


def _corr_sql():
    from itertools import combinations

    return " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) AS n, round(corr({a}, {b}), 5) AS r FROM lineitem" for a, b in combinations(LINE, 2))


@query("D15_correlation_pairs", _corr_sql())
def _(t):
    return rounded(S.correlation_pairs(t.lineitem, LINE), 5)


@query("D15_strong_pairs", f"SELECT * FROM ({_corr_sql()}) WHERE abs(r) > 0.005")
def _(t):
    return rounded(S.strong_pairs(S.correlation_pairs(t.lineitem, LINE), 0.005), 5)


@query("D15_ranked_with_target", f"SELECT CASE WHEN var_a = 'l_tax' THEN var_b ELSE var_a END AS variable, r FROM ({_corr_sql()}) WHERE var_a = 'l_tax' OR var_b = 'l_tax'")
def _(t):
    return rounded(S.ranked_with_target(S.correlation_pairs(t.lineitem, LINE), "l_tax"), 5)


def _p_sql():
    """Student's t by its finite series: even and odd degrees of freedom."""
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS var_a, '{b}' AS var_b, count(*) AS n, corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1 :])
    return f"""WITH c AS (SELECT *, n - 2 AS nu, ln(1 - r * r) AS lc FROM ({pairs})), k AS (SELECT range AS k FROM range(1, 400000)),
 f AS (SELECT k, sum(ln((2 * k - 1) / (2 * k))) OVER (ORDER BY k) AS even, sum(ln((2 * k) / (2 * k + 1))) OVER (ORDER BY k) AS odd FROM k),
 e AS (SELECT var_a, var_b, 1 + sum(exp(CASE WHEN nu % 2 = 0 THEN even ELSE odd END + k * lc)) AS s FROM c JOIN f ON k <= (nu - 2 - nu % 2) // 2 GROUP BY 1, 2),
 p AS (SELECT c.*, CASE WHEN nu % 2 = 0 THEN 1 - abs(r) * s ELSE 1 - 2 / pi() * (atan(abs(r) / sqrt(1 - r * r)) + abs(r) * sqrt(1 - r * r) * s) END AS p FROM c JOIN e USING (var_a, var_b))
SELECT var_a, var_b, n, round(r, 5) AS r, round(p, 5) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p"""


@query("D16_correlation_test", _p_sql())
def _(t):
    return rounded(S.correlation_test(t.lineitem, LINE), 5)


@query(
    "D17_moments",
    """WITH m AS (SELECT l_returnflag AS flag, count(*)::DOUBLE AS n, avg(l_extendedprice) AS mu FROM lineitem GROUP BY 1), c AS (
  SELECT flag, any_value(n) AS n, avg(pow(l_extendedprice - mu, 2)) AS m2, avg(pow(l_extendedprice - mu, 3)) AS m3, avg(pow(l_extendedprice - mu, 4)) AS m4 FROM lineitem JOIN m ON flag = l_returnflag GROUP BY flag)
SELECT flag, CAST(n AS BIGINT) AS n, round(m3 / pow(m2, 1.5), 4) AS skew_pop, round(m4 / (m2 * m2), 4) AS kurtosis, round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 4) AS skew_sample FROM c""",
)
def _(t):
    return rounded(S.moments(t.lineitem.withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_extendedprice"))


GINI_SQL = """SELECT {k}, count(*) AS n, round(2 * sum(i * {v}) / (count(*) * sum({v})) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini
 FROM (SELECT {k}, {v}, row_number() OVER (PARTITION BY {k} ORDER BY {v}) AS i FROM {t}) GROUP BY 1"""


@query("D18_gini", GINI_SQL.format(k="l_returnflag", v="l_quantity", t="lineitem"))
def _(t):
    return rounded(S.gini(t.lineitem, ["l_returnflag"], "l_quantity"), 6)


@query(
    "D19_regression_metrics",
    f"""WITH {PLOTS}, p AS (SELECT country, reported_area_ha AS o, measured_plot_area_ha AS p FROM plots WHERE reported_area_ha IS NOT NULL AND measured_plot_area_ha IS NOT NULL)
SELECT country, count(*) AS n, round(avg(abs(p - o)), 5) AS mae, round(sqrt(avg(pow(p - o, 2))), 5) AS rmse, round(avg(p - o), 5) AS bias, round(1 - sum(pow(p - o, 2)) / (var_pop(o) * count(*)), 5) AS r2_sse,
 round(pow(corr(o, p), 2), 5) AS r2_corr, round(stddev_pop(o) / (sqrt(avg(pow(p - o, 2))) + 1e-9), 5) AS rpd, round(sqrt(avg(pow(p - o, 2))) / avg(o), 5) AS rrmse FROM p GROUP BY 1""",
)
def _(t):
    return rounded(S.regression_metrics(plots(t), ["country"], "reported_area_ha", "measured_plot_area_ha"), 5)


@query(
    "D20_summarise_folds",
    "SELECT p_brand, round(avg(p_retailprice), 4) AS p_retailprice_mean, round(stddev_samp(p_retailprice), 4) AS p_retailprice_sd, count(p_retailprice) AS p_retailprice_folds FROM part GROUP BY 1",
)
def _(t):
    return rounded(S.summarise_folds(t.part, ["p_brand"], ["p_retailprice"]))


@query(
    "D21_hyper_response",
    """SELECT parameter, value, p_type, count(*) AS n, round(avg(p_retailprice), 4) AS p_retailprice_mean, round(stddev_samp(p_retailprice), 4) AS p_retailprice_sd FROM (
 SELECT 'p_size' AS parameter, CAST(p_size AS VARCHAR) AS value, p_type, p_retailprice FROM part UNION ALL SELECT 'p_brand', p_brand, p_type, p_retailprice FROM part) GROUP BY ALL""",
)
def _(t):
    return rounded(S.hyper_response(t.part, ["p_size", "p_brand"], ["p_retailprice"], "p_type"))


@query(
    "D22_mean_rank",
    "SELECT p_type, round(avg(rk), 6) AS mean_rank, count(*) AS n_units FROM (SELECT p_type, rank() OVER (PARTITION BY p_brand ORDER BY s DESC) AS rk FROM (SELECT p_brand, p_type, sum(p_retailprice) AS s FROM part GROUP BY 1, 2)) GROUP BY 1",
)
def _(t):
    scores = t.part.groupBy("p_brand", "p_type").agg(F.sum("p_retailprice").alias("s"))
    return rounded(S.mean_rank(scores, "p_brand", "p_type", "s"), 6)


@query(
    "D23_measurement_quality",
    f"""WITH {PLOTS}, p AS (SELECT *, CASE WHEN measured_plot_area_ha > 0 AND reported_area_ha > 0 THEN reported_area_ha / measured_plot_area_ha END AS ratio FROM plots)
SELECT region, count(*) AS n_plots, count(measured_plot_area_ha) AS n_measured, round(100.0 * count(measured_plot_area_ha) / count(*), 5) AS pct_measured, count(ratio) AS n_both,
 round(corr(reported_area_ha, measured_plot_area_ha) FILTER (ratio IS NOT NULL), 5) AS r, round(avg(ratio), 5) AS ratio_mean, round(stddev_samp(ratio), 5) AS ratio_sd,
 round(100.0 * count(*) FILTER (ratio > 1) / count(ratio), 5) AS pct_over, round(quantile_cont(ratio, 0.5), 5) AS ratio_median FROM p GROUP BY 1""",
)
def _(t):
    return rounded(S.measurement_quality(plots(t), ["region"], "measured_plot_area_ha", "reported_area_ha"), 5)


@query("D24_rejection_rate", "SELECT l_returnflag, count(*) AS n, round(100.0 * count(*) FILTER (l_tax < 0.05) / count(*), 5) AS pct_rejected FROM lineitem GROUP BY 1")
def _(t):
    return rounded(S.rejection_rate(t.lineitem, ["l_returnflag"], "l_tax"), 5)


@query(
    "D25_ecdf",
    "SELECT l_returnflag, l_quantity, round(max(cd), 6) AS ecdf FROM (SELECT l_returnflag, l_quantity, cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS cd FROM lineitem) GROUP BY 1, 2",
)
def _(t):
    return rounded(S.ecdf(t.lineitem, ["l_returnflag"], "l_quantity"), 6)


@query(
    "D26_density_grid",
    """WITH b AS (SELECT CAST(1 + floor((l_quantity - 0) / 60 * 20) AS BIGINT) AS x_bin, CAST(1 + floor(l_extendedprice / 110000 * 20) AS BIGINT) AS y_bin FROM lineitem), c AS (SELECT x_bin, y_bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT x_bin, y_bin, n, round(n / (sum(n) OVER () * (3.0 * 5500.0)), 9) AS density FROM c""",
)
def _(t):
    return rounded(S.density_grid(t.lineitem, "l_quantity", "l_extendedprice", 20, (0, 60, 0, 110000)), 9)


@query(
    "D27_box_stats",
    "SELECT c_mktsegment, round(min(c_acctbal), 4) AS low, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(quantile_cont(c_acctbal, 0.5), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q3, round(max(c_acctbal), 4) AS high FROM customer GROUP BY 1",
)
def _(t):
    return rounded(S.box_stats(t.customer, ["c_mktsegment"], "c_acctbal"))


@query(
    "D28_ols_line",
    "SELECT l_returnflag, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1",
)
def _(t):
    df = S.ols_line(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return rounded(df.withColumns({"slope": F.round("slope", 3), "intercept": F.round("intercept", 3)}), 6)


@query(
    "D29_upper_envelope",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem QUALIFY row_number() OVER (PARTITION BY ceil(l_quantity / 5.0) ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 10)
SELECT CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(regr_r2(y, x), 4) AS r2 FROM p""",
)
def _(t):
    return rounded(S.upper_envelope(t.lineitem, "l_quantity", "l_extendedprice", 5.0, 10, ["l_orderkey", "l_linenumber", "l_partkey"]))


@query(
    "D30_ellipse",
    """WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS cx, avg(l_discount * 100) AS cy, var_samp(l_quantity) AS a, var_samp(l_discount * 100) AS b, covar_samp(l_quantity, l_discount * 100) AS c FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, round(cx, 4) AS cx, round(cy, 4) AS cy, round(sqrt(-2 * ln(0.05) * ((a + b) / 2 + sqrt(pow((a - b) / 2, 2) + c * c))), 4) AS major,
 round(sqrt(-2 * ln(0.05) * ((a + b) / 2 - sqrt(pow((a - b) / 2, 2) + c * c))), 4) AS minor, round(atan2(2 * c, a - b) / 2, 4) AS angle FROM m""",
)
def _(t):
    return rounded(S.ellipse(t.lineitem.withColumn("d", F.col("l_discount") * 100), ["l_returnflag"], "l_quantity", "d", 0.95))


@query("D31_location_counts", f"WITH {POINTS} SELECT x, y, count(*) AS n FROM points GROUP BY 1, 2")
def _(t):
    return S.value_counts(points(t), ["x", "y"])


@query(
    "D32_row_mean",
    f"WITH {PLOTS} SELECT country, round(sum(CASE WHEN measured_plot_area_ha IS NULL THEN reported_area_ha WHEN reported_area_ha IS NULL THEN measured_plot_area_ha ELSE (measured_plot_area_ha + reported_area_ha) / 2 END), 3) AS total FROM plots GROUP BY 1",
)
def _(t):
    return rounded(plots(t).groupBy("country").agg(F.sum(N.row_mean(["measured_plot_area_ha", "reported_area_ha"])).alias("total")), 3)


@query(
    "D33_vif",
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM r)
SELECT 'l_quantity' AS variable, round((1 - bc * bc) / det, 6) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round((1 - ac * ac) / det, 6) FROM d UNION ALL SELECT 'l_discount', round((1 - ab * ab) / det, 6) FROM d""",
)
def _(t):
    return rounded(S.vif(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), 6)


@query(
    "D34_quantile_bands",
    """WITH l AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT label, CAST(i AS INTEGER) AS quantile, round(min(v)::DOUBLE, 5) AS low, round(avg(v::DOUBLE), 5) AS central, round(max(v)::DOUBLE, 5) AS high FROM l GROUP BY 1, 2""",
)
def _(t):
    df = t.embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return rounded(S.quantile_bands(df, "label", "embedding"), 5)


@query(
    "D35_check_contract",
    f"""WITH {PLOTS} SELECT 'column country' AS rule, 0::BIGINT AS violations UNION ALL SELECT 'column elevation', 1 UNION ALL SELECT 'area_positive', count(*) FILTER (NOT coalesce(reported_area_ha > 0, false)) FROM plots UNION ALL
 SELECT 'x_range', count(*) FILTER (NOT (x BETWEEN -18 AND 40)) FROM plots UNION ALL SELECT 'min_rows', 0 UNION ALL SELECT 'countries', CASE WHEN count(DISTINCT country) < 30 THEN 1 ELSE 0 END FROM plots UNION ALL
 SELECT 'median_range', CASE WHEN quantile_cont(reported_area_ha, 0.5) BETWEEN 0.1 AND 10 THEN 0 ELSE 1 END FROM plots""",
)
def _(t):
    return S.check_contract(
        plots(t), ["country", "elevation"], {"area_positive": F.col("reported_area_ha") > 0, "x_range": F.col("x").between(-18, 40)},
        {"countries": ("country", 30)}, min_rows=100, median=("reported_area_ha", 0.1, 10),
    )


# E: windows and ranks ------------------------------------------------------------
@query(
    "E1_cumulate",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cum_o_totalprice FROM orders",
)
def _(t):
    df = W.cumulate(t.orders, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    return rounded(df.select("o_orderkey", "cum_o_totalprice"), 2)


@query(
    "E2_share_curves",
    """WITH s AS (SELECT l_returnflag AS grp, l_quantity, sum(l_extendedprice) AS price, sum(l_tax) AS tax FROM lineitem GROUP BY 1, 2), u AS (SELECT * FROM s UNION ALL SELECT 'all', l_quantity, sum(price), sum(tax) FROM s GROUP BY l_quantity)
SELECT grp, l_quantity, round(sum(price) OVER w / sum(price) OVER (PARTITION BY grp), 6) AS price, round(sum(tax) OVER w / sum(tax) OVER (PARTITION BY grp), 6) AS tax FROM u WINDOW w AS (PARTITION BY grp ORDER BY l_quantity ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("grp"), "l_quantity", F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    return rounded(W.share_curves(df, ["grp"], "l_quantity", ["price", "tax"], overall="all"), 6)


@query(
    "E3_decumulate",
    "SELECT o_orderkey, round(coalesce(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_totalprice), 2) AS step_o_totalprice FROM orders",
)
def _(t):
    df = W.decumulate(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    return rounded(df.select("o_orderkey", "step_o_totalprice"), 2)


@query("E4_top_k", "SELECT p_brand, p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS rank FROM part QUALIFY rank <= 10")
def _(t):
    return W.top_k(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", 10, ["p_partkey"])


@query("E5_first_past", "SELECT l_returnflag, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS INTEGER) AS step FROM lineitem WHERE l_extendedprice > 50000 QUALIFY step <= 2")
def _(t):
    return W.first_past(t.lineitem.select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 50000, 2)


@query(
    "E6_crossing",
    """WITH s AS (SELECT l_returnflag AS grp, l_extendedprice AS size, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), c AS (SELECT grp, size, sum(q) OVER (PARTITION BY grp ORDER BY size ROWS UNBOUNDED PRECEDING) / sum(q) OVER (PARTITION BY grp) AS q FROM s)
SELECT grp, size, round(q, 6) AS q FROM c WHERE q > 0.4999 AND q < 0.501""",
)
def _(t):
    df = t.lineitem.select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("size"), F.col("l_quantity").alias("q"))
    return rounded(W.crossing(W.share_curves(df, ["grp"], "size", ["q"]), "q"), 6)


@query("E7_distinct_keep_first", f"WITH {POINTS} SELECT CAST(round(x) AS BIGINT) || '_' || CAST(round(y) AS BIGINT) AS spot, point_id FROM points QUALIFY row_number() OVER (PARTITION BY round(x), round(y) ORDER BY point_id) = 1")
def _(t):
    df = points(t).select(F.concat_ws("_", F.round("x").cast("long").cast("string"), F.round("y").cast("long").cast("string")).alias("spot"), "point_id")
    return W.distinct_keep_first(df, ["spot"], ["point_id"])


@query("E21_rank_desc", "SELECT l_orderkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC) AS rank FROM lineitem")
def _(t):
    return W.rank_desc(t.lineitem, ["l_returnflag"], "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("E22_category_code", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part")
def _(t):
    return W.category_code(t.part, "p_name").select("p_partkey", "code")


# folds ------------------------------------------------------------------------------
@query(
    "E17_stratified_folds",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS c FROM lineitem), s AS (SELECT CAST((l_extendedprice > c[1])::INT + (l_extendedprice > c[2])::INT + (l_extendedprice > c[3])::INT AS INTEGER) AS stratum FROM lineitem, q),
 n AS (SELECT stratum, count(*) AS m FROM s GROUP BY 1)
SELECT stratum, CAST(f AS INTEGER) AS fold, m // 5 + CASE WHEN f < m % 5 THEN 1 ELSE 0 END AS n FROM n, range(5) r(f)""",
)
def _(t):
    df = K.stratified_folds(t.lineitem, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5, seed=1)
    return df.groupBy("stratum", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "E18_group_folds",
    """WITH g AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
 o AS (SELECT *, (row_number() OVER (ORDER BY n DESC, c_nationkey) - 1) % 10 AS turn FROM g)
SELECT c_nationkey, n, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INTEGER) AS fold, 1::BIGINT AS n_folds FROM o""",
)
def _(t):
    df = K.group_folds(t.customer, "c_nationkey", 5)
    return df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.max("fold").alias("fold"), F.countDistinct("fold").alias("n_folds"))


@query("E19_random_folds", "SELECT count(*) AS n, 10::BIGINT AS n_folds, true AS balanced, true AS disjoint FROM orders")
def _(t):
    folded = K.random_folds(t.orders, ["o_orderkey"], 10)
    sizes = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))
    balanced = F.max(F.abs(F.col("n") * 10 - F.col("_all"))) < 0.25 * F.max("_all")
    sizes = sizes.withColumn("_all", folded.agg(F.count(F.lit(1))).scalar())
    keys = folded.agg(F.countDistinct("o_orderkey")).scalar()
    return sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_folds"), balanced.alias("balanced"), (F.sum("keys") == F.max(keys)).alias("disjoint"))


@query("E19_train_test", "SELECT count(*) AS n, 0::BIGINT AS n_both, true AS near_share FROM orders")
def _(t):
    train, test = K.train_test(t.orders, ["o_orderkey"], 0.7, seed=7)
    sides = train.select("o_orderkey", F.lit(1).alias("train")).unionByName(test.select("o_orderkey", F.lit(0).alias("train")))
    per_key = sides.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg("train").alias("train"))
    return per_key.agg(F.sum("n").alias("n"), F.count_if(~F.col("train").isin(0.0, 1.0)).alias("n_both"), F.avg("train").between(0.65, 0.75).alias("near_share"))


@query("E20_logo_plan", "SELECT row_number() OVER (ORDER BY n_name) AS fold, n_name AS test_unit, count(*) AS n_test, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t):
    return K.logo_plan(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), "n_name")


# F, G, H: sorting, sets, reshaping ---------------------------------------------------
@query("F1_sort_by", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def _(t):
    return R.sort_by(t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice"), o_orderpriority="asc", o_totalprice="desc", o_orderkey="asc")


@query("F2_top_report", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return R.top_report(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 20, ["o_orderkey"])


@query("F3_lattice_sample", f"WITH {POINTS} SELECT point_id FROM points WHERE (CAST(round(x * 100) AS BIGINT) + 1800) % 15 = 0 AND (CAST(round(y * 100) AS BIGINT) + 3500) % 15 = 0")
def _(t):
    return R.lattice_sample(points(t), "x", "y", -18, -35, 0.15, digits=2).select("point_id")


@query("F4_seeded_sample", "SELECT 1000::BIGINT AS n, 1000::BIGINT AS n_distinct, 1000::BIGINT AS n_present, true AS repeatable")
def _(t):
    once, again = (R.seeded_sample(t.orders, ["o_orderkey"], 1000, seed=3) for _ in range(2))
    present = once.join(t.orders.select("o_orderkey"), "o_orderkey", "left_semi").agg(F.count(F.lit(1))).scalar()
    differing = once.join(again.select("o_orderkey"), "o_orderkey", "left_anti").agg(F.count(F.lit(1))).scalar()
    return once.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("n_distinct"), F.max(present).alias("n_present"), (F.max(differing) == 0).alias("repeatable"))


@query("G1_union_all", "SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def _(t):
    return t.supplier.select(F.col("s_name").alias("name")).unionByName(t.customer.select(F.col("c_name").alias("name")))


@query("G2_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("G3_difference", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def _(t):
    other = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return R.difference(t.part.select("p_partkey"), other, ["p_partkey"])


@query(
    "G4_merge_layers",
    "SELECT coalesce(a.k, b.k) AS cell_id, coalesce(a.v, b.v) AS value FROM (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size < 20) a FULL JOIN (SELECT l_partkey AS k, max(l_extendedprice) AS v FROM lineitem GROUP BY 1) b ON a.k = b.k",
)
def _(t):
    a = t.part.where("p_size < 20").select(F.col("p_partkey").alias("cell_id"), F.col("p_retailprice").alias("value"))
    b = t.lineitem.groupBy(F.col("l_partkey").alias("cell_id")).agg(F.max("l_extendedprice").alias("value"))
    return R.merge_layers([a, b])


@query("G5_select_present", "SELECT p_partkey, p_size FROM part")
def _(t):
    from plotwise.operators.clean import select_present

    return select_present(t.part, ["p_partkey", "p_colour", "p_size"])


@query("H1_to_long", "SELECT l_orderkey, l_linenumber, l_partkey, name, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS discount, l_quantity AS quantity FROM lineitem) UNPIVOT (value FOR name IN (discount, quantity))")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("m_discount"), F.col("l_quantity").alias("m_quantity"))
    return R.to_long(df, ["l_orderkey", "l_linenumber", "l_partkey"], "m_")


@query("H2_to_wide", 'SELECT l_partkey, round(sum(l_quantity) FILTER (l_returnflag = \'A\'), 2) AS "A", round(sum(l_quantity) FILTER (l_returnflag = \'N\'), 2) AS "N", round(sum(l_quantity) FILTER (l_returnflag = \'R\'), 2) AS "R" FROM lineitem GROUP BY 1')
def _(t):
    return rounded(R.to_wide(t.lineitem, ["l_partkey"], "l_returnflag", ["A", "N", "R"], F.sum("l_quantity")), 2)


@query("H3_unnest", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS INTEGER) AS pos, round(unnest(embedding)::DOUBLE, 5) AS a, round(unnest(embedding)::DOUBLE * 2, 5) AS b FROM embeddings")
def _(t):
    df = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return rounded(R.unnest(df.withColumn("b", F.transform("a", lambda v: v * 2)), ["a", "b"]), 5)


@query("H4_bands_to_array", "SELECT p_partkey, [CAST(p_size AS DOUBLE), p_retailprice] AS bands FROM part")
def _(t):
    df = t.part.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return R.bands_to_array(df, ["p_size", "p_retailprice"], "bands")


@query("H5_array_to_bands", "SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS q1, round(embedding[2]::DOUBLE, 5) AS q2, round(embedding[3]::DOUBLE, 5) AS q3 FROM embeddings")
def _(t):
    df = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rounded(R.array_to_bands(df, "e", 3), 5)
