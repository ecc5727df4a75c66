"""Distribution operators on cells of customer points and quantile arrays."""

from pyspark.sql import functions as F

from plotwise.catalog.base import NX, RES, X0, Y0, point_x, point_y, SQL_X, SQL_Y, query, rounded
from plotwise.catalog.survey import SIZE_CASE, SIZE_LABELS
from plotwise.operators import distribution as L
from plotwise.operators import stats as S
from plotwise.operators.geo import Grid

COARSE = Grid(X0, Y0, 10.0, 7)
FARM_SQL = f"""units AS (SELECT CAST(floor(({SQL_Y.format(k='o_custkey')} + 35) / 10) * 7 + floor(({SQL_X.format(k='o_custkey')} + 18) / 10) AS BIGINT) AS cell_id,
  o_orderkey, o_totalprice / 50000 AS size_ha, o_orderpriority AS zone, o_orderstatus AS status, o_orderdate FROM orders)"""


def units(t):
    k = F.col("o_custkey")
    return t.orders.select(
        COARSE.cell(point_x(k), point_y(k)).alias("cell_id"), "o_orderkey", (F.col("o_totalprice") / 50000).alias("size_ha"),
        F.col("o_orderpriority").alias("zone"), F.col("o_orderstatus").alias("status"), "o_orderdate",
    )


QUANT_SQL = "q AS (SELECT vec_id, 10 + vec_id % 40 AS n, list_sort(list_transform(embedding, lambda v: abs(v::DOUBLE) * 3)) AS q FROM embeddings)"


def quantile_cells(t):
    q = F.sort_array(F.transform("embedding", lambda v: F.abs(v.cast("double")) * 3))
    return t.embeddings.select("vec_id", (10 + F.col("vec_id") % 40).alias("n"), q.alias("q"))


@query(
    "L1_ks_two_sample",
    f"""WITH {FARM_SQL}, c AS (SELECT zone, size_ha AS v, count(*) FILTER (status = 'F') AS a, count(*) FILTER (status = 'O') AS b FROM units WHERE status IN ('F', 'O') GROUP BY 1, 2),
 r AS (SELECT zone, sum(a) OVER w AS ra, sum(b) OVER w AS rb, sum(a) OVER (PARTITION BY zone) AS na, sum(b) OVER (PARTITION BY zone) AS nb FROM c WINDOW w AS (PARTITION BY zone ORDER BY v)), d AS (
 SELECT zone, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, max(abs(ra / na - rb / nb)) AS ks_d FROM r GROUP BY 1)
SELECT zone, n_a, n_b, round(ks_d, 6) AS ks_d, round(least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * j * j * ks_d * ks_d * n_a * n_b / (n_a + n_b)))))), 5) AS ks_p FROM d""",
)
def _(t):
    u = units(t)
    df = L.ks_two_sample(u.where("status = 'F'"), u.where("status = 'O'"), ["zone"], "size_ha")
    return rounded(df.withColumn("ks_p", F.round("ks_p", 5)), 6)


@query(
    "L2_multinomial_fit",
    f"""WITH {FARM_SQL}, q AS (SELECT cell_id, quantile_cont(size_ha, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM units GROUP BY 1), e AS (
 SELECT cell_id, q, list_sort(list_distinct(q)) AS e FROM q), c AS (SELECT cell_id, len(list_filter(e, lambda x: x < size_ha)) AS class, count(*)::DOUBLE AS n FROM units JOIN e USING (cell_id) GROUP BY ALL), p AS (
 SELECT cell_id, n, CASE WHEN class < len(e) THEN len(list_filter(q, lambda x: x = e[class + 1])) ELSE 0.01::DOUBLE END / 10.01::DOUBLE AS p FROM c JOIN e USING (cell_id))
SELECT cell_id, sum(n)::BIGINT AS n, round(sum(n * ln(n / p)) - sum(n) * ln(sum(n)), 5) AS llr, true AS p_in_range FROM p GROUP BY 1""",
)
def _(t):
    u = units(t)
    q = S.O.group_quantiles(u, ["cell_id"], "size_ha", {f"q{i}": i / 10 for i in range(1, 11)})
    q = q.select("cell_id", F.array(*[f"q{i}" for i in range(1, 11)]).alias("quantiles"))
    found = L.multinomial_fit(u, q, ["cell_id"], "size_ha", ["o_orderkey"], trials=1000, seed=5)
    return rounded(found.select("cell_id", "n", "llr", F.col("p").between(0, 1).alias("p_in_range")), 5)


@query("L3_fit_lognormal", f"WITH {FARM_SQL} SELECT zone, count(*) AS n, round(avg(ln(greatest(size_ha, 0.001))), 6) AS logn_mean, round(stddev_pop(ln(greatest(size_ha, 0.001))), 6) AS logn_sd FROM units GROUP BY 1")
def _(t):
    return rounded(L.fit_lognormal(units(t), ["zone"], "size_ha"), 6)


@query(
    "L4_lognormal_from_moments",
    f"""WITH {FARM_SQL}, m AS (SELECT zone, avg(size_ha) AS m, stddev_samp(size_ha) AS s FROM units GROUP BY 1)
SELECT zone, round(ln(m * m / sqrt(m * m + s * s)), 6) AS adjusted_logn_mean, round(sqrt(ln(1 + s * s / (m * m))), 6) AS adjusted_logn_sd FROM m""",
)
def _(t):
    m = units(t).groupBy("zone").agg(F.avg("size_ha").alias("m"), F.stddev_samp("size_ha").alias("s"))
    return rounded(L.with_lognormal_from_moments(m, "m", "s").drop("m", "s"), 6)


@query(
    "L5_lognormal_moments",
    f"""WITH {FARM_SQL}, m AS (SELECT zone, avg(ln(size_ha)) AS m, stddev_pop(ln(size_ha)) AS s FROM units GROUP BY 1)
SELECT zone, round(exp(m + s * s / 2), 4) AS arith_mean, round(sqrt((exp(s * s) - 1) * exp(2 * m + s * s)), 4) AS arith_sd FROM m""",
)
def _(t):
    m = L.fit_lognormal(units(t), ["zone"], "size_ha")
    return rounded(L.with_lognormal_moments(m, "logn_mean", "logn_sd").select("zone", "arith_mean", "arith_sd"))


EXPAND = """SELECT vec_id, j + 1 AS unit, round(q[floor(p)::INT + 1] + (q[ceil(p)::INT + 1] - q[floor(p)::INT + 1]) * (p - floor(p)), 5) AS size_ha FROM (
  SELECT vec_id, q, n, unnest(range(0, {n})) AS j, CASE WHEN {n} > 1 THEN unnest(range(0, {n})) * (len(q) - 1) / ({n} - 1)::DOUBLE ELSE 0 END AS p FROM q)"""


@query("L6_expand_population", f"WITH {QUANT_SQL} " + EXPAND.format(n="n"))
def _(t):
    return rounded(L.expand_population(quantile_cells(t), ["vec_id"], "n", "q"), 5)


@query("L7_expand_keep_max", f"WITH {QUANT_SQL} " + EXPAND.format(n="(n - 1)") + " UNION ALL SELECT vec_id, n, round(list_max(q), 5) FROM q")
def _(t):
    return rounded(L.expand_population(quantile_cells(t), ["vec_id"], "n", "q", keep_max=True), 5)


def _sample_check(df, cells, col="size_ha"):
    """Per cell: units drawn, and whether all stay within the quantile range."""
    ends = cells.select("vec_id", F.array_min("q").alias("lo"), F.array_max("q").alias("hi"))
    inside = F.col(col).between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)
    return df.join(ends, "vec_id").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~inside).alias("n_outside"))


@query("L8_sample_population", "SELECT vec_id, 10 + vec_id % 40 AS n, 0::BIGINT AS n_outside FROM embeddings")
def _(t):
    cells = quantile_cells(t)
    return _sample_check(L.sample_population(cells, ["vec_id"], "n", "q", seed=2024), cells)


@query("L9_sample_trunc_lognormal", "SELECT vec_id, 10 + vec_id % 40 AS n, 0::BIGINT AS n_outside FROM embeddings")
def _(t):
    cells = quantile_cells(t)
    return _sample_check(L.sample_trunc_lognormal(cells, ["vec_id"], "n", "q", seed=2024), cells)


@query(
    "L10_share_below",
    f"""WITH {FARM_SQL} SELECT cell_id, count(*) AS n, round(sum(size_ha), 4) AS total, count(*) FILTER (size_ha < 0.5) AS nb_0_5, round(coalesce(sum(size_ha) FILTER (size_ha < 0.5), 0), 4) AS sum_0_5, count(*) FILTER (size_ha < 2) AS nb_2,
 round(coalesce(sum(size_ha) FILTER (size_ha < 2), 0), 4) AS sum_2, round(avg((size_ha < 0.5)::INT), 4) AS share_nb_0_5, round(avg((size_ha < 2)::INT), 4) AS share_nb_2,
 round(coalesce(sum(size_ha) FILTER (size_ha < 0.5), 0) / sum(size_ha), 4) AS share_sum_0_5, round(coalesce(sum(size_ha) FILTER (size_ha < 2), 0) / sum(size_ha), 4) AS share_sum_2 FROM units GROUP BY 1""",
)
def _(t):
    return rounded(S.share_below(units(t), ["cell_id"], "size_ha", [0.5, 2]))


CUTS = [1, 2, 5, 10]
CLASS_SQL = f"""cls AS (SELECT zone, CAST(c AS DOUBLE) AS size_class, count(*) FILTER (size_ha < c) AS cum_nb, coalesce(sum(size_ha) FILTER (size_ha < c), 0) AS cum_ha,
  count(*) FILTER (size_ha < c AND size_ha >= p) AS nb, coalesce(sum(size_ha) FILTER (size_ha < c AND size_ha >= p), 0) AS ha FROM units, (VALUES (1, 0), (2, 1), (5, 2), (10, 5)) k(c, p) GROUP BY 1, 2)"""


@query("L11_size_classes", f"WITH {FARM_SQL}, {CLASS_SQL} SELECT zone, size_class, cum_nb, round(cum_ha, 4) AS cum_ha, nb, round(ha, 4) AS ha FROM cls")
def _(t):
    return rounded(L.size_classes(units(t), ["zone"], "size_ha", CUTS))


@query(
    "L12_compare_classes",
    f"""WITH {FARM_SQL}, {CLASS_SQL}, ref AS (SELECT CASE WHEN p_size % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS zone, CASE WHEN p_size <= 10 THEN 1.0 WHEN p_size <= 20 THEN 2.0 WHEN p_size <= 30 THEN 5.0 ELSE 10.0 END::DOUBLE AS size_class, sum(p_size) AS v FROM part GROUP BY 1, 2)
SELECT zone, size_class, nb, CAST(v AS BIGINT) AS ref_farms, CAST(sum(v) OVER (PARTITION BY zone ORDER BY size_class) AS BIGINT) AS ref_cum_farms FROM cls JOIN ref USING (zone, size_class)""",
)
def _(t):
    size = F.col("p_size")
    zone = F.when(size % 2 == 0, "1-URGENT").otherwise("5-LOW")
    cls = F.when(size <= 10, 1.0).when(size <= 20, 2.0).when(size <= 30, 5.0).otherwise(10.0)
    ref = t.part.groupBy(zone.alias("zone"), cls.alias("size_class")).agg(F.sum("p_size").alias("farms"))
    pred = L.size_classes(units(t), ["zone"], "size_ha", CUTS)
    return L.compare_classes(pred, ref, ["zone"], "size_class", "farms").select("zone", "size_class", "nb", "ref_farms", "ref_cum_farms")


@query(
    "L13_compare_counts",
    """WITH e AS (SELECT c_nationkey AS unit, sum(c_acctbal) AS est FROM customer GROUP BY 1), o AS (SELECT s_nationkey AS unit, count(*) AS obs FROM supplier GROUP BY 1), b AS (SELECT * FROM e JOIN o USING (unit))
SELECT count(*) AS n_units, round(sum(est), 2) AS total_est, CAST(sum(obs) AS BIGINT) AS total_obs, round(pow(corr(est, obs), 2), 6) AS r2_corr, round(pow(corr(est, obs) FILTER (unit NOT IN (3, 7)), 2), 6) AS r2_without FROM b""",
)
def _(t):
    e = t.customer.groupBy(F.col("c_nationkey").alias("unit")).agg(F.sum("c_acctbal").alias("est"))
    o = t.supplier.groupBy(F.col("s_nationkey").alias("unit")).agg(F.count(F.lit(1)).alias("obs"))
    df = L.compare_counts(e, o, "unit", "est", "obs", [3, 7])
    return rounded(df.withColumn("total_est", F.round("total_est", 2)), 6)


GINI = "2 * sum(i * size_ha) / (count(*) * sum(size_ha)) - (count(*) + 1) / count(*)::DOUBLE"


@query(
    "L14_heterogeneity",
    f"""WITH {FARM_SQL}, r AS (SELECT cell_id, size_ha, row_number() OVER (PARTITION BY cell_id ORDER BY size_ha) AS i FROM units)
SELECT cell_id, count(*) AS n, round(avg(size_ha), 5) AS mean, round(stddev_samp(size_ha), 5) AS sd, round({GINI}, 5) AS gini FROM r GROUP BY 1 HAVING count(*) > 9""",
)
def _(t):
    return rounded(L.heterogeneity(units(t), ["cell_id"], "size_ha"), 5)


@query(
    "L15_zone_farm_stats",
    f"""WITH {FARM_SQL}, r AS (SELECT zone, size_ha, row_number() OVER (PARTITION BY zone ORDER BY size_ha) AS i FROM units)
SELECT zone, count(*) AS n, round(avg(size_ha), 5) AS avg, round(stddev_samp(size_ha), 5) AS sd, round(sum(size_ha), 5) AS total, round(quantile_cont(size_ha, 0.5), 5) AS med, round({GINI}, 5) AS gini,
 count(*) FILTER (size_ha < 1) AS nb_1, round(coalesce(sum(size_ha) FILTER (size_ha < 1), 0), 5) AS sum_1, round(avg((size_ha < 1)::INT), 5) AS share_nb_1, round(coalesce(sum(size_ha) FILTER (size_ha < 1), 0) / sum(size_ha), 5) AS share_sum_1 FROM r GROUP BY 1""",
)
def _(t):
    return rounded(L.zone_farm_stats(units(t), "zone", "size_ha", [1]), 5)


def _threshold_sql():
    case = SIZE_CASE.format(c="size_ha")
    one = lambda f: (
        f"SELECT product, '{f}' AS grouping_factor, CAST({f} AS VARCHAR) AS group_modality, threshold, sum(value) AS value FROM l GROUP BY ALL"
    )
    cols = ", ".join(f"""coalesce(round(100 * max(value) FILTER (threshold = '{x}') / sum(value), 1), 0) AS "{x}" """ for x in SIZE_LABELS)
    return f"""WITH {FARM_SQL}, l AS (SELECT zone, status, {case} AS threshold, product, value FROM (SELECT *, size_ha AS area, 1.0::DOUBLE AS farms FROM units) UNPIVOT (value FOR product IN (area, farms)) ),
 e AS ({one('zone')} UNION ALL {one('status')}) SELECT product, grouping_factor, group_modality, {cols} FROM e GROUP BY 1, 2, 3""".replace(
        f"{case} AS threshold, product, value FROM (SELECT *, size_ha AS area, 1.0::DOUBLE AS farms FROM units)",
        f"threshold, product, value FROM (SELECT zone, status, {case} AS threshold, size_ha AS area, 1.0::DOUBLE AS farms FROM units)",
    )


@query("L16_threshold_shares", _threshold_sql())
def _(t):
    df = units(t).withColumn("area", F.col("size_ha")).withColumn("farms", F.lit(1.0))
    return L.threshold_shares(df, ["zone", "status"], "size_ha", ["area", "farms"], [0.5, 1, 2], SIZE_LABELS)
