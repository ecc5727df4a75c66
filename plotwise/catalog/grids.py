"""Geometry and grid operators on cells and points derived from customers."""

from pyspark.sql import functions as F

from plotwise.catalog.base import CELLS, NX, POINTS, RES, X0, Y0, grid, points, query, rounded
from plotwise.catalog.survey import STEPS_SQL, steps
from plotwise.functions import numbers as N
from plotwise.operators import geo as G
from plotwise.operators import grid as R

GRID = G.Grid(X0, Y0, RES, NX)
CELL_SQL = f"CAST(floor((y - ({Y0})) / {RES}) * {NX} + floor((x - ({X0})) / {RES}) AS BIGINT)"
# 5 x 5 rectangles, one per nation
RECT = "rect AS (SELECT n_nationkey, n_name, n_regionkey, -18 + 14 * (n_nationkey % 5) AS xa, -4 + 14 * (n_nationkey % 5) AS xb, -35 + 10 * (n_nationkey // 5) AS ya, -25 + 10 * (n_nationkey // 5) AS yb FROM nation)"
INSIDE = "x >= xa AND x < xb AND y >= ya AND y < yb"
ZONES = f"{CELLS}, {RECT}, zoned AS (SELECT grid.*, n_name, n_regionkey FROM grid LEFT JOIN rect ON {INSIDE})"


def polygons(t):
    n = F.col("n_nationkey")
    xa, ya = -18 + 14 * (n % 5), -35 + 10 * F.floor(n / 5)
    return t.nation.select("n_nationkey", "n_name", "n_regionkey", G.rectangle(xa, xa + 14, ya, ya + 10).alias("ring"))


def zoned(t):
    return R.rasterize(grid(t), polygons(t), ["n_name", "n_regionkey"], "n_nationkey", size=2.0)


@query("C11_extract_at", f"WITH {CELLS} SELECT point_id, cropland, rainfall FROM points LEFT JOIN grid ON grid.cell_id = {CELL_SQL.replace('y -', 'points.y -').replace('x -', 'points.x -')}")
def _(t):
    return G.extract_at(points(t), grid(t), GRID, ["cropland", "rainfall"]).select("point_id", "cropland", "rainfall")


@query("C12_cell_of", f"WITH {POINTS} SELECT point_id, {CELL_SQL} AS cell_id FROM points")
def _(t):
    return G.cell_of(points(t), GRID).select("point_id", "cell_id")


@query(
    "C13_nearest_cell",
    f"""WITH {CELLS}, few AS (SELECT * FROM grid WHERE landcover < 2)
SELECT point_id, arg_min(s.cell_id, (round(sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2), 9), s.cell_id)) AS cell_id, round(min(sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2)), 5) AS dist FROM points p, few s GROUP BY 1""",
)
def _(t):
    return rounded(G.nearest_cell(points(t), grid(t).where("landcover < 2"), GRID, "point_id"), 5)


@query("C14_attach_admin", f"WITH {POINTS}, {RECT} SELECT point_id, n_name, n_regionkey FROM points LEFT JOIN rect ON {INSIDE}")
def _(t):
    return G.attach_admin(points(t), polygons(t), ["n_name", "n_regionkey"], "n_nationkey", size=2.0).select("point_id", "n_name", "n_regionkey")


KNN_SQL = f"""WITH {POINTS}, d AS (SELECT a.point_id, b.point_id AS neighbour, ((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d2, sqrt(d2) AS dist FROM points a JOIN points b ON a.point_id <> b.point_id), k AS (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, neighbour) AS rank FROM d QUALIFY rank <= 4)"""


@query("C16_knn", KNN_SQL + " SELECT point_id, neighbour, CAST(rank AS INTEGER) AS rank, round(dist, 5) AS dist FROM k")
def _(t):
    return rounded(G.knn(points(t), 4), 5)


@query("R1_clip_to", f"WITH {ZONES} SELECT cell_id, cropland FROM zoned WHERE n_regionkey = 2")
def _(t):
    return R.clip_to(grid(t), polygons(t).where("n_regionkey = 2"), size=2.0).select("cell_id", "cropland")


TARGET = f"t AS (SELECT DISTINCT CAST(floor((y - ({Y0})) / 0.7) * 100 + floor((x - ({X0})) / 0.7) AS BIGINT) AS cell_id FROM points), tc AS (SELECT cell_id, {X0}::DOUBLE + (cell_id % 100 + 0.5::DOUBLE) * 0.7::DOUBLE AS x, {Y0}::DOUBLE + (cell_id // 100 + 0.5::DOUBLE) * 0.7::DOUBLE AS y FROM t)"
TGRID = G.Grid(X0, Y0, 0.7, 100)


def target(t):
    cells = points(t).select(TGRID.cell("x", "y").alias("cell_id")).distinct()
    return cells.select("cell_id", TGRID.centre_x("cell_id").alias("x"), TGRID.centre_y("cell_id").alias("y"))


@query(
    "R2_resample_bilinear",
    f"""WITH {CELLS}, {TARGET}, u AS (SELECT cell_id, (x - ({X0})) / {RES}::DOUBLE - 0.5 AS u, (y - ({Y0})) / {RES}::DOUBLE - 0.5 AS v FROM tc), c AS (
  SELECT cell_id, floor(u) + a AS i, floor(v) + b AS j, (CASE a WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) * (CASE b WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) AS w FROM u, (VALUES (0), (1)) q(a), (VALUES (0), (1)) r(b))
SELECT c.cell_id, round(sum(w * cropland) / sum(w) FILTER (cropland IS NOT NULL), 4) AS cropland FROM c LEFT JOIN grid g ON c.i = g.i AND c.j = g.j GROUP BY 1""",
)
def _(t):
    return rounded(R.resample(grid(t), GRID, target(t), "cropland"))


@query("R2_resample_nearest", f"WITH {CELLS}, {TARGET} SELECT tc.cell_id, g.landcover FROM tc LEFT JOIN grid g ON g.cell_id = {CELL_SQL.replace('y -', 'tc.y -').replace('x -', 'tc.x -')}")
def _(t):
    return R.resample(grid(t), GRID, target(t), "landcover", "nearest")


@query("R3_coarsen", f"WITH {CELLS} SELECT (j // 10) * 14 + i // 10 AS cell_id, round(sum(cropland), 3) AS cropland, round(avg(rainfall), 4) AS rainfall FROM grid GROUP BY 1")
def _(t):
    return rounded(R.coarsen(grid(t), GRID, 10, {"cropland": "sum", "rainfall": "avg"}))


@query("R4_cell_area_ha", f"WITH {CELLS} SELECT cell_id, round(6371008.8 ** 2 * radians({RES}) / 10000 * (sin(radians(y + 0.25)) - sin(radians(y - 0.25))), 3) AS area_ha FROM grid")
def _(t):
    return rounded(grid(t).select("cell_id", R.cell_area_ha("y", RES).alias("area_ha")), 3)


@query("R5_rasterize", f"WITH {ZONES} SELECT cell_id, n_name, n_regionkey FROM zoned")
def _(t):
    return zoned(t).select("cell_id", "n_name", "n_regionkey")


DENSE = f"dense AS (SELECT CAST(a.i AS BIGINT) AS i, CAST(b.j AS BIGINT) AS j, b.j * {NX} + a.i AS cell_id, ((b.j * {NX} + a.i) * 15485863 % 2000)::DOUBLE AS z FROM (SELECT DISTINCT i FROM grid) a, (SELECT DISTINCT j FROM grid) b WHERE (a.i * 31 + b.j) % 50 <> 0)"


def dense(t):
    """Every (column, row) pair seen in the points, less a few holes."""
    g = grid(t)
    rows = g.agg(F.collect_set("j")).scalar()  # at most one entry per grid row
    c = F.col("j") * NX + F.col("i")
    df = g.select("i").distinct().withColumn("_rows", rows).select("i", F.explode("_rows").alias("j"))
    return df.where((F.col("i") * 31 + F.col("j")) % 50 != 0).select(c.alias("cell_id"), (c * 15485863 % 2000).cast("double").alias("z"))


METRE = "(pi() * 6371008.8 / 180 * 0.5)"


@query(
    "R6_terrain_slope",
    f"""WITH {CELLS}, {DENSE}, n AS (SELECT c.cell_id, c.j, count(*) AS n, sum((b.i - c.i) * CASE WHEN b.j = c.j THEN 2 ELSE 1 END * b.z) AS gx, sum((b.j - c.j) * CASE WHEN b.i = c.i THEN 2 ELSE 1 END * b.z) AS gy
  FROM dense c LEFT JOIN dense b ON abs(b.i - c.i) <= 1 AND abs(b.j - c.j) <= 1 AND b.cell_id <> c.cell_id GROUP BY 1, 2)
SELECT cell_id, CASE WHEN n = 8 THEN round(atan(sqrt(pow(gx / (8 * {METRE} * cos(radians({Y0} + (j + 0.5) * 0.5))), 2) + pow(gy / (8 * {METRE}), 2))), 6) END AS slope FROM n""",
)
def _(t):
    return rounded(R.terrain_slope(dense(t), GRID, "z"), 6)


@query("R7_mask_where", f"WITH {CELLS} SELECT cell_id, CASE WHEN landcover IN (2, 4, 5, 8) OR rainfall < 200 THEN NULL ELSE cropland END AS cropland FROM grid")
def _(t):
    g = R.mask_where(grid(t), F.col("landcover").isin(2, 4, 5, 8), ["cropland"])
    return R.mask_where(g, F.col("rainfall") < 200, ["cropland"]).select("cell_id", "cropland")


@query("R8_layer_algebra", f"WITH {CELLS} SELECT cell_id, round(cropland * rainfall, 4) AS product, round(cropland - elevation, 4) AS gap, CASE WHEN rainfall <> 0 THEN round(cropland / rainfall, 6) END AS ratio FROM grid")
def _(t):
    c, r = F.col("cropland"), F.col("rainfall")
    df = grid(t).select("cell_id", F.round(c * r, 4).alias("product"), F.round(c - F.col("elevation"), 4).alias("gap"), N.safe_ratio(c, r).alias("ratio"))
    return rounded(df, 6)


@query("R9_sum_layers", f"WITH {CELLS} SELECT cell_id, round(coalesce(cropland, 0) + coalesce(rainfall, 0), 4) AS wet, coalesce(elevation, 0) AS high FROM grid")
def _(t):
    return rounded(R.sum_groups(grid(t), {"wet": ["cropland", "rainfall"], "high": ["elevation"]}).select("cell_id", "wet", "high"))


YEARLY = f"{STEPS_SQL}, y AS (SELECT cell_id, year, sum(rain_mm) AS v FROM steps GROUP BY 1, 2), st AS (SELECT cell_id, avg(v) AS avg, stddev_samp(v) AS sd, count(*) AS n FROM y GROUP BY 1)"


def yearly(t):
    return steps(t).groupBy("cell_id", "year").agg(F.sum("rain_mm").alias("v"))


@query("R10_temporal_stats", f"WITH {YEARLY} SELECT cell_id, round(avg, 3) AS avg, round(sd, 3) AS sd, n, round(sd / avg, 5) AS cv FROM st")
def _(t):
    df = R.temporal_stats(yearly(t), ["cell_id"], "v")
    return rounded(df.withColumns({"avg": F.round("avg", 3), "sd": F.round("sd", 3)}), 5)


@query("R10_high_variability", f"WITH {YEARLY} SELECT count(*) AS n_cells, round(100.0 * avg((sd / avg > 0.3)::INT), 4) AS pct_high FROM st WHERE sd IS NOT NULL")
def _(t):
    return rounded(R.high_variability(R.temporal_stats(yearly(t), ["cell_id"], "v")))


@query("R11_monthly_totals", f"WITH {STEPS_SQL} SELECT cell_id, year, month, round(coalesce(sum(rain_mm) FILTER (rain_mm >= 100000), 0), 2) AS month_mm FROM steps GROUP BY 1, 2, 3")
def _(t):
    signed = steps(t).withColumn("rain_mm", F.when(F.col("rain_mm") >= 100000, F.col("rain_mm")).otherwise(-9999.0))
    return rounded(R.monthly_totals(signed, "rain_mm"), 2)


@query(
    "R11_rollup_dekads",
    f"""WITH {STEPS_SQL}, ok AS (SELECT year FROM (SELECT DISTINCT year, month, dekad FROM steps) GROUP BY 1 HAVING count(*) = 36)
SELECT cell_id, year, round(sum(rain_mm), 2) AS year_mm FROM steps WHERE year IN (SELECT year FROM ok) AND year <> (SELECT max(year) FROM steps) GROUP BY 1, 2""",
)
def _(t):
    return rounded(R.rollup_dekads(steps(t), "rain_mm"), 2)


@query("R12_zonal_stats", f"WITH {ZONES} SELECT n_regionkey, n_name, count(cropland) AS n, round(avg(cropland), 4) AS mean, round(stddev_samp(cropland), 4) AS sd, round(coalesce(sum(cropland), 0), 4) AS total FROM zoned WHERE n_name IS NOT NULL GROUP BY 1, 2")
def _(t):
    return rounded(R.zonal_stats(zoned(t), ["n_regionkey", "n_name"], "cropland"))


@query("R13_zonal_fill", f"WITH {ZONES} SELECT cell_id, round(avg(cropland) OVER (PARTITION BY n_name), 4) AS zone_mean FROM zoned")
def _(t):
    return rounded(R.zonal_fill(zoned(t), ["n_name"], "cropland", "zone_mean").select("cell_id", "zone_mean"))


@query("R14_paint_by_key", f"WITH {ZONES} SELECT cell_id, round(bal, 4) AS c_acctbal FROM zoned LEFT JOIN (SELECT n.n_name, avg(c_acctbal) AS bal FROM customer JOIN nation n ON c_nationkey = n.n_nationkey GROUP BY 1) USING (n_name)")
def _(t):
    table = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_acctbal")
    return rounded(R.paint_by_key(zoned(t), table, "n_name", "c_acctbal").select("cell_id", "c_acctbal"))


@query("R15_valid_pixels", f"WITH {CELLS} SELECT cell_id, CASE WHEN cropland IS NOT NULL THEN round(cropland + rainfall, 4) END AS pred FROM grid")
def _(t):
    g = grid(t)
    scored = R.valid_pixels(g, ["cropland", "rainfall"]).withColumn("pred", F.col("cropland") + F.col("rainfall"))
    return rounded(R.score_valid(g.select("cell_id"), scored, "pred"))


PRODUCTS = ["cropland", "rainfall", "elevation"]


@query(
    "R16_compare_products",
    f"""WITH {ZONES}, s AS (SELECT n_name, coalesce(sum(round(cropland * 10)), 0) AS cropland, sum(rainfall) AS rainfall, sum(elevation) AS elevation FROM zoned WHERE n_name IS NOT NULL GROUP BY 1), l AS (SELECT * FROM s UNPIVOT (total FOR source IN (cropland, rainfall, elevation)))
SELECT n_name, source, round(total, 3) AS total, CAST(row_number() OVER (PARTITION BY source ORDER BY total DESC, n_name) AS INTEGER) AS rank FROM l QUALIFY rank <= 10""",
)
def _(t):
    return rounded(R.compare_products(zoned(t).withColumn("cropland", F.round(F.col("cropland") * 10)), "n_name", PRODUCTS), 3)


@query("R17_units_per_cell", f"WITH {ZONES} SELECT n_name, round(sum(CASE WHEN elevation <> 0 THEN cropland / elevation END), 5) AS nb_units FROM zoned WHERE n_name IS NOT NULL GROUP BY 1")
def _(t):
    df = R.units_per_cell(zoned(t).where("n_name is not null"), "cropland", "elevation")
    return rounded(df.groupBy("n_name").agg(F.sum("nb_units").alias("nb_units")), 5)


@query(
    "R18_zonal_total",
    f"""WITH {ZONES}, s AS (SELECT n_name, coalesce(sum(cropland), 0) AS total FROM zoned GROUP BY 1), b AS (SELECT s.n_name, total, n AS n_cust FROM s JOIN (SELECT n.n_name, count(*) AS n FROM customer JOIN nation n ON c_nationkey = n.n_nationkey GROUP BY 1) q ON s.n_name = q.n_name)
SELECT n_name, round(total, 3) AS total, n_cust, round((SELECT pow(corr(total, n_cust), 2) FROM b), 5) AS r2_corr FROM b""",
)
def _(t):
    ref = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_cust"))
    df = R.zonal_total(zoned(t), "n_name", "cropland", ref, "n_cust")
    return rounded(df.withColumn("total", F.round("total", 3)), 5)


@query(
    "R19_morans_i",
    KNN_SQL
    + """, z AS (SELECT point_id, value - avg(value) OVER () AS z FROM points), g AS (SELECT count(*)::DOUBLE AS n, sum(z * z) AS m2, sum(z ** 4) AS m4 FROM z),
 c AS (SELECT sum(a.z * b.z) / 4 AS x FROM k JOIN z a ON k.point_id = a.point_id JOIN z b ON k.neighbour = b.point_id), m AS (SELECT count(*) AS mu FROM k p JOIN k q ON p.point_id = q.neighbour AND p.neighbour = q.point_id),
 e AS (SELECT sum(pow(1 + coalesce(d, 0) / 4.0, 2)) AS s2 FROM points LEFT JOIN (SELECT neighbour, count(*) AS d FROM k GROUP BY 1) i ON i.neighbour = points.point_id), f AS (SELECT n, x / m2 AS i, n / 4 + mu / 16.0 AS s1, s2, n * m4 / (m2 * m2) AS b2 FROM g, c, m, e),
 v AS (SELECT *, -1 / (n - 1) AS ei, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * n * n) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * n * n)) / ((n - 1) * (n - 2) * (n - 3) * n * n) - 1 / ((n - 1) * (n - 1)) AS var FROM f)
SELECT CAST(n AS BIGINT) AS n, round(i, 6) AS moran_i, round(ei, 6) AS expected, round(var, 6) AS variance, round((i - ei) / sqrt(var), 5) AS z FROM v""",
)
def _(t):
    df = R.morans_i(points(t), "value")
    return rounded(df.withColumn("z", F.round("z", 5)), 6)


@query("R20_snap_grid", f"WITH {CELLS} SELECT CAST(floor((y + 36) / 2) * 40 + floor((x + 20) / 2) AS BIGINT) AS cell_id, count(*) AS n FROM grid GROUP BY 1")
def _(t):
    return R.snap_grid(grid(t), GRID, G.Grid(-20, -36, 2, 40)).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query("R21_points_to_grid", f"WITH {POINTS} SELECT {CELL_SQL} AS cell_id, count(*) AS n, round(avg(value), 4) AS value FROM points GROUP BY 1")
def _(t):
    return rounded(R.points_to_grid(points(t), GRID, ["value"]))


@query("K30_grid_agreement", f"WITH {CELLS} SELECT count(*) AS n, round(corr(value, rainfall), 5) AS r, round(pow(corr(value, rainfall), 2), 5) AS r2_corr FROM points JOIN grid ON grid.cell_id = {CELL_SQL.replace('y -', 'points.y -').replace('x -', 'points.x -')}")
def _(t):
    return rounded(R.grid_agreement(points(t), grid(t), GRID, "value", "rainfall"), 5)
