"""Raster-style work as joins and aggregates on cell tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions import numbers as N
from plotwise.operators import ordering as O
from plotwise.operators import windows as W
from plotwise.operators.geo import Grid, attach_admin, knn

EARTH_RADIUS_M = 6371008.8


def clip_to(cells: DataFrame, polygons: DataFrame, box: tuple[float, float, float, float] | None = None, size: float = 1.0) -> DataFrame:
    """Cells whose centre lies in any polygon; the box prunes before the join."""
    if box:
        x0, x1, y0, y1 = box
        cells = cells.where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    marked = polygons.select("ring", F.lit(1).alias("_hit"))
    return attach_admin(cells, marked, ["_hit"], "_hit", size).where("_hit = 1").drop("_hit")


def rasterize(cells: DataFrame, polygons: DataFrame, fields: list[str], order: str, size: float = 1.0) -> DataFrame:
    """Polygon attributes of the cell centres."""
    return attach_admin(cells, polygons, fields, order, size)


def resample(source: DataFrame, grid: Grid, target: DataFrame, value: str, method: str = "bilinear") -> DataFrame:
    """Source values at target centres (``cell_id, x, y``).

    Bilinear weights are renormalised over the corners that have a value.
    """
    layer = source.select(F.col("cell_id").alias("_src"), F.col(value).alias("_v"))
    spots = target.select("cell_id", "x", "y")
    if method == "nearest":
        return spots.withColumn("_src", grid.cell("x", "y")).join(layer, "_src", "left").select("cell_id", F.col("_v").alias(value))
    u, v = (F.col("x") - F.lit(grid.x0)) / F.lit(grid.res) - 0.5, (F.col("y") - F.lit(grid.y0)) / F.lit(grid.res) - 0.5
    at = spots.select("cell_id", F.floor(u).alias("_i"), F.floor(v).alias("_j"), (u - F.floor(u)).alias("_fx"), (v - F.floor(v)).alias("_fy"))
    corner = lambda a, b: F.struct(
        grid.number(F.col("_i") + a, F.col("_j") + b).alias("_src"),
        ((F.col("_fx") if a else 1 - F.col("_fx")) * (F.col("_fy") if b else 1 - F.col("_fy"))).alias("_w"),
    )
    corners = at.select("cell_id", F.inline(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])))
    weighted = corners.join(layer, "_src", "left")
    w = F.when(F.col("_v").isNotNull(), F.col("_w"))
    return weighted.groupBy("cell_id").agg(N.safe_ratio(F.sum(F.col("_w") * F.col("_v")), F.sum(w)).alias(value))


def coarsen(cells: DataFrame, grid: Grid, k: int, aggs: dict[str, str]) -> DataFrame:
    """Blocks of k x k cells; ``aggs`` maps a band to sum, avg, min or max."""
    big = grid.coarser(k)
    block = big.number(F.floor(grid.col_of("cell_id") / k), F.floor(grid.row_of("cell_id") / k))
    return cells.groupBy(block.alias("cell_id")).agg(*[getattr(F, f)(c).alias(c) for c, f in aggs.items()])


def cell_area_ha(y, res: float) -> Column:
    """Area of a lon/lat cell centred on latitude y, by the spherical zone formula."""
    y = N.as_col(y)
    band = F.sin(F.radians(y + res / 2)) - F.sin(F.radians(y - res / 2))
    return F.lit(EARTH_RADIUS_M**2 * math.radians(res) / 10_000) * band


def terrain_slope(cells: DataFrame, grid: Grid, z: str) -> DataFrame:
    """Slope in radians from the eight neighbours (Horn weights).

    Every cell sends its weighted height to its neighbours, so one aggregation
    replaces eight self-joins.  Cells without all eight get NULL.
    """
    col, row = grid.col_of("cell_id"), grid.row_of("cell_id")
    sends = []
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            wx, wy = (-a * (2 if b == 0 else 1), -b * (2 if a == 0 else 1))
            sends.append(F.struct(grid.number(col + a, row + b).alias("_to"), F.lit(wx).alias("_wx"), F.lit(wy).alias("_wy")))
    moved = cells.where(F.col(z).isNotNull()).select(F.col(z).alias("_z"), F.inline(F.array(*sends)))
    own = (F.col("_wx") == 0) & (F.col("_wy") == 0)
    sums = moved.where("_to is not null").groupBy("_to").agg(
        F.sum(F.col("_wx") * F.col("_z")).alias("_gx"), F.sum(F.col("_wy") * F.col("_z")).alias("_gy"),
        F.count_if(~own).alias("_n"), F.count_if(own).alias("_own"),
    )
    metre = math.pi * EARTH_RADIUS_M / 180 * grid.res
    dx = F.lit(metre) * F.cos(F.radians(grid.centre_y("cell_id")))
    gx, gy = F.col("_gx") / (8 * dx), F.col("_gy") / (8 * F.lit(metre))
    return sums.where("_own = 1").select(F.col("_to").alias("cell_id"), "_gx", "_gy", "_n").select(
        "cell_id", F.when(F.col("_n") == 8, F.atan(F.sqrt(gx * gx + gy * gy))).alias("slope")
    )


def mask_where(cells: DataFrame, condition: Column, cols: list[str]) -> DataFrame:
    """NULL in the named bands where the condition holds (unknown keeps the value)."""
    drop = F.coalesce(condition, F.lit(False))
    return cells.withColumns({c: F.when(~drop, F.col(c)) for c in cols})


def sum_groups(cells: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Sums over groups of layers, NULL counted as zero."""
    return cells.withColumns({n: N.null_sum([c for c in cols if c in cells.columns]) for n, cols in groups.items()})


def temporal_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample sd and coefficient of variation over time per cell."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("avg"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return out.withColumn("cv", N.safe_ratio("sd", "avg"))


def high_variability(stats: DataFrame, limit: float = 0.3) -> DataFrame:
    """Percent of cells whose coefficient of variation is above the limit."""
    known = stats.where(F.col("cv").isNotNull())
    return known.agg(F.count(F.lit(1)).alias("n_cells"), (100 * F.avg((F.col("cv") > limit).cast("double"))).alias("pct_high"))


def monthly_totals(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Dekads to months; negative values are nodata."""
    keys = keys or ["cell_id"]
    v = F.when(F.col(value) >= 0, F.col(value))
    return df.groupBy(*keys, "year", "month").agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("month_mm"))


def rollup_dekads(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Yearly totals for years with all 36 dekads present, except the last year.

    Whether a step is present is a matter of its layer, not of single cells.
    """
    keys = keys or ["cell_id"]
    steps = df.select("year", "month", "dekad").distinct()
    full = steps.groupBy("year").agg(F.count(F.lit(1)).alias("_n")).where("_n = 36").select("year")
    last = df.agg(F.max("year")).scalar()
    v = F.when(F.col(value) >= 0, F.col(value))
    totals = df.groupBy(*keys, "year").agg(F.coalesce(F.sum(v), F.lit(0.0)).alias("year_mm"))
    return totals.join(full, "year", "left_semi").where(F.col("year") != last)


def zonal_stats(cells: DataFrame, zone: list[str], value: str) -> DataFrame:
    return cells.where(F.col(zone[-1]).isNotNull()).groupBy(*zone).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total")
    )


def zonal_fill(cells: DataFrame, zone: list[str], value: str, out: str) -> DataFrame:
    """The zone mean written back to its cells, from a pre-aggregated table."""
    means = cells.groupBy(*zone).agg(F.avg(value).alias(out))
    return O.join_null_safe(cells, means, zone)


def paint_by_key(cells: DataFrame, table: DataFrame, key: str, col: str) -> DataFrame:
    """A value per unit (mean of its series) on every cell of the unit."""
    return cells.join(table.groupBy(key).agg(F.avg(col).alias(col)), key, "left")


def valid_pixels(cells: DataFrame, bands: list[str]) -> DataFrame:
    """Cells with a finite value in every band."""
    return cells.withColumns({b: N.finite(F.col(b).cast("double")) for b in bands}).dropna("any", subset=bands)


def score_valid(cells: DataFrame, scored: DataFrame, col: str, key: str = "cell_id") -> DataFrame:
    """Predictions of the valid cells back on the full grid; NULL elsewhere."""
    return cells.join(scored.select(key, col), key, "left")


def compare_products(cells: DataFrame, zone: str, products: list[str], k: int = 10) -> DataFrame:
    """Zone totals per product and the rank of each zone within its product."""
    sums = cells.where(F.col(zone).isNotNull()).groupBy(zone).agg(*[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in products])
    long = sums.unpivot([zone], products, "source", "total")
    return W.top_k(long, ["source"], "total", k, [zone])


def units_per_cell(cells: DataFrame, area: str, size: str, out: str = "nb_units") -> DataFrame:
    return cells.withColumn(out, N.safe_ratio(area, size))


def zonal_total(cells: DataFrame, zone: str, value: str, reference: DataFrame, count: str) -> DataFrame:
    """Zone totals beside reference counts, with their correlation in one table."""
    sums = cells.groupBy(zone).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    both = sums.join(reference.select(zone, count), zone)
    r = both.agg(N.corr("total", count)).scalar()
    return both.withColumn("r2_corr", r * r)


def snap_grid(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Cell numbers on another origin and resolution, by cell centre."""
    return cells.withColumn("cell_id", target.cell(source.centre_x("cell_id"), source.centre_y("cell_id")))


def points_to_grid(points: DataFrame, grid: Grid, cols: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Point values averaged per cell, with the number of points."""
    keyed = points.withColumn("cell_id", grid.cell(x, y)).where("cell_id is not null")
    return keyed.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])


def morans_i(points: DataFrame, col: str, k: int = 4, key: str = "point_id") -> DataFrame:
    """Moran's I with k nearest neighbours and row-standardised weights.

    Returns n, I, its expectation and variance under randomisation, and z.
    """
    known = points.where(F.col(col).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull()).select(key, "x", "y", F.col(col).cast("double").alias("_v"))
    mean = known.agg(F.avg("_v")).scalar()
    dev = known.select(key, (F.col("_v") - mean).alias("_z"))
    links = knn(known, k, key).select(key, "neighbour")
    lag = links.join(dev.select(F.col(key).alias("neighbour"), F.col("_z").alias("_zn")), "neighbour").join(dev, key)
    cross = lag.agg(F.sum(F.col("_z") * F.col("_zn")) / k).scalar()
    back = links.select(F.col("neighbour").alias(key), F.col(key).alias("neighbour"))
    mutual = links.join(back, [key, "neighbour"]).agg(F.count(F.lit(1)).cast("double")).scalar()
    indegree = links.groupBy("neighbour").agg(F.count(F.lit(1)).alias("_d"))
    # points nobody points at add (1 + 0)^2 each
    s2_in = indegree.agg(F.sum(F.pow(1 + F.col("_d") / k, F.lit(2.0)) - 1)).scalar()
    z2 = F.col("_z") * F.col("_z")
    base = dev.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(z2).alias("_m2"), F.sum(z2 * z2).alias("_m4"))
    base = base.withColumns({"_cross": cross, "_mutual": mutual, "_s2in": s2_in})
    n = F.col("n")
    s0, s1, s2 = n, n / k + F.col("_mutual") / (k * k), n + F.col("_s2in")
    kurt = N.safe_ratio(n * F.col("_m4"), F.col("_m2") * F.col("_m2"))
    expected = N.safe_ratio(F.lit(-1), n - 1)
    num = n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - kurt * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)
    var = N.safe_ratio(num, (n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected
    i = N.safe_ratio("_cross", "_m2")
    return base.select(n.cast("long").alias("n"), i.alias("moran_i"), expected.alias("expected"), var.alias("variance"), N.safe_ratio(i - expected, F.sqrt(F.when(var > 0, var))).alias("z"))


def grid_agreement(points: DataFrame, cells: DataFrame, grid: Grid, obs: str, pred: str) -> DataFrame:
    """r2 between point observations and the prediction of their cell."""
    from plotwise.operators.geo import extract_at
    from plotwise.operators.stats import pearson

    return pearson(extract_at(points, cells, grid, [pred]), [], obs, pred)
