"""Plots to farms, profiles, a scored grid, virtual farms and their size classes: the farm-size study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.operators import clean as C
from plotwise.operators import distribution as L
from plotwise.operators import forests as R
from plotwise.operators import geo as G
from plotwise.operators import grid as D
from plotwise.operators import ordering as O
from plotwise.operators import stats as S
from plotwise.session import stored, stored_in_batches


def clean_plots(plots: DataFrame, measured: str = "measured_plot_area_ha", reported: str = "reported_area_ha") -> DataFrame:
    """Sentinels, unit slips and implausible areas, then the preferred area."""
    df = C.null_sentinels(plots, measured)
    df = C.fix_area_units(df, measured, reported)
    df = C.null_above(df, measured, 100)
    return C.prefer_measured(df, measured, reported, "plot_area_ha")


def farm_profile(plots: DataFrame, p: float = 0.95) -> DataFrame:
    """Farm-size profile per country with a TOTAL row, after the percentile trim."""
    farms = C.within_bbox(S.farm_area(clean_plots(plots)), "x", "y", (-18, 52, -35, 38)).where("country is not null")
    # one counted table serves the limit and the profile: sizes above the limit drop out of it
    counted = stored(farms.groupBy("country", "year", "farm_area_ha").agg(F.count(F.lit(1)).alias("_c")))
    sizes = counted.where("farm_area_ha is not null").groupBy("country", "farm_area_ha").agg(F.sum("_c").alias("_c"))
    limits = O.quantiles_of_counts(sizes, ["country"], "farm_area_ha", {"_limit": p})
    trimmed = stored(counted.join(limits, "country").where("farm_area_ha <= _limit").drop("_limit"))
    return S.profile_of_counts(trimmed, "country", "farm_area_ha", {"q10": 0.10, "med": 0.5, "q90": 0.90}, below=[0.5, 1], year="year")


def located_farms(plots: DataFrame, polygons: DataFrame, fields: list[str], order: str, p: float = 0.95) -> DataFrame:
    """Trimmed farms with their place and the admin fields of the polygon that holds them."""
    farms = stored(C.within_bbox(S.farm_area(clean_plots(plots)), "x", "y", (-18, 52, -35, 38)).where("country is not null"))
    kept = C.trim_by_quantile(farms, ["country"], "farm_area_ha", p)
    return G.attach_admin(kept.select("country", "year", "farm_id", "x", "y", "farm_area_ha"), polygons, fields, order)


@dataclass(frozen=True)
class Prediction:
    """How the grid is scored: extremely randomised trees, `quantiles` evenly spaced quantiles per cell."""

    trees: int = 1500
    depth: int = 8
    tried: int = 4
    min_leaf: int = 10
    min_split: int = 5
    quantiles: int = 100
    seed: int = 2024


def farm_size_study(
    plots: DataFrame, polygons: DataFrame, admin: list[str], order: str, cells: DataFrame, grid: G.Grid, bands: list[str], land: str, zone: str,
    cuts: list[float], thresholds: list[float], settings: Prediction = Prediction(), p: float = 0.95,
) -> dict[str, DataFrame]:
    """From plots to size classes of a whole grid.

    Farms get the admin fields of their polygon and the bands of their cell; a
    forest learns farm size from the bands and gives a mean and quantiles per cell where
    all bands are known. Land in hectares over mean size gives the farms of a
    cell, whose sizes are spread evenly over its quantiles. These virtual farms
    give size classes per first admin field, statistics and shares below the thresholds per zone, and
    observed admin means are held against those of the map.

    Returns the tables farms, fit (out-of-bag agreement), importance, cells, population, classes, zones,
    shares and admin_means. `cells` has cell_id, x, y, the bands, `land` and `zone`.
    """
    farms = stored(located_farms(plots, polygons, admin, order, p))
    training = stored(G.extract_at(farms, cells, grid, bands))
    ids = ["country", "year", "farm_id"]
    s = settings
    forest = R.fit_forest(training, "farm_area_ha", bands, ids, s.trees, s.depth, s.min_leaf, s.min_split, s.tried, "random", s.seed)
    probs = [i / s.quantiles for i in range(1, s.quantiles + 1)]
    placed = G.attach_admin(cells, polygons, admin, order)
    scored = forest.quantiles(forest.predict(placed, "predicted_ha"), probs, R.response_values(training, "farm_area_ha"), "sizes")
    scored = stored_in_batches(D.units_per_cell(scored, land, "predicted_ha", "nb_farms").withColumn("nb_farms", F.round("nb_farms").cast("long")))
    population = L.expand_population(scored.where("sizes is not null and nb_farms > 0"), ["cell_id", *admin, zone], "nb_farms", "sizes", "farm_ha")
    population = stored(population)
    observed = farms.groupBy(*admin).agg(F.count(F.lit(1)).alias("n_farms"), F.avg("farm_area_ha").alias("observed_ha"))
    mapped = scored.groupBy(*admin).agg(F.avg("predicted_ha").alias("mapped_ha"), F.sum("nb_farms").alias("nb_farms"))
    labels = [f"below_{S._tag(t)}" for t in thresholds] + [f"from_{S._tag(thresholds[-1])}"]
    counted = population.withColumns({"farms": F.lit(1.0), "area": F.col("farm_ha")})
    return {
        "farms": farms,
        "fit": forest.out_of_bag(),
        "importance": forest.importance(),
        "cells": scored,
        "population": population,
        "classes": L.size_classes(population, [admin[0]], "farm_ha", cuts),
        "zones": L.zone_farm_stats(population, zone, "farm_ha", thresholds),
        "shares": L.threshold_shares(counted, [admin[0], zone], "farm_ha", ["area", "farms"], thresholds, labels),
        "admin_means": O.join_null_safe(observed, mapped, admin, "left"),
    }
