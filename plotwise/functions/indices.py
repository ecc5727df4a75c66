"""Spectral indices and cross-sensor features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.numbers import EPS


def normalised_difference(a: str, b: str) -> Column:
    a, b = F.col(a), F.col(b)
    return (a - b) / (a + b + EPS)


def _soil_adjusted(nir: str, red: str, soil: float = 0.5) -> Column:
    n, r = F.col(nir), F.col(red)
    return (n - r) / (n + r + soil + EPS) * (1 + soil)


def _modified_soil_adjusted(nir: str, red: str) -> Column:
    n, r = F.col(nir), F.col(red)
    lead = 2 * n + 1
    root = lead * lead - 8 * (n - r)
    # greatest() skips NULL, so a missing band must be kept missing
    return F.when(root.isNotNull(), (lead - F.sqrt(F.greatest(root, F.lit(0.0)))) / 2)


def _wide_range(nir: str, red: str) -> Column:
    n, r = F.col(nir) * 0.1, F.col(red)
    return (n - r) / (n + r + EPS)


BANDS = {"green": "B03_mean", "red": "B04_mean", "nir": "B08_mean", "edge": "B8A_mean", "swir": "B11_mean"}


def add_indices(df: DataFrame, bands: dict[str, str] | None = None) -> DataFrame:
    """SAVI, MSAVI2, WDRVI, GNDVI, RENDVI and LSWI2 where their bands exist."""
    b = {**BANDS, **(bands or {})}
    rules = {
        "SAVI": (("nir", "red"), _soil_adjusted),
        "MSAVI2": (("nir", "red"), _modified_soil_adjusted),
        "WDRVI": (("nir", "red"), _wide_range),
        "GNDVI": (("nir", "green"), normalised_difference),
        "RENDVI": (("edge", "red"), normalised_difference),
        "LSWI2": (("edge", "swir"), normalised_difference),
    }
    new = {
        name: make(*[b[s] for s in sources])
        for name, (sources, make) in rules.items()
        if all(b[s] in df.columns for s in sources)
    }
    return df.withColumns(new) if new else df


def add_cross_features(df: DataFrame) -> DataFrame:
    """Products, ratios and gaps between sensors, skipping absent sources."""
    c = F.col
    rules: dict[str, tuple[tuple[str, ...], Column]] = {
        "NDVI_peak_sq": (("NDVI_peak",), c("NDVI_peak") * c("NDVI_peak")),
        "CCCI_peak": (("NDRE_peak", "NDVI_peak"), c("NDRE_peak") / (F.abs(c("NDVI_peak")) + EPS)),
        "EVI_NDVI_gap": (("EVI_peak", "NDVI_peak"), c("EVI_peak") - c("NDVI_peak")),
        "NDVI_int_x_NDRE_int": (("NDVI_integral", "NDRE_integral"), c("NDVI_integral") * c("NDRE_integral")),
        "LSWI_peak": (("B8A_mean_peak", "B11_mean_peak"), normalised_difference("B8A_mean_peak", "B11_mean_peak")),
        "VI_SAR_peak": (("NDVI_peak", "RVI_peak"), c("NDVI_peak") * c("RVI_peak")),
        "NDRE_DpRVI_peak": (("NDRE_peak", "DpRVI_peak"), c("NDRE_peak") * c("DpRVI_peak")),
        "VH_NDVI_last": (("VH_mean_last", "NDVI_last"), c("VH_mean_last") * c("NDVI_last")),
        "VH_VV_ratio_peak": (("VH_mean_peak", "VV_mean_peak"), c("VH_mean_peak") / (c("VV_mean_peak") + EPS)),
        "SAR_opt_dtharv_diff": (("VV_mean_dtharv", "NDVI_dtharv"), c("VV_mean_dtharv") - c("NDVI_dtharv")),
    }
    new = {n: e for n, (src, e) in rules.items() if all(s in df.columns for s in src)}
    return df.withColumns(new) if new else df
