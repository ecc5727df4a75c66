"""Features of irregular observation series, one row per entity.

Each observation has a date and a tie column; together they order the series.
Everything that can be a mergeable aggregate is one, so a single entity may
hold any share of the rows.  Steps that need neighbours work on chunked series.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions import numbers as N
from plotwise.operators import ordering as O


@dataclass
class Series:
    """Names of the columns that describe an observation."""

    key: str = "agronomic_key"
    date: str = "date"
    tie: str = "obs_id"
    end: str = "end_date"


def _known(c: str, value: Column) -> Column:
    return F.when(F.col(c).isNotNull(), value)


def _stat_columns(s: Series, cols: list[str]) -> list[Column]:
    out = []
    for c in cols:
        at = _known(c, F.struct(s.date, s.tie))
        earliest_peak = _known(c, F.struct(F.col(c), -F.unix_date(s.date), F.dayofyear(s.date).alias("doy")))
        out += [
            F.max(c).alias(f"{c}_peak"),
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"),
            F.max_by(c, at).alias(f"{c}_last"),
            F.datediff(F.max(s.end), F.max(_known(c, F.col(s.date)))).cast("double").alias(f"{c}_dtharv"),
            F.max(earliest_peak).getField("doy").cast("double").alias(f"{c}_doy_peak"),
        ]
    return out


def trajectory_stats(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """peak, mean, std (population), last, days to the end date, day of first peak."""
    return df.groupBy(s.key).agg(*_stat_columns(s, cols))


def with_previous(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """Beside each value, the date, day of year and value of the observation before it that has one, as `_p_<column>`.

    One exchange of the observations serves all columns; series are cut into
    pieces, so any may be long.
    """
    spot = lambda c: _known(c, F.struct(F.col(s.date).alias("d"), F.dayofyear(s.date).alias("doy"), F.col(c).cast("double").alias("v")))
    seen = df.withColumns({f"_o_{c}": spot(c) for c in cols})
    return O.carry(seen, [s.key], [s.date, s.tie], {f"_o_{c}": f"_p_{c}" for c in cols}, previous=True, known=True).drop(*[f"_o_{c}" for c in cols])


def _integral_columns(s: Series, cols: list[str]) -> list[Column]:
    out = []
    for c in cols:
        area = F.sum((F.dayofyear(s.date) - F.col(f"_p_{c}.doy")) * (F.col(c) + F.col(f"_p_{c}.v")) / 2)
        out.append(F.when(F.count(c) == 1, F.max(c)).when(F.count(c) > 1, F.coalesce(area, F.lit(0.0))).alias(f"{c}_integral"))
    return out


def trapezoid(df: DataFrame, s: Series, cols: list[str]) -> DataFrame:
    """Trapezoid integral over day of year; a single value returns itself."""
    return with_previous(df.select(s.key, s.date, s.tie, *cols), s, cols).groupBy(s.key).agg(*_integral_columns(s, cols))


def _slope_columns(s: Series, cols: list[str], windows: dict[str, tuple[str, str]] | None, season: str | None) -> list[Column]:
    """Slope between the last value and the one before it; in a window both lie inside."""
    out, spans = [], [(season, F.lit(True), None)] if season else []
    for name, (lo, hi) in (windows or {}).items():
        spans.append((f"{name}_slope", F.col(s.date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(lo).cast("date")))
    for c in cols:
        before = F.col(f"_p_{c}")
        for name, inside, lo in spans:
            near = before.isNotNull() if lo is None else before["d"] >= lo
            slope = F.when(near, (F.col(c) - before["v"]) / (F.dayofyear(s.date) - before["doy"] + N.EPS))
            out.append(F.max_by(slope, F.when(F.col(c).isNotNull() & inside, F.struct(s.date, s.tie))).alias(f"{c}_{name}"))
    return out


def last_two_slopes(df: DataFrame, s: Series, cols: list[str], windows: dict[str, tuple[str, str]] | None = None, season: str | None = "slope") -> DataFrame:
    """Slope between the last two valid observations, per season and date window."""
    return with_previous(df.select(s.key, s.date, s.tie, *cols), s, cols).groupBy(s.key).agg(*_slope_columns(s, cols, windows, season))


def _window_columns(s: Series, cols: list[str], windows: dict[str, tuple[str, str]]) -> list[Column]:
    out = []
    for name, (lo, hi) in windows.items():
        inside = F.col(s.date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
        for c in cols:
            v = F.when(inside, F.col(c))
            out += [F.avg(v).alias(f"{c}_{name}_mean"), F.max(v).alias(f"{c}_{name}_max")]
    return out


def window_stats(df: DataFrame, s: Series, cols: list[str], windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean, max and last-two slope per column and named date window."""
    seen = with_previous(df.select(s.key, s.date, s.tie, *cols), s, cols)
    return seen.groupBy(s.key).agg(*_window_columns(s, cols, windows), *_slope_columns(s, cols, windows, None))


def _phenology_columns(s: Series, col: str, lo: float, hi: float) -> list[Column]:
    v, doy = F.col(col), F.dayofyear(s.date).cast("double")
    at = F.struct(s.date, s.tie)
    up = F.min_by(doy, F.when(v >= lo, at))
    down = F.max_by(F.struct(doy.alias("doy"), v.alias("value")), F.when(v >= hi, at))
    return [
        up.alias("green_up_doy"),
        down.getField("doy").alias("senescence_doy"),
        down.getField("value").alias("ndvi_at_senes"),
        (down.getField("doy") - up).alias("season_length"),
    ]


def phenology(df: DataFrame, s: Series, col: str, lo: float = 0.35, hi: float = 0.50) -> DataFrame:
    """First day at or above lo, last day at or above hi, value there, and length."""
    return df.groupBy(s.key).agg(*_phenology_columns(s, col, lo, hi))


def series_entropy(df: DataFrame, s: Series, col: str, bins: int = 10, out: str | None = None) -> DataFrame:
    """Shannon entropy (bits) over min(bins, n) equal-width bins; needs n >= 3."""
    out = out or f"{col}_entropy"
    counts = O.value_counts(df, [s.key], col)
    span = counts.groupBy(s.key).agg(F.min(col).alias("_a"), F.max(col).alias("_b"), F.sum("_c").alias("_n"))
    k = F.least(F.lit(bins), F.col("_n"))
    place = F.when(F.col("_b") > F.col("_a"), F.floor((F.col(col) - F.col("_a")) / (F.col("_b") - F.col("_a")) * k))
    # a flat series falls into one bin; the top edge belongs to the last bin
    binned = counts.join(span, s.key).where("_n >= 3").withColumn("_bin", F.coalesce(F.least(place, k - 1), F.lit(0)))
    share = binned.groupBy(s.key, "_bin").agg((F.sum("_c") / F.max("_n")).alias("_p"))
    return share.groupBy(s.key).agg((-F.sum(F.col("_p") * F.log2(F.col("_p") + N.EPS))).alias(out))


def autocorr_lag1(df: DataFrame, s: Series, col: str, out: str | None = None) -> DataFrame:
    """Correlation of a series with itself one observation earlier; needs n >= 3."""
    out = out or f"{col}_autocorr_l1"
    seen = with_previous(df.select(s.key, s.date, s.tie, col), s, [col])
    return seen.groupBy(s.key).agg(F.count(col).alias("_n"), N.corr(F.col(f"_p_{col}.v"), col).alias(out)).where("_n >= 3").drop("_n")


def coverage_columns(s: Series, optical: Column, radar: Column) -> list[Column]:
    return [
        F.count_if(optical).alias("n_obs_optical"),
        F.count_if(radar).alias("n_obs_sar"),
        F.count(F.lit(1)).alias("n_obs_total"),
        F.datediff(F.max(s.date), F.min(s.date)).cast("double").alias("season_span_days"),
    ]


def coverage(df: DataFrame, s: Series, optical: Column, radar: Column) -> DataFrame:
    """Observation counts per sensor group and the span of the season in days."""
    return df.groupBy(s.key).agg(*coverage_columns(s, optical, radar))


@dataclass
class FeaturePlan:
    """Which features to build; columns absent from the input are skipped."""

    optical: list[str]
    radar: list[str]
    windows: dict[str, tuple[str, str]] = field(default_factory=dict)
    optical_windowed: tuple[str, ...] = ("NDVI", "NDRE", "EVI", "SAVI", "GNDVI", "RENDVI")
    radar_windowed: tuple[str, ...] = ("VH_mean", "VV_mean", "RVI", "DpRVI")
    phenology: str = "NDVI"
    structure: str = "VH_mean"


def build_trajectory_features(df: DataFrame, s: Series, plan: FeaturePlan, is_optical: Column, is_radar: Column) -> DataFrame:
    """All features of an entity in one row.

    Columns of the other sensor group are blanked first, so both groups share
    one aggregation.  The observations are dealt once, beside the values before
    them; all else is one mergeable aggregate.  Only the entropy, whose bins need
    the range of the series first, counts one column a second time.
    """
    opt = [c for c in plan.optical if c in df.columns]
    sar = [c for c in plan.radar if c in df.columns]
    masked = df.withColumns({"_opt": is_optical, "_sar": is_radar})
    masked = masked.withColumns(
        {**{c: F.when(F.col("_opt"), N.finite(F.col(c).cast("double"))) for c in opt}, **{c: F.when(F.col("_sar"), N.finite(F.col(c).cast("double"))) for c in sar}}
    ).select(s.key, s.date, s.tie, s.end, "_opt", "_sar", *opt, *sar)
    windowed = [c for c in plan.optical_windowed if c in opt] + [c for c in plan.radar_windowed if c in sar]
    cols = [*opt, *sar]
    aggs = _stat_columns(s, cols) + _window_columns(s, windowed, plan.windows) + _integral_columns(s, cols) + _slope_columns(s, cols, None, "slope")
    if plan.windows:
        aggs += _slope_columns(s, windowed, plan.windows, None)
    if plan.phenology in opt:
        aggs += _phenology_columns(s, plan.phenology, 0.35, 0.50)
    aggs += coverage_columns(s, F.col("_opt"), F.col("_sar"))
    if plan.structure in sar:
        lag = N.corr(F.col(f"_p_{plan.structure}.v"), plan.structure)
        aggs.append(F.when(F.count(plan.structure) >= 3, lag).alias("VH_autocorr_l1"))
    features = with_previous(masked, s, cols).groupBy(s.key).agg(*aggs)
    if plan.structure not in sar:
        return features
    return features.join(series_entropy(masked, s, plan.structure, out="VH_entropy"), s.key, "left")
