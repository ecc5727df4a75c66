"""Grouped statistics, correlations and model-agreement measures."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions import numbers as N
from plotwise.operators import clean as C
from plotwise.operators import ordering as O
from plotwise.session import stored


def _tag(threshold: float) -> str:
    """Column-name form of a threshold: 0.5 -> 0_5."""
    return f"{threshold:g}".replace(".", "_")


# counts and sums -----------------------------------------------------------
def value_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Distinct non-null values per group; the values spread over all tasks first."""
    return df.where(F.col(col).isNotNull()).select(*keys, col).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct"))


FARM_KEYS = ["x", "y", "country", "year", "farm_id", "hh_size"]


def farm_area(plots: DataFrame, area: str = "plot_area_ha", keys: list[str] | None = None, farm: list[str] | None = None, out: str = "farm_area_ha") -> DataFrame:
    """Plots summed to farms; a farm with any plot of unknown area is left out.

    Sums combine before the shuffle; the window that spots bad farms then sees
    only the one or two summed rows of each farm, and no self-join is needed.
    Use ``area='measured_plot_area_ha'`` for the strict variant.
    """
    keys = keys or FARM_KEYS
    farm = farm or ["country", "year", "farm_id"]
    sums = plots.groupBy(*keys).agg(
        F.coalesce(F.sum(area), F.lit(0.0)).alias(out), F.count_if(F.col(area).isNull()).alias("_bad")
    )
    bad = F.sum("_bad").over(Window.partitionBy(*farm))
    return sums.withColumn("_bad", bad).where("_bad = 0").drop("_bad")


def sum_all(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])


def location_means(df: DataFrame, keys: list[str], cols: list[str], min_n: int = 9) -> DataFrame:
    """Mean of every column per location, for locations above ``min_n`` rows."""
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in cols])
    return agg.where(F.col("n") > min_n)


def collect_sizes(df: DataFrame, keys: list[str], col: str, part_size: int = 100_000) -> DataFrame:
    """Sorted lists of values per cell: (keys, part, n, sizes).

    A list holds at most ``part_size`` values; a larger cell continues in
    parts 1, 2, ..., so no row or task grows with a cell.
    """
    run = O.prefix_sums(O.value_counts(df, keys, col), keys, [col], ["_c"])
    start, end = F.col("_c_run") - F.col("_c"), F.col("_c_run") - 1
    split = run.withColumn("part", F.explode(F.sequence(F.floor(start / part_size), F.floor(end / part_size))))
    copies = F.least(end, (F.col("part") + 1) * part_size - 1) - F.greatest(start, F.col("part") * part_size) + 1
    lists = split.groupBy(*keys, "part").agg(F.sum(copies).alias("n"), F.sort_array(F.collect_list(F.struct(F.col(col).alias("v"), copies.cast("int").alias("k")))).alias("_l"))
    return lists.select(*keys, "part", "n", F.flatten(F.transform("_l", lambda e: F.array_repeat(e["v"], e["k"]))).alias("sizes"))


def column_totals(df: DataFrame, cols: list[str]) -> DataFrame:
    row = df.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in cols])
    return row.unpivot([], cols, "name", "total").orderBy(F.desc("total"), "name")


def share_of_total(df: DataFrame, keys: list[str], part: list[str], value: str) -> DataFrame:
    """Sum per (keys, part), the keys total and the share of it."""
    cell = df.groupBy(*keys, *part).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("value"))
    tot = F.sum("value").over(Window.partitionBy(*keys))
    return cell.withColumn("tot", tot).withColumn("share", N.safe_ratio("value", "tot"))


def major_groups(df: DataFrame, key: str, value: str, p: float = 0.05) -> DataFrame:
    """Groups above a share of the total, with cumulative share, largest first."""
    sums = df.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("absolute"))
    total = sums.agg(F.sum("absolute")).scalar()
    rel = sums.withColumn("relative", N.safe_ratio("absolute", total)).withColumn("_neg", -F.col("absolute"))
    run = O.prefix_sums(rel, [], ["_neg", key], ["relative"])
    return run.where(F.col("relative") > p).select(key, "absolute", "relative", F.col("relative_run").alias("cumulative"))


def by_each_factor(df: DataFrame, factors: list[str], keys: list[str], aggs: list[Column]) -> DataFrame:
    """The same aggregate under several grouping factors, stacked.

    Output columns: keys, grouping_factor, group_modality, then the aggregates.
    """
    sets = [[*[F.col(k) for k in keys], F.col(f)] for f in factors]
    flags = [F.grouping(f).alias(f"_g_{f}") for f in factors]
    grouped = df.groupingSets(sets, *keys, *factors).agg(*flags, *aggs)
    name = reduce(lambda a, f: a.when(F.col(f"_g_{f}") == 0, F.lit(f)), factors, F.when(F.lit(False), F.lit("")))
    value = reduce(lambda a, f: a.when(F.col(f"_g_{f}") == 0, F.col(f).cast("string")), factors, F.when(F.lit(False), F.lit("")))
    rest = [c for c in grouped.columns if c not in (*keys, *factors) and not c.startswith("_g_")]
    return grouped.select(*keys, name.alias("grouping_factor"), value.alias("group_modality"), *rest)


# distribution profiles -----------------------------------------------------
def _basic(col: str) -> list[Column]:
    return [
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("sd"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
    ]


def profile(df: DataFrame, keys: list[str], col: str, probs: dict[str, float] | None = None) -> DataFrame:
    """n, mean, sample sd, min, max and exact quantiles per group."""
    probs = probs or {"q01": 0.01, "median": 0.5, "q99": 0.99}
    base = stored(df.where(F.col(col).isNotNull()).select(*dict.fromkeys([*keys, col])))
    return O.join_null_safe(base.groupBy(*keys).agg(*_basic(col)), O.group_quantiles(base, keys, col, probs), keys)


def profile_with_total(df: DataFrame, key: str, col: str, probs: dict[str, float], below: list[float], year: str | None = None, total: str = "TOTAL") -> DataFrame:
    """Profile per group plus a row recomputed from all raw rows.

    Also n and percent of rows under each threshold, and waves and period when
    a year column is named. Equal rows are counted once and for all.
    """
    names = list(dict.fromkeys([key, col, *([year] if year else [])]))
    return profile_of_counts(stored(df.where(F.col(key).isNotNull()).groupBy(*names).agg(F.count(F.lit(1)).alias("_c"))), key, col, probs, below, year, total)


def profile_of_counts(base: DataFrame, key: str, col: str, probs: dict[str, float], below: list[float], year: str | None = None, total: str = "TOTAL") -> DataFrame:
    """The same from a stored table of (key, col, year) and the number of such rows, _c."""
    n = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("_c"))), F.lit(0))
    counts = [F.sum("_c").alias("n_obs"), N.safe_ratio(F.sum(F.col(col) * F.col("_c")), n(F.col(col).isNotNull())).alias("avg")]
    counts += [n(F.col(col) < t).alias(f"n_{_tag(t)}") for t in below]
    if year:
        counts += [F.min(year).alias("_y0"), F.max(year).alias("_y1")]
    agg = base.rollup(key).agg(F.grouping(key).alias("_total"), *counts)
    label = F.when(F.col("_total") == 1, F.lit(total)).otherwise(F.col(key))
    agg = agg.withColumn(key, label).drop("_total")
    vals = stored(base.where(F.col(col).isNotNull()).groupBy(key, col).agg(F.sum("_c").alias("_c")))
    everyone = vals.groupBy(col).agg(F.sum("_c").alias("_c")).select(F.lit(total).alias(key), col, "_c")
    table = agg.join(O.quantiles_of_counts(vals.unionByName(everyone), [key], col, probs), key, "left")
    if year:
        waves = base.select(key, year).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_waves"))
        # the grand total adds the waves of all groups
        waves = waves.unionByName(waves.agg(F.sum("n_waves").alias("n_waves")).select(F.lit(total).alias(key), "n_waves"))
        same = F.col("_y0") == F.col("_y1")
        period = F.when(same, F.col("_y0").cast("string")).otherwise(F.concat_ws("-", F.col("_y0").cast("string"), F.col("_y1").cast("string")))
        table = table.join(waves, key, "left").withColumn("period", period).drop("_y0", "_y1")
    for t in below:
        table = table.withColumn(f"prct_below_{_tag(t)}", 100 * F.col(f"n_{_tag(t)}") / F.col("n_obs"))
    return table


def share_below(df: DataFrame, keys: list[str], col: str, thresholds: list[float]) -> DataFrame:
    """n, total, and count, sum and shares below each threshold, in one pass."""
    v = F.col(col)
    parts = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total")]
    for t in thresholds:
        under = v < t
        parts += [
            F.count_if(under).alias(f"nb_{_tag(t)}"),
            F.coalesce(F.sum(F.when(under, v)), F.lit(0.0)).alias(f"sum_{_tag(t)}"),
        ]
    out = df.groupBy(*keys).agg(*parts)
    return out.withColumns(
        {
            **{f"share_nb_{_tag(t)}": N.safe_ratio(f"nb_{_tag(t)}", "n") for t in thresholds},
            **{f"share_sum_{_tag(t)}": N.safe_ratio(f"sum_{_tag(t)}", "total") for t in thresholds},
        }
    )


def box_stats(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    return O.group_quantiles(df, keys, col, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def moments(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Population skewness, its bias-corrected form, and non-excess kurtosis."""
    out = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(
        F.count(col).alias("n"), F.skewness(col).alias("skew_pop"), (F.kurtosis(col) + 3).alias("kurtosis")
    )
    n = F.col("n").cast("double")
    fixed = F.col("skew_pop") * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2)
    return out.withColumn("skew_sample", fixed)


def gini(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Uncorrected Gini: 2 sum(i * x(i)) / (n sum x) - (n + 1) / n.

    Equal values are counted first; c copies starting after rank b add
    x * (c * b + c (c + 1) / 2) to the rank sum.
    """
    vals = O.value_counts(df, keys, col)
    run = O.prefix_sums(vals, keys, [col], ["_c"])
    c, before = F.col("_c").cast("double"), (F.col("_c_run") - F.col("_c")).cast("double")
    agg = run.groupBy(*keys).agg(
        F.max("_c_all").cast("double").alias("_n"),
        F.sum(F.col(col) * c).alias("_sum"),
        F.sum(F.col(col) * (c * before + c * (c + 1) / 2)).alias("_ranked"),
    )
    value = N.safe_ratio(2 * F.col("_ranked"), F.col("_n") * F.col("_sum")) - (F.col("_n") + 1) / F.col("_n")
    return agg.select(*keys, F.col("_n").cast("long").alias("n"), value.alias("gini"))


def ecdf(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    run = O.prefix_sums(O.value_counts(df, keys, col), keys, [col], ["_c"])
    return run.select(*keys, col, (F.col("_c_run") / F.col("_c_all")).alias("ecdf"))


def density_grid(df: DataFrame, x: str, y: str, n: int, lims: tuple[float, float, float, float]) -> DataFrame:
    """Counts and density on an n x n lattice; points outside are left out."""
    x0, x1, y0, y1 = lims
    cell = df.select(
        F.width_bucket(F.col(x), F.lit(float(x0)), F.lit(float(x1)), F.lit(n)).alias("x_bin"),
        F.width_bucket(F.col(y), F.lit(float(y0)), F.lit(float(y1)), F.lit(n)).alias("y_bin"),
    ).where(F.col("x_bin").between(1, n) & F.col("y_bin").between(1, n))
    counts = cell.groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    area = (x1 - x0) / n * (y1 - y0) / n
    return counts.withColumn("density", F.col("n") / (total * F.lit(area)))


# correlation and agreement --------------------------------------------------
def _pair(a: str, b: str) -> Column:
    return F.col(a).isNotNull() & F.col(b).isNotNull()


def pearson(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    out = df.where(_pair(a, b)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), N.corr(a, b).alias("r"))
    return out.withColumn("r2_corr", F.col("r") * F.col("r"))


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """r of every column pair on complete cases, from one aggregation."""
    pairs = list(combinations(cols, 2))
    row = C.complete_cases(df.select(*cols), cols).agg(
        F.count(F.lit(1)).alias("n"), *[N.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    cells = [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col("n"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*cells)))


def strong_pairs(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    return pairs.where(F.abs("r") > threshold)


def ranked_with_target(pairs: DataFrame, target: str) -> DataFrame:
    """Variables by absolute correlation with the target, strongest first."""
    hit = pairs.where((F.col("var_a") == target) | (F.col("var_b") == target))
    other = F.when(F.col("var_a") == target, F.col("var_b")).otherwise(F.col("var_a"))
    return hit.select(other.alias("variable"), "r").orderBy(F.desc(F.abs("r")), "variable")


def _two_sided_p(r: float | None, n: int) -> float | None:
    """Student-t p-value of a correlation by a continued fraction."""
    if r is None or n < 3:
        return None
    df = n - 2
    x = 1.0 - r * r  # df / (df + t^2)
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    a, b = df / 2, 0.5
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, 1 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d or 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1.0 + num * d) or 1e-300)
            c = (1.0 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - front * h if flip else front * h


def correlation_test(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairs with p-value and stars; the p step sees only one row per pair."""

    def stars(p):
        return None if p is None else "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""

    def add(batches):
        for pdf in batches:
            pdf["p"] = [_two_sided_p(None if r != r else r, int(n)) for r, n in zip(pdf["r"], pdf["n"])]
            pdf["stars"] = [stars(None if p is None or p != p else p) for p in pdf["p"]]
            yield pdf

    return correlation_pairs(df, cols).mapInPandas(add, "var_a string, var_b string, n long, r double, p double, stars string")


def regression_metrics(df: DataFrame, keys: list[str], obs: str, pred: str) -> DataFrame:
    """MAE, RMSE, R2 by squared error and by correlation, bias, RPD, RRMSE."""
    o, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    err = p - o
    agg = df.where(_pair(obs, pred)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("bias"),
        F.stddev_pop(o).alias("_sd"),
        F.avg(o).alias("_mean"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(o) * F.count(F.lit(1))).alias("_sst"),
        N.corr(o, p).alias("_r"),
    )
    return agg.select(
        *keys, "n", "mae", "rmse", "bias",
        (1 - N.safe_ratio("_sse", "_sst")).alias("r2_sse"),
        (F.col("_r") * F.col("_r")).alias("r2_corr"),
        (F.col("_sd") / (F.col("rmse") + N.EPS)).alias("rpd"),
        N.safe_ratio("rmse", "_mean").alias("rrmse"),
    )


def summarise_folds(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sd of each metric over folds and the number of folds that gave one."""
    parts = []
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"), F.count(m).alias(f"{m}_folds")]
    return df.groupBy(*keys).agg(*parts)


def hyper_response(df: DataFrame, params: list[str], metrics: list[str], rule: str) -> DataFrame:
    """Mean and sd of the metrics per (parameter, value, rule)."""
    long = df.select(*metrics, rule, *[F.col(p).cast("string").alias(p) for p in params]).unpivot([*metrics, rule], params, "parameter", "value")
    parts = []
    for m in metrics:
        parts += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd")]
    return long.groupBy("parameter", "value", rule).agg(F.count(F.lit(1)).alias("n"), *parts)


def mean_rank(df: DataFrame, unit: str, variable: str, score: str) -> DataFrame:
    """Rank of each variable's score within its unit (largest = 1), averaged.

    A unit holds one row per model variable, so the window stays short.
    """
    w = Window.partitionBy(unit).orderBy(F.desc(score))
    return df.withColumn("_rank", F.rank().over(w)).groupBy(variable).agg(F.avg("_rank").alias("mean_rank"), F.count(F.lit(1)).alias("n_units"))


def measurement_quality(df: DataFrame, keys: list[str], measured: str, reported: str) -> DataFrame:
    """Coverage, agreement and the ratio of reported to measured area; ``df`` is read once."""
    both = _pair(measured, reported) & (F.col(measured) > 0) & (F.col(reported) > 0)
    ratio = F.when(both, N.safe_ratio(reported, measured))
    work = stored(df.select(*dict.fromkeys([*keys, measured, reported])).withColumn("_ratio", ratio))
    base = work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_plots"),
        F.count(measured).alias("n_measured"),
        (100 * F.avg(F.col(measured).isNotNull().cast("double"))).alias("pct_measured"),
        F.count_if(both).alias("n_both"),
        N.corr(F.when(both, F.col(measured)), F.when(both, F.col(reported))).alias("r"),
        F.avg("_ratio").alias("ratio_mean"),
        F.stddev_samp("_ratio").alias("ratio_sd"),
        (100 * F.avg(F.when(both, (F.col("_ratio") > 1).cast("double")))).alias("pct_over"),
    )
    mid = O.group_quantiles(work, keys, "_ratio", {"ratio_median": 0.5})
    return O.join_null_safe(base, mid, keys, "left")


def rejection_rate(df: DataFrame, keys: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Percent of units whose test rejects; units without a p-value count as not."""
    hit = F.coalesce(F.col(p) < alpha, F.lit(False)).cast("double")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (100 * F.avg(hit)).alias("pct_rejected"))


def levelled_fit(df: DataFrame, levels: list[str], obs: str, pred: str) -> DataFrame:
    """Means per unit at each nested level, then agreement across units per level."""
    sets = [[F.col(c) for c in levels[: i + 1]] for i in range(len(levels))]
    means = df.where(_pair(obs, pred)).groupingSets(sets, *levels).agg(
        F.grouping_id().alias("_id"), F.avg(obs).alias("_o"), F.avg(pred).alias("_p")
    )
    depth = len(levels)
    name = F.lit(None).cast("string")
    for i, level in enumerate(levels):
        name = F.when(F.col("_id") == (1 << (depth - 1 - i)) - 1, F.lit(level)).otherwise(name)
    fit = means.withColumn("level", name).groupBy("level").agg(F.count(F.lit(1)).alias("n_units"), N.corr("_o", "_p").alias("_r"))
    return fit.select("level", "n_units", (F.col("_r") * F.col("_r")).alias("r2_corr"))


def ols_line(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.regr_count(F.col(y), F.col(x)).alias("n"),
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_r2(F.col(y), F.col(x)).alias("r2"),
    )


def envelope_points(df: DataFrame, x: str, y: str, width: float, n: int, ties: list[str]) -> DataFrame:
    """The n largest y in each x bin (right-closed); limits apply before the shuffle."""
    binned = df.where(_pair(x, y)).withColumn("bin", F.ceil(F.col(x) / F.lit(float(width))).cast("long"))
    w = Window.partitionBy("bin").orderBy(F.desc(y), *ties)
    return binned.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def upper_envelope(df: DataFrame, x: str, y: str, width: float, n: int, ties: list[str]) -> DataFrame:
    return ols_line(envelope_points(df, x, y, width, n, ties), [], y, x)


def ellipse(df: DataFrame, keys: list[str], x: str, y: str, level: float) -> DataFrame:
    """Centre, half-axes and angle of a normal confidence ellipse.

    The chi-square quantile with two degrees of freedom is -2 ln(1 - level).
    """
    scale = -2 * math.log(1 - level)
    m = df.where(_pair(x, y)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"),
        F.var_samp(x).alias("_a"), F.var_samp(y).alias("_b"), F.covar_samp(x, y).alias("_c"),
    )
    mid, half = (F.col("_a") + F.col("_b")) / 2, (F.col("_a") - F.col("_b")) / 2
    root = F.sqrt(half * half + F.col("_c") * F.col("_c"))
    return m.select(
        *keys, "n", "cx", "cy",
        F.sqrt(F.lit(scale) * (mid + root)).alias("major"),
        F.sqrt(F.lit(scale) * F.greatest(mid - root, F.lit(0.0))).alias("minor"),
        (F.atan2(2 * F.col("_c"), F.col("_a") - F.col("_b")) / 2).alias("angle"),
    )


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance inflation: diagonal of the inverse of the k x k correlation matrix."""
    import numpy as np
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    rows = VectorAssembler(inputCols=cols, outputCol="v").transform(C.complete_cases(df.select(*cols), cols))
    matrix = Correlation.corr(rows, "v").first()[0].toArray()
    return df.sparkSession.createDataFrame(
        list(zip(cols, np.diag(np.linalg.inv(matrix)).tolist())), "variable string, vif double"
    )


def quantile_bands(df: DataFrame, key: str, values: str) -> DataFrame:
    """min, mean and max of the i-th list element per class."""
    long = df.select(key, F.posexplode(values).alias("_pos", "_v"))
    return long.groupBy(key, (F.col("_pos") + 1).alias("quantile")).agg(
        F.min("_v").alias("low"), F.avg("_v").alias("central"), F.max("_v").alias("high")
    )


# data contract ---------------------------------------------------------------
def check_contract(df: DataFrame, required: list[str], rules: dict[str, Column], minimum: dict[str, tuple[str, int]] | None = None, min_rows: int = 0, median: tuple[str, float, float] | None = None) -> DataFrame:
    """(rule, violations): columns, row rules, group counts, rows and median range.

    A NULL rule counts as broken.  Row rules share one pass over the data.
    """
    spark = df.sparkSession
    missing = [(f"column {c}", 0 if c in df.columns else 1) for c in required]
    out = spark.createDataFrame(missing, "rule string, violations long") if missing else None
    parts = {n: F.count_if(~F.coalesce(ok, F.lit(False))) for n, ok in rules.items()}
    parts["min_rows"] = F.when(F.count(F.lit(1)) < min_rows, 1).otherwise(0).cast("long")
    row = df.agg(*[e.cast("long").alias(n) for n, e in parts.items()])
    tables = [row.unpivot([], list(parts), "rule", "violations")]
    for name, (col, n) in (minimum or {}).items():
        few = F.when(F.count(F.lit(1)) < n, 1).otherwise(0).cast("long")
        tables.append(df.where(F.col(col).isNotNull()).select(col).distinct().agg(few.alias("violations")).select(F.lit(name).alias("rule"), "violations"))
    if median:
        col, lo, hi = median
        mid = O.group_quantiles(df, [], col, {"m": 0.5})
        tables.append(mid.select(F.lit("median_range").alias("rule"), F.when(F.col("m").between(lo, hi), 0).otherwise(1).cast("long").alias("violations")))
    return reduce(DataFrame.unionByName, tables if out is None else [out, *tables])
