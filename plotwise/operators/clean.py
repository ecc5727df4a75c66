"""Cleaning, recoding and filtering of survey tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwise.functions import numbers as N
from plotwise.operators import ordering as O

SENTINELS = (99, 999, 9999, 99999, 999999)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become NULL (done at ingest)."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: N.finite(c) for c in floats}) if floats else df


def rename_strip(df: DataFrame, pattern: str, replacement: str = "") -> DataFrame:
    return df.toDF(*[re.sub(pattern, replacement, c) for c in df.columns])


def select_matching(df: DataFrame, *patterns: str) -> DataFrame:
    """Columns matching any pattern, in the order of the patterns."""
    names: list[str] = []
    for p in patterns:
        names += [c for c in df.columns if re.search(p, c) and c not in names]
    return df.select(*names)


def select_present(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[c for c in names if c in df.columns])


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna("any", subset=cols)


def null_sentinels(df: DataFrame, col: str, values=SENTINELS) -> DataFrame:
    return df.withColumn(col, F.when(~N.is_in(col, values), F.col(col)))


def fix_area_units(df: DataFrame, measured: str, reported: str) -> DataFrame:
    """Square metres typed as hectares, told by the size of the reported area."""
    m, r = F.col(measured), F.col(reported)
    wrong = ((m > 10) & (r < 1)) | ((m > 1000) & (r >= 1))
    return df.withColumn(measured, F.when(wrong, m / 10000).otherwise(m))


def null_above(df: DataFrame, col: str, limit: float) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col) <= limit, F.col(col)))


def prefer_measured(df: DataFrame, measured: str, reported: str, out: str, ratio: float = 5, floor: float = 20) -> DataFrame:
    """Measured area unless missing, not positive, or implausibly above reported."""
    m, r = F.col(measured), F.col(reported)
    # NULL and zero reported areas: R gives NA (rule skipped) and Inf (rule met)
    far = F.when(r == 0, m > 0).otherwise(m / F.when(r != 0, r) > ratio) & (m > floor)
    return df.withColumn(out, F.when(m.isNull() | (m <= 0) | F.coalesce(far, F.lit(False)), r).otherwise(m))


def convert_units(
    df: DataFrame,
    lookup: DataFrame,
    fixed: dict[str, float],
    fallback: dict[str, float],
    place: str,
    unit: str,
    amount: str,
    out: str,
) -> DataFrame:
    """Local units to hectares: fixed unit, then (place, unit) rate, then fallback.

    ``lookup`` has the columns ``place``, ``unit`` and ``rate``, unique per pair.
    """
    table = lookup.select(F.col("place").alias(place), F.col("unit").alias(unit), F.col("rate").alias("_rate"))
    none = F.lit(None).cast("double")
    rate = F.coalesce(
        N.recode(unit, fixed, none) if fixed else none,
        F.col("_rate"),
        N.recode(unit, fallback, none) if fallback else none,
    )
    return df.join(table, [place, unit], "left").withColumn(out, F.col(amount) * rate).drop("_rate")


def strip_prefix(col, prefixes: tuple[str, ...]) -> Column:
    return F.regexp_replace(N.as_col(col), "^(" + "|".join(re.escape(p) for p in prefixes) + ")", "")


def nested_id(*parts, width: int = 2) -> Column:
    """Ids joined by underscores; numeric parts are zero-padded."""
    cells = [p if isinstance(p, Column) else F.lpad(F.col(p).cast("string"), width, "0") for p in parts]
    return F.concat_ws("_", *cells)


def sequence_id(df: DataFrame, keys: list[str], order: list[str], out: str = "seq_id") -> DataFrame:
    """country_year_n, n counting along a total order within the keys."""
    numbered = O.row_numbers(df, keys, order, "_n")
    return numbered.withColumn(out, F.concat_ws("_", *[F.col(k).cast("string") for k in keys], F.col("_n").cast("string"))).drop("_n")


def within_bbox(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float], null_island: bool = True) -> DataFrame:
    """Points strictly inside (x0, x1, y0, y1); (0, 0) counts as missing."""
    x0, x1, y0, y1 = box
    keep = (F.col(x) > x0) & (F.col(x) < x1) & (F.col(y) > y0) & (F.col(y) < y1)
    return df.where(keep & ~((F.col(x) == 0) & (F.col(y) == 0)) if null_island else keep)


def exclude_values(df: DataFrame, col: str, values) -> DataFrame:
    """Rows whose value is outside the set; missing values stay."""
    return df.where(~N.is_in(col, values))


def drop_small_groups(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Groups with at least n rows.

    The counts are combined before the shuffle and joined back, so no task
    holds a whole group.
    """
    small = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < n).drop("_n")
    return _without(df, small, keys)


def _without(df: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    renamed = bad.select(*[F.col(k).alias(f"_bad_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_bad_{k}")) for k in keys]
    return df.join(renamed, on, "left_anti")


def trim_by_quantile(df: DataFrame, keys: list[str], col: str, p: float) -> DataFrame:
    """Rows at or below the p-quantile of their group."""
    limits = O.group_quantiles(df, keys, col, {"_limit": p})
    return O.join_null_safe(df, limits, keys).where(F.col(col) <= F.col("_limit")).drop("_limit")


def map_sets(df: DataFrame, col: str, sets: dict[str, list], out: str) -> DataFrame:
    """Name of the set that holds the code; NULL when none does."""
    return df.withColumn(out, N.recode(col, {c: name for name, codes in sets.items() for c in codes}, F.lit(None).cast("string")))


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / sample sd over the whole table; one scalar subquery."""
    stats = df.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols])).scalar()
    work = df.withColumn("_stats", stats)
    return work.withColumns({c: N.safe_ratio(F.col(c) - F.col(f"_stats.{c}.m"), F.col(f"_stats.{c}.s")) for c in cols}).drop("_stats")


def with_powers(df: DataFrame, col: str, degree: int = 2) -> DataFrame:
    return df.withColumns({f"{col}_p{d}": F.pow(F.col(col), F.lit(float(d))) for d in range(2, degree + 1)})


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-finite to NULL, then the exact column median, 0 when there is none."""
    clean = df.withColumns({c: N.finite(c) for c in cols})
    long = clean.unpivot([], cols, "_name", "_value")
    medians = O.group_quantiles(long, ["_name"], "_value", {"_median": 0.5})
    row = medians.agg(F.map_from_entries(F.collect_list(F.struct("_name", "_median")))).scalar()
    work = clean.withColumn("_medians", row)
    return work.withColumns({c: F.coalesce(F.col(c), F.col("_medians")[c], F.lit(0.0)) for c in cols}).drop("_medians")


def column_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, null_share, distinct_ends) per column in one pass."""
    parts = []
    for c in cols:
        v = F.col(c).cast("double")
        parts += [F.avg(v.isNull().cast("double")).alias(f"{c}|n"), F.min(v).alias(f"{c}|a"), F.max(v).alias(f"{c}|b")]
    row = df.agg(*parts)
    cells = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(f"{c}|n").alias("null_share"), F.col(f"{c}|a").alias("low"), F.col(f"{c}|b").alias("high")) for c in cols]
    )
    return row.select(F.inline(cells))


def drop_constant(df: DataFrame, cols: list[str]) -> DataFrame:
    """Without columns of at most one distinct value (NULL is not a value)."""
    flat = [r["name"] for r in column_profile(df, cols).where("low is null or low = high").collect()]
    return df.drop(*flat)


def drop_sparse(df: DataFrame, cols: list[str], p: float) -> DataFrame:
    sparse = [r["name"] for r in column_profile(df, cols).where(F.col("null_share") > p).collect()]
    return df.drop(*sparse)


def variance_filter(df: DataFrame, cols: list[str], threshold: float = 0.0) -> DataFrame:
    """Keep columns whose sample variance is above the threshold."""
    row = df.agg(*[F.var_samp(c).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if row[c] is None or row[c] <= threshold])


def mask_to_centroid(df: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """Coordinates replaced by the mean of their cluster."""
    centre = df.groupBy(key).agg(F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    return O.join_null_safe(df.drop(x, y), centre, [key]).withColumnsRenamed({"_x": x, "_y": y})


def strip_footnotes(df: DataFrame, col: str, drop: str = "source|note", mark: str = r"\*") -> DataFrame:
    """Footnote rows removed; a mark in the name becomes a certainty flag."""
    kept = df.where(~F.coalesce(F.lower(col).rlike(drop), F.lit(False)))
    return kept.withColumns(
        {
            "certitude": F.when(F.coalesce(F.col(col).rlike(mark), F.lit(False)), "missing_info").otherwise("complete_info"),
            col: F.regexp_replace(F.col(col), mark, ""),
        }
    )


def fill_down(df: DataFrame, cols: list[str], order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Each missing value takes the last one above it."""
    return O.carry(df, keys or [], order, {c: c for c in cols}, previous=False).select(*df.columns)


def period_label(df: DataFrame, keys: list[str], year: str, out: str = "period") -> DataFrame:
    span = df.groupBy(*keys).agg(F.min(year).cast("string").alias("_a"), F.max(year).cast("string").alias("_b"))
    label = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.concat_ws("-", "_a", "_b"))
    return span.select(*keys, label.alias(out))


def best_row(df: DataFrame, col: str, ties: list[str], largest: bool = True, keys: list[str] | None = None) -> DataFrame:
    """The row with the largest (smallest) value; ties fall to the lowest tie columns.

    Window limits are applied before the shuffle, so each task sends one row
    per group.
    """
    order = [F.desc_nulls_last(col) if largest else F.asc_nulls_last(col), *[F.asc(t) for t in ties]]
    if not keys:
        return df.orderBy(*order).limit(1)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def override(df: DataFrame, key: str, col: str, values: dict) -> DataFrame:
    """Replace single values by key."""
    return df.withColumn(col, N.recode(key, values, F.col(col)))


def drop_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Header or total rows recognised by content; unknown counts as keep."""
    return df.where(~F.coalesce(condition, F.lit(False)))
