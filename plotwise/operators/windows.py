"""Running sums, ranks and ordered picks within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions import numbers as N
from plotwise.operators import ordering as O


def cumulate(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Add ``cum_<col>``, the running sum along the order."""
    run = O.prefix_sums(df, keys, order, cols)
    return run.select(*df.columns, *[F.col(f"{c}_run").alias(f"cum_{c}") for c in cols])


def cumulative_share(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Running sum over group total per column; 0 where the total is 0."""
    run = O.prefix_sums(df, keys, order, cols)
    kept = [c for c in df.columns if c not in cols]
    return run.select(*kept, *[F.coalesce(N.safe_ratio(f"{c}_run", f"{c}_all"), F.lit(0.0)).alias(c) for c in cols])


def share_curves(df: DataFrame, keys: list[str], order: str, cols: list[str], overall: str | None = None) -> DataFrame:
    """Lorenz-type curves: sums per (keys, order) first, then cumulative shares.

    ``overall`` labels an extra curve over all groups (single key only).
    """
    from plotwise.operators.stats import sum_all

    sums = sum_all(df, [*keys, order], cols)
    curves = cumulative_share(sums, keys, [order], cols)
    if overall is None:
        return curves
    everyone = sum_all(sums, [order], cols).withColumn(keys[0], F.lit(overall))
    return curves.unionByName(cumulative_share(everyone, keys, [order], cols))


def decumulate(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Add ``step_<col>``: the first value, then differences."""
    prev = O.carry(df, keys, order, {c: f"_prev_{c}" for c in cols}, previous=True)
    return prev.select(*df.columns, *[F.coalesce(F.col(c) - F.col(f"_prev_{c}"), F.col(c)).alias(f"step_{c}") for c in cols])


def top_k(df: DataFrame, keys: list[str], col: str, k: int, ties: list[str], largest: bool = True, out: str = "rank") -> DataFrame:
    """First k rows per group; Spark limits each group before the shuffle."""
    order = [F.desc_nulls_last(col) if largest else F.asc_nulls_last(col), *[F.asc(t) for t in ties]]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_past(df: DataFrame, keys: list[str], order: str, threshold: float, k: int, ties: list[str] | None = None) -> DataFrame:
    """First k rows past a threshold on an ordered curve."""
    return top_k(df.where(F.col(order) > threshold), keys, order, k, ties or [], largest=False, out="step")


def crossing(df: DataFrame, value: str, lo: float = 0.4999, hi: float = 0.501) -> DataFrame:
    return df.where((F.col(value) > lo) & (F.col(value) < hi))


def distinct_keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def rank_desc(df: DataFrame, keys: list[str], col: str, out: str = "rank") -> DataFrame:
    """rank() with the largest value first; ties share a rank.

    Ranks are found on distinct values and joined back, so neither a large
    group nor a frequent value ends up in one task.
    """
    vals = O.value_counts(df, keys, col).withColumn("_neg", -F.col(col).cast("double"))
    run = O.prefix_sums(vals, keys, ["_neg"], ["_c"])
    ranks = run.select(*keys, col, (F.col("_c_run") - F.col("_c") + 1).alias(out))
    return O.join_null_safe(df, ranks, [*keys, col])


def category_code(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Dense code 0, 1, ... in the sort order of the categories."""
    cats = df.where(F.col(col).isNotNull()).select(col).distinct()
    coded = O.row_numbers(cats, [], [col], "_n").select(col, (F.col("_n") - 1).alias(out))
    return df.join(coded, col, "left").withColumn(out, F.coalesce(out, F.lit(-1).cast("long")))
