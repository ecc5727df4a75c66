"""Sorting, sampling, set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions import numbers as N


def sort_by(df: DataFrame, **direction: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) if d == "desc" else F.asc(c) for c, d in direction.items()])


def top_report(df: DataFrame, col: str, n: int, ties: list[str], largest: bool = True) -> DataFrame:
    """Head or tail of an ordered table; runs as a per-task top-n and one merge."""
    return df.orderBy(F.desc(col) if largest else F.asc(col), *ties).limit(n)


def lattice_sample(df: DataFrame, x: str, y: str, x0: float, y0: float, step: float, digits: int = 1) -> DataFrame:
    """Points whose rounded coordinates fall on a coarse lattice.

    Membership is arithmetic on the row, so no lattice table is built.
    """
    scale = 10**digits
    unit = round(step * scale)
    on = lambda c, base: F.pmod(F.round(F.round(F.col(c), digits) * scale).cast("long") - round(base * scale), F.lit(unit)) == 0
    return df.where(on(x, x0) & on(y, y0))


def seeded_sample(df: DataFrame, ids: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash (all rows when there are fewer)."""
    return df.withColumn("_u", N.uniform_hash(*ids, seed=seed)).orderBy("_u", *ids).limit(n).drop("_u")


def difference(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_anti")


def merge_layers(layers: list[DataFrame], key: str = "cell_id", value: str = "value") -> DataFrame:
    """First non-null value per cell in the given order of layers."""
    ranked = [df.where(F.col(value).isNotNull()).select(key, F.lit(i).alias("_order"), value) for i, df in enumerate(layers)]
    long = reduce(DataFrame.unionByName, ranked)
    return long.groupBy(key).agg(F.min_by(value, "_order").alias(value))


def to_long(df: DataFrame, ids: list[str], prefix: str, name: str = "name", value: str = "value") -> DataFrame:
    """Columns with a prefix become rows; the prefix is stripped from the name."""
    cols = [c for c in df.columns if c.startswith(prefix) and c not in ids]
    long = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, name, value)
    return long.withColumn(name, F.substring(name, len(prefix) + 1, 1_000_000))


def to_wide(df: DataFrame, ids: list[str], name: str, values: list, agg: Column) -> DataFrame:
    """Long to wide for a stated list of values, so no extra pass finds them."""
    return df.groupBy(*ids).pivot(name, values).agg(agg)


def unnest(df: DataFrame, arrays: list[str], position: str = "pos") -> DataFrame:
    """Parallel lists to rows; one row per element with its 1-based position."""
    rest = [c for c in df.columns if c not in arrays]
    long = df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("_p", "_e"))
    return long.select(*rest, (F.col("_p") + 1).alias(position), *[F.col(f"_e.{a}").alias(a) for a in arrays])


def bands_to_array(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in cols], F.array(*cols).alias(out))


def array_to_bands(df: DataFrame, col: str, n: int, prefix: str = "q") -> DataFrame:
    width = len(str(n))
    return df.select(
        *[c for c in df.columns if c != col],
        *[F.get(F.col(col), F.lit(i)).alias(f"{prefix}{i + 1:0{width}d}") for i in range(n)],
    )
