"""Assignment of rows and groups to cross-validation folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.functions import numbers as N
from plotwise.operators import ordering as O


def stratified_folds(df: DataFrame, y: str, ids: list[str], k: int, seed: int = 0, strata: int = 4, out: str = "fold") -> DataFrame:
    """Balanced folds within quantile strata of the response.

    Rows of a stratum are dealt to folds in the order of a seeded hash.
    """
    cuts = {f"c{i}": i / strata for i in range(1, strata)}
    row = O.group_quantiles(df, [], y, cuts).select(F.struct(*cuts)).scalar()
    work = df.withColumn("_cuts", row)
    stratum = sum(((F.col(y) > F.col(f"_cuts.{c}")).cast("int") for c in cuts), F.lit(0))
    work = work.withColumn("stratum", stratum).withColumn("_u", N.uniform_hash(*ids, seed=seed)).drop("_cuts")
    dealt = O.row_numbers(work, ["stratum"], ["_u", *ids], "_n")
    return dealt.withColumn(out, ((F.col("_n") - 1) % k).cast("int")).drop("_n", "_u")


def random_folds(df: DataFrame, ids: list[str], k: int, seed: int = 0, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.floor(N.uniform_hash(*ids, seed=seed) * k).cast("int"))


def train_test(df: DataFrame, ids: list[str], share: float = 0.7, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by hashed keys; a row always lands on the same side."""
    u = N.uniform_hash(*ids, seed=seed)
    return df.where(u < share), df.where(u >= share)


def group_folds(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """Whole groups per fold, balanced by size.

    Groups are numbered from the largest down and dealt to the folds forth and
    back, 0 .. k-1, k-1 .. 0, so fold sizes differ by less than the largest group
    at any number of groups. NULL is a group of its own.
    """
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    numbered = O.row_numbers(counts.withColumn("_less", -F.col("_n")), [], ["_less", group], "_at")
    turn = F.pmod(F.col("_at") - 1, F.lit(2 * k))
    fold = F.when(turn < k, turn).otherwise(2 * k - 1 - turn).cast("int")
    return O.join_null_safe(df, numbered.select(group, fold.alias(out)), [group])


def logo_plan(df: DataFrame, key: str) -> DataFrame:
    """One fold per distinct unit: train on the rest, test on the unit."""
    units = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_test"))
    total = units.agg(F.sum("n_test")).scalar()
    numbered = O.row_numbers(units, [], [key], "fold")
    return numbered.select("fold", F.col(key).alias("test_unit"), "n_test", (total - F.col("n_test")).alias("n_train"))
