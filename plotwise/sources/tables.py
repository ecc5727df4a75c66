"""Reading and writing the flat tables that pass between analysis steps."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WAVE_FILE = r"([^/]+)_(\d{4})_raw\.csv$"
STEP_FILE = r"(\d{4})\.(\d{1,2})\.(\d)[^/]*$"


def read_waves(spark: SparkSession, path: str, schema: T.StructType, pattern: str = WAVE_FILE) -> DataFrame:
    """Every survey wave under a glob; country and year come from the file name.

    The schema fixes ids as strings; exact duplicate rows of a wave collapse.
    """
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    name = F.col("_metadata.file_path")
    named = raw.select(
        *[c for c in raw.columns if c not in ("country", "year")],
        F.regexp_extract(name, pattern, 1).alias("country"),
        F.regexp_extract(name, pattern, 2).try_cast("int").alias("year"),
    )
    return named.dropDuplicates()


def wave_manifest(df: DataFrame, farm: str = "farm_id") -> DataFrame:
    """Distinct farms per wave, newest wave of each country first."""
    # two plain aggregates spread a large wave; count_distinct would not
    per_farm = df.select("country", "year", farm).distinct().where(F.col(farm).isNotNull())
    return (
        per_farm.groupBy("country", "year")
        .agg(F.count(F.lit(1)).alias("nb_farms"))
        .orderBy(F.asc("country"), F.desc("year"))
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fallback: str | None = None) -> DataFrame:
    """A Parquet, ORC or CSV table with blanks trimmed from its header.

    ``fallback`` is tried when nothing exists at ``path``.
    """
    if fallback is not None and not _exists(spark, path):
        path = fallback
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "csv":
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    elif kind in ("parquet", "orc"):
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = getattr(reader, kind)(path)
    else:
        df = spark.read.parquet(path)
    return trim_header(df)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies at the path or matches the pattern."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def union_fill(*dfs: DataFrame) -> DataFrame:
    """Union by name; columns a source lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def with_step_columns(df: DataFrame, name, pattern: str = STEP_FILE) -> DataFrame:
    """Year, month and dekad columns out of a layer name; other names drop out."""
    parts = {n: F.regexp_extract(name, pattern, i).try_cast("int") for i, n in enumerate(("year", "month", "dekad"), 1)}
    return df.withColumns(parts).where(F.col("year").isNotNull())


def read_time_layers(spark: SparkSession, path: str, schema: T.StructType, pattern: str = STEP_FILE) -> DataFrame:
    """Time-stepped layers, one file per step; absent steps are simply not read."""
    raw = spark.read.csv(path, schema=schema, header=True)
    named = raw.select("*", F.col("_metadata.file_path").alias("_file"))
    return with_step_columns(named, F.col("_file"), pattern).drop("_file")


def stack_layers(layers: dict[str, DataFrame], key: str = "cell_id", value: str = "value") -> DataFrame:
    """Single-band cell tables side by side, one column per layer.

    A union and one aggregate replace a chain of full outer joins: one shuffle
    for any number of layers.
    """
    long = reduce(
        DataFrame.unionByName,
        [df.select(key, F.lit(n).alias("_layer"), F.col(value).cast("double").alias("_value")) for n, df in layers.items()],
    )
    return long.groupBy(key).agg(*[F.max(F.when(F.col("_layer") == n, F.col("_value"))).alias(n) for n in layers])


def select_layers(df: DataFrame, pattern: str, rename=None, keep: tuple[str, ...] = ("cell_id",)) -> DataFrame:
    """Columns whose name matches a pattern, optionally renamed."""
    found = [c for c in df.columns if re.search(pattern, c)]
    return df.select(*keep, *[F.col(c).alias(rename(c) if rename else c) for c in found])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """A named set of tables, one sub-directory each."""
    for name, df in tables.items():
        write_table(df, f"{path.rstrip('/')}/{name}", fmt)


def write_partitioned(df: DataFrame, path: str, cols: list[str], fmt: str = "parquet") -> None:
    """One directory per value of ``cols``.

    Dynamic overwrite replaces only the partitions present in ``df``.  Rows are
    not shuffled to one task per value, so a dominant value is written in
    parallel; rebalance lets adaptive execution choose file sizes.
    """
    df.hint("rebalance", *cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *cols
    ).format(fmt).save(path)


def pending_units(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units of a plan that have no finished result yet."""
    return plan.join(done.select(*keys), keys, "left_anti")


def gather_results(spark: SparkSession, path: str, fmt: str = "parquet", units: list[str] | None = None) -> DataFrame:
    """All per-unit results below one directory as a single table.

    Folders named column=value below ``path`` give a column. ``units`` names
    folders that are called otherwise; column=value folders below those give
    columns as well.
    """
    parts = [spark.read.format(fmt).load(p) for p in ([path] if units is None else [f"{path}/{u}" for u in units])]
    return reduce(DataFrame.unionByName, parts)


def completeness(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Each expected unit with whether it is present."""
    seen = present.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return expected.join(seen, keys, "left").select(
        *expected.columns, F.coalesce("_seen", F.lit(False)).alias("present")
    )
