"""Registry, table access and the stand-in tables both engines derive alike."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwise.session import checkpoint_dir

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def scratch(self) -> str:
        """A fresh folder below the shared checkpoint folder."""
        return f"{checkpoint_dir(self.spark).rstrip('/')}/plotwise-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


# points of a customer ---------------------------------------------------------
def point_x(key):
    return F.round(F.lit(-18.0) + F.pmod(key * 7919, F.lit(7000)) / 100.0, 2)


def point_y(key):
    return F.round(F.lit(-35.0) + F.pmod(key * 104729, F.lit(5000)) / 100.0, 2)


SQL_X = "round(-18.0::DOUBLE + ({k} * 7919 % 7000) / 100.0::DOUBLE, 2)"
SQL_Y = "round(-35.0::DOUBLE + ({k} * 104729 % 5000) / 100.0::DOUBLE, 2)"


def points(t: Tables) -> DataFrame:
    c = t.customer
    return c.select(
        F.col("c_custkey").alias("point_id"),
        point_x(F.col("c_custkey")).alias("x"),
        point_y(F.col("c_custkey")).alias("y"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("value"),
    )


POINTS = f"""points AS (
  SELECT c_custkey AS point_id, {SQL_X.format(k='c_custkey')}::DOUBLE AS x, {SQL_Y.format(k='c_custkey')}::DOUBLE AS y,
         c_nationkey AS nation, c_acctbal AS value FROM customer)"""


# plots of a farm ----------------------------------------------------------------
def plots(t: Tables) -> DataFrame:
    """Line items as plots: orders are farms, (nation, order year) are waves."""
    li, o, c, n, r = t.lineitem, t.orders, t.customer, t.nation, t.region
    df = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")
    price = F.col("l_extendedprice") / 10000
    return df.select(
        point_x(F.col("c_custkey")).alias("x"),
        point_y(F.col("c_custkey")).alias("y"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("region"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderkey").cast("string").alias("farm_id"),
        (1 + F.col("c_custkey") % 9).cast("int").alias("hh_size"),
        F.col("l_linenumber").alias("plot_no"),
        F.when(k % 31 != 4, F.col("l_quantity") / 10).alias("reported_area_ha"),
        F.when(k % 17 == 0, F.lit(None).cast("double"))
        .when(k % 19 == 1, F.lit(999.0))
        .when(k % 23 == 2, price * 10000)
        .when(k % 29 == 3, price * 30)
        .otherwise(price)
        .alias("measured_plot_area_ha"),
    )


PLOTS = f"""plots AS (
  SELECT {SQL_X.format(k='c_custkey')}::DOUBLE AS x, {SQL_Y.format(k='c_custkey')}::DOUBLE AS y,
         n_name AS country, r_name AS region, CAST(year(o_orderdate) AS INTEGER) AS year,
         CAST(o_orderkey AS VARCHAR) AS farm_id, CAST(1 + c_custkey % 9 AS INTEGER) AS hh_size,
         l_linenumber AS plot_no,
         CASE WHEN (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 31 <> 4 THEN l_quantity / 10 END AS reported_area_ha,
         CASE WHEN (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 17 = 0 THEN NULL
              WHEN (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 19 = 1 THEN 999.0
              WHEN (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 23 = 2 THEN l_extendedprice / 10000 * 10000
              WHEN (l_orderkey * 7 + l_linenumber * 13 + l_partkey) % 29 = 3 THEN l_extendedprice / 10000 * 30
              ELSE l_extendedprice / 10000 END AS measured_plot_area_ha
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CLEAN = (
    PLOTS
    + """, fixed AS (
  SELECT * REPLACE (CASE WHEN measured_plot_area_ha IN (99, 999, 9999, 99999, 999999) THEN NULL ELSE measured_plot_area_ha END AS measured_plot_area_ha)
  FROM plots), scaled AS (
  SELECT * REPLACE (CASE WHEN measured_plot_area_ha > 10 AND reported_area_ha < 1 THEN measured_plot_area_ha / 10000
                         WHEN measured_plot_area_ha > 1000 AND reported_area_ha >= 1 THEN measured_plot_area_ha / 10000
                         ELSE measured_plot_area_ha END AS measured_plot_area_ha) FROM fixed), capped AS (
  SELECT * REPLACE (CASE WHEN measured_plot_area_ha <= 100 THEN measured_plot_area_ha END AS measured_plot_area_ha) FROM scaled), clean AS (
  SELECT *, CASE WHEN measured_plot_area_ha IS NULL OR measured_plot_area_ha <= 0 THEN reported_area_ha
                 WHEN measured_plot_area_ha / reported_area_ha > 5 AND measured_plot_area_ha > 20 THEN reported_area_ha
                 ELSE measured_plot_area_ha END AS plot_area_ha FROM capped)"""
)

FARMS = (
    CLEAN
    + """, farms AS (
  SELECT x, y, country, year, farm_id, hh_size, coalesce(sum(plot_area_ha), 0) AS farm_area_ha
  FROM clean WHERE (country, year, farm_id) NOT IN (SELECT (country, year, farm_id) FROM clean WHERE plot_area_ha IS NULL)
  GROUP BY ALL)"""
)


def clean_plots(t: Tables) -> DataFrame:
    from plotwise.plans.farm_size import clean_plots as clean

    return clean(plots(t))


def farms(t: Tables) -> DataFrame:
    from plotwise.operators.stats import farm_area

    return farm_area(clean_plots(t))


# cells of a regular 0.5 degree grid ---------------------------------------------
RES, X0, Y0, NX = 0.5, -18.0, -35.0, 140

CELLS = (
    POINTS
    + f""", cells AS (
  SELECT DISTINCT CAST(floor((y - ({Y0})) / {RES}) * {NX} + floor((x - ({X0})) / {RES}) AS BIGINT) AS cell_id FROM points), grid AS (
  SELECT cell_id, {X0} + (cell_id % {NX} + 0.5) * {RES} AS x, {Y0} + (cell_id // {NX} + 0.5) * {RES} AS y,
         cell_id % {NX} AS i, cell_id // {NX} AS j,
         CASE WHEN cell_id % 13 <> 0 THEN (cell_id * 7919 % 1000) / 10.0 END AS cropland,
         (cell_id * 104729 % 3000) / 1.0 AS rainfall,
         (cell_id * 15485863 % 2000) / 1.0 AS elevation,
         CAST(cell_id * 31 % 9 AS INTEGER) AS landcover FROM cells)"""
).replace("/ 10.0", "/ 10.0::DOUBLE").replace("/ 1.0", "/ 1.0::DOUBLE").replace(f"+ 0.5) * {RES}", f"+ 0.5::DOUBLE) * {RES}")


def grid(t: Tables) -> DataFrame:
    """Cells that hold a point, with four bands made from the cell number."""
    from plotwise.operators.geo import Grid

    g = Grid(X0, Y0, RES, NX)
    cells = points(t).select(g.cell("x", "y").alias("cell_id")).distinct()
    c = F.col("cell_id")
    return cells.select(
        c,
        g.centre_x(c).alias("x"),
        g.centre_y(c).alias("y"),
        g.col_of(c).alias("i"),
        g.row_of(c).alias("j"),
        F.when(c % 13 != 0, c * 7919 % 1000 / 10.0).alias("cropland"),
        (c * 104729 % 3000).cast("double").alias("rainfall"),
        (c * 15485863 % 2000).cast("double").alias("elevation"),
        (c * 31 % 9).cast("int").alias("landcover"),
    )
