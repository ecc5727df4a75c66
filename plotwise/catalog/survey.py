"""Sources, cleaning and joins."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotwise.catalog.base import (
    CLEAN,
    FARMS,
    PLOTS,
    POINTS,
    clean_plots,
    farms,
    plots,
    points,
    query,
    rounded,
)
from plotwise.functions import indices as I
from plotwise.functions import numbers as N
from plotwise.operators import clean as C
from plotwise.operators import joins as J
from plotwise.plans.farm_size import farm_profile
from plotwise.sources import tables as A

# flagship -----------------------------------------------------------------------
FLAGSHIP_SQL = f"""WITH {FARMS}, boxed AS (
  SELECT * FROM farms WHERE x > -18 AND x < 52 AND y > -35 AND y < 38 AND NOT (x = 0 AND y = 0)), trimmed AS (
  SELECT b.* FROM boxed b JOIN (SELECT country, quantile_cont(farm_area_ha, 0.95) AS lim FROM boxed GROUP BY country) q
  USING (country) WHERE farm_area_ha <= lim)
SELECT coalesce(country, 'TOTAL') AS country, count(*) AS n_obs, round(avg(farm_area_ha), 4) AS avg,
  count(*) FILTER (farm_area_ha < 0.5) AS n_0_5, count(*) FILTER (farm_area_ha < 1) AS n_1,
  round(quantile_cont(farm_area_ha, 0.1), 4) AS q10, round(quantile_cont(farm_area_ha, 0.5), 4) AS med,
  round(quantile_cont(farm_area_ha, 0.9), 4) AS q90, count(DISTINCT country || '_' || year) AS n_waves,
  CASE WHEN min(year) = max(year) THEN CAST(min(year) AS VARCHAR) ELSE min(year) || '-' || max(year) END AS period,
  round(100.0 * count(*) FILTER (farm_area_ha < 0.5) / count(*), 4) AS prct_below_0_5,
  round(100.0 * count(*) FILTER (farm_area_ha < 1) / count(*), 4) AS prct_below_1
FROM trimmed GROUP BY ROLLUP (country)"""


@query("flagship_farm_profile", FLAGSHIP_SQL)
def flagship(t):
    return rounded(farm_profile(plots(t)))


# A: sources and sinks -----------------------------------------------------------
WAVE_SCHEMA = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("farm_id", T.StringType()),
        T.StructField("hh_size", T.IntegerType()),
        T.StructField("reported_area_ha", T.DoubleType()),
    ]
)


def _waves(t):
    path = t.scratch()
    rows = plots(t).select(*[f.name for f in WAVE_SCHEMA], F.concat_ws("_", "country", F.col("year").cast("string"), F.lit("raw.csv")).alias("wave"))
    rows.hint("rebalance", "wave").write.partitionBy("wave").option("header", True).csv(path)
    return A.read_waves(t.spark, path, WAVE_SCHEMA, pattern=r"wave=([^/]+)_(\d{4})_raw\.csv")


@query(
    "A1_read_waves",
    f"WITH {PLOTS}, d AS (SELECT DISTINCT x, y, farm_id, hh_size, reported_area_ha, country, year FROM plots) "
    "SELECT country, year, count(*) AS n, count(DISTINCT farm_id) AS n_farms, round(sum(reported_area_ha), 3) AS area FROM d GROUP BY country, year",
)
def _(t):
    df = _waves(t).groupBy("country", "year").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("farm_id").alias("n_farms"), F.sum("reported_area_ha").alias("area")
    )
    return rounded(df, 3)


@query("A2_wave_manifest", f"WITH {PLOTS} SELECT country, year, count(DISTINCT farm_id) AS nb_farms FROM plots GROUP BY country, year")
def _(t):
    return A.wave_manifest(plots(t))


@query(
    "A3_read_table",
    "SELECT p_brand, count(*) AS n, min(p_retailprice) AS low FROM part GROUP BY p_brand",
)
def _(t):
    path = t.scratch()
    part = t.part.select("p_brand", "p_retailprice")
    A.write_table(part.toDF(" p_brand", "p_retailprice "), f"{path}/part.parquet")
    df = A.read_table(t.spark, f"{path}/part.csv", fallback=f"{path}/part.parquet")
    return df.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("low"))


@query(
    "A4_union_fill",
    "SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation UNION ALL "
    "SELECT s_name, NULL, s_acctbal FROM supplier",
)
def _(t):
    return A.union_fill(
        t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")),
        t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
    )


STEPS_SQL = """steps AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
  CAST(least(3, 1 + (day(o_orderdate) - 1) // 10) AS INTEGER) AS dekad, o_custkey % 50 AS cell_id, o_totalprice AS rain_mm FROM orders)"""


def steps(t):
    day = F.dayofmonth("o_orderdate")
    return t.orders.select(
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.least(F.lit(3), 1 + F.floor((day - 1) / 10)).cast("int").alias("dekad"),
        (F.col("o_custkey") % 50).alias("cell_id"),
        F.col("o_totalprice").alias("rain_mm"),
    )


@query(
    "A5_read_time_layers",
    f"WITH {STEPS_SQL} SELECT year, month, dekad, count(*) AS n, round(sum(rain_mm), 2) AS total FROM steps GROUP BY ALL",
)
def _(t):
    path = t.scratch()
    name = F.format_string("rain.%04d.%02d.%d.csv", "year", "month", "dekad")
    steps(t).select("cell_id", "rain_mm", name.alias("layer")).hint("rebalance", "layer").write.partitionBy("layer").option("header", True).csv(path)
    schema = T.StructType([T.StructField("cell_id", T.LongType()), T.StructField("rain_mm", T.DoubleType())])
    df = A.read_time_layers(t.spark, path, schema, pattern=r"rain\.(\d{4})\.(\d{2})\.(\d)\.csv")
    return rounded(df.groupBy("year", "month", "dekad").agg(F.count(F.lit(1)).alias("n"), F.sum("rain_mm").alias("total")), 2)


@query(
    "A6_stack_layers",
    """SELECT cell_id, max(retail) AS retail, max(size) AS size FROM (
  SELECT p_partkey AS cell_id, p_retailprice AS retail, NULL AS size FROM part WHERE p_size > 10
  UNION ALL SELECT p_partkey, NULL, CAST(p_size AS DOUBLE) FROM part WHERE p_size < 40) GROUP BY cell_id""",
)
def _(t):
    p = t.part
    return A.stack_layers(
        {
            "retail": p.where("p_size > 10").select(F.col("p_partkey").alias("cell_id"), F.col("p_retailprice").alias("value")),
            "size": p.where("p_size < 40").select(F.col("p_partkey").alias("cell_id"), F.col("p_size").alias("value")),
        }
    )


@query("A7_select_layers", "SELECT l_orderkey, l_linenumber, l_extendedprice AS price_ext, l_discount AS disc FROM lineitem")
def _(t):
    short = {"l_extendedprice": "price_ext", "l_discount": "disc"}
    return A.select_layers(t.lineitem, r"^l_(ext|disc)", short.get, keep=("l_orderkey", "l_linenumber"))


@query("A8_write_table", "SELECT * FROM supplier")
def _(t):
    path = t.scratch()
    A.write_table(t.supplier, path)
    return A.read_table(t.spark, path)


@query("A9_write_bundle", "SELECT r_name AS region, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    path = t.scratch()
    A.write_bundle({"nation": t.nation, "region": t.region}, path)
    n, r = (A.read_table(t.spark, f"{path}/{x}") for x in ("nation", "region"))
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("region"), F.col("n_name").alias("name"))


@query("A10_write_partitioned", f"WITH {STEPS_SQL} SELECT year, month, count(*) AS n FROM steps GROUP BY ALL")
def _(t):
    path = t.scratch()
    A.write_partitioned(steps(t), path, ["year", "month"])
    df = t.spark.read.parquet(path)
    return df.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A11_pending_units",
    "SELECT DISTINCT c_nationkey AS unit FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
)
def _(t):
    plan = t.customer.select(F.col("c_nationkey").alias("unit")).distinct()
    done = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("unit"))
    return A.pending_units(plan, done, ["unit"])


@query("A12_gather_results", "SELECT s_nationkey AS unit, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY 1")
def _(t):
    path = t.scratch()
    for lo, hi in ((0, 11), (12, 24)):
        part = t.supplier.where(F.col("s_nationkey").between(lo, hi))
        A.write_partitioned(part, f"{path}/units_{lo}_{hi}", ["s_nationkey"])
    df = A.gather_results(t.spark, path, units=["units_0_11", "units_12_24"]).groupBy(F.col("s_nationkey").alias("unit"))
    return rounded(df.agg(F.count(F.lit(1)).alias("n"), F.sum("s_acctbal").alias("total")), 2)


@query(
    "A13_completeness",
    f"""WITH {STEPS_SQL}, want AS (SELECT y::INTEGER AS year, m::INTEGER AS month, d::INTEGER AS dekad
  FROM range(1995, 2003) a(y), range(1, 13) b(m), range(1, 4) c(d))
SELECT want.*, (year, month, dekad) IN (SELECT (year, month, dekad) FROM steps) AS present FROM want""",
)
def _(t):
    want = J.expand_grid(t.spark, year=list(range(1995, 2003)), month=list(range(1, 13)), dekad=[1, 2, 3])
    return A.completeness(want, steps(t), ["year", "month", "dekad"])


# B: projections, cleaning, predicates ---------------------------------------------
@query("B1_rename_strip", "SELECT orderkey, extendedprice, discount FROM (SELECT l_orderkey AS orderkey, l_extendedprice AS extendedprice, l_discount AS discount FROM lineitem)")
def _(t):
    return C.rename_strip(C.select_matching(t.lineitem, "orderkey$", "^l_ext", "discount"), "^l_")


@query("B2_complete_cases", f"WITH {PLOTS} SELECT country, count(*) AS n FROM plots WHERE reported_area_ha IS NOT NULL AND measured_plot_area_ha IS NOT NULL GROUP BY country")
def _(t):
    return C.complete_cases(plots(t), ["reported_area_ha", "measured_plot_area_ha"]).groupBy("country").agg(F.count(F.lit(1)).alias("n"))


def _plot_check(df, col="measured_plot_area_ha"):
    out = df.groupBy("country", "year").agg(F.count(F.lit(1)).alias("n"), F.count(col).alias("n_known"), F.sum(col).alias("total"), F.max(col).alias("largest"))
    return rounded(out, 3)


def _plot_sql(table, col="measured_plot_area_ha"):
    return f"WITH {CLEAN} SELECT country, year, count(*) AS n, count({col}) AS n_known, round(sum({col}), 3) AS total, round(max({col}), 3) AS largest FROM {table} GROUP BY country, year"


@query("B3_null_sentinels", _plot_sql("fixed"))
def _(t):
    return _plot_check(C.null_sentinels(plots(t), "measured_plot_area_ha"))


@query("B4_fix_area_units", _plot_sql("scaled"))
def _(t):
    return _plot_check(C.fix_area_units(C.null_sentinels(plots(t), "measured_plot_area_ha"), "measured_plot_area_ha", "reported_area_ha"))


@query("B5_null_above", _plot_sql("capped"))
def _(t):
    df = C.fix_area_units(C.null_sentinels(plots(t), "measured_plot_area_ha"), "measured_plot_area_ha", "reported_area_ha")
    return _plot_check(C.null_above(df, "measured_plot_area_ha", 100))


@query("B6_prefer_measured", _plot_sql("clean", "plot_area_ha"))
def _(t):
    return _plot_check(clean_plots(t), "plot_area_ha")


UNITS_SQL = """WITH rates AS (SELECT c_nationkey AS place, c_mktsegment AS unit, avg(abs(c_acctbal)) / 10000 AS rate
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_nationkey < 20 GROUP BY ALL), obs AS (
  SELECT c_custkey, c_nationkey AS place, c_mktsegment AS unit, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT unit, count(*) AS n, count(area) AS n_known, round(sum(area), 3) AS area FROM (
  SELECT unit, amount * CASE unit WHEN 'AUTOMOBILE' THEN 1.0 WHEN 'HOUSEHOLD' THEN 0.0001 ELSE coalesce(rate, CASE unit WHEN 'BUILDING' THEN 0.61 END) END AS area
  FROM obs LEFT JOIN rates USING (place, unit)) GROUP BY unit"""


@query("B7_convert_units", UNITS_SQL)
def _(t):
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("place"), F.col("c_mktsegment").alias("unit"), "c_acctbal")
    rates = c.where("unit in ('BUILDING', 'FURNITURE') and place < 20").groupBy("place", "unit").agg((F.avg(F.abs("c_acctbal")) / 10000).alias("rate"))
    obs = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("place", "unit", F.col("o_totalprice").alias("amount"))
    out = C.convert_units(obs, rates, {"AUTOMOBILE": 1.0, "HOUSEHOLD": 0.0001}, {"BUILDING": 0.61}, "place", "unit", "amount", "area")
    return rounded(out.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count("area").alias("n_known"), F.sum("area").alias("area")), 3)


@query(
    "B8_build_ids",
    "SELECT l_orderkey, l_linenumber, regexp_replace(s_name, '^(Supplier#00|Supplier#)', '') || '_' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') AS plot_id "
    "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
)
def _(t):
    df = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return df.select("l_orderkey", "l_linenumber", C.nested_id(C.strip_prefix("s_name", ("Supplier#00", "Supplier#")), "l_linenumber").alias("plot_id"))


@query(
    "B9_sequence_id",
    """SELECT o_orderkey, o_orderpriority || '_' || year(o_orderdate) || '_' ||
  row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_totalprice, o_orderkey) AS seq_id FROM orders""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("year"))
    return C.sequence_id(df, ["o_orderpriority", "year"], ["o_totalprice", "o_orderkey"]).select("o_orderkey", "seq_id")


@query(
    "B10_lenient_parse",
    """SELECT o_orderkey, TRY_CAST(replace(trim(CASE WHEN o_orderkey % 5 = 0 THEN '-' ELSE replace(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), '9', ',9') END), ',', '') AS DOUBLE) AS amount,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE)::VARCHAR END AS day FROM orders""",
)
def _(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("-")).otherwise(F.regexp_replace(F.floor("o_totalprice").cast("string"), "9", ",9"))
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", N.to_number(text).alias("amount"), N.to_date(day).cast("string").alias("day"))


@query("B11_within_bbox", f"WITH {POINTS} SELECT point_id, x, y FROM points WHERE x > -10 AND x < 40 AND y > -30 AND y < 10 AND NOT (x = 0 AND y = 0)")
def _(t):
    return C.within_bbox(points(t), "x", "y", (-10, 40, -30, 10)).select("point_id", "x", "y")


@query("B12_year_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1998")
def _(t):
    # a range on the raw column reaches the Parquet scan; year(date) would not
    day = F.col("o_orderdate")
    return t.orders.where((day >= F.lit("1998-01-01").cast("timestamp")) & (day < F.lit("1999-01-01").cast("timestamp"))).select("o_orderkey", "o_totalprice")


@query("B13_exclude_values", "SELECT n_name, grp FROM (SELECT n_name, CASE WHEN n_nationkey % 4 <> 0 THEN 'G' || n_nationkey % 4 END AS grp FROM nation) WHERE grp IS NULL OR grp NOT IN ('G1', 'G3')")
def _(t):
    grp = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("G"), (F.col("n_nationkey") % 4).cast("string")))
    return C.exclude_values(t.nation.select("n_name", grp.alias("grp")), "grp", ["G1", "G3"])


@query("B14_drop_small_groups", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 80)")
def _(t):
    return C.drop_small_groups(t.part, ["p_brand"], 80).select("p_partkey", "p_brand")


@query(
    "B15_trim_by_quantile",
    "SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice FROM lineitem JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS lim FROM lineitem GROUP BY 1) q USING (l_returnflag) WHERE l_extendedprice <= lim",
)
def _(t):
    return C.trim_by_quantile(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.95).select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")


SIZE_LABELS = ["< 0.5 ha", "0.5 - 1 ha", "1 - 2 ha", "> 2 ha"]
SIZE_CASE = "CASE WHEN {c} IS NULL THEN NULL WHEN {c} < 0.5 THEN '< 0.5 ha' WHEN {c} < 1 THEN '0.5 - 1 ha' WHEN {c} < 2 THEN '1 - 2 ha' ELSE '> 2 ha' END"


@query("B16_bin_ranges", f"WITH {CLEAN} SELECT {SIZE_CASE.format(c='plot_area_ha')} AS size_class, count(*) AS n FROM clean GROUP BY 1")
def _(t):
    return clean_plots(t).groupBy(N.bins("plot_area_ha", [0.5, 1, 2], SIZE_LABELS).alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


@query("B17_recode", "SELECT r_regionkey, CASE r_name WHEN 'AFRICA' THEN 'Afr.' WHEN 'ASIA' THEN 'As.' ELSE r_name END AS label FROM region")
def _(t):
    return t.region.select("r_regionkey", N.recode("r_name", {"AFRICA": "Afr.", "ASIA": "As."}).alias("label"))


@query("B18_map_sets", "SELECT n_name, CASE WHEN n_nationkey IN (0, 5, 10) THEN 'west' WHEN n_nationkey IN (1, 2, 3) THEN 'east' END AS block FROM nation")
def _(t):
    return C.map_sets(t.nation, "n_nationkey", {"west": [0, 5, 10], "east": [1, 2, 3]}, "block").select("n_name", "block")


@query(
    "B19_zscore",
    "SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 4) AS p_retailprice, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 4) AS p_size FROM part",
)
def _(t):
    return rounded(C.zscore(t.part.select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"]))


@query("B20_with_powers", "SELECT p_partkey, p_size, CAST(p_size * p_size AS DOUBLE) AS p_size_p2, CAST(p_size * p_size * p_size AS DOUBLE) AS p_size_p3 FROM part")
def _(t):
    return C.with_powers(t.part.select("p_partkey", "p_size"), "p_size", 3)


@query("B21_clip", f"WITH {PLOTS} SELECT country, round(sum(CASE WHEN reported_area_ha IS NOT NULL THEN least(greatest(reported_area_ha, 1.0), 4.0) END), 3) AS total FROM plots GROUP BY 1")
def _(t):
    return rounded(plots(t).groupBy("country").agg(F.sum(N.clip("reported_area_ha", 1.0, 4.0)).alias("total")), 3)


@query(
    "B22_impute_median",
    f"WITH {PLOTS}, m AS (SELECT quantile_cont(measured_plot_area_ha, 0.5) AS a, quantile_cont(reported_area_ha, 0.5) AS b FROM plots) "
    "SELECT country, round(sum(coalesce(measured_plot_area_ha, a)), 3) AS measured, round(sum(coalesce(reported_area_ha, b)), 3) AS reported, CAST(sum(0) AS DOUBLE) AS nothing FROM plots, m GROUP BY country",
)
def _(t):
    df = plots(t).select("country", "measured_plot_area_ha", "reported_area_ha", F.lit(None).cast("double").alias("nothing"))
    df = C.impute_median(df, ["measured_plot_area_ha", "reported_area_ha", "nothing"])
    return rounded(df.groupBy("country").agg(F.sum("measured_plot_area_ha").alias("measured"), F.sum("reported_area_ha").alias("reported"), F.sum("nothing").alias("nothing")), 3)


@query("B23_drop_constant", "SELECT p_partkey, p_size FROM part")
def _(t):
    return C.drop_constant(t.part.select("p_partkey", "p_size", F.lit(3.0).alias("flat")), ["p_size", "flat"])


@query("B24_drop_sparse", f"WITH {PLOTS} SELECT country, farm_id, plot_no, reported_area_ha FROM plots")
def _(t):
    df = plots(t).select("country", "farm_id", "plot_no", "reported_area_ha", F.when(F.col("plot_no") == 1, 1.0).alias("thin"))
    return C.drop_sparse(df, ["reported_area_ha", "thin"], 0.4)


@query("B25_variance_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def _(t):
    return C.variance_filter(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"), ["l_extendedprice", "l_tax"], 0.01)


@query(
    "B26_transform_response",
    "SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log1p, round(sqrt(o_totalprice), 6) AS root, round(cbrt(o_totalprice), 6) AS cube, round(o_totalprice, 2) AS back FROM orders",
)
def _(t):
    v = F.col("o_totalprice")
    df = t.orders.select(
        "o_orderkey", N.transform_response(v, "log1p").alias("log1p"), N.transform_response(v, "sqrt").alias("root"), N.transform_response(v, "cbrt").alias("cube"),
        F.round(N.invert_response(N.transform_response(v, "log"), "log"), 2).alias("back"),
    )
    return rounded(df, 6)


@query("B27_safe_ratio", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax <> 0 THEN round(l_discount / l_tax, 6) END AS ratio FROM lineitem")
def _(t):
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.safe_ratio("l_discount", "l_tax").alias("ratio")), 6)


BANDS = {"B03_mean": "l_tax", "B04_mean": "l_discount", "B08_mean": "l_quantity / 50", "B8A_mean": "l_extendedprice / 100000", "B11_mean": "l_linenumber / 10"}


@query(
    "B28_add_indices",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS g, l_discount AS r, l_quantity / 50 AS n, l_extendedprice / 100000 AS e, l_linenumber / 10.0::DOUBLE AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round((n - r) / (n + r + 0.5 + 1e-9) * 1.5, 6) AS SAVI,
 round((2 * n + 1 - sqrt(greatest((2 * n + 1) * (2 * n + 1) - 8 * (n - r), 0))) / 2, 6) AS MSAVI2,
 round((0.1::DOUBLE * n - r) / (0.1::DOUBLE * n + r + 1e-9), 6) AS WDRVI, round((n - g) / (n + g + 1e-9), 6) AS GNDVI,
 round((e - r) / (e + r + 1e-9), 6) AS RENDVI, round((e - s) / (e + s + 1e-9), 6) AS LSWI2 FROM b""",
)
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.expr(e).alias(n) for n, e in BANDS.items()])
    return rounded(I.add_indices(df).drop(*BANDS), 6)


@query("B30_weighted_layers", "SELECT l_orderkey, l_linenumber, l_partkey, round((5 * l_tax + 10 * l_discount + 15 * l_quantity) / 30, 6) AS sand FROM lineitem")
def _(t):
    return rounded(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.weighted_layers({"l_tax": 5, "l_discount": 10, "l_quantity": 15}).alias("sand")), 6)


@query("B31_flag_groups", "SELECT event_id, event_type IN ('purchase', 'view', 'click') AS optical, event_type IN ('purchase', 'error', 'signup') AS radar FROM events")
def _(t):
    return t.events.select("event_id", N.is_in("event_type", ["purchase", "view", "click"]).alias("optical"), N.is_in("event_type", ["purchase", "error", "signup"]).alias("radar"))


@query("B32_round_coords", f"WITH {POINTS} SELECT point_id, CASE WHEN nation = 3 THEN round(value, 0) ELSE value END AS value FROM points")
def _(t):
    return points(t).select("point_id", N.round_where("value", F.col("nation") == 3, 0).alias("value"))


@query("B33_mask_to_centroid", f"WITH {POINTS} SELECT point_id, nation, round(avg(x) OVER (PARTITION BY nation), 4) AS x, round(avg(y) OVER (PARTITION BY nation), 4) AS y FROM points")
def _(t):
    return rounded(C.mask_to_centroid(points(t).drop("value"), "nation"))


@query(
    "B34_strip_footnotes",
    "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'missing_info' ELSE 'complete_info' END AS certitude, s_name AS name FROM supplier WHERE s_suppkey % 10 <> 7",
)
def _(t):
    name = F.when(F.col("s_suppkey") % 10 == 7, F.lit("Source: census")).when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("*"))).otherwise(F.col("s_name"))
    return C.strip_footnotes(t.supplier.select("s_suppkey", name.alias("name")), "name")


@query(
    "B35_fill_down",
    "SELECT o_orderkey, last_value(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END IGNORE NULLS) OVER (ORDER BY o_orderkey) AS label FROM orders",
)
def _(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("label"))
    return C.fill_down(df, ["label"], ["o_orderkey"])


@query(
    "B36_period_label",
    "SELECT o_custkey, CASE WHEN min(year(o_orderdate)) = max(year(o_orderdate)) THEN CAST(min(year(o_orderdate)) AS VARCHAR) ELSE min(year(o_orderdate)) || '-' || max(year(o_orderdate)) END AS period FROM orders GROUP BY 1",
)
def _(t):
    return C.period_label(t.orders.select("o_custkey", F.year("o_orderdate").alias("year")), ["o_custkey"], "year")


@query(
    "B37_midpoint_mean",
    """WITH c AS (SELECT p_brand, count(*) FILTER (p_size <= 10) AS a, count(*) FILTER (p_size > 10 AND p_size <= 30) AS b, count(*) FILTER (p_size > 30) AS c FROM part GROUP BY 1)
SELECT p_brand, round((5.0 * a + 20.0 * b + 40.0 * c) * 0.4047 / (a + b + c), 4) AS mean_ha FROM c""",
)
def _(t):
    s = F.col("p_size")
    counts = t.part.groupBy("p_brand").agg(F.count_if(s <= 10).alias("a"), F.count_if((s > 10) & (s <= 30)).alias("b"), F.count_if(s > 30).alias("c"))
    return rounded(counts.select("p_brand", N.midpoint_mean({"a": 5.0, "b": 20.0, "c": 40.0}, 0.4047).alias("mean_ha")))


@query("B38_best_row", "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def _(t):
    return C.best_row(t.part.select("p_brand", "p_partkey", "p_retailprice"), "p_retailprice", ["p_partkey"], keys=["p_brand"])


@query("B39_override", "SELECT n_nationkey, CASE WHEN n_nationkey = 4 THEN 99 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(t):
    return C.override(t.nation, "n_nationkey", "n_regionkey", {4: 99}).select("n_nationkey", "n_regionkey")


@query("B40_drop_rows", "SELECT n_name FROM nation WHERE n_name NOT IN ('NATION_0', 'NATION_7')")
def _(t):
    return C.drop_rows(t.nation.select("n_name"), F.col("n_name").isin("NATION_0", "NATION_7"))


# C: joins -------------------------------------------------------------------------
@query("C1_inner_join", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return J.equi_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), o, ["l_orderkey"])


@query("C2_left_fill", "SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON p_partkey = l_partkey")
def _(t):
    n = t.lineitem.where("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return J.left_fill(t.part.select("p_partkey"), n, ["p_partkey"], {"n": 0})


@query("C3_exclude_keys", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_tax >= 0.08)")
def _(t):
    bad = t.lineitem.where("l_tax >= 0.08").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.exclude_keys(t.orders, bad, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("C4_keep_keys", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(t):
    good = t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return J.keep_keys(t.customer, good, ["c_custkey"]).select("c_custkey", "c_name")


@query("C5_natural_join", "SELECT n_name AS nation, r_name, nk FROM (SELECT n_nationkey AS nk, n_regionkey AS rk, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS rk, r_name FROM region)")
def _(t):
    n = t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"), F.col("n_name").alias("nation"))
    return J.natural_join(n, t.region.select(F.col("r_regionkey").alias("rk"), "r_name")).drop("rk")


@query(
    "C6_lookup_join",
    "SELECT c_custkey, o_totalprice AS last_price FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey",
)
def _(t):
    ref = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", F.col("o_totalprice").alias("last_price"))
    return J.lookup_join(t.customer.select("c_custkey"), ref, "c_custkey", ["o_orderdate", "o_orderkey"])


@query(
    "C7_expand_grid",
    "SELECT a.n_nationkey AS train, m.algo FROM nation a, (VALUES ('forest'), ('ridge')) m(algo)",
)
def _(t):
    return J.expand_grid(t.nation.select(F.col("n_nationkey").alias("train")), algo=["forest", "ridge"])


@query(
    "C8_guard_until",
    "SELECT event_id, user_id FROM events JOIN (SELECT DISTINCT user_id, DATE '2024-01-20' + CAST(user_id % 10 AS INTEGER) AS end_date FROM events) USING (user_id) WHERE CAST(ts AS DATE) <= end_date",
)
def _(t):
    e = t.events.select("event_id", "user_id", F.to_date("ts").alias("date"))
    ends = e.select("user_id").distinct().withColumn("end_date", F.date_add(F.lit("2024-01-20").cast("date"), (F.col("user_id") % 10).cast("int")))
    return J.guard_until(e, ends, "user_id", "date", "end_date").select("event_id", "user_id")


FUZZY_SQL = """WITH a AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size <= 25), b AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size > 25)
SELECT a.p_name, a.p_brand, b.p_name AS p_name_right, b.p_brand AS p_brand_right, round(1 - jaro_similarity(lower(a.p_name), lower(b.p_name)), 6) AS dist_p_name,
  round(1 - jaro_similarity(lower(a.p_brand), lower(b.p_brand)), 6) AS dist_p_brand
FROM a JOIN b ON jaro_similarity(lower(a.p_name), lower(b.p_name)) >= 0.8 - 1e-12 AND jaro_similarity(lower(a.p_brand), lower(b.p_brand)) >= 0.8 - 1e-12"""


def _fuzzy(t):
    p = t.part
    a = p.where("p_size <= 25").select("p_name", "p_brand").distinct()
    b = p.where("p_size > 25").select("p_name", "p_brand").distinct()
    return J.fuzzy_join(a, b, ["p_name", "p_brand"], 0.2)


@query("C9_fuzzy_join", FUZZY_SQL)
def _(t):
    return rounded(_fuzzy(t), 6)


@query(
    "C10_veto_tokens",
    f"SELECT p_name, p_name_right, count(*) AS n FROM ({FUZZY_SQL}) WHERE NOT (p_name LIKE '%bolt%' AND p_name_right NOT LIKE '%bolt%') AND NOT (p_name LIKE '%red%' AND p_name_right NOT LIKE '%red%') GROUP BY ALL",
)
def _(t):
    return J.veto_tokens(_fuzzy(t), "p_name", "p_name_right", ["bolt", "red"]).groupBy("p_name", "p_name_right").agg(F.count(F.lit(1)).alias("n"))


@query("C15_unit_pairs", "SELECT a.s_nationkey AS train_unit, b.s_nationkey AS test_unit FROM (SELECT DISTINCT s_nationkey FROM supplier) a JOIN (SELECT DISTINCT s_nationkey FROM supplier) b ON a.s_nationkey <> b.s_nationkey")
def _(t):
    return J.unit_pairs(t.supplier, "s_nationkey")


@query("C17_bind_by_key", "SELECT o_orderkey, o_totalprice, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return J.bind_by_key(t.orders.select("o_orderkey", "o_totalprice"), n, ["o_orderkey"])
