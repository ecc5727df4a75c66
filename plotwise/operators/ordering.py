"""Order-dependent work on groups of any size.

A plain window sends a whole group to one task.  The operators here cut the
order axis into pieces, run the window inside (group, piece), and carry one
summary row per piece to the next.  Cut points are rows of the table picked by
a hash, at a fixed rate: small tables stay in one piece, large ones get pieces
of about ``CUT_RATE`` rows, at most ``MAX_CUTS`` of them.  They only balance the
work; any choice gives the same result, and every row is processed.  Cuts are
taken over the whole table, so a group holding a third of all rows is spread
over a third of the pieces, and over all order columns, so a date or value
shared by many rows is split by the columns that break its ties.

``order`` is a list of column names; together they should leave no ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.session import stored

MAX_CUTS = 4096  # a power of two; bounds the list of cut points
CUT_RATE = 65536  # one cut per so many rows; setting plotwise.cut.rate overrides
SKETCH_GROUPS = 1024


def cut_points(df: DataFrame, keys: list[str], order: list[str]) -> str | None:
    """Ascending cut points as JSON text of order structs; None for no cuts.

    A small job of its own: it reads the key and order columns once.  The
    hashed sample shrinks in two steps, per hash group and then once, so no
    step and no result grows beyond a fixed number of rows.
    """
    rate = int(df.sparkSession.conf.get("plotwise.cut.rate", str(CUT_RATE)))
    rows = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(rate)) == 0)
    rows = rows.select(F.struct(*order).alias("cut"), F.xxhash64(F.lit(rate), *keys, *order).alias("h"))
    rows = rows.withColumn("part", F.pmod("h", F.lit(SKETCH_GROUPS)))
    few = Window.partitionBy("part").orderBy("h")
    kept = rows.withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= MAX_CUTS // SKETCH_GROUPS)
    row = kept.agg(F.count(F.lit(1)).alias("n"), F.to_json(F.sort_array(F.collect_list("cut"))).alias("cuts")).first()
    return row["cuts"] if row["n"] else None


def with_chunk(df: DataFrame, keys: list[str], order: list[str], out: str = "_chunk") -> DataFrame:
    """Add the number of cut points at or below the row (binary search)."""
    text = cut_points(df, keys, order)
    if text is None:
        return df.withColumn(out, F.lit(0))
    place = F.struct(*order)
    # folds to one literal array, which is shared and never a column of rows
    cuts = F.from_json(F.lit(text), df.select(F.array(place).alias("c")).schema["c"].dataType)
    steps, step = [], MAX_CUTS // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    found = F.aggregate(
        F.array(*steps), F.lit(0), lambda at, s: F.when(F.get(cuts, at + s - 1) <= place, at + s).otherwise(at)
    )
    return df.withColumn(out, found)


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match, with one copy of the keys kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    if not keys:  # one row on the right
        renamed = renamed.groupBy().agg(*[F.first(c).alias(c) for c in renamed.columns])
        on = F.lit(True)
    else:
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"_right_{k}" for k in keys])


def _keyed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Chunked rows under one group column ``_g``.

    A struct of the keys compares NULL fields as equal, so join and window
    below share one plain hash partitioning on (_g, _chunk).
    """
    group = F.struct(*keys) if keys else F.lit(0)
    extra = [k for k in keys if k not in order]
    return with_chunk(df, keys, order).withColumn("_g", group).drop(*extra)


def _unkeyed(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    new = [c for c in df.columns if c not in columns and c != "_g"]
    own = [F.col(f"_g.{c}").alias(c) if c in keys and c not in df.columns else F.col(c) for c in columns]
    return df.select(*own, *new)


def _sorted(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[str],
    keep=None,
) -> DataFrame:
    """Add ``<m>_run`` (inclusive running sum) and ``<m>_all`` (group sum).

    ``keep`` may name a condition on the chunk summary (``<m>_off`` .. and
    ``<m>_all``) so that only chunks a later step needs are sorted.
    NULL measures count as zero.
    """
    pieces = _keyed(df, keys, order)
    totals = pieces.groupBy("_g", "_chunk").agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(f"{m}_sum") for m in measures]
    )
    ahead = Window.partitionBy("_g").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_g")
    for m in measures:
        totals = totals.withColumn(
            f"{m}_off", F.coalesce(F.sum(f"{m}_sum").over(ahead), F.lit(0))
        ).withColumn(f"{m}_all", F.sum(f"{m}_sum").over(whole))
    if keep is not None:
        totals = totals.where(keep)
    totals = totals.drop(*[f"{m}_sum" for m in measures])
    inside = (
        Window.partitionBy("_g", "_chunk")
        .orderBy(*_sorted(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = pieces.join(totals, ["_g", "_chunk"])
    for m in measures:
        out = out.withColumn(
            f"{m}_run", F.col(f"{m}_off") + F.coalesce(F.sum(m).over(inside), F.lit(0))
        )
    out = out.drop("_chunk", *[f"{m}_off" for m in measures])
    return _unkeyed(out, keys, df.columns)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], out: str = "rn") -> DataFrame:
    """row_number() over a total order, without one task per group."""
    counted = prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, order, ["_one"])
    return counted.withColumnRenamed("_one_run", out).drop("_one", "_one_all")


def carry(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], previous: bool, known: bool = False) -> DataFrame:
    """Bring values forward along the order.

    ``previous=True`` gives lag(col, 1), or with ``known`` the last non-null value
    before the row; ``previous=False`` gives the last non-null value up to the
    current row.  ``cols`` maps source to new column.
    """
    pieces = _keyed(df, keys, order)
    place = F.struct(*order)
    ends = []
    for c in cols:
        seen = F.struct(F.col(c).alias("v"))
        counts = F.lit(True) if previous and not known else F.col(c).isNotNull()
        ends.append(F.max_by(F.when(counts, seen), F.when(counts, place)).alias(f"_end_{c}"))
    totals = pieces.groupBy("_g", "_chunk").agg(*ends)
    ahead = Window.partitionBy("_g").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    for c in cols:
        totals = totals.withColumn(f"_in_{c}", F.last(f"_end_{c}", ignorenulls=True).over(ahead))
    totals = totals.drop(*[f"_end_{c}" for c in cols])
    out = pieces.join(totals, ["_g", "_chunk"])
    inside = Window.partitionBy("_g", "_chunk").orderBy(*_sorted(order))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in cols:
        if previous and known:
            value = F.coalesce(F.last(c, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col(f"_in_{c}.v"))
        elif previous:
            first = F.row_number().over(inside) == 1
            value = F.when(first, F.col(f"_in_{c}.v")).otherwise(F.lag(c).over(inside))
        else:
            value = F.coalesce(F.last(c, ignorenulls=True).over(running), F.col(f"_in_{c}.v"))
        out = out.withColumn(f"_out_{c}", value)
    out = _unkeyed(out.drop("_chunk", *[f"_in_{c}" for c in cols]), keys, df.columns)
    return out.drop(*[n for n in cols.values() if n in df.columns]).withColumnsRenamed(
        {f"_out_{c}": n for c, n in cols.items()}
    )


def value_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """(keys, value) -> ``_c``; equal values collapse before any sort."""
    return df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))


def quantiles_of_counts(vals: DataFrame, keys: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles (type 7) from a (keys, value, _c) table."""

    def spots(total: Column, p: float) -> tuple[Column, Column, Column]:
        at = (total - 1) * F.lit(float(p))
        return F.floor(at), F.ceil(at), at - F.floor(at)

    wanted = []
    for p in probs.values():
        for spot in spots(F.col("_c_all"), p)[:2]:
            wanted.append((spot >= F.col("_c_off")) & (spot < F.col("_c_off") + F.col("_c_sum")))
    run = prefix_sums(vals, keys, [col], ["_c"], keep=reduce(lambda a, b: a | b, wanted))
    picks = []
    for i, p in enumerate(probs.values()):
        lo, hi, share = spots(F.col("_c_all"), p)
        holds = lambda s: (s >= F.col("_c_run") - F.col("_c")) & (s < F.col("_c_run"))
        picks += [
            F.max(F.when(holds(lo), F.col(col))).alias(f"_lo{i}"),
            F.max(F.when(holds(hi), F.col(col))).alias(f"_hi{i}"),
            F.max(share).alias(f"_share{i}"),
        ]
    found = run.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_share{i}")).alias(n)
            for i, n in enumerate(probs)
        ],
    )


def group_quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group; every group present in ``df`` with a value.

    ``df`` is read once: cuts and sums come from the table of counted values.
    """
    return quantiles_of_counts(stored(value_counts(df, keys, col)), keys, col, probs)
