"""Comparing, fitting and expanding distributions per cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions import distributions as D
from plotwise.functions import numbers as N
from plotwise.functions.arrays import interpolate
from plotwise.operators import ordering as O
from plotwise.operators import stats as S
from plotwise.operators import windows as W
from plotwise.session import stored

BLOCK = 4096  # units generated per row when a cell is expanded


def ks_two_sample(a: DataFrame, b: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Two-sample KS distance and asymptotic p per group present in both samples.

    Both samples become counts per distinct value; the running counts are
    chunked, so a group may hold any share of the rows.
    """
    side = lambda df, i: df.where(F.col(col).isNotNull()).select(*keys, col, F.lit(1 - i).alias("_a"), F.lit(i).alias("_b"))
    counts = side(a, 0).unionByName(side(b, 1)).groupBy(*keys, col).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    run = O.prefix_sums(counts, keys, [col], ["_a", "_b"])
    gap = F.abs(F.col("_a_run") / F.col("_a_all") - F.col("_b_run") / F.col("_b_all"))
    out = run.where("_a_all > 0 and _b_all > 0").groupBy(*keys).agg(
        F.max("_a_all").alias("n_a"), F.max("_b_all").alias("n_b"), F.max(gap).alias("ks_d")
    )
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    return out.withColumn("ks_p", D.kolmogorov_p(F.sqrt(n * m / (n + m)) * F.col("ks_d")))


def multinomial_fit(obs: DataFrame, quantiles: DataFrame, keys: list[str], col: str, ids: list[str], trials: int = 1000, seed: int = 0, outside: float = 0.01) -> DataFrame:
    """How well observed sizes fit classes cut at predicted quantiles.

    Classes end at each distinct quantile (right-closed), weighted by how often
    it occurs; one more class above the top has the small weight ``outside``.
    Returns the log-likelihood ratio and the share of seeded replicates with a
    ratio at least as extreme.  Observations are counted per class first; a
    replicate draws the counts of a cell class by class, so its cost is the
    number of classes, whatever the number of observations.
    """
    q = F.array_sort("quantiles")
    edges = F.array_distinct(q)
    weights = F.concat(
        F.transform(edges, lambda e: F.size(F.filter(F.col("_q"), lambda v: v == e)).cast("double")), F.array(F.lit(float(outside)))
    )
    total = F.aggregate("_w", F.lit(0.0), lambda s, v: s + v)
    classes = quantiles.withColumn("_q", q).withColumn("_edges", edges).withColumn("_w", weights).select(*keys, "_edges", F.transform("_w", lambda v: v / total).alias("_p"))
    seen = O.value_counts(obs, keys, col).join(classes, keys)
    seen = seen.withColumn("_class", F.size(F.filter("_edges", lambda e: e < F.col(col))))
    per_class = seen.groupBy(*keys, "_class").agg(F.sum("_c").alias("_n"), F.first("_p").alias("_p"))
    cells = per_class.groupBy(*keys).agg(F.sum("_n").alias("n"), F.first("_p").alias("_p"), F.collect_list(F.struct("_class", "_n")).alias("_held"))
    cells = cells.withColumn("_key", F.xxhash64(F.lit(seed), *keys))
    schema = ", ".join([*[f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys], "n long, llr double, p double"])

    def ratio(counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """sum of c ln(c / p), less n ln n, over the classes that hold something."""
        held = counts > 0
        n = counts.sum(axis=-1)
        return np.where(held, counts * np.log(np.where(held, counts, 1) / p), 0).sum(axis=-1) - n * np.log(n)

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            llrs, ps = [], []
            for key, n, p, held in zip(batch["_key"], batch["n"], batch["_p"], batch["_held"]):
                p = np.asarray(p)
                counts = np.zeros(len(p), dtype=np.int64)
                for h in held:
                    counts[h["_class"]] += h["_n"]
                llr = float(ratio(counts, p))
                drawn = np.random.default_rng(int(key) % 2**63).multinomial(n, p / p.sum(), size=trials)
                llrs.append(llr)
                ps.append(float((ratio(drawn, p) >= llr - 1e-9).mean()))
            yield batch.assign(llr=llrs, p=ps)[[*keys, "n", "llr", "p"]]

    return cells.mapInPandas(test, schema)


def fit_lognormal(df: DataFrame, keys: list[str], col: str, floor: float = 0.001) -> DataFrame:
    """Maximum-likelihood log-normal: mean and population sd of the logs."""
    v = F.ln(F.greatest(F.col(col), F.lit(floor)))
    return df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("logn_mean"), F.stddev_pop(v).alias("logn_sd"))


def with_lognormal_from_moments(df: DataFrame, mean: str, sd: str) -> DataFrame:
    mu, sigma = D.lognormal_from_moments(mean, sd)
    return df.withColumns({"adjusted_logn_mean": mu, "adjusted_logn_sd": sigma})


def with_lognormal_moments(df: DataFrame, mu: str, sigma: str) -> DataFrame:
    mean, sd = D.lognormal_moments(mu, sigma)
    return df.withColumns({"arith_mean": mean, "arith_sd": sd})


def _units(df: DataFrame, n: str, keep: list[str]) -> DataFrame:
    """One row per unit with its 0-based number ``_u``.

    Cells first split into blocks which are spread over the cluster, so a cell
    with very many units is generated by many tasks and no array grows with it.
    """
    blocks = df.where(F.col(n) > 0).select(*keep, F.col(n).cast("long").alias("_n"))
    blocks = blocks.withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / BLOCK))))
    spread = blocks.repartition(F.xxhash64(*keep[:1], "_b"))
    top = F.least(F.col("_n") - 1, (F.col("_b") + 1) * BLOCK - 1)
    return spread.withColumn("_u", F.explode(F.sequence(F.col("_b") * BLOCK, top))).drop("_b")


def expand_population(df: DataFrame, cell: list[str], n: str, quantiles: str, out: str = "size_ha", keep_max: bool = False) -> DataFrame:
    """n evenly spaced, linearly interpolated values of each cell's quantiles.

    ``keep_max`` spaces n - 1 values and adds the largest quantile.
    """
    units = _units(df, n, [*cell, quantiles])
    points = F.col("_n") - 1 if keep_max else F.col("_n")
    at = N.safe_ratio(F.col("_u") * (F.size(quantiles) - 1), points - 1)
    value = interpolate(F.col(quantiles), F.coalesce(at, F.lit(0.0)))
    if keep_max:
        value = F.when(F.col("_u") == F.col("_n") - 1, F.array_max(quantiles)).otherwise(value)
    return units.select(*cell, (F.col("_u") + 1).alias("unit"), value.alias(out))


def sample_population(df: DataFrame, cell: list[str], n: str, quantiles: str, seed: int, out: str = "size_ha") -> DataFrame:
    """n values at seeded uniform positions on the quantile curve.

    The curve starts at probability 1/m for m quantiles; below it is flat.
    """
    units = _units(df, n, [*cell, quantiles])
    m = F.size(quantiles)
    u = N.uniform_hash(*cell, "_u", seed=seed)
    # 0-based position of probability u between 1/m and 1; one quantile is flat
    at = u * m - 1
    return units.select(*cell, (F.col("_u") + 1).alias("unit"), interpolate(F.col(quantiles), at).alias(out))


def sample_trunc_lognormal(df: DataFrame, cell: list[str], n: str, quantiles: str, seed: int, out: str = "size_ha", floor: float = 0.001) -> DataFrame:
    """n seeded draws from a log-normal fitted to the quantiles, cut at their ends."""
    logs = F.transform(quantiles, lambda v: F.ln(F.greatest(v, F.lit(floor))))
    fitted = df.withColumn("_logs", logs).withColumn("_mu", F.aggregate("_logs", F.lit(0.0), lambda s, v: s + v) / F.size("_logs"))
    spread = F.aggregate("_logs", F.lit(0.0), lambda s, v: s + (v - F.col("_mu")) * (v - F.col("_mu")))
    fitted = fitted.withColumn("_sd", F.coalesce(F.sqrt(N.safe_ratio(spread, F.size("_logs") - 1)), F.lit(0.0))).withColumns(
        {"_lo": F.array_min("_logs"), "_hi": F.array_max("_logs")}
    )
    fitted = fitted.withColumns({"_pa": D.normal_cdf(N.safe_ratio(F.col("_lo") - F.col("_mu"), "_sd")), "_pb": D.normal_cdf(N.safe_ratio(F.col("_hi") - F.col("_mu"), "_sd"))})
    units = _units(fitted, n, [*cell, "_mu", "_sd", "_lo", "_hi", "_pa", "_pb"])
    p = F.col("_pa") + N.uniform_hash(*cell, "_u", seed=seed) * (F.col("_pb") - F.col("_pa"))
    draw = F.when(F.col("_sd") > 0, F.col("_mu") + F.col("_sd") * D.normal_quantile(p)).otherwise(F.col("_mu"))
    value = F.exp(F.least(F.greatest(draw, F.col("_lo")), F.col("_hi")))
    return units.select(*cell, (F.col("_u") + 1).alias("unit"), value.alias(out))


def size_classes(df: DataFrame, keys: list[str], col: str, cuts: list[float]) -> DataFrame:
    """Number and area below each cut, and within each class, in one pass."""
    sums = S.share_below(df, keys, col, cuts)
    nb = lambda c: F.col(f"nb_{S._tag(c)}")
    area = lambda c: F.col(f"sum_{S._tag(c)}")
    cells = []
    for i, c in enumerate(cuts):
        before = cuts[i - 1] if i else None
        cells.append(
            F.struct(
                F.lit(float(c)).alias("size_class"), nb(c).alias("cum_nb"), area(c).alias("cum_ha"),
                (nb(c) - nb(before) if i else nb(c)).alias("nb"), (area(c) - area(before) if i else area(c)).alias("ha"),
            )
        )
    return sums.select(*keys, F.inline(F.array(*cells)))


def compare_classes(pred: DataFrame, ref: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Predicted classes beside reported ones with their running sums."""
    cum = W.cumulate(ref, keys, [order], [value]).withColumnsRenamed({value: f"ref_{value}", f"cum_{value}": f"ref_cum_{value}"})
    return pred.join(cum, [*keys, order])


def compare_counts(estimated: DataFrame, census: DataFrame, key: str, est: str, obs: str, exclude: list) -> DataFrame:
    """Totals and squared correlation of counts, with and without some units."""
    both = estimated.join(census, key).where(F.col(est).isNotNull() & F.col(obs).isNotNull())
    kept = ~N.is_in(key, exclude)
    r, rx = N.corr(est, obs), N.corr(F.when(kept, F.col(est)), F.when(kept, F.col(obs)))
    return both.agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(est).alias("total_est"), F.sum(obs).alias("total_obs"),
        (r * r).alias("r2_corr"), (rx * rx).alias("r2_without"),
    )


def heterogeneity(df: DataFrame, cell: list[str], col: str, min_n: int = 9) -> DataFrame:
    """Mean, sd and Gini of cells with more than ``min_n`` rows."""
    base = df.where(F.col(col).isNotNull())
    stats = base.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))
    return O.join_null_safe(stats.where(F.col("n") > min_n), S.gini(base, cell, col).drop("n"), cell)


def zone_farm_stats(df: DataFrame, zone: str, col: str, thresholds: list[float], probs: dict[str, float] | None = None) -> DataFrame:
    """Mean, median, sd, Gini, total and n per zone, with shares below thresholds."""
    df = stored(df.where(F.col(zone).isNotNull()).select(zone, col))
    shares = S.share_below(df, [zone], col, thresholds).drop("n", "total")
    rows = df.where(F.col(zone).isNotNull() & F.col(col).isNotNull())
    base = rows.groupBy(zone).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("avg"), F.stddev_samp(col).alias("sd"), F.sum(col).alias("total"))
    mid = O.group_quantiles(rows, [zone], col, probs or {"med": 0.5})
    return base.join(mid, zone).join(S.gini(rows, [zone], col).drop("n"), zone).join(shares, zone)


def threshold_shares(df: DataFrame, factors: list[str], size: str, products: list[str], cuts: list[float], labels: list[str]) -> DataFrame:
    """Percent of each product in size ranges, by each grouping factor, wide.

    Sums over the finest combination come first; every later step works on
    that small table.
    """
    labelled = df.withColumn("threshold", N.bins(size, cuts, labels))
    fine = labelled.groupBy(*factors, "threshold").agg(*[F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in products])
    long = fine.unpivot([*factors, "threshold"], products, "product", "value")
    each = S.by_each_factor(long, factors, ["product", "threshold"], [F.sum("value").alias("value")]).where("group_modality is not null")
    cell = ["product", "grouping_factor", "group_modality"]
    share = S.share_of_total(each, cell, ["threshold"], "value")
    wide = share.groupBy(*cell).pivot("threshold", labels).agg(F.round(100 * F.first("share"), 1))
    return wide.select(*cell, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in labels])
