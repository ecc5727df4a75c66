"""Joins between survey, lookup and result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotwise.functions.text import jaro_similarity
from plotwise.session import stored


def equi_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, keys, how)


def left_fill(a: DataFrame, b: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    return a.join(b, keys, "left").fillna(fill)


def exclude_keys(df: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(bad.select(*keys), keys, "left_anti")


def keep_keys(df: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(good.select(*keys), keys, "left_semi")


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on every column name the two tables share."""
    common = [c for c in a.columns if c in b.columns]
    if not common:
        raise ValueError("no common columns")
    return a.join(b, common)


def one_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """First (last) row per key along an order that leaves no ties."""
    by = [F.desc(c) if last else F.asc(c) for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lookup_join(df: DataFrame, ref: DataFrame, key: str, order: list[str], last: bool = True) -> DataFrame:
    """Left join to the last (first) reference row per key."""
    kept = one_per_key(ref, [key], order, last)
    return df.join(kept.drop(*[c for c in order if c != key]), key, "left")


def expand_grid(start: SparkSession | DataFrame, **axes) -> DataFrame:
    """All combinations of a few short value lists, or each row of a table with them."""
    out = start if isinstance(start, DataFrame) else start.range(1).select()
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def guard_until(obs: DataFrame, ref: DataFrame, key: str, date: str, end: str) -> DataFrame:
    """Observations on or before the end date of their entity."""
    ends = ref.where(F.col(end).isNotNull()).groupBy(key).agg(F.max(end).alias(end))
    return obs.join(ends, key).where(F.col(date) <= F.col(end))


def unit_pairs(df: DataFrame, key: str, block: int = 1000) -> DataFrame:
    """Every (train, test) pair of distinct units of a key column.

    Units are dealt to blocks of about ``block`` by a hash, and each block meets
    each, so no row, key or task holds more than a block of units.
    """
    units = stored(df.select(F.col(key).alias("unit")).where("unit is not null").distinct())
    blocks = max(1, -(-units.count() // block))
    own = F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int")
    trains = units.select(F.col("unit").alias("train_unit"), own.alias("_a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))
    tests = units.select(F.col("unit").alias("test_unit"), own.alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_a"))
    return trains.join(tests, ["_a", "_b"]).where("train_unit <> test_unit").select("train_unit", "test_unit")


def bind_by_key(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two tables side by side, matched by key rather than position."""
    return a.join(b.select(*keys, *[c for c in b.columns if c not in a.columns]), keys)


def _letters(name: Column) -> Column:
    """Distinct (letter, occurrence) items of a text: 'anna' -> a1 n1 n2 a2."""
    chars = F.split(name, "")
    return F.transform(
        chars,
        lambda c, i: F.concat(
            c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).cast("string")
        ),
    )


def candidate_pairs(left: DataFrame, right: DataFrame, scope: list[str], max_dist: float) -> DataFrame:
    """(scope, _l, _r) for texts ``s`` of one scope that may lie within a Jaro distance; few others come along.

    Jaro similarity s needs m shared letters with m/|a| + m/|b| >= 3s - 1, so
    m >= (3s - 1)|a||b| / (|a| + |b|) =: need.  A text whose partner is at
    least b_min long needs k = need(|a|, b_min) shared letters, and two letter
    sets sharing k items always meet in the first |a| - k + 1 items of any
    common order.  Ordering items rarest first makes these prefixes selective.
    Pairs that meet are kept where their lengths allow it and their whole
    letter sets share as many items as they need; nothing within the distance is lost.
    """
    strict = 3 * (1 - max_dist) - 1
    shortest = max(strict - 1, 0.0)  # b_min / |a|, from need <= min(|a|, |b|)
    both = left.select(*scope, "s", F.lit("l").alias("side")).unionByName(right.select(*scope, "s", F.lit("r").alias("side")))
    sized = both.distinct().withColumn("n", F.length("s")).where("n > 0")
    items = sized.select("s", F.explode(_letters(F.col("s"))).alias("item")).distinct()
    rarity = items.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    ranked = items.join(rarity, "item").groupBy("s").agg(F.sort_array(F.collect_list(F.struct("freq", "item"))).getField("item").alias("items"))
    least = F.ceil(F.col("n") * (strict * shortest / (1 + shortest)) - 1e-9)
    prefix = F.slice("items", F.lit(1), F.greatest(F.col("n") - least + 1, F.lit(1)).cast("int"))
    keyed = sized.join(ranked, "s").select(*scope, "side", "s", "items", F.explode(prefix).alias("item"))
    side = lambda at: keyed.where(F.col("side") == at).select(*scope, "item", F.col("s").alias(f"_{at}"), F.col("items").alias(f"i{at}"))
    nl, nr = F.size("il"), F.size("ir")
    need = F.lit(strict) * nl * nr / (nl + nr) - 1e-9
    fits = (F.least(nl, nr) >= need) & (F.size(F.array_intersect("il", "ir")) >= need)
    return side("l").join(side("r"), [*scope, "item"]).where(fits).select(*scope, "_l", "_r").distinct()


def similar_values(left: DataFrame, right: DataFrame, key: str, max_dist: float) -> DataFrame:
    """(_l, _r, dist) for distinct lower-case texts within a Jaro distance."""
    names = lambda df: df.select(F.lower(F.col(key)).alias("s"))
    return _similar(names(left), names(right), [], max_dist)


def _similar(left: DataFrame, right: DataFrame, scope: list[str], max_dist: float) -> DataFrame:
    """(scope, _l, _r, dist) within the distance; empty texts equal each other."""
    left, right = (df.where("s is not null").distinct() for df in (left, right))
    scored = candidate_pairs(left, right, scope, max_dist).withColumn("dist", 1 - jaro_similarity(F.col("_l"), F.col("_r")))
    blank = lambda df, at: df.where("s = ''").select(*scope, F.col("s").alias(at))
    blanks = blank(left, "_l").withColumn("_k", F.lit(0)).join(blank(right, "_r").withColumn("_k", F.lit(0)), [*scope, "_k"]).drop("_k")
    return scored.where(F.col("dist") <= max_dist + 1e-12).unionByName(blanks.withColumn("dist", F.lit(0.0)))


def fuzzy_join(a: DataFrame, b: DataFrame, keys: list[str], max_dist: float = 0.2) -> DataFrame:
    """Rows whose lower-cased keys all lie within a Jaro distance.

    Distinct texts are compared once per key, whatever number of rows carry
    them; put the key of fewest values first: texts of the next key are only
    compared inside the pairs that the keys before allow.  Rows then join by equality.
    Right-hand keys come back as ``<k>_right``.
    """
    left = a.withColumns({f"_l_{k}": F.lower(k) for k in keys})
    right = b.select(
        *[F.col(c).alias(f"{c}_right" if c in a.columns else c) for c in b.columns],
        *[F.lower(k).alias(f"_r_{k}") for k in keys],
    )
    lk = left.select(*[f"_l_{k}" for k in keys]).distinct()
    rk = right.select(*[f"_r_{k}" for k in keys]).distinct()
    combos, scope = None, []
    for i, k in enumerate(keys):
        mine, theirs = [f"_l_{x}" for x in keys[:i]], [f"_r_{x}" for x in keys[:i]]
        known = combos.select(*scope) if scope else None
        inside = lambda names, on, own: (names.join(known, on) if scope else names).select(*scope, F.col(own).alias("s"))  # noqa: E731, B023
        near = _similar(inside(lk, mine, f"_l_{k}"), inside(rk, theirs, f"_r_{k}"), scope, max_dist)
        near = near.withColumnsRenamed({"_l": f"_l_{k}", "_r": f"_r_{k}", "dist": f"dist_{k}"})
        combos = stored(near if combos is None else combos.join(near, scope))
        scope = [*scope, f"_l_{k}", f"_r_{k}"]
    out = left.join(combos, [f"_l_{k}" for k in keys]).join(right, [f"_r_{k}" for k in keys])
    return out.drop(*[f"_l_{k}" for k in keys], *[f"_r_{k}" for k in keys])


def veto_tokens(pairs: DataFrame, left: str, right: str, tokens: list[str]) -> DataFrame:
    """Drop pairs where a listed token is in the left text but not in the right.

    The token list is a short fixed vocabulary, so it is a plain expression.
    """
    listed = F.array(*[F.lit(t.lower()) for t in tokens])
    has = lambda text, t: F.contains(F.lower(F.col(text)), t)
    return pairs.where(~F.exists(listed, lambda t: has(left, t) & ~has(right, t)))
