"""Column expressions with explicit NULL and non-finite rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnLike) -> Column:
    """NaN and infinities become NULL; NaN sorts above infinity."""
    c = as_col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def safe_ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, NULL where the quotient is not a finite number."""
    return finite(F.try_divide(as_col(a).cast("double"), as_col(b).cast("double")))


def corr(a: ColumnLike, b: ColumnLike) -> Column:
    """Pearson correlation over complete pairs; NULL without variation.

    The built-in one divides by zero on a constant column in ANSI mode.
    """
    a, b = as_col(a).cast("double"), as_col(b).cast("double")
    both = a.isNotNull() & b.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, a))) * F.sqrt(F.var_pop(F.when(both, b)))
    return safe_ratio(F.covar_pop(a, b), spread)


def clip(c: ColumnLike, lo: float, hi: float) -> Column:
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def is_in(c: ColumnLike, values) -> Column:
    """Membership that is FALSE, not NULL, for a missing value."""
    return F.coalesce(as_col(c).isin(*values), F.lit(False))


def null_sum(cols: list[ColumnLike]) -> Column:
    """Sum over columns in which NULL counts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(as_col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_mean(cols: list[ColumnLike]) -> Column:
    """Mean over the non-null columns of a row; NULL when there are none."""
    seen = reduce(lambda a, b: a + b, [as_col(c).isNotNull().cast("int") for c in cols])
    return F.try_divide(null_sum(cols), seen.cast("double"))


def weighted_layers(weights: dict[str, float]) -> Column:
    """Thickness-weighted mean of layers; any missing layer gives NULL."""
    parts = [F.col(c) * F.lit(float(w)) for c, w in weights.items()]
    return reduce(lambda a, b: a + b, parts) / F.lit(float(sum(weights.values())))


def midpoint_mean(midpoints: dict[str, float], factor: float = 1.0) -> Column:
    """Mean size from counts per class and the class mid-points."""
    total = null_sum(list(midpoints))
    area = null_sum([F.col(c) * F.lit(float(m)) for c, m in midpoints.items()])
    return safe_ratio(area * F.lit(float(factor)), total)


def bins(c: ColumnLike, edges: list[float], labels: list[str], right: bool = False) -> Column:
    """Label of the range holding the value.

    ``edges`` are the inner cut points; ``right`` closes ranges on the right.
    """
    c = as_col(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(c <= edge if right else c < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def recode(c: ColumnLike, mapping: dict, default: Column | None = None) -> Column:
    c = as_col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)) if out is None else out.when(c == old, F.lit(new))
    return out.otherwise(c if default is None else default)


def round_where(c: ColumnLike, condition: Column, digits: int) -> Column:
    c = as_col(c)
    return F.when(condition, F.bround(c, digits)).otherwise(c)


FORWARD = {
    "log1p": F.log1p,
    "log": F.ln,
    "sqrt": F.sqrt,
    "cbrt": F.cbrt,
}
BACKWARD = {
    "log1p": F.expm1,
    "log": F.exp,
    "sqrt": lambda c: c * c,
    "cbrt": lambda c: c * c * c,
}


def transform_response(c: ColumnLike, kind: str) -> Column:
    return FORWARD[kind](as_col(c))


def invert_response(c: ColumnLike, kind: str) -> Column:
    return BACKWARD[kind](as_col(c))


def to_number(c: ColumnLike) -> Column:
    """Number from text with thousands commas; dashes and junk give NULL."""
    return F.regexp_replace(F.trim(as_col(c)), ",", "").try_cast("double")


def to_date(c: ColumnLike, fmt: str | None = None) -> Column:
    c = as_col(c)
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return parsed.cast("date")


def uniform_hash(*cols: ColumnLike, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from the key columns."""
    h = F.xxhash64(F.lit(seed), *[as_col(c) for c in cols])
    return F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
