"""Normal and log-normal expressions and the Kolmogorov tail."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotwise.functions.numbers import as_col

# Polynomial for the normal tail (Abramowitz and Stegun 26.2.17)
TAIL_RATE = 0.2316419
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)

# Rational approximation of the normal quantile (Acklam)
MID_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MID_LOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
END_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
END_LOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
END_AT = 0.02425


def _poly(coefficients, x: Column) -> Column:
    """Horner form, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def normal_cdf(z) -> Column:
    z = as_col(z)
    t = 1 / (1 + F.lit(TAIL_RATE) * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * _poly(TAIL[::-1], t)
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p) -> Column:
    p = as_col(p)
    q = p - 0.5
    middle = q * _poly(MID_TOP, q * q) / _poly(MID_LOW, q * q)
    root = lambda x: F.sqrt(-2 * F.ln(x))
    end = lambda x: _poly(END_TOP, root(x)) / _poly(END_LOW, root(x))
    return F.when(p < END_AT, end(p)).when(p > 1 - END_AT, -end(1 - p)).otherwise(middle)


def lognormal_from_moments(mean, sd) -> tuple[Column, Column]:
    """meanlog and sdlog of the log-normal with the given mean and sd."""
    m, s = as_col(mean), as_col(sd)
    return F.ln(m * m / F.sqrt(m * m + s * s)), F.sqrt(F.ln(1 + s * s / (m * m)))


def lognormal_moments(mu, sigma) -> tuple[Column, Column]:
    """Arithmetic mean and sd of a log-normal."""
    mu, v = as_col(mu), as_col(sigma) * as_col(sigma)
    return F.exp(mu + v / 2), F.sqrt((F.exp(v) - 1) * F.exp(2 * mu + v))


def kolmogorov_p(z: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of the scaled two-sample distance."""
    js = F.sequence(F.lit(1), F.lit(terms))
    total = F.aggregate(js, F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * z * z))
    # the series does not converge near zero, where p is 1 to 15 digits
    return F.when(z < 0.18, 1.0).otherwise(F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0)))
