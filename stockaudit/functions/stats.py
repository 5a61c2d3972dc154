"""Correlation and its significance as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Terms of the continued fraction, whatever the number of pairs; 20 give ten digits for up to ten million.
FRACTION_TERMS = 60
# The gamma quotient is taken this far above its argument, where six terms of its series give eleven digits.
GAMMA_SHIFT = 16


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r over complete pairs; null below three pairs or for a constant side."""
    complete = x.isNotNull() & y.isNotNull()
    x = F.when(complete, x.cast("double"))
    y = F.when(complete, y.cast("double"))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    # Rounding may carry r past 1; least() and greatest() would turn a null r into a bound.
    return F.when(F.count(x) >= 3, F.when(r > 1, 1.0).when(r < -1, -1.0).otherwise(r))


def pairs(x: Column, y: Column) -> Column:
    """Aggregate: number of complete pairs."""
    return F.count(F.when(x.isNotNull() & y.isNotNull(), 1))


def gamma_quotient(a: Column) -> Column:
    """Gamma(a + 1/2) / Gamma(a) for positive a, by its series at ``a + GAMMA_SHIFT`` and the recurrence down to a."""
    z = a + GAMMA_SHIFT
    series = F.lit(0.0)
    # Coefficients of 1/z^6 down to 1 (Abramowitz & Stegun 6.1.47 with a = 1/2, b = 0).
    for term in (869 / 4194304, -399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0):
        series = series / z + term
    steps = F.sequence(F.lit(0), F.lit(GAMMA_SHIFT - 1))
    return F.aggregate(steps, F.sqrt(z) * series, lambda product, j: product * (a + j) / (a + j + 0.5))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function (Abramowitz & Stegun 26.5.8), from the front."""

    def advanced(state: Column, coefficient: Column) -> Column:
        lower = 1 / (1 + coefficient * state["lower"])
        upper = 1 + coefficient / state["upper"]
        return F.struct((state["value"] * lower * upper).alias("value"), lower.alias("lower"), upper.alias("upper"))

    def two_terms(state: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return advanced(advanced(state, even), odd)

    first = 1 / (1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("value"), first.alias("lower"), F.lit(1.0).alias("upper"))
    terms = F.sequence(F.lit(1), F.lit(FRACTION_TERMS))
    return F.aggregate(terms, start, two_terms, lambda state: state["value"])


def corr_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation from Student's t with n - 2 degrees of freedom.

    It is the incomplete beta function of 1 - r^2 with half the degrees of freedom and 1/2. Its continued fraction
    converges quickly below the mean of that distribution; above it the complement of the mirrored function is taken.
    The work does not depend on n.
    """
    half = (n - 2) / 2.0
    squared = r * r
    front = F.exp(half * F.log1p(-squared)) * F.abs(r) * gamma_quotient(half) / math.sqrt(math.pi)
    below = front * _beta_fraction(half, F.lit(0.5), 1 - squared) / half
    above = 1 - 2 * front * _beta_fraction(F.lit(0.5), half, squared)
    tail = F.when(1 - squared < (half + 1) / (half + 2.5), below).otherwise(above)
    return F.when((n >= 3) & (F.abs(r) >= 1), F.lit(0.0)).when((n >= 3) & r.isNotNull(), F.greatest(tail, F.lit(0.0)))
