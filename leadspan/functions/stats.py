"""Rates, the 2x2 significance test and correlation as plain Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(c: Column) -> Column:
    """Half rounds towards +infinity, for negative values too."""
    return F.floor(c + F.lit(0.5))


def ratio(n: Column, d: Column, empty=0.0) -> Column:
    return F.when(d > 0, n.cast("double") / F.nullif(d, F.lit(0)).cast("double")).otherwise(F.lit(empty).cast("double"))


def rate1(n: Column, d: Column) -> Column:
    """Percentage with one decimal, 0 when the denominator is 0."""
    return F.when(d > 0, js_round(ratio(n, d) * 1000.0) / 10.0).otherwise(F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


# Abramowitz & Stegun 7.1.26, scale then polynomial coefficients, lowest power first.
ERFC_SCALE = 0.3275911
ERFC_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc_nonnegative(x: Column) -> Column:
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERFC_SCALE) * x)
    poly = F.lit(0.0)
    for coefficient in reversed(ERFC_COEFFICIENTS):
        poly = t * (F.lit(coefficient) + poly)
    return poly * F.exp(-x * x)


def ab_test(n_a: Column, c_a: Column, n_b: Column, c_b: Column) -> dict[str, Column]:
    """Chi-square on a 2x2 table: p value, significance, winner, lift and the sample size needed.

    For a 2x2 table the sum over the four cells equals diff^2 * (1/eA1 + 1/eA0 + 1/eB1 + 1/eB0),
    where diff = cA - eA1 is the same in size in every cell.
    """
    n_a, c_a, n_b, c_b = (c.cast("double") for c in (n_a, c_a, n_b, c_b))
    pooled = safe_div(c_a + c_b, n_a + n_b)
    expected = [n_a * pooled, n_a * (1 - pooled), n_b * pooled, n_b * (1 - pooled)]
    testable = (n_a > 0) & (n_b > 0) & (pooled > 0) & (pooled < 1)
    gap = c_a - expected[0]
    chi2 = sum((safe_div(gap * gap, e) for e in expected), F.lit(0.0))
    p = F.when(testable & (chi2 > 0), erfc_nonnegative(F.sqrt(chi2 / 2))).otherwise(F.lit(1.0))
    rate_a, rate_b = safe_div(c_a, n_a), safe_div(c_b, n_b)
    low, high = F.least(rate_a, rate_b), F.greatest(rate_a, rate_b)
    significant = testable & (p < 0.05) & (n_a >= 30) & (n_b >= 30)
    diff = high - low
    return {
        "chi_squared": F.when(testable, chi2).otherwise(F.lit(0.0)),
        "p_value": p,
        "significant": significant,
        "winner": F.when(significant, F.when(rate_a > rate_b, "A").otherwise("B")),
        "lift_percent": F.when(testable & (low > 0), safe_div(diff, low) * 100).otherwise(F.lit(0.0)),
        "min_sample": F.when(~testable, F.lit(30).cast("bigint"))
        .when(diff > 0, F.ceil(safe_div(16 * pooled * (1 - pooled), diff * diff)))
        .otherwise(F.lit(100).cast("bigint")),
    }


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation with 2 decimals; null below 3 pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, 1))
    xd, yd = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.sqrt(F.var_pop(xd) * F.var_pop(yd))
    value = F.try_divide(F.covar_pop(xd, yd), F.when(spread > 0, spread))
    return F.when(n >= 3, js_round(value * 100) / 100)
