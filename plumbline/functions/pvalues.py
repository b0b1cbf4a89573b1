"""p-values of the drift and normality tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kolmogorov(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Two-sample Kolmogorov-Smirnov p-value from the limiting series."""
    z2 = statistic * statistic * n * m / (n + m)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z2),
    )
    # Below 0.2 the series has not converged and the probability is 1 to many digits.
    return F.when(z2 < 0.04, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def dagostino(skew: Column, excess: Column, n: Column) -> tuple[Column, Column]:
    """D'Agostino and Pearson's K2 statistic and its p-value from population moments."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1
    delta = 1.0 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    ratio = y / alpha
    z_skew = delta * F.log(ratio + F.sqrt(ratio * ratio + 1))

    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (excess + 3.0 - mean) / F.sqrt(var)
    b1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / b1 * (2.0 / b1 + F.sqrt(1.0 + 4.0 / (b1 * b1)))
    denominator = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    z_kurt = (1.0 - 2.0 / (9.0 * a) - F.cbrt((1.0 - 2.0 / a) / denominator)) / F.sqrt(2.0 / (9.0 * a))

    k2 = z_skew * z_skew + z_kurt * z_kurt
    return k2, F.exp(-k2 / 2.0)


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, scale * h)


@F.pandas_udf(T.DoubleType())
def chi_squared(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    """Chi-squared p-value; runs on one row per column."""
    return pd.Series([
        None if pd.isna(s) or pd.isna(k) or k <= 0 else upper_gamma(k / 2.0, s / 2.0)
        for s, k in zip(statistic, freedom)
    ], dtype="float64")
