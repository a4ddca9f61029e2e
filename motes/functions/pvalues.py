"""Two-sided p-values of statistics as columns: of normal scores in closed form, of Student's t by a vectorised function for result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .curves import normal_cdf


def of_normal(z: Column) -> Column:
    return 2 * normal_cdf(-F.abs(z))


def beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        term = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * (value - 1)


def of_student(t: Column, freedom: Column) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([beta_share(n_ / (n_ + t_ * t_), n_ / 2, 0.5) if np.isfinite(t_) and n_ > 0 else np.nan for t_, n_ in zip(t.to_numpy(float), n.to_numpy(float), strict=True)])

    return F.nanvl(p(t, freedom), F.lit(None).cast("double"))
