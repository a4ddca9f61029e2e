"""Closed-form curves as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BOLTZMANN = 1.380649e-23


def disk_order(x: Column, steps: int = 64) -> Column:
    """Mean polar order of a disk of scaled radius x for a field with exponential correlation exp(-r): sqrt of the pair integral.

    The distance d = 2 x s of two points of a unit disk has density 16 s (acos(s) - s sqrt(1 - s^2)) / pi, summed at midpoints.
    """
    grid = F.array(*[F.struct(F.lit((i + 0.5) / steps).alias("s"), F.lit(16 / math.pi * ((i + 0.5) / steps) * (math.acos((i + 0.5) / steps) - (i + 0.5) / steps * math.sqrt(1 - ((i + 0.5) / steps) ** 2)) / steps).alias("w")) for i in range(steps)])
    return F.sqrt(F.aggregate(grid, F.lit(0.0), lambda a, g: a + g["w"] * F.exp(-2 * x * g["s"])))


def master(x: Column) -> Column:
    """(1 - exp(-x)) / x, by its series near 0."""
    return F.when(F.abs(x) < 1e-4, 1 - x / 2 + x * x / 6).otherwise((1 - F.exp(-x)) / F.when(x == 0, F.lit(None)).otherwise(x))


def stokes_einstein(diameter_um: Column, kelvin: float = 298.0, viscosity: float = 1e-3) -> Column:
    """Diffusion coefficient of a sphere, um^2/s."""
    return F.lit(BOLTZMANN * kelvin / (3 * math.pi * viscosity) * 1e18) / diameter_um


def unified_diffusion(x: Column, speed: float, tau0: float, tau_xi: float) -> Column:
    """v^2 tau / 2 with the rate 1/tau the sum of an own rate and one of crossing domains."""
    return speed**2 / 2 / (1 / tau0 + 1 / (tau_xi * (1 + x)))


#: Coefficients of a rational approximation of the normal quantile (fixed values; relative error below 1.2e-9).
NORMAL_MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
NORMAL_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
NORMAL_EDGE = 0.02425


def polynomial(x, coefficients) -> Column:
    """Horner's scheme, highest power first."""
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal law for 0 < p < 1, by a rational approximation."""
    q = p - 0.5
    middle = polynomial(q * q, NORMAL_MIDDLE[0]) * q / polynomial(q * q, NORMAL_MIDDLE[1])
    near = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(F.when(near > 0, near)))
    tail = polynomial(t, NORMAL_TAIL[0]) / polynomial(t, NORMAL_TAIL[1])
    return F.when(near >= NORMAL_EDGE, middle).when(p < 0.5, tail).otherwise(-tail)


#: Coefficients of Hart's approximation of the normal law's distribution function (absolute error below 1e-14).
NORMAL_CDF = ((0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376), (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752))


def normal_cdf(z: Column) -> Column:
    """Distribution function of the standard normal law."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, e * polynomial(a, NORMAL_CDF[0]) / polynomial(a, NORMAL_CDF[1])).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)
