"""Angles as columns."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PI = math.pi


def wrap(a: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(a + PI, F.lit(2 * PI)) - PI


@F.arrow_udf(T.DoubleType())
def heading(y: pa.Array, x: pa.Array) -> pa.Array:
    """atan2(y, x) to the last bit as the C library gives it, which DuckDB calls too; Java's own may be one unit off. Whether a reversal counts as +pi or -pi hangs on that bit."""
    return pa.array([None if a is None or b is None else math.atan2(a, b) for a, b in zip(y.to_pylist(), x.to_pylist(), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def wrap_closed(a: pa.Array) -> pa.Array:
    """To [-pi, pi], through the unit vector; the C library's functions, for the same reason."""
    return pa.array([x if x is None else math.atan2(math.sin(x), math.cos(x)) if math.isfinite(x) else math.nan for x in a.to_pylist()], pa.float64())


def length(x: Column, y: Column) -> Column:
    """Length of a vector to the last bit of sqrt(x x + y y): lengths that tie with a threshold in that formula do so here, while hypot may fall on either side."""
    return F.sqrt(x * x + y * y)


def fold(a: Column) -> Column:
    """A headless axis to [-pi/2, pi/2)."""
    return F.pmod(a + PI / 2, F.lit(PI)) - PI / 2


def turn(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed angle from vector a to vector b; an exact reversal is +pi."""
    cross = ax * by - ay * bx
    return F.atan2(F.when(cross == 0, 0.0).otherwise(cross), ax * bx + ay * by)
