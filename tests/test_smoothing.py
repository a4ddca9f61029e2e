import numpy as np
import pytest

from motes.operators import smoothing


def test_whittaker_is_the_penalised_solution():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 30):
        y = rng.normal(size=n)
        d = np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((0, n))
        assert smoothing.whittaker(y, 7.0) == pytest.approx(np.linalg.solve(np.eye(n) + 7 * d.T @ d, y))


def test_constant_velocity_is_recovered(spark):
    rng = np.random.default_rng(2)
    rows = [("c", "e", 1, f, 3 * f * 0.1 + rng.normal(0, 0.02), -f * 0.1 + rng.normal(0, 0.02)) for f in range(50) if f % 7]
    df = spark.createDataFrame([(a, b, c, d, float(x), float(y)) for a, b, c, d, x, y in rows], "condition string, exp string, particle long, frame int, x double, y double")
    k = smoothing.kalman_velocity(df, 0.02, 0.01, 0.1).toPandas()
    assert k.vx.mean() == pytest.approx(3, abs=0.1) and k.vy.mean() == pytest.approx(-1, abs=0.1) and (k.vx_error > 0).all() and len(k) == len(rows)
    s = smoothing.spline_velocity(df, 50.0, 0.1).toPandas()
    assert s.vx.median() == pytest.approx(3, abs=0.2)
    assert smoothing.kalman_velocity(df.where("false"), 1.0).count() == 0 and smoothing.spline_velocity(df.where("frame = 1")).count() == 1
