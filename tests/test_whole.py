"""Queries over whole tables against brute force."""

import numpy as np
import pytest

from motes.plans.registry import QUERIES
from motes.sources.fixtures import Views

SF = "/root/testdata/sf0.001"


def test_whole_tracks(spark):
    tracks = Views(spark, SF).tracks.select("condition", "exp", "frame", "x", "y").toPandas()
    for r in QUERIES["x08_power_tail"](spark, SF).collect():
        x = tracks[(tracks.condition == r.condition) & (tracks.x >= r.x_min - 1e-8) & (tracks.x <= r.x_max + 1e-8)].x
        assert r.n == len(x) and r.exponent == pytest.approx(1 + len(x) / np.log(x / r.x_min).sum(), rel=1e-5)
        assert (tracks[tracks.condition == r.condition].x >= r.x_max - 1e-8).sum() >= 5


def test_retention_of_the_slowdown(spark):
    """Depths of lags 0 to 2 around every particle, from all pixels of its frame's past."""
    t = Views(spark, SF)
    particles, field = t.on_field.toPandas(), t.field.toPandas()
    field["s"] = np.hypot(field.u, field.v)
    by, near = dict(list(field.groupby(["exp", "frame"]))), {}
    for p in particles.dropna().itertuples():
        for lag in (0, 1, 2):
            f = by.get((p.exp, p.frame - lag))
            if f is not None:
                r = np.hypot(f.px - p.x, f.py - p.y) - 1
                cell = near.setdefault((p.exp, lag), ([], []))
                cell[0].extend(f.s[(r >= 0) & (r < 1) & (r <= 4)])
                cell[1].extend(f.s[(r >= 2) & (r <= 4)])
    depth = {k: 1 - np.mean(a) / np.mean(b) for k, (a, b) in near.items() if a and b}
    got = {r.exp: r.retention for r in QUERIES["x14_retention"](spark, SF).collect()}
    assert got and all(v == pytest.approx(depth[e, 2] / depth[e, 0], abs=1e-6) for e, v in got.items() if v is not None and (e, 2) in depth)


def test_all_rows_of_blocks(spark):
    from motes.plans.fields import spun

    for name, size, step in (("g17_overlapping_blocks", 8, 4), ("g19_block_pairs", 4, 4)):
        every = QUERIES[name](spark, SF).toPandas()
        field = spun(Views(spark, SF)).where("frame = 0").select("exp", "px", "py").toPandas()
        for r in every[every.frame == 0].itertuples():
            f = field[field.exp == r.exp]
            assert r.n == (f.px.between(r.bx * step, r.bx * step + size - 1) & f.py.between(r.row * step, r.row * step + size - 1)).sum()
        assert every["row"].nunique() > 1


def test_hidden_vector_of_two_radii(spark):
    """Mean flows within two radii and their mean dot products with the motion give the motion back, where the flows are not collinear."""
    from motes.plans.fields import moved

    t = Views(spark, SF)
    particles, field = moved(t).select("exp", "frame", "particle", "x", "y", "dx", "dy").toPandas(), t.field.toPandas()
    got = {(r.exp, r.frame, r.particle): (r.hx, r.hy) for r in QUERIES["k26_hidden_vector"](spark, SF).collect()}
    by = dict(list(field.groupby(["exp", "frame"])))
    tried = 0
    for p in particles.dropna().itertuples():
        f = by.get((p.exp, p.frame))
        h = got.get((p.exp, p.frame, p.particle))
        if f is None or h is None or h[0] is None:
            continue
        d2 = (f.px - p.x) ** 2 + (f.py - p.y) ** 2
        rows = [f[d2 <= r * r] for r in (1.5, 3.0) if (d2 <= r * r).any()]
        a = np.array([[g.u.mean(), g.v.mean()] for g in rows])
        d = np.array([(g.u * p.dx + g.v * p.dy).mean() for g in rows])
        if len(a) and np.linalg.cond(a) < 1e3:
            assert np.allclose(np.linalg.lstsq(a, d, rcond=None)[0], h, atol=2e-4)
            assert len(a) == 1 or np.allclose(h, (p.dx, p.dy), atol=2e-4)
            tried += 1
    assert tried > 0
