"""Operators against numpy, analytic identities, and hard inputs: empty, one row, ties, gaps, nulls."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motes.functions import angles, bins
from motes.operators import association, distributions, field, filters, fits, kinematics, lagstats, resample, spatial, states
from motes.sources import io
from motes.streaming import forms

TRACK = "condition string, exp string, particle long, frame int, x double, y double"


def tracks(spark, rows):
    return spark.createDataFrame([("c", "e", p, f, float(x), float(y)) for p, f, x, y in rows], TRACK)


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(1)
    xy = rng.normal(size=(3, 40, 2)).cumsum(axis=1)
    return tracks(spark, [(p, f, *xy[p, f]) for p in range(3) for f in range(40)]), xy


def test_straight_line(spark):
    v = kinematics.velocity(tracks(spark, [(1, f, 3 * f, 4 * f) for f in range(5)]), dt=2.0).orderBy("frame").collect()
    assert v[0].v is None and all(r.v == 2.5 and r.theta == pytest.approx(math.atan2(4, 3)) for r in v[1:])
    assert [r.dtheta for r in v[2:]] == [0.0, 0.0, 0.0]


def test_msd_of_a_line_is_square(spark):
    m = {r.lag: r.msd for r in lagstats.imsd(tracks(spark, [(1, f, f, 0) for f in range(10)]), 5).collect()}
    assert m == {k: float(k * k) for k in range(1, 6)}


def test_msd_brute_force(walk):
    df, xy = walk
    for r in lagstats.imsd(df, 7).collect():
        d = xy[r.particle, r.lag :] - xy[r.particle, : -r.lag]
        assert r.msd == pytest.approx((d**2).sum(1).mean()) and r.n == 40 - r.lag


def test_gaps_by_frame_and_row(spark):
    t = tracks(spark, [(1, 0, 0, 0), (1, 1, 1, 0), (1, 5, 9, 0)])
    assert {r.lag for r in lagstats.imsd(t, 3, "frame").collect()} == {1}
    assert {r.lag for r in lagstats.imsd(t, 3, "row").collect()} == {1, 2}
    assert [r.segment for r in kinematics.segments(t).orderBy("frame").collect()] == [0, 0, 1]


def test_empty_and_single(spark):
    none = tracks(spark, [])
    one = tracks(spark, [(1, 0, 0, 0)])
    for op in (lambda d: lagstats.imsd(d, 3), lambda d: lagstats.msad(d, 3), filters.end_to_end, kinematics.velocity, lambda d: distributions.histogram(d, "x", 0, 1, 4, ["exp"]), lambda d: association.correlations(d, "x", "y", ["exp"])):
        op(none).collect()
        op(one).collect()


def test_turn_of_reversal_is_plus_pi(spark):
    got = kinematics.turning_angle(tracks(spark, [(1, 0, 0, 0), (1, 1, 1, 0), (1, 2, 0, 0)])).collect()
    assert [r.angle for r in got] == [pytest.approx(math.pi)]


def test_wraps(spark):
    r = spark.range(1).select(angles.wrap(F.lit(4.0)).alias("a"), angles.fold(F.lit(3.0)).alias("b"), angles.wrap_closed(F.lit(-4.0)).alias("c")).first()
    assert r.a == pytest.approx(4 - 2 * math.pi) and r.b == pytest.approx(3 - math.pi) and r.c == pytest.approx(2 * math.pi - 4)


def test_bin_edges(spark):
    v = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 5.0, 10.0, 11.0)], "v double")
    got = v.select(bins.uniform(F.col("v"), 0, 10, 2).alias("a"), bins.uniform(F.col("v"), 0, 10, 2, "left").alias("b"), bins.uniform(F.col("v"), 0, 10, 2, "clip").alias("c"), bins.by_edges(F.col("v"), [0, 5, 10], "right").alias("d")).collect()
    assert [tuple(r) for r in got] == [(None, None, 0, None), (0, 0, 0, 0), (1, 1, 1, 0), (1, None, 1, 1), (None, None, 1, None)]


def test_near_pixels_brute_force(spark):
    rng = np.random.default_rng(2)
    pix = [(i, j) for i in range(12) for j in range(12) if rng.random() < 0.8]
    f = spark.createDataFrame([("e", 0, i, j, 1.0, 0.0) for i, j in pix], "exp string, frame int, px int, py int, u double, v double")
    pts = rng.uniform(0, 12, (6, 2))
    p = spark.createDataFrame([("e", 0, k, float(x), float(y)) for k, (x, y) in enumerate(pts)], "exp string, frame int, particle long, x double, y double")
    want = {(k, i, j) for k, (x, y) in enumerate(pts) for i, j in pix if (i - x) ** 2 + (j - y) ** 2 <= 9}
    rows = [(r.particle, r.px, r.py) for r in spatial.near_pixels(p, f, 3.0).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_uniform_field_has_full_order(spark):
    f = spark.createDataFrame([("e", 0, i, j, 0.6, 0.8) for i in range(8) for j in range(8)], "exp string, frame int, px int, py int, u double, v double")
    r = field.frame_order(f).first()
    assert r.polar == pytest.approx(1) and r.nematic == pytest.approx(1) and r.axis == pytest.approx(math.atan2(0.8, 0.6))
    assert all(x.c == pytest.approx(1) for x in field.two_point(f, 3).collect())
    assert all(abs(x.q) < 1e-12 for x in field.gradients(f).collect())
    assert field.neighbourhood_order(f, 1).first()["median"] == pytest.approx(1)


def test_stripes_alternate(spark):
    f = spark.createDataFrame([("e", 0, i, j, 1.0 if i % 2 else -1.0, 0.0) for i in range(6) for j in range(6)], "exp string, frame int, px int, py int, u double, v double")
    theta = spark.createDataFrame([("e", 0, 0.0)], "exp string, frame int, theta double")
    s = field.spins(f, theta)
    assert field.spin_fractions(s, ["exp"]).first().bias == 0
    b = {r.window: r for r in field.block_curve(s, [1, 2], 1.0, 6).collect()}
    assert b[1].abs_m == 1 and b[2].abs_m == 0 and b[2].p == pytest.approx(0)


def test_ranks_with_ties(spark):
    d = spark.createDataFrame([("k", v) for v in (1.0, 2.0, 2.0, 5.0)], "k string, v double")
    assert sorted(r.r for r in association.average_rank(d, "v", ["k"], "r").collect()) == [1, 2.5, 2.5, 4]


def test_weighted_line_is_polyfit(spark):
    rng = np.random.default_rng(3)
    x, w = rng.uniform(0, 5, 20), rng.uniform(0.5, 2, 20)
    y = 2 * x + 1 + rng.normal(0, 0.1, 20)
    d = spark.createDataFrame([("k", float(a), float(b), float(c)) for a, b, c in zip(x, y, w)], "k string, x double, y double, w double")
    r = fits.weighted_line(d, F.col("x"), F.col("y"), F.col("w"), ["k"]).first()
    p, cov = np.polyfit(x, y, 1, w=w, cov=True)
    assert (r.slope, r.intercept) == (pytest.approx(p[0]), pytest.approx(p[1])) and r.slope_error == pytest.approx(cov[0, 0] ** 0.5)


def test_curve_fits_choose_the_model(spark):
    rows = [("k", float(x), 3 * math.exp(-x / 4) + 1, None) for x in range(1, 30)]
    d = spark.createDataFrame(rows, "k string, x double, y double, sigma double")
    best = fits.curve_fits(d, ["k"], ["exponential", "offset_exponential", "line"]).where("rank = 1").first()
    assert best.model == "offset_exponential" and best.parameters == pytest.approx([3, 4, 1], rel=1e-4)


def test_bootstrap_is_repeatable_and_sane(spark):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(rng.normal(size=200))], "k string, u long, v double")
    a, b = (resample.bootstrap_mean(d, "v", ["u"], ["k"], 200).first() for _ in range(2))
    assert a == b and a.se == pytest.approx(1 / 200**0.5, rel=0.3)


def test_time_shuffle_keeps_values(walk):
    df, xy = walk
    got = resample.time_shuffle(df, ["y"], ["exp", "particle"], 2).where("round = 2 and particle = 1").orderBy("frame").toPandas()
    assert sorted(got.y) == pytest.approx(sorted(xy[1, :, 1])) and list(got.x) == pytest.approx(list(xy[1, :, 0]))


def test_glitches(spark):
    s = [1, 1, 0, 1, 1, 0, 0, 1, 0]
    d = spark.createDataFrame([("e", 1, i, v) for i, v in enumerate(s)], "exp string, particle long, frame int, state int")
    got = [r.state for r in states.without_glitches(d, ["exp", "particle"], 2).orderBy("frame").collect()]
    assert got == [1, 1, 1, 1, 1, 0, 0, 0, 0]


def test_hmm_finds_two_levels(spark):
    rng = np.random.default_rng(5)
    rows = []
    for p in range(6):
        s = 0
        for f in range(150):
            s = s if rng.random() < 0.9 else 1 - s
            rows.append(("c", "e", p, 0, f, float(rng.normal(4 * s, 0.5)), s))
    d = spark.createDataFrame(rows, "condition string, exp string, particle long, segment long, frame int, obs double, truth int")
    m = states.fit_hmm(d, 2, 12)
    assert all(b >= a - 1e-6 for a, b in zip(m["likelihoods"], m["likelihoods"][1:]))
    assert m["mean"] == pytest.approx([0, 4], abs=0.3)
    got = states.decode(d.drop("truth"), m).join(d.select("particle", "frame", "truth"), ["particle", "frame"])
    assert got.where("state = truth").count() > 0.97 * len(rows)


def test_csv_tree(spark, tmp_path):
    p = tmp_path / "beads06um" / "d1" / "exp1"
    p.mkdir(parents=True)
    (p / "beads_tracks.csv").write_text("frame,particle,x,y\n0,1,0.5,1\n1,1,2,3\n")
    r = io.read_track_csvs(spark, str(tmp_path)).orderBy("frame").collect()
    assert [(x.condition, x.date, x.exp, x.frame, x.x) for x in r] == [("beads06um", "d1", "exp1", 0, 0.5), ("beads06um", "d1", "exp1", 1, 2.0)]
    io.save_tracks(io.read_track_csvs(spark, str(tmp_path)), str(tmp_path / "out"))
    assert io.read_tracks(spark, str(tmp_path / "out")).where("condition = 'beads06um'").count() == 2


def test_streams_equal_batch(spark, tmp_path, walk):
    df, _ = walk
    df.where("frame <> 20").withColumn("v", F.col("x")).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = forms.drained(forms.arriving_steps(src), "steps", str(tmp_path)).orderBy("particle", "frame").toPandas()
    want = kinematics.gap_aware_speed(df.where("frame <> 20")).orderBy("particle", "frame").toPandas()
    assert got.v.fillna(-1).tolist() == pytest.approx(want.v.fillna(-1).tolist())
    runs = forms.drained(forms.dwell_runs(src, "v", 0.5, 1.0), "runs", str(tmp_path)).toPandas()
    s = states.hysteresis(df.where("frame <> 20").withColumn("v", F.col("x")), "v", 0.5, 1.0)
    batch = states.islands(s, "state", ["exp", "particle", "segment"]).toPandas()
    ended = {(r.particle, r.state, r["first"], r["last"]) for _, r in runs.iterrows()}
    assert ended <= {(r.particle, r.state, r["first"], r["last"]) for _, r in batch.iterrows()} and len(ended) >= len(batch) - 3
    seg = forms.drained(forms.segments(forms.with_time(src, 4), "5 seconds", "1 second"), "seg", str(tmp_path)).toPandas()
    assert set(zip(seg["first"], seg["last"])) <= {(0, 19), (21, 39)}
    mom = forms.drained(forms.window_moments(forms.with_time(src, 4), "x", "40 seconds", "1 second"), "mom", str(tmp_path)).toPandas()
    assert mom.n.max() <= 30


def particles_of(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("e", f, p, float(x), float(y)) for f in (0, 1) for p, (x, y) in enumerate(rng.uniform(-30, 30, (n, 2)) * (1, 1 if f else 0.02))]
    return rows, spark.createDataFrame(rows, "exp string, frame long, particle long, x double, y double")


@pytest.mark.parametrize("within", [None, 7.5])
def test_pairs_in_blocks(spark, within):
    """All pairs once each, however a crowded cell or frame is cut into blocks."""
    from motes.operators import spatial

    rows, df = particles_of(spark, 60)
    want = {(f, p, q): np.hypot(x - u, y - v) for _, f, p, x, y in rows for _, g, q, u, v in rows if f == g and p < q}
    want = {k: r for k, r in want.items() if within is None or r <= within}
    for block in (3, 1024):
        got = [((r.frame, r.particle, r.particle_2), r.r) for r in spatial.pairs(df, [], within, block).collect()]
        assert len(got) == len(want) and {k: pytest.approx(r) for k, r in got} == want
    assert spatial.pairs(df.where("false"), [], within).count() == 0


def test_no_pair_is_shuffled(spark):
    """Above the join of pairs an exchange takes only what a task has summed."""
    from motes.plans.registry import QUERIES

    for name in ("g03_pair_bins", "g04_short_range", "g05_relative_order"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().splitlines()
        top = next(i for i, line in enumerate(plan) if "Join" in line)
        above = [next((w for w in ("Exchange", "HashAggregate") if w in line), None) for line in plan[:top]]
        assert [w for w in above if w][-1] == "HashAggregate", name


def test_relative_displacements_ignore_what_moves_all(spark):
    """A drift of the frame changes nothing; pairs that part along the director have cos2 1, across -1."""
    from motes.operators import spatial

    df = spark.createDataFrame([("e", 0, 1, 0.0, 0.0, 5.0, 2.0, 0.3), ("e", 0, 2, 1.0, 0.0, 5.0 + math.cos(0.3), 2.0 + math.sin(0.3), 0.3), ("e", 0, 3, 2.0, 0.0, 5.0 - math.sin(0.3), 2.0 + math.cos(0.3), 0.3)], "exp string, frame long, particle long, x double, y double, dx double, dy double, theta double")
    got = {(r.particle, r.particle_2): r for r in spatial.relative_displacements(spatial.pairs(df, ["dx", "dy", "theta"])).collect()}
    assert got[1, 2].cos2 == pytest.approx(1) and got[1, 2].phi == pytest.approx(0) and got[1, 3].cos2 == pytest.approx(-1) and got[2, 3].dr == pytest.approx(2**0.5)
    order = spatial.relative_order(spatial.relative_displacements(spatial.pairs(df, ["dx", "dy", "theta"])), ["exp"], 0.5).first()
    assert order.n == 3 and order.order == pytest.approx(0, abs=1e-12)
