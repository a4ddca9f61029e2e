"""Ranks and quantiles whatever the ranges, triggered averages, shapes of histograms, residual targets, stored windows."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from motes.operators import composed, ranks, resample, smoothing, states
from motes.sources import io


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else None, float(rng.randrange(50)) if i % 4 else 7.0, i) for i in range(3000)] + [("one", 2.5, 9000), ("empty", None, 9001)]
    return rows, spark.createDataFrame(rows, "k string, v double, i int")


def by_key(rows):
    groups = defaultdict(list)
    for k, v, i in rows:
        if v is not None:
            groups[k].append((v, i))
    return {k: sorted(g) for k, g in groups.items()}


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_ranks_do_not_depend_on_ranges(spark, values, parts):
    """Other numbers of ranges, other orders of rows and a cached input: the same ranks, each exactly once."""
    rows, df = values
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for given in (df, df.orderBy(F.desc("i")).repartition(5).cache()):
            got = {r.i: (r.rank, r.total) for r in ranks.ranked(given, "v", ["k"], ["i"]).collect()}
            want = {i: (n, len(g)) for g in by_key(rows).values() for n, (_, i) in enumerate(g, 1)}
            assert got == want
            mean = {r.i: r.r for r in ranks.average_rank(given, "v", ["k"], "r").collect()}
            for g in by_key(rows).values():
                v = pd.Series([x for x, _ in g])
                assert [mean[i] for _, i in g] == v.rank().tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_are_written_once(spark, values):
    """Both readers of the places see the same ones: a second look at the plan computes nothing anew."""
    _, df = values
    rows = ranks.placed(df.withColumn("u", F.rand()), ["k", "u"])
    a, b = rows.select("i", "u", "_place").collect(), rows.select("i", "u", "_place").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len({r._place for r in a}) == len(a)


def test_what_is_stashed_can_be_cleared(spark, values):
    _, df = values
    rows = io.stashed(df, "kept")
    assert rows.count() == len(values[0]) and io._own(spark) in rows.inputFiles()[0]
    io.clear(spark)
    with pytest.raises(Exception, match="exist"):
        spark.read.parquet(io._own(spark))


def test_quantiles_equal_percentile(values):
    rows, df = values
    shares = {f"q{i}": p for i, p in enumerate((0, 0.01, 0.25, 0.5, 0.77, 1))}
    got = {r.k: r for r in ranks.quantiles(df, "v", ["k"], shares).collect()}
    for k, g in by_key(rows).items():
        assert [got[k][n] for n in shares] == pytest.approx(np.quantile([v for v, _ in g], list(shares.values())).tolist(), abs=1e-12)
    assert "empty" not in got
    whole = ranks.with_quantiles(df.groupBy("k").agg(F.count("*").alias("n")), df, "v", ["k"], {"m": 0.5}).collect()
    assert len(whole) == 4 and {r.k: r.m for r in whole}["empty"] is None
    assert ranks.quantiles(df, "v", [], {"m": 0.5}).first().m == np.median([v for _, v, _ in rows if v is not None])
    weighed = ranks.quantiles(df.withColumn("w", F.col("i") % 3), "v", ["k"], {"m": 0.4}, "w").collect()
    assert "one" not in {r.k for r in weighed}  # its only row counts 0 times
    for r in weighed:
        assert r.m == pytest.approx(np.quantile(np.repeat([v for v, _ in by_key(rows)[r.k]], [i % 3 for _, i in by_key(rows)[r.k]]), 0.4))
    assert ranks.quantiles(df.where("false"), "v", ["k"], shares).count() == 0


def test_no_task_holds_a_group(values):
    """Plans of quantiles and numbers have no window or aggregate that gathers a whole group's rows or values."""
    _, df = values
    for out in (ranks.quantiles(df, "v", ["k"], {"m": 0.5}), ranks.numbered(df, ["k"], ["v", "i"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "collect_list" not in plan


def states_frame(spark, seed):
    rng = random.Random(seed)
    rows = []
    for p in range(12):
        mark, frame = 0, 0
        for seg in range(3):
            for _ in range(rng.randrange(1, 25)):
                mark = 1 - mark if rng.random() < 0.2 else mark
                rows.append((f"c{p % 2}", f"e{p % 4}", p, seg, frame, mark, rng.random() if rng.random() < 0.95 else None))
                frame += 1
            frame += 5
    return rows, spark.createDataFrame(rows, "condition string, exp string, particle int, segment int, frame int, state int, x double")


@pytest.mark.parametrize("clear", [False, True])
def test_triggered_sums_brute(spark, clear):
    rows, df = states_frame(spark, 3)
    unit, reach = ["condition", "exp", "particle"], 4
    own, segs = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r[:3]].append(r[6])
        segs[r[:4]].append(r)
    mean = {k: np.mean([v for v in vs if v is not None]) for k, vs in own.items()}
    want = defaultdict(lambda: [0.0, 0])
    for key, seg in segs.items():
        change = [i > 0 and seg[i][5] != seg[i - 1][5] for i in range(len(seg))]
        for t in range(1, len(seg)):
            if clear and not change[t] and any(change[max(0, t - reach) : t + reach + 1]):
                continue
            for k in range(-reach, reach + 1):
                if 0 <= t + k < len(seg) and seg[t + k][6] is not None:
                    cell = want[(*key[:3], 1 - seg[t - 1][5], int(not change[t]), k)]
                    cell[0] += seg[t + k][6] - mean[key[:3]]
                    cell[1] += 1
    sums = states.triggered_sums(df, "x", reach, ["exp", "particle", "segment"], unit, clear)
    got = {(*[r[c] for c in unit], r.kind, r.control, r.offset): (r.s, r.n) for r in sums.collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    if clear:
        return
    whole = {}
    for (c, _, _, kind, control, k), (s, n) in want.items():
        cell = whole.setdefault((c, kind, k), [0, 0, 0, 0])
        cell[2 * control] += s
        cell[2 * control + 1] += n
    curves = {(r.condition, r.kind, r.offset): r for r in states.triggered_curves(sums, ["condition"]).collect()}
    assert all(curves[k].difference == pytest.approx(a / n - b / m) for k, (a, n, b, m) in whole.items() if n and m)
    pre = {(r.condition, r.kind): r for r in states.pre_difference(sums, ["condition"], "exp", "particle", n=30).collect()}
    for (c, kind), r in pre.items():
        d = [curves[c, kind, k].difference for k in (-3, -2, -1)]
        assert r.difference == pytest.approx(np.mean(d)) and r.low <= r.high and r.se > 0
    assert states.pre_difference(sums.where("false"), ["condition"], "exp", "particle", n=5).count() == 0


def test_events_without_effect_show_none(spark):
    """A value that does not know of the states has no pre-window difference beyond its interval; one that rises before a stop has."""
    rows, df = states_frame(spark, 5)
    w = Window.partitionBy("exp", "particle", "segment").orderBy("frame")
    ahead = df.withColumn("x", F.greatest(*[F.coalesce(F.lead("state", k).over(w), F.lit(0)) for k in (1, 2, 3)]) * 5.0 + F.coalesce("x", F.lit(0.5)))
    sums = states.triggered_sums(ahead.where("condition is not null"), "x", 3, ["exp", "particle", "segment"], ["condition", "exp", "particle"])
    got = {r.kind: r for r in states.pre_difference(sums, [], "exp", "particle", n=60).collect()}
    assert got[1].low > 0.5


def test_hierarchical_weights_match_the_bootstrap(spark):
    _, df = states_frame(spark, 6)
    a = resample.hierarchical(df, "x", "exp", "particle", ["condition"], 15).collect()
    u = df.groupBy("condition", "exp", "particle").agg(F.avg("x").alias("m"))
    w = resample.hierarchical_weights(df, "exp", "particle", ["condition"], 15)
    reps = u.join(w, ["condition", "exp", "particle"]).groupBy("condition", "b").agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("v"))
    b = {r.condition: r for r in resample.interval(reps, "v", ["condition"]).collect()}
    assert all(r.se == pytest.approx(b[r.condition].se) and r.low == pytest.approx(b[r.condition].low) for r in a)


def test_shape_of_a_known_potential(spark):
    """Cosines drawn from exp(A arctanh c - 2 kappa c^2) / sqrt(1 - c^2): the fit finds both strengths, and the intervals hold them."""
    polar, nematic, rng = 0.6, 0.4, np.random.default_rng(2)
    c = np.linspace(-0.9999, 0.9999, 400_001)
    p = np.exp(polar * np.arctanh(c) - 2 * nematic * c**2) / np.sqrt(1 - c**2)
    drawn = rng.choice(c, 60_000, p=p / p.sum())
    df = spark.createDataFrame(pd.DataFrame({"condition": "a", "particle": np.arange(60_000) % 200, "c": drawn}))
    reps = composed.shape_replicates(df, "c", ["particle"], ["condition"], 28, 40).cache()
    fit = composed.shape_fit(reps, ["condition"]).first()
    assert fit.polar == pytest.approx(polar, abs=0.05) and fit.nematic == pytest.approx(nematic, abs=0.08)
    assert fit.polar_low <= fit.polar <= fit.polar_high and fit.nematic_low < fit.nematic_high and 0 < fit.polar_se < 0.1
    rows = {r.bin: r for r in composed.shape_table(reps, ["condition"]).collect()}
    h = np.histogram(drawn, np.linspace(-1, 1, 29), density=True)[0]
    assert [rows[i].p for i in range(28)] == pytest.approx(h.tolist())
    assert [rows[i].even + rows[i].odd for i in range(28)] == pytest.approx(h.tolist()) and rows[13].potential == pytest.approx(-0.5 * np.log(1 - rows[13].c ** 2))
    assert all(r.p_low <= r.p <= r.p_high for r in rows.values())
    assert composed.shape_table(composed.shape_replicates(df.where("false"), "c", ["particle"], ["condition"], 28, 3), ["condition"]).count() == 0


def test_residual_reaches_its_target(spark):
    rng = np.random.default_rng(4)
    t = np.arange(300)
    known = rng.random(300) > 0.2
    known[[0, -1]] = True
    for noise in (0.05, 0.3):
        true = np.sin(t / 20) * 3 + t / 50
        y = true + rng.normal(0, noise, 300)
        target = known.sum() * noise**2
        z, penalty = smoothing.smoothed_to(np.where(known, y, 0), target, known)
        assert ((z - y)[known] ** 2).sum() == pytest.approx(target, rel=0.01) and np.isfinite(penalty)
        assert np.sqrt(np.mean((z - true) ** 2)) < 0.6 * noise
    z, penalty = smoothing.smoothed_to(2.0 * t + 0.01 * rng.normal(size=300), 300.0, np.ones(300, bool))
    assert penalty == float("inf") and np.allclose(np.diff(z, 2), 0, atol=1e-9)
    frame = spark.createDataFrame(pd.DataFrame({"exp": "e", "particle": np.repeat([1, 2], 300), "frame": np.tile(t, 2), "x": np.tile(true, 2) + rng.normal(0, 0.3, 600), "y": np.tile(3.0 * t, 2)}))
    got = smoothing.spline_velocity(frame, noise=0.3).toPandas().merge(frame.toPandas(), on=["exp", "particle", "frame"])
    for _, g in got.groupby("particle"):
        assert ((g.x_smooth - g.x) ** 2).sum() == pytest.approx(300 * 0.09, rel=0.01) and g.vy.to_numpy() == pytest.approx(3.0)


def test_bands_solve_the_dense_system():
    rng = np.random.default_rng(5)
    for n in (3, 4, 5, 40):
        known = rng.random(n) > 0.3
        known[[0, n - 1]] = True
        y = rng.normal(size=(n, 3))
        lam = np.array([0.1, 3.0, 1e4])
        d2 = np.diff(np.eye(n), 2, axis=0)
        got = smoothing.whittaker(y, lam, known)
        for j in range(3):
            want = np.linalg.solve(np.diag(known.astype(float)) + lam[j] * d2.T @ d2, np.where(known, y[:, j], 0))
            assert got[:, j] == pytest.approx(want, abs=1e-8)
            assert smoothing.whittaker(y[:, j], lam[j], known) == pytest.approx(want, abs=1e-8)
