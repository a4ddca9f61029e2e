"""What shows on tables larger than the given ones: values in which a last bit decides, and steps whose work must grow with the input."""

import math
import random

import pytest
from pyspark.sql import functions as F

TRACK = "condition string, exp string, particle long, frame int, x double, y double"


@pytest.fixture(scope="module")
def cents(spark):
    """Tracks of random places in cents, with exact reversals."""
    rng = random.Random(3)
    rows = []
    for p in range(40):
        x, y = [0.0], [0.0]
        for i in range(60):
            back = i % 3 == 2
            dx, dy = (x[-2] - x[-1], y[-2] - y[-1]) if back else (round(rng.expovariate(0.02), 2), rng.randrange(1, 100))
            x.append(x[-1] + dx)
            y.append(y[-1] + dy)
        rows += [("c0", "e0", p, i, a, float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return rows, spark.createDataFrame(rows, TRACK)


def steps(rows):
    """(particle, frame): dx, dy."""
    at = {(r[2], r[3]): r[4:] for r in rows}
    return {(p, f): (x - at[p, f - 1][0], y - at[p, f - 1][1]) for (p, f), (x, y) in at.items() if f}


def test_lag_below_the_smallest_number(spark):
    from motes.plans import registry

    got = [r[0] for r in spark.createDataFrame([(0.0,), (100.0,), (float("inf"),)], "x double").select(registry.lags.log_lag(F.col("x"))).collect()]
    assert got == [-math.inf, 2.0, math.inf]


def test_headings_to_the_last_bit(spark, cents):
    """Reversals turn to the side that the C library's atan2 gives."""
    from motes.operators import kinematics

    rows, df = cents
    want = {k: math.atan2(dy, dx) for k, (dx, dy) in steps(rows).items()}
    v = kinematics.velocity(df)
    assert {(r.particle, r.frame): r.theta for r in v.where("theta is not null").collect()} == want
    last = {}
    for r in kinematics.unwrapped(v.where("theta is not null"), "theta").orderBy("particle", "frame").collect():
        if r.frame > 1:
            d = want[r.particle, r.frame] - want[r.particle, r.frame - 1]
            last[r.particle] += math.atan2(math.sin(d), math.cos(d))
        else:
            last[r.particle] = r.theta
        assert r.theta_unwrapped == pytest.approx(last[r.particle], abs=1e-9)


def test_speeds_and_distances_to_the_last_bit(spark, cents):
    """Lengths tie with thresholds, medians and bin edges where sqrt(dx dx + dy dy) does."""
    from motes.operators import kinematics, spatial

    rows, df = cents
    want = {k: math.sqrt(dx * dx + dy * dy) for k, (dx, dy) in steps(rows).items()}
    assert {(r.particle, r.frame): r.v for r in kinematics.gap_aware_speed(df).where("v is not null").collect()} == want
    at = {(r[2], r[3]): r[4:] for r in rows}
    for r in spatial.pairs(df, []).collect():
        (ax, ay), (bx, by) = at[r.particle, r.frame], at[r.particle_2, r.frame]
        assert r.r == math.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def test_many_groups_to_one_call(spark):
    """Groups cut by the ends of batches come whole and once, nulls in keys are alike, and a call takes many groups."""
    from motes.operators.grouped import in_groups

    rng = random.Random(4)
    rows = [("e" if p % 5 else None, p if p % 7 else None, f) for p in range(90) for f in range(rng.randrange(1, 9))]
    rows += [("long", 1, f) for f in range(300)]
    df = spark.createDataFrame(rows, "exp string, particle long, frame int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        def run(pdf, starts):
            size = [b - a for a, b in zip(starts, [*starts[1:], len(pdf)])]
            return pdf.iloc[starts][["exp", "particle"]].assign(n=size, groups=len(starts))

        got = in_groups(df, ["exp", "particle"], "frame", run, "exp string, particle long, n long, groups long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(r.exp, r.particle): r["count"] for r in df.groupBy("exp", "particle").count().collect()}
    assert len(got) == len(want) and {(r.exp, r.particle): r.n for r in got} == want and max(r.groups for r in got) > 3


def test_tracks_smoothed_side_by_side():
    """The curves are those of each track alone, whatever lies beside it."""
    import numpy as np

    from motes.operators import smoothing

    rng = np.random.default_rng(8)
    size = [1, 2, 3, 5, 17, 40, 40]
    y, known = np.zeros((40, 7)), np.zeros((40, 7), bool)
    for j, n in enumerate(size):
        known[:n, j] = rng.random(n) < 0.7
        known[[0, n - 1], j] = True
        y[:n, j] = np.where(known[:n, j], rng.normal(size=n).cumsum(), 0)
    target = known.sum(0) * 0.05**2
    target[6] = 1e9  # a straight line
    got = smoothing.smoothed_each(y, target, known)
    for j, n in enumerate(size):
        assert got[:n, j] == pytest.approx(smoothing.smoothed_to(y[:n, j], target[j], known[:n, j])[0], abs=1e-8)


@pytest.mark.parametrize("block", [3, 1000])
def test_pair_moments_are_those_of_all_pairs(spark, block):
    """However the particles fall into cells and blocks, and however many are alike; ends of a bin belong where floor(r / width) puts them."""
    from motes.operators import spatial

    rng = random.Random(6)
    places = [(float(rng.randrange(-60, 60)), float(rng.randrange(0, 30)), rng.choice([0.0, 1.1, 2.7])) for _ in range(25)]
    rows = [(f"e{f % 2}", f, p, p % 2, *rng.choice(places)) for f in range(3) for p in range(40)]
    rows = [(*r[:6], math.cos(r[6]), math.sin(r[6])) for r in rows]
    df = spark.createDataFrame([*rows, ("e0", 0, 99, 1, None, 1.0, 1.0, 0.0)], "exp string, frame int, particle long, kind int, x double, y double, ux double, uy double")
    want: dict = {}
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[2] < b[2]:
                r = math.sqrt((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2)
                if r < 25:
                    want.setdefault((a[0], a[3] == b[3], r // 5), []).append(a[6] * b[6] + a[7] * b[7])
    got = spatial.merged_moments(spatial.pair_moments(df, ["exp"], 5.0, 25.0, block), ["exp", "same", "bin"]).collect()
    assert len(got) == len(want)
    for r in got:
        c = want[r.exp, r.same, r.bin]
        mean = sum(c) / len(c)
        assert r.n == len(c) and r.mean == pytest.approx(mean, abs=1e-12) and r.m2 == pytest.approx(sum((x - mean) ** 2 for x in c), abs=1e-9)


def test_pairs_of_one_angle_have_no_spread(spark):
    """The spread of values that are alike is 0, not what rounding of their squares leaves."""
    from motes.operators import spatial

    rng = random.Random(7)
    df = spark.createDataFrame([("e", f, 0, rng.uniform(0, 90), rng.uniform(0, 90), math.cos(0.4) / 3, math.sin(0.4) / 3) for f in range(4) for _ in range(50)], "exp string, frame int, kind int, x double, y double, ux double, uy double")
    got = spatial.pair_correlation_bins(df, 10.0, 100.0).collect()
    assert got and all(r.mean == pytest.approx(1 / 9) and r.std < 1e-12 for r in got)


def made_by_joins(plan):
    """Rows that the joins of an executed plan have given."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return made_by_joins(plan.executedPlan())
    if "QueryStage" in name:
        return made_by_joins(plan.plan())
    below = [made_by_joins(plan.children().apply(i)) for i in range(plan.children().size())]
    return sum(below) + (plan.metrics().apply("numOutputRows").value() if "Join" in name else 0)


def test_no_row_for_a_pair(spark):
    """Sums over pairs come from blocks that meet: joins give no more rows than there are particles, about."""
    from motes.plans.registry import QUERIES

    df = QUERIES["g03_pair_bins"](spark, "/root/testdata/sf0.01")
    df.collect()
    assert 0 < made_by_joins(df._jdf.queryExecution().executedPlan()) < 16_000


def test_few_rows_with_many_pairs_go_to_many_tasks(spark):
    """The join of pairs has as many tasks as the session's shuffles, however few bytes its rows are."""
    from motes.operators import spatial

    df = spark.createDataFrame([("e", f, p, 0.0, 0.0) for f in range(40) for p in range(20)], "exp string, frame int, particle long, x double, y double")
    asked = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        for within in (None, 5.0):
            tasks = spatial.pairs(df, [], within).groupBy(F.spark_partition_id()).count().collect()
            assert len(tasks) > 7 and sum(r["count"] for r in tasks) == 40 * 190
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
