"""Models, ranks and p-values against plain numpy, enumeration and known values."""

from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from motes.functions import curves, pvalues
from motes.operators import association, distributions, fits, ranks, smoothing, spatial, states


def test_normal_law(spark):
    p = [1e-9, 1e-4, 0.02, 0.024251, 0.3, 0.5, 0.77, 0.99, 1 - 1e-7]
    got = spark.createDataFrame([(v,) for v in p], "p double").select(curves.normal_quantile(F.col("p")).alias("q"), curves.normal_cdf(curves.normal_quantile(F.col("p"))).alias("c")).collect()
    for v, r in zip(p, got):
        assert r.q == pytest.approx(NormalDist().inv_cdf(v), rel=2e-9, abs=1e-12) and r.c == pytest.approx(NormalDist().cdf(r.q), abs=1e-13)


def test_p_values(spark):
    # known values: two-sided tails of Student's law
    known = [(2.228138852, 10, 0.05), (12.70620474, 1, 0.05), (3.169272667, 10, 0.01), (1.959963985, 1e7, 0.05), (0.0, 5, 1.0), (2.570581836, 5.0, 0.05)]
    got = spark.createDataFrame([(t, float(n)) for t, n, _ in known], "t double, n double").select(pvalues.of_student(F.col("t"), F.col("n")).alias("p"), pvalues.of_normal(F.lit(1.959963985)).alias("z")).collect()
    assert [r.p for r in got] == pytest.approx([p for *_, p in known], rel=1e-6) and got[0].z == pytest.approx(0.05, rel=1e-7)
    df = spark.createDataFrame([(float(v), v % 2 == 0) for v in range(20)], "v double, first boolean")
    r = association.with_p(association.two_samples(df, "v", "first")).first()
    assert 0 < r.p_t < 1 and 0 < r.p_z < 1


def test_ranks_across_ranges(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 4000), "v": np.where(rng.random(4000) < 0.3, 7.0, rng.normal(0, 10, 4000)), "i": np.arange(4000)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, v double, i long")
    got = ranks.average_rank(df, "v", ["k"], "r").toPandas().sort_values("i")
    want = pdf.groupby(pdf.k.fillna("none")).v.rank()
    assert got.r.to_numpy() == pytest.approx(want.to_numpy())
    order = ranks.ranked(df, "v", ["k"], ["i"]).toPandas()
    for _, g in order.groupby(order.k.fillna("none")):
        g = g.sort_values(["v", "i"])
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and (g.total == len(g)).all()
    whole = ranks.ranked(df, "v", [], ["i"]).toPandas().sort_values(["v", "i"])
    assert whole["rank"].tolist() == list(range(1, 4001))
    c = pdf.groupby("v").size().rename("n").reset_index()
    run = ranks.running(spark.createDataFrame(c), "v", [], "n", "up", "all").toPandas().sort_values("v")
    assert run.up.tolist() == c.sort_values("v").n.cumsum().tolist() and (run["all"] == 4000).all()


MODEL = {"pi": np.array([0.6, 0.4]), "a": np.array([[0.8, 0.2], [0.3, 0.7]]), "mean": np.array([0.0, 2.0]), "var": np.array([1.0, 0.5])}


def enumerated(x):
    """Probability of every path of a short sequence."""
    b = np.exp(-0.5 * (x[:, None] - MODEL["mean"]) ** 2 / MODEL["var"]) / np.sqrt(2 * np.pi * MODEL["var"])
    return {p: MODEL["pi"][p[0]] * b[0, p[0]] * np.prod([MODEL["a"][p[t - 1], p[t]] * b[t, p[t]] for t in range(1, len(x))]) for p in product((0, 1), repeat=len(x))}


def test_hidden_markov_by_enumeration(spark):
    rng = np.random.default_rng(4)
    xs = {k: rng.normal(1, 1.2, n) for k, n in enumerate((1, 2, 5, 8))}
    rows = [("c", "e", k, 0, f, float(v)) for k, x in xs.items() for f, v in enumerate(x)]
    obs = spark.createDataFrame(rows, "condition string, exp string, particle long, segment long, frame int, obs double")
    got = states.decode(obs, MODEL).toPandas()
    for k, x in xs.items():
        paths = enumerated(x)
        g = got[got.particle == k].sort_values("frame")
        best = max(paths, key=paths.get)
        total = sum(paths.values())
        assert tuple(g.state) == best
        for t, (s, post) in enumerate(zip(g.state, g.posterior)):
            assert post == pytest.approx(sum(v for p, v in paths.items() if p[t] == s) / total, rel=1e-6)
        alone = pd.DataFrame({"x": [x], "enter": [None], "follow": [None]})
        assert np.log(states._posterior(alone, MODEL)[4]).sum() == pytest.approx(np.log(total), rel=1e-9)
    fit = states.fit_hmm(obs, 2, 6, 0.0)
    assert all(b >= a - 1e-9 for a, b in zip(fit["likelihoods"], fit["likelihoods"][1:])) and (np.diff(fit["mean"]) >= 0).all()


def test_chunks_of_a_sequence_join_to_the_whole(spark):
    rng = np.random.default_rng(14)
    rows, level = [], 0
    for k, n in enumerate((1, 6, 7, 8, 90, 333)):
        for f in range(n):
            level = 1 - level if rng.random() < 0.1 else level
            rows.append(("c", "e", k, f // 200, 3 + f, float(rng.normal(2 * level, 0.8))))
    obs = spark.createDataFrame(rows, "condition string, exp string, particle long, segment long, frame int, obs double").repartition(5)
    whole, cut = (states.fit_hmm(obs, 2, 4, 0.0, frames) for frames in (10**6, 7))
    for name in ("pi", "a", "mean", "var", "likelihoods"):
        assert np.allclose(whole[name], cut[name], rtol=1e-9, atol=1e-9), name
    a, b = (states.decode(obs, MODEL, frames).toPandas().sort_values(["particle", "segment", "frame"], ignore_index=True) for frames in (10**6, 7))
    assert len(a) == len(rows) and (a.state == b.state).all() and np.allclose(a.posterior, b.posterior, atol=1e-9) and (a.obs == b.obs).all()


def test_glitches_by_repeated_rule(spark):
    def plain(s, least):
        s = list(s)
        while True:
            edges = [0, *[i for i in range(1, len(s)) if s[i] != s[i - 1]], len(s)]
            for a, b in zip(edges[1:-2], edges[2:-1]):
                if b - a < least and s[a - 1] == s[b]:
                    s[a:b] = [s[b]] * (b - a)
                    break
            else:
                return s

    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 2, rng.integers(1, 30)).tolist() for _ in range(40)]
    df = spark.createDataFrame([("e", k, f, int(v)) for k, s in enumerate(seqs) for f, v in enumerate(s)], "exp string, particle long, frame int, state int")
    got = states.without_glitches(df, ["exp", "particle"], 3).toPandas().sort_values("frame")
    for k, s in enumerate(seqs):
        assert got[got.particle == k].state.tolist() == plain(s, 3)


def test_smoother_is_the_least_squares_path():
    rng = np.random.default_rng(6)
    t, noise, power = np.array([0.0, 1.0, 1.5, 3.0, 3.2, 5.0]), 0.3, 0.7
    z = rng.normal(0, 2, len(t))
    got, error = smoothing._rts(t, z, noise, power)
    # the smoothed path minimises squared residuals over start, measurements and steps
    n = len(t)
    rows, right = [], []

    def add(block, value, cov):
        w = np.linalg.inv(np.linalg.cholesky(cov))
        rows.append(w @ block)
        right.append(w @ value)

    unit = np.eye(2 * n)
    add(unit[:2], np.array([z[0], (z[1] - z[0]) / (t[1] - t[0])]), np.diag([noise**2, noise**2 + 1.0]))
    for k in range(n):
        add(unit[2 * k : 2 * k + 1], z[k : k + 1], np.array([[noise**2]]))
        if k:
            h = t[k] - t[k - 1]
            step = np.array([[1, h], [0, 1.0]])
            add(unit[2 * k : 2 * k + 2] - step @ unit[2 * k - 2 : 2 * k], np.zeros(2), power * np.array([[h**3 / 3, h * h / 2], [h * h / 2, h]]))
    a, b = np.concatenate(rows), np.concatenate(right)
    path = np.linalg.lstsq(a, b, rcond=None)[0]
    assert got == pytest.approx(path[1::2], rel=1e-6, abs=1e-8) and error == pytest.approx(np.sqrt(np.diag(np.linalg.inv(a.T @ a))[1::2]), rel=1e-6)


@pytest.mark.parametrize(("model", "p"), [("exponential", [3, 4]), ("offset_exponential", [2, 3, 0.5]), ("gaussian", [2, 5]), ("active_msd", [1.5, 4, 0.2]), ("double_exponential", [2, 1, 1, 9]), ("relaxation", [3, 4, 1]), ("caged_msd", [4, 3, 0.1]), ("run_tumble_msd", [2, 0.3, 0.1]), ("quenching", [3, 0.4]), ("line", [2, 1])])
def test_curves_are_recovered(spark, model, p):
    x = np.linspace(0.5, 20, 40)
    y = fits.MODELS[model][1](x, np.array(p, float))
    got, rss = fits.levenberg(x, y, np.ones(len(x)), model)
    assert rss < 1e-10 * (y**2).sum() and sorted(np.abs(got)) == pytest.approx(sorted(p), rel=1e-3)


def test_lognormal_values_fit_the_normal_law(spark):
    q = [float(np.exp(1 + 0.5 * NormalDist().inv_cdf((i - 0.3175) / (2000 + 0.365)))) for i in range(1, 2001)]
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(q)], "condition string, particle long, x double")
    r = distributions.normal_qq(df, "x", ["condition"], ["particle"]).first()
    assert r.slope == pytest.approx(0.5, rel=2e-3) and r.intercept == pytest.approx(1, rel=1e-3) and r.r2 > 0.999 and r.ks < 0.01


def test_local_lengths(spark):
    """Uniform flow does not decay, so it has no length; stripes of opposite flow have one about as wide as a stripe."""
    rows = [("u", 0, x, y, 1.0, 0.0) for x in range(24) for y in range(24)] + [("s", 0, x, y, 1.0 if (x // 6) % 2 == 0 else -1.0, 0.0) for x in range(24) for y in range(24)]
    field = spark.createDataFrame(rows, "exp string, frame int, px int, py int, u double, v double")
    got = spatial.local_length_map(field, 4, 5).toPandas()
    assert set(got.exp) == {"s"} and got.xi.between(1, 12).all() and len(got) > 10
    assert spatial.local_length_map(field.where("false"), 4, 5).count() == 0


def test_farthest_cell_without_all_pairs(spark):
    field = spark.createDataFrame([("e", 0, x, y) for x in range(40) for y in range(40)] + [("none", 0, 1, 1)], "exp string, frame int, px int, py int")
    points = spark.createDataFrame([("e", 0, 3.0, 3.0), ("e", 0, 5.0, 30.0)], "exp string, frame int, x double, y double")
    got = spatial.farthest_cell(field, points).collect()
    best = max(((min((x - a) ** 2 + (y - b) ** 2 for a, b in ((3, 3), (5, 30))), -x, -y) for x in range(40) for y in range(40)))
    assert [(r.exp, r.px, r.py) for r in got] == [("e", -best[1], -best[2])] and got[0].distance == pytest.approx(best[0] ** 0.5)
