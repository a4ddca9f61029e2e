"""Closed-form curve fits as grouped aggregates, and a grouped-map job for the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import counted, running, with_quantiles


#: Ranks of a block of values over which power_tail bounds distances.
BLOCK = 256


def correlation_length(curve: DataFrame, keys: list[str], r: str = "r", c: str = "c", least: float = 0.01) -> DataFrame:
    """Xi from ln c = ln a - r / xi, from the curve's peak on, c >= least, at least 3 points, slope < -1e-6."""
    peak = curve.groupBy(*keys).agg(F.max_by(r, F.struct(c, -F.col(r))).alias("_p"))
    rows = curve.join(peak, keys).where((F.col(r) >= F.col("_p")) & (F.col(c) >= least))
    fit = rows.groupBy(*keys).agg(F.regr_slope(F.log(c), F.col(r)).alias("_s"), F.regr_intercept(F.log(c), F.col(r)).alias("_i"), F.count("*").alias("n")).where("n >= 3 and _s < -1e-6")
    return fit.select(*keys, (-1 / F.col("_s")).alias("xi"), F.exp("_i").alias("a"), "n")


def weighted_line(df: DataFrame, x: Column, y: Column, w: Column, keys: list[str]) -> DataFrame:
    """Line by least squares with weights on residuals: slope, intercept, slope_error (scaled by chi2 / (n - 2)), n."""
    d = df.withColumns({"_x": x, "_y": y, "_w": w * w}).dropna(subset=["_x", "_y", "_w"])
    s = lambda e: F.sum(F.col("_w") * e)
    m = d.groupBy(*keys).agg(s(F.lit(1.0)).alias("_0"), s(F.col("_x")).alias("_1"), s(F.col("_y")).alias("_y1"), s(F.col("_x") ** 2).alias("_2"), s(F.col("_x") * F.col("_y")).alias("_xy"), s(F.col("_y") ** 2).alias("_yy"), F.count("*").alias("n"))
    m = m.withColumn("_d", F.col("_0") * F.col("_2") - F.col("_1") ** 2).where("_d > 0")
    m = m.withColumns({"slope": (F.col("_0") * F.col("_xy") - F.col("_1") * F.col("_y1")) / F.col("_d"), "intercept": (F.col("_2") * F.col("_y1") - F.col("_1") * F.col("_xy")) / F.col("_d")})
    rss = F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy") - F.col("intercept") * F.col("_y1"), F.lit(0.0))
    return m.withColumn("slope_error", F.when(F.col("n") > 2, F.sqrt(rss / F.when(F.col("n") > 2, F.col("n") - 2) * F.col("_0") / F.col("_d")))).select(*keys, "slope", "intercept", "slope_error", "n")


def weighted_length(curve: DataFrame, keys: list[str], least: float = 0.01, gaussian: bool = False) -> DataFrame:
    """As X01 with weights c / sem: xi and its error; gaussian fits ln c = ln a - (r / xi)^2."""
    x = F.col("r") ** 2 if gaussian else F.col("r")
    f = weighted_line(curve.where((F.col("c") >= least) & (F.col("sem") > 0)), x, F.log("c"), F.col("c") / F.col("sem"), keys).where("slope < -1e-6 and n >= 3")
    if gaussian:
        return f.select(*keys, (1 / F.sqrt(-F.col("slope"))).alias("xi"), (F.col("slope_error") / 2 * F.pow(-F.col("slope"), F.lit(-1.5))).alias("xi_error"), "n")
    return f.select(*keys, (-1 / F.col("slope")).alias("xi"), (F.col("slope_error") / F.col("slope") ** 2).alias("xi_error"), "n")


def until_drop(curve: DataFrame, keys: list[str], ratio: float = 0.36787944117144233) -> DataFrame:
    """The curve up to its first point below ratio times its peak after the peak, at least its first three points from the peak on."""
    w = Window.partitionBy(*keys)
    p = curve.withColumns({"_m": F.max("c").over(w), "_p": F.max_by("r", F.struct("c", -F.col("r"))).over(w)}).where(F.col("r") >= F.col("_p"))
    p = p.withColumn("_i", F.row_number().over(w.orderBy("r")))
    end = F.min(F.when(F.col("c") < ratio * F.col("_m"), F.col("_i"))).over(w)
    return p.withColumn("_e", end).where(F.col("_e").isNull() | (F.col("_i") <= F.greatest("_e", F.lit(3)))).drop("_m", "_p", "_i", "_e")


def power_law(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """y = A x^-p in logs: exponent p, amplitude A, r2, n."""
    d = df.where((F.col(x) > 0) & (F.col(y) > 0))
    a, b = F.log(y), F.log(x)
    return d.groupBy(*keys).agg((-F.regr_slope(a, b)).alias("exponent"), F.exp(F.regr_intercept(a, b)).alias("amplitude"), F.regr_r2(a, b).alias("r2"), F.count("*").alias("n"))


def exponential_pdf(pdf: DataFrame, x: str, p: str, w: Column, keys: list[str], low: float, high: float) -> DataFrame:
    """Decay length of a density in log space over [low, high]."""
    f = weighted_line(pdf.where((F.col(p) > 0) & F.col(x).between(low, high)), F.col(x), F.log(p), w, keys).where("slope < 0")
    return f.select(*keys, (-1 / F.col("slope")).alias("length"), (F.col("slope_error") / F.col("slope") ** 2).alias("length_error"), "n")


def exponential_ccdf(c: DataFrame, durations: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Tau from ln S = -t / tau through the origin with weights sqrt(S n), else the mean: c has x, ccdf."""
    n = durations.where(F.col(value) > 0).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("_m"))
    w2 = F.col("ccdf") * F.col("n")
    f = c.join(n, keys).groupBy(*keys).agg(F.try_divide(F.sum(w2 * F.col("x") * F.log("ccdf")), F.sum(w2 * F.col("x") ** 2)).alias("_s"), F.first("_m").alias("_m"), F.first("n").alias("n"))
    return f.select(*keys, F.when(F.col("_s") < 0, -1 / F.when(F.col("_s") < 0, F.col("_s"))).otherwise(F.col("_m")).alias("tau"), "n")


def power_tail(df: DataFrame, x: str, keys: list[str], least: int = 15, last: int = 5, candidates: int = 250) -> DataFrame:
    """Power-law tail of positive values: x_max, the largest value that `last` rows reach; of evenly ranked candidates for x_min, from the
    lowest 15 % on and with `least` ranks below x_max, the one with the smallest Kolmogorov-Smirnov distance, exponent by maximum likelihood; then slope
    and r2 of log10 P(X >= x) on log10 x in between (every row at its own rank).

    Equal values are one row with their count; ranks, and sums of n and ln x above each value, are running sums, so a candidate's exponent is a lookup. The
    distance needs values times candidates, so only the values that can hold a candidate's maximum are measured: the law's and the ranks' values
    both rise, and inside a block of neighbouring values their difference stays below that of the block's ends taken crosswise. A block is opened for a
    candidate only if that bound reaches what the block ends of the candidate already show.
    """
    from ..sources.io import stashed

    pos = df.where(F.col(x) > 0).select(*keys, F.col(x).cast("double").alias("_x"))
    # _lo and _hi: ranks from 0 of the first and last row of each value
    c = counted(pos, "_x", keys).withColumns({"_lo": F.col("_up") - F.col("_n"), "_hi": F.col("_up") - 1, "_l": F.col("_n") * F.log("_x")}).withColumn("_n", F.col("_all")).drop("_up", "_all")
    rows = stashed(c, "values")
    c = stashed(running(rows, "_x", keys, "_l", "_lup", "_lall").where(F.col("_n") >= least + last), "sums")
    end = c.where((F.col("_lo") <= F.col("_n") - last) & (F.col("_n") - last <= F.col("_hi"))).select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(keys)], F.col("_x").alias("x_max"), F.col("_hi").alias("_end"), F.col("_lup").alias("_lend"))
    same = [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(keys)]
    c = c.join(end, same).where(F.col("_x") <= F.col("x_max")).drop(*[f"_e{i}" for i in range(len(keys))])
    stop = F.col("_n") - last - least
    start = F.when(F.floor(F.col("_n") * 0.15) < stop, F.floor(F.col("_n") * 0.15)).otherwise(F.greatest(F.lit(0), stop - 30))
    count = F.least(F.lit(candidates), stop - start + 1)
    span = stop - start
    # candidate ranks are start + floor(k span / (count - 1)); a value is one if such a rank lies in [_lo, _hi]: the first k that reaches _lo
    of = lambda k: start + F.floor(k * span / F.greatest(count - 1, F.lit(1)))
    k = F.greatest(F.ceil((F.col("_lo") - start) * F.greatest(count - 1, F.lit(1)) / F.greatest(span, F.lit(1))), F.lit(0))
    holds = F.lit(False)
    for near in (k - 1, k, k + 1):  # neighbours too, so that rounding of the quotient does not matter
        holds = holds | (near.between(0, count - 1) & of(near).between(F.col("_lo"), F.col("_hi")))
    n = F.col("_end") - F.col("_lo") + 1
    logs = F.col("_lend") - F.col("_lup") + F.col("_l") - n * F.log("_x")
    chosen = c.where(holds & (n >= least)).withColumns({"_m": n, "_a": F.try_divide(n, F.when(logs > 0, logs))}).where("_a is not null")
    cand = stashed(chosen.select(*keys, F.col("_x").alias("x_min"), "x_max", F.col("_lo").alias("_from"), "_m", "_a"), "candidates")
    tail = c.select(*keys, "_x", "_lo", "_hi").withColumn("_block", F.floor(F.col("_lo") / BLOCK))
    blocks = tail.groupBy(*keys, "_block").agg(F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_lo").alias("_lo0"), F.max("_lo").alias("_lo1"), F.min("_hi").alias("_hi0"), F.max("_hi").alias("_hi1"))
    law = lambda v: 1 - F.pow(F.col("x_min") / v, F.col("_a"))
    share = lambda i: (F.col(i) - F.col("_from") + 1) / F.col("_m")
    gap = lambda v, lo, hi: F.greatest(F.abs(share(lo) - law(F.col(v))), F.abs(share(hi) - law(F.col(v))))
    # a block that begins below x_min is always opened
    inside = F.col("_x0") >= F.col("x_min")
    most = F.when(inside, F.greatest(share("_hi1") - law(F.col("_x0")), law(F.col("_x1")) - share("_lo0"))).otherwise(2.0)
    shown = F.when(inside, F.greatest(gap("_x0", "_lo0", "_hi0"), gap("_x1", "_lo1", "_hi1")))
    pairs = blocks.join(cand, keys).where(F.col("_x1") >= F.col("x_min")).withColumns({"_most": most, "_shown": shown})
    pairs = pairs.withColumn("_least", F.coalesce(F.max("_shown").over(Window.partitionBy(*keys, "x_min")), F.lit(0.0))).where(F.col("_most") >= F.col("_least") * (1 - 1e-9))
    opened = pairs.select(*keys, "_block", "x_min", "x_max", "_a", "_m", "_from")
    measured = tail.join(opened, [*keys, "_block"]).where(F.col("_x") >= F.col("x_min")).withColumn("_d", gap("_x", "_lo", "_hi"))
    best = measured.groupBy(*keys, "x_min", "x_max", "_a", "_m", "_from").agg(F.max("_d").alias("distance")).groupBy(*keys).agg(F.min_by(F.struct("x_min", "x_max", "distance", (F.col("_a") + 1).alias("exponent"), F.col("_m").alias("n")), F.struct("distance", "x_min")).alias("_b")).select(*keys, "_b.*")
    # every row at its own rank
    fit = rows.join(best, keys).where(F.col("_x").between(F.col("x_min"), F.col("x_max"))).select(*keys, "_x", "_n", F.explode(F.sequence("_lo", "_hi")).alias("_i"))
    fit = fit.withColumns({"_u": F.log10("_x"), "_v": F.log10((F.col("_n") - F.col("_i")) / F.col("_n"))})
    line = fit.groupBy(*keys).agg(F.regr_slope("_v", "_u").alias("slope"), F.regr_r2("_v", "_u").alias("r2"))
    return best.join(line, keys)


def von_mises(stats: DataFrame) -> DataFrame:
    """Mean angle and concentration kappa from circular statistics with r, by Best and Fisher's pieces."""
    r = F.col("r")
    k = F.when(r < 0.53, 2 * r + r**3 + 5 * r**5 / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(F.try_divide(F.lit(1.0), r**3 - 4 * r**2 + 3 * r))
    return stats.withColumn("kappa", k)


def ols(df: DataFrame, x: str, y: str, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Slope, intercept, their standard errors, r2, AIC and leave-one-out RMSE, from sums and hat values joined back."""
    d = df.dropna(subset=[x, y])
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("_mx"), F.regr_sxx(y, x).alias("_sxx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")).where("n > 2 and _sxx > 0")
    e = d.join(s, keys).withColumns({"_e": F.col(y) - F.col("intercept") - F.col("slope") * F.col(x), "_h": 1 / F.col("n") + (F.col(x) - F.col("_mx")) ** 2 / F.col("_sxx")})
    g = e.groupBy(*keys).agg(F.sum(F.col("_e") ** 2).alias("_rss"), F.sqrt(F.avg(F.try_divide(F.col("_e"), 1 - F.col("_h")) ** 2)).alias("loo_rmse"))
    out = s.join(g, keys).withColumn("_v", F.col("_rss") / (F.col("n") - 2))
    return out.select(*keys, "slope", "intercept", F.sqrt(F.col("_v") / F.col("_sxx")).alias("slope_error"), F.sqrt(F.col("_v") * (1 / F.col("n") + F.col("_mx") ** 2 / F.col("_sxx"))).alias("intercept_error"), "r2", (F.col("n") * F.log(F.col("_rss") / F.col("n")) + 4).alias("aic"), "loo_rmse", "n")


def weighted_design(df: DataFrame, y: str, u: str, columns: list[str]) -> list[float]:
    """X11: beta of y = u (beta0 + sum beta_i x_i): the Gram matrix is one aggregate, a system of a few numbers is solved on the driver."""
    cols = [F.col(u), *[F.col(u) * F.col(c) for c in columns]]
    n = len(cols)
    got = df.agg(*[F.sum(cols[i] * cols[j]) for i in range(n) for j in range(n)], *[F.sum(c * F.col(y)) for c in cols]).first()
    return np.linalg.lstsq(np.array(got[: n * n], float).reshape(n, n), np.array(got[n * n :], float), rcond=None)[0].tolist()


def inverse_variance_mean(df: DataFrame, x: str, error: str, keys: list[str]) -> DataFrame:
    """Weighted mean and its error."""
    w = 1 / F.col(error) ** 2
    return df.where(F.col(error) > 0).groupBy(*keys).agg((F.sum(F.col(x) * w) / F.sum(w)).alias("mean"), (1 / F.sqrt(F.sum(w))).alias("error"), F.count("*").alias("n"))


def retention(df: DataFrame, keys: list[str], time: str, depth: str, error: str) -> DataFrame:
    """R = D(t_max) / D(0), its error, and a lower bound of the relaxation time, t_max / -ln(R - error), null if R - error leaves (0, 1)."""
    g = df.groupBy(*keys).agg(F.min_by(F.struct(depth, error), time).alias("_a"), F.max_by(F.struct(depth, error), time).alias("_b"), F.max(time).alias("_t"))
    a, b, ea, eb = F.col(f"_a.{depth}"), F.col(f"_b.{depth}"), F.col(f"_a.{error}"), F.col(f"_b.{error}")
    r = F.try_divide(b, a)
    out = g.withColumns({"retention": r, "error": F.abs(r) * F.sqrt(F.try_divide(ea, a) ** 2 + F.try_divide(eb, b) ** 2)})
    low = F.col("retention") - F.col("error")
    return out.withColumn("tau_low", F.when((low > 0) & (low < 1), F.col("_t") / -F.log(F.when(low > 0, low)))).drop("_a", "_b", "_t")


def selection_bias(df: DataFrame, v: str, u: str, limit: float, keys: list[str]) -> DataFrame:
    """Median of v / u where |u| exceeds the limit, against sum(v u) / sum(u u)."""
    over = df.where(F.abs(F.col(u)) > limit).withColumn("_ratio", F.col(v) / F.col(u))
    return with_quantiles(df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(v) * F.col(u)), F.sum(F.col(u) ** 2)).alias("regression")), over, "_ratio", keys, {"median_ratio": 0.5})


#: Models of X16: start values from the data (sorted by x), and the curve: decays, with offset, of two times, from a first to a last value; mean-squared
#: displacements of persistent, caged and run-and-tumble motion with diffusion; quenching; a line.
MODELS = {
    "exponential": (lambda x, y: [y.max(), max(x.mean(), 1e-9)], lambda x, p: p[0] * np.exp(-x / p[1])),
    "offset_exponential": (lambda x, y: [y.max() - y.min(), max(x.mean(), 1e-9), y.min()], lambda x, p: p[0] * np.exp(-x / p[1]) + p[2]),
    "gaussian": (lambda x, y: [y.max(), max(x.std(), 1e-9)], lambda x, p: p[0] * np.exp(-0.5 * (x / p[1]) ** 2)),
    "active_msd": (lambda x, y: [max(y.max(), 1e-9) ** 0.5 / max(x.max(), 1e-9), max(x.mean(), 1e-9), 0.0], lambda x, p: 2 * p[0] ** 2 * p[1] * (x - p[1] * (1 - np.exp(-x / p[1]))) + 4 * p[2] * x),
    "double_exponential": (lambda x, y: [y.max() / 2, max(x.mean() / 4, 1e-9), y.max() / 2, max(2 * x.mean(), 1e-9)], lambda x, p: p[0] * np.exp(-x / p[1]) + p[2] * np.exp(-x / p[3])),
    "relaxation": (lambda x, y: [y[0], max(x.mean(), 1e-9), y[-1]], lambda x, p: p[2] + (p[0] - p[2]) * np.exp(-x / p[1])),
    "caged_msd": (lambda x, y: [max(y.max(), 1e-9), max(x.mean(), 1e-9), 0.0], lambda x, p: p[0] * (1 - np.exp(-x / p[1])) + 4 * p[2] * x),
    "run_tumble_msd": (lambda x, y: [max(y.max(), 1e-9) ** 0.5 / max(x.max(), 1e-9), max(1 / x.mean(), 1e-9), 0.0], lambda x, p: 2 * (p[0] / p[1]) ** 2 * (p[1] * x - 1 + np.exp(-p[1] * x)) + 4 * p[2] * x),
    "quenching": (lambda x, y: [y.max(), max(1 / x.mean(), 1e-9)], lambda x, p: p[0] / (1 + p[1] * x)),
    "line": (lambda x, y: [0.0, y.mean()], lambda x, p: p[0] * x + p[1]),
}


def levenberg(x: np.ndarray, y: np.ndarray, w: np.ndarray, model: str, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Damped least squares with a numerical Jacobian: parameters and weighted residual sum."""
    start, f = MODELS[model]
    p = np.array(start(x, y), float)
    cost = lambda q: float((((y - f(x, q)) * w) ** 2).sum())
    damping, now = 1e-3, cost(p)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            h = 1e-6 * np.maximum(np.abs(p), 1e-3)
            jac = np.stack([(f(x, p + h[i] * (np.arange(len(p)) == i)) - f(x, p)) / h[i] for i in range(len(p))], 1) * w[:, None]
            if not np.isfinite(jac).all():
                break
            a, g = jac.T @ jac, jac.T @ ((y - f(x, p)) * w)
            step = np.linalg.lstsq(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), g, rcond=None)[0]
            new = cost(p + step)
            if np.isfinite(new) and new < now:
                small = now - new < 1e-12 * max(now, 1e-300)
                p, now, damping = p + step, new, max(damping / 5, 1e-12)
                if small:
                    break
            else:
                damping *= 4
                if damping > 1e12:
                    break
    return p, now


def curve_fits(curves: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Every curve (rows x, y, sigma or null) against every model: parameters, rss, aicc and rank by AICc.

    A curve is bounded by its number of lags or bins; curves and models spread over tasks.
    """
    asked = curves.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    schema = ", ".join(f"{k} {dict(curves.dtypes)[k]}" for k in keys) + ", model string, parameters array<double>, rss double, aicc double, n long"

    def run(group, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf.x) & np.isfinite(pdf.y)].sort_values(["x", "y"])
        x, y, model = pdf.x.to_numpy(float), pdf.y.to_numpy(float), group[-1]
        w = 1 / pdf.sigma.where(pdf.sigma > 0, 1.0).fillna(1.0).to_numpy(float) if "sigma" in pdf else np.ones(len(x))
        k = len(MODELS[model][0](np.ones(1), np.ones(1)))
        if len(x) < k + 2:
            return pd.DataFrame([(*group, [], np.nan, np.nan, len(x))], columns=[*keys, "model", "parameters", "rss", "aicc", "n"])
        p, rss = levenberg(x, y, w, model)
        aicc = len(x) * np.log(max(rss, 1e-300) / len(x)) + 2 * k + 2 * k * (k + 1) / (len(x) - k - 1)
        return pd.DataFrame([(*group, p.tolist(), rss, aicc, len(x))], columns=[*keys, "model", "parameters", "rss", "aicc", "n"])

    got = asked.groupBy(*keys, "model").applyInPandas(run, schema)
    return got.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce(F.nanvl("aicc", F.lit(1e300)), F.lit(1e300)), "model")))


def scaled_curve(df: DataFrame, x: str, y: str, shape, grid: list[float], keys: list[str]) -> DataFrame:
    """y = v0 g(x / xi): for each xi of a grid v0 in closed form, then the xi with the smallest residual."""
    rows = df.withColumn("xi", F.explode(F.array(*[F.lit(float(v)) for v in grid]))).withColumn("_g", shape(F.col(x) / F.col("xi")))
    s = rows.groupBy(*keys, "xi").agg(F.sum(F.col(y) * F.col("_g")).alias("_yg"), F.sum(F.col("_g") ** 2).alias("_gg"), F.sum(F.col(y) ** 2).alias("_yy"))
    s = s.withColumns({"v0": F.try_divide("_yg", "_gg"), "rss": F.col("_yy") - F.coalesce(F.try_divide(F.col("_yg") ** 2, "_gg"), F.lit(0.0))})
    return s.groupBy(*keys).agg(F.min_by(F.struct("xi", "v0", "rss"), F.struct("rss", "xi")).alias("_b")).select(*keys, "_b.*")


def sign_change(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """First x at which y changes sign, by a straight line between neighbours."""
    w = Window.partitionBy(*keys).orderBy(x)
    rows = curve.withColumns({"_x": F.lag(x).over(w), "_y": F.lag(y).over(w)}).where(F.col("_y") * F.col(y) < 0)
    at = F.col("_x") - F.col("_y") * (F.col(x) - F.col("_x")) / (F.col(y) - F.col("_y"))
    return rows.groupBy(*keys).agg(F.min(at).alias("crossing"))


def hermite(curve: DataFrame, keys: list[str], x: str, y: str, at: list[float]) -> DataFrame:
    """Shape-preserving cubic through a curve at given points inside its range: slopes are weighted harmonic means of neighbours, 0 at extremes."""
    w = Window.partitionBy(*keys).orderBy(x)
    c = curve.withColumns({"_h": F.lead(x).over(w) - F.col(x), "_d": (F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x))})
    h0, d0 = F.lag("_h").over(w), F.lag("_d").over(w)
    a, b = 2 * F.col("_h") + h0, F.col("_h") + 2 * h0
    m = F.when(d0.isNull(), F.col("_d")).when(F.col("_d").isNull(), d0).when(d0 * F.col("_d") <= 0, 0.0).otherwise((a + b) / (a / F.when(d0 != 0, d0) + b / F.when(F.col("_d") != 0, F.col("_d"))))
    c = c.withColumn("_m", m).withColumns({"_y2": F.lead(y).over(w), "_m2": F.lead("_m").over(w)}).where("_h is not null")
    p = c.withColumn("at", F.explode(F.array(*[F.lit(float(v)) for v in at]))).where((F.col("at") >= F.col(x)) & (F.col("at") < F.col(x) + F.col("_h")))
    t = (F.col("at") - F.col(x)) / F.col("_h")
    value = (2 * t**3 - 3 * t**2 + 1) * F.col(y) + (t**3 - 2 * t**2 + t) * F.col("_h") * F.col("_m") + (-2 * t**3 + 3 * t**2) * F.col("_y2") + (t**3 - t**2) * F.col("_h") * F.col("_m2")
    return p.select(*keys, "at", value.alias("value"))
