"""Lag statistics of trajectories.

Pairs of rows a bounded lag apart come from one window: the next max_lag rows as an array that is exploded. For frame lags that
suffices too, since rows at most max_lag frames apart are at most max_lag rows apart; so no lag statistic needs a self-join, and the first aggregate by particle
keeps the window's partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import heading
from .kinematics import KEY, segments, track, unwrapped
from .ranks import quantiles, with_quantiles

#: Parts of a lag whose largest values are found on their own first.
PARTS = 64


def lagged(df: DataFrame, columns: list[str], max_lag: int, by: str = "row", extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows paired with later ones of their track (and extra keys): lag, and each column of the later row with suffix _2."""
    w = Window.partitionBy(*KEY, *extra).orderBy("frame")
    cols = list(dict.fromkeys(["frame", *columns]))
    ahead = F.array(*[F.struct(F.lit(k).alias("k"), F.lead(F.struct(*cols), k).over(w).alias("s")) for k in range(1, max_lag + 1)])
    out = df.withColumn("_a", ahead).withColumn("_p", F.explode(F.filter("_a", lambda p: p["s"].isNotNull()))).drop("_a")
    lag = F.col("_p.k") if by == "row" else F.col("_p.s.frame") - F.col("frame")
    out = out.withColumn("lag", lag).withColumns({f"{c}_2": F.col(f"_p.s.{c}") for c in cols}).drop("_p")
    return out.where((F.col("lag") > 0) & (F.col("lag") <= max_lag))


def _square() -> Column:
    return (F.col("x_2") - F.col("x")) ** 2 + (F.col("y_2") - F.col("y")) ** 2


def imsd(tracks: DataFrame, max_lag: int, by: str = "row", scale: float = 1.0) -> DataFrame:
    """Time-averaged MSD of each particle and lag: msd (full square), msd_axis_mean (half of it), n."""
    return lagged(tracks, ["x", "y"], max_lag, by).groupBy("condition", *KEY, "lag").agg((F.avg(_square()) * scale**2).alias("msd"), (F.avg(_square()) * scale**2 / 2).alias("msd_axis_mean"), F.count("*").alias("n"))


def msd_from_first(tracks: DataFrame) -> DataFrame:
    """Square of the distance to the first point."""
    return tracks.withColumn("lag", F.row_number().over(track()) - 1).withColumn("msd", (F.col("x") - F.first("x").over(track())) ** 2 + (F.col("y") - F.first("y").over(track())) ** 2).where("lag > 0")


def ensemble(per_particle: DataFrame, value: str, keys: list[str], least: int = 1) -> DataFrame:
    """Mean, sem and n over particles of each key."""
    return per_particle.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n")).where(F.col("n") >= least)


def pooled(per_particle: DataFrame, value: str, keys: list[str], least: int = 1) -> DataFrame:
    """Mean, std, n and exact quantiles q10 q25 q50 q75 q90 over particles; bootstrapped adds the error and interval of the mean."""
    out = per_particle.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")).where(F.col("n") >= least)
    return with_quantiles(out, per_particle, value, keys, {f"q{p}": p / 100 for p in (10, 25, 50, 75, 90)})


def bootstrapped(stats: DataFrame, per_particle: DataFrame, value: str, keys: list[str], replicates: int) -> DataFrame:
    """Stats of pooled() with se, low and high (95 %) of the mean over resampled particles."""
    from .resample import bootstrap_mean

    return stats.join(bootstrap_mean(per_particle, value, ["particle"], keys, replicates), keys)


def at_lag(per_particle: DataFrame, value: str, target: int, tolerance: int) -> DataFrame:
    """Each particle's value at the lag nearest the target, if within the tolerance."""
    near = per_particle.where(F.abs(F.col("lag") - target) <= tolerance)
    return near.groupBy("condition", *KEY).agg(F.min_by(value, F.struct(F.abs(F.col("lag") - target), F.col("lag"))).alias(value))


def alpha(per_particle: DataFrame, value: str = "msd", low: float = 1, high: float = 300) -> DataFrame:
    """Slope of log10(value) on log10(lag) over [low, high], over all lags if that has fewer than 3, null if still fewer."""
    ok = F.col(value) > 0
    a, b = F.log10(F.when(ok, F.col(value))), F.log10(F.col("lag").cast("double"))
    inside = ok & F.col("lag").between(low, high)
    fit = lambda c: F.regr_slope(F.when(c, a), F.when(c, b))
    out = per_particle.groupBy("condition", *KEY).agg(F.count(F.when(inside, 1)).alias("_i"), F.count(F.when(ok, 1)).alias("_n"), fit(inside).alias("_a"), fit(ok).alias("_b"), F.max("lag").alias("longest"))
    return out.withColumn("alpha", F.when(F.col("_i") >= 3, F.col("_a")).when(F.col("_n") >= 3, F.col("_b"))).drop("_i", "_n", "_a", "_b")


def by_alpha(tracks: DataFrame, max_lag: int, least: float) -> DataFrame:
    """tracks whose exponent exceeds a limit; undefined ones go."""
    return tracks.join(alpha(imsd(tracks, max_lag)).where(F.col("alpha") > least), KEY, "left_semi")


def slope_summary(per_particle: DataFrame, low: float, high: float, longest: int) -> DataFrame:
    """Exponents over a range of lags, of particles with long tracks, summarised by condition."""
    return pooled(alpha(per_particle, "msd", low, high).where((F.col("longest") >= longest) & F.col("alpha").isNotNull()), "alpha", ["condition"])


def local_exponent(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Log-log slope between neighbours of a curve, at their geometric mean: x_mid, exponent."""
    w = Window.partitionBy(*keys).orderBy(x)
    nx, ny = F.lead(x).over(w), F.lead(y).over(w)
    ok = (F.col(y) > 0) & (ny > 0) & (F.col(x) > 0)
    return curve.withColumns({"x_mid": F.when(ok, F.sqrt(F.col(x) * nx)), "exponent": F.when(ok, F.log(ny / F.col(y)) / F.log(nx / F.col(x)))}).where("exponent is not null")


def ergodicity_breaking(per_particle: DataFrame, value: str = "msd", least: int = 2) -> DataFrame:
    """EB = var / mean^2 over particles for each lag, with error EB sqrt(2 / (n - 1))."""
    out = per_particle.groupBy("condition", "lag").agg(F.try_divide(F.var_samp(value), F.avg(value) ** 2).alias("eb"), F.count("*").alias("n")).where(F.col("n") >= least)
    return out.withColumn("eb_error", F.col("eb") * F.sqrt(2 / (F.col("n") - 1)))


def ngp(df: DataFrame, r2: Column, keys: list[str], factor: float = 0.5, least: int = 4) -> DataFrame:
    """Non-Gaussian parameter factor <r^4> / <r^2>^2 - 1 of groups with enough displacements."""
    return df.withColumn("_r", r2).groupBy(*keys).agg((factor * F.try_divide(F.avg(F.col("_r") ** 2), F.avg("_r") ** 2) - 1).alias("ngp"), F.count("*").alias("n")).where(F.col("n") >= least)


def excess(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(m4 - 3 m2^2) / m2^2 with moments about 0."""
    m2, m4 = F.avg(F.col(column) ** 2), F.avg(F.col(column) ** 4)
    return df.groupBy(*keys).agg(F.try_divide(m4 - 3 * m2 * m2, m2 * m2).alias("excess"))


def resultant_length(tracks: DataFrame, max_lag: int, axial: bool = False) -> DataFrame:
    """Mean resultant length of unit displacements (of doubled angles if axial) per particle, then over particles."""
    p = lagged(tracks, ["x", "y"], max_lag).withColumn("_r", F.sqrt(_square())).where("_r > 0")
    u, v = (F.col("x_2") - F.col("x")) / F.col("_r"), (F.col("y_2") - F.col("y")) / F.col("_r")
    c, s = (u * u - v * v, 2 * u * v) if axial else (u, v)
    return ensemble(p.groupBy("condition", *KEY, "lag").agg(F.hypot(F.avg(c), F.avg(s)).alias("length")), "length", ["condition", "lag"])


def skewness(tracks: DataFrame, max_lag: int) -> DataFrame:
    """Bias-corrected skewness of dx and dy per particle (3 displacements at least, not all equal), mean over particles."""
    p = lagged(tracks, ["x", "y"], max_lag)
    n = F.count("*")
    fix = F.sqrt(n * (n - 1)) / (n - 2)
    own = lambda c: F.when((n > 2) & (F.var_pop(c) > 1e-20), F.skewness(c) * F.when(n > 2, fix))
    per = p.withColumns({"dx": F.col("x_2") - F.col("x"), "dy": F.col("y_2") - F.col("y")}).groupBy(*KEY, "lag").agg(own("dx").alias("sx"), own("dy").alias("sy"))
    return per.groupBy("lag").agg(F.avg("sx").alias("skew_x"), F.avg("sy").alias("skew_y"))


def evolution(tracks: DataFrame, max_lag: int, keys: list[str]) -> DataFrame:
    """Mean, population std, sem, median and msd of |displacement| for each lag."""
    p = lagged(tracks, ["x", "y"], max_lag).withColumn("r", F.sqrt(_square()))
    return p.groupBy(*keys, "lag").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), (F.stddev_pop("r") / F.sqrt(F.count("*"))).alias("sem"), F.percentile("r", 0.5).alias("median"), F.avg(_square()).alias("msd"), F.count("*").alias("n"))


def autocorrelation(df: DataFrame, a: list[str], max_lag: int, by: str = "frame", normalise: bool = True, keys: tuple[str, ...] = ("condition",), extra: tuple[str, ...] = ()) -> DataFrame:
    """Sum over the columns a of value(t) value(t + lag): mean per particle, mean and sem over particles, divided by lag 0.

    The columns are the mode: (vx, vy) velocity, (cos theta, sin theta) orientation or angles, |v| speed, and deviations for fluctuations.
    """
    known = df.dropna(subset=a)
    zero = known.withColumn("lag", F.lit(0)).withColumns({f"{c}_2": F.col(c) for c in a})
    later = lagged(known, a, max_lag, by, extra)
    cols = [*dict.fromkeys([*keys, *KEY]), "lag", *a, *[f"{c}_2" for c in a]]
    dot = sum((F.col(c) * F.col(f"{c}_2") for c in a[1:]), F.col(a[0]) * F.col(f"{a[0]}_2"))
    per = zero.select(cols).unionByName(later.select(cols)).groupBy(*dict.fromkeys([*keys, *KEY]), "lag").agg(F.avg(dot).alias("c"))
    out = ensemble(per, "c", [*keys, "lag"])
    if normalise:
        first = F.max(F.when(F.col("lag") == 0, F.col("mean"))).over(Window.partitionBy(*keys))
        out = out.withColumn("_0", first).withColumns({"mean": F.try_divide("mean", "_0"), "sem": F.try_divide("sem", F.abs("_0"))}).drop("_0")
    return out


def irregular_autocorrelation(df: DataFrame, value: str, time: str, max_lag: float, least: int, rows_ahead: int) -> DataFrame:
    """Pairs of a particle at most max_lag of time apart, by rounded time difference: raw, over C(0), and with mean removed over the variance.

    rows_ahead bounds how many rows can lie within max_lag.
    """
    p = lagged(df, [value, time], rows_ahead).withColumn("dt", F.round(F.col(f"{time}_2") - F.col(time), 3)).where((F.col("dt") <= max_lag) & (F.col("dt") > 0))
    whole = df.groupBy("condition").agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_s"), F.avg(F.col(value) ** 2).alias("_0"))
    c = p.groupBy("condition", "dt").agg(F.avg(F.col(value) * F.col(f"{value}_2")).alias("raw"), F.count("*").alias("n")).where(F.col("n") >= least)
    return c.join(whole, "condition").withColumns({"normalised": F.try_divide("raw", "_0"), "centred": F.try_divide(F.col("raw") - F.col("_m") ** 2, "_s")}).drop("_m", "_s", "_0")


def field_autocorrelation(field: DataFrame, max_lag: int, period: int | None = None) -> DataFrame:
    """Mean over pixels and times of u(t) . u(t + lag), lag 0 included; frames are matched exactly, and modulo the period if there is one (then as a circular convolution)."""
    if period is not None:
        later = field.select("exp", "px", "py", "frame", F.col("u").alias("_u"), F.col("v").alias("_v"))
        asked = field.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(max_lag)))).withColumn("frame", F.pmod(F.col("frame") + F.col("lag"), F.lit(period)))
        pairs = asked.join(later, ["exp", "px", "py", "frame"])
        return pairs.groupBy("exp", "lag").agg(F.avg(F.col("u") * F.col("_u") + F.col("v") * F.col("_v")).alias("c"), F.count("*").alias("n"))
    w = Window.partitionBy("exp", "px", "py").orderBy("frame")
    ahead = F.array(*[F.lead(F.struct("frame", "u", "v"), k).over(w) if k else F.struct("frame", "u", "v") for k in range(max_lag + 1)])
    p = field.withColumn("_a", ahead).withColumn("_p", F.explode(F.filter("_a", lambda s: s.isNotNull()))).drop("_a").withColumn("lag", F.col("_p.frame") - F.col("frame")).where(F.col("lag") <= max_lag)
    return p.groupBy("exp", "lag").agg((F.sum(F.col("u") * F.col("_p.u") + F.col("v") * F.col("_p.v")) / F.count("*")).alias("c"), F.count("*").alias("n"))


def msad(tracks: DataFrame, max_lag: int, least: int = 3) -> DataFrame:
    """Mean squared change of the unwrapped heading per lag inside contiguous segments of at least 3 headings."""
    seg = segments(tracks)
    w = Window.partitionBy(*KEY, "segment").orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    headed = seg.withColumns({"_dx": dx, "_dy": dy}).where("_dx is not null and (_dx <> 0 or _dy <> 0)").withColumn("heading", heading("_dy", "_dx"))
    n = F.count("*").over(Window.partitionBy(*KEY, "segment"))
    smooth = unwrapped(headed.withColumn("_n", n).where(F.col("_n") >= least), "heading", ("segment",))
    p = lagged(smooth, ["heading_unwrapped"], max_lag, "row", ("segment",))
    return p.groupBy("condition", *KEY, "lag").agg(F.avg((F.col("heading_unwrapped_2") - F.col("heading_unwrapped")) ** 2).alias("msad"), F.count("*").alias("n"))


def linear_fit(curve: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """y = 2 D x + C: diffusion D and offset C."""
    return curve.groupBy(*keys).agg((F.regr_slope(y, x) / 2).alias("diffusion"), F.regr_intercept(y, x).alias("offset"), F.count("*").alias("n"))


def state_islands(tracks: DataFrame, state: str = "state") -> DataFrame:
    """Rows in islands of contiguous frames and constant state, and once more in islands of contiguous frames as state -1."""
    own = segments(tracks, F.col(state) != F.lag(state).over(track()))
    return own.unionByName(segments(tracks).withColumn(state, F.lit(-1)))


def state_msd(tracks: DataFrame, max_lag: int, state: str = "state") -> DataFrame:
    """MSD by lag inside islands of one state, pooled over particles; -1 stands for all states."""
    p = lagged(state_islands(tracks, state), ["x", "y"], max_lag, "row", (state, "segment"))
    return p.groupBy("condition", state, "lag").agg(F.avg(_square()).alias("msd"), F.count("*").alias("n"))


def state_autocorrelation(df: DataFrame, columns: list[str], max_lag: int, state: str = "state") -> DataFrame:
    """Autocorrelation inside islands of one state, over that state's mean square."""
    isl = state_islands(df.dropna(subset=columns), state)
    p = lagged(isl, columns, max_lag, "row", (state, "segment"))
    dot = lambda s: sum((F.col(c) * F.col(c + s) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0] + s))
    zero = isl.groupBy("condition", state).agg(F.avg(dot("")).alias("_0"))
    return p.groupBy("condition", state, "lag").agg(F.avg(dot("_2")).alias("_c"), F.count("*").alias("n")).join(zero, ["condition", state]).withColumn("c", F.try_divide("_c", "_0")).drop("_c", "_0")


def green_kubo(curve: DataFrame, keys: list[str], dt: float = 1.0, x: str = "lag", c: str = "mean") -> DataFrame:
    """Half the trapezoid integral of c, whole, up to its first zero crossing (interpolated), and its running maximum and median."""
    w = Window.partitionBy(*keys).orderBy(x)
    before, at = F.lag(c).over(w), F.lag(x).over(w)
    out = curve.withColumns({"_b": before, "_x": at}).withColumn("_area", F.coalesce((F.col(c) + F.col("_b")) / 2 * (F.col(x) - F.col("_x")) * dt, F.lit(0.0)))
    running = F.sum("_area").over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min(F.when(F.col(c) < 0, F.col(x))).over(Window.partitionBy(*keys))
    out = out.withColumns({"_run": running, "_first": first})
    to_zero = F.when(F.col(x) == F.col("_first"), F.col("_run") - F.col("_area") + F.col("_b") ** 2 / (F.col("_b") - F.col(c)) / 2 * (F.col(x) - F.col("_x")) * dt)
    agg = out.withColumn("_zero", to_zero).groupBy(*keys).agg((F.max_by("_run", x) / 2).alias("whole"), (F.coalesce(F.max("_zero"), F.max_by("_run", x)) / 2).alias("to_zero"), (F.max("_run") / 2).alias("peak"), (F.percentile("_run", 0.5) / 2).alias("median"))
    return agg


def crossing_lag(curve: DataFrame, keys: list[str], value: str, target: float) -> DataFrame:
    """Lag at which a rising curve first reaches the target, log-log interpolated, extrapolated from the end pair if it never does."""
    w = Window.partitionBy(*keys).orderBy("lag")
    rows = curve.withColumns({"_x": F.lag("lag").over(w), "_y": F.lag(value).over(w), "_last": F.max("lag").over(Window.partitionBy(*keys))}).where("_y is not null")
    pick = F.when(F.col(value) >= target, F.col("lag"))
    rows = rows.withColumn("_hit", F.min(pick).over(Window.partitionBy(*keys))).where(F.col("lag") == F.coalesce("_hit", "_last"))
    slope = F.log(F.col(value) / F.col("_y")) / F.log(F.col("lag") / F.col("_x"))
    return rows.where(F.col(value) != F.col("_y")).select(*keys, (F.col("_x") * F.exp(F.log(F.lit(target) / F.col("_y")) / slope)).alias("lag_at_target"))


def increment_autocorrelation(tracks: DataFrame, column: str, max_lag: int) -> DataFrame:
    """Autocorrelation of a track's increments, centred, biased normalisation."""
    d = tracks.withColumn("_d", F.col(column) - F.lag(column).over(track())).where("_d is not null")
    d = d.withColumn("_c", F.col("_d") - F.avg("_d").over(Window.partitionBy(*KEY)))
    total = d.groupBy(*KEY).agg(F.sum(F.col("_c") ** 2).alias("_t"))
    return lagged(d, ["_c"], max_lag).groupBy(*KEY, "lag").agg(F.sum(F.col("_c") * F.col("_c_2")).alias("_s")).join(total, KEY).select(*KEY, "lag", F.try_divide("_s", "_t").alias("c"))


def gap_bias(tracks: DataFrame, max_lag: int) -> DataFrame:
    """Pooled MSD by row lag over that by frame lag, for each lag."""
    pool = lambda by, name: lagged(tracks, ["x", "y"], max_lag, by).groupBy("lag").agg(F.avg(_square()).alias(name))
    return pool("row", "by_row").join(pool("frame", "by_frame"), "lag").withColumn("bias", F.try_divide("by_row", "by_frame"))


def transport_efficiency(per_particle: DataFrame, speed: float) -> DataFrame:
    """sqrt(msd) / (speed lag) of the ensemble, and mean and median over particles."""
    rows = per_particle.withColumn("_eta", F.sqrt("msd") / (speed * F.col("lag")))
    out = rows.groupBy("condition", "lag").agg((F.sqrt(F.avg("msd")) / (speed * F.first("lag"))).alias("eta"), F.avg("_eta").alias("eta_mean"), F.count("*").alias("n"))
    return with_quantiles(out, rows, "_eta", ["condition", "lag"], {"eta_median": 0.5})


def domain_reach(at: DataFrame, reach: DataFrame, cond: DataFrame, xi: float) -> DataFrame:
    """sqrt(msd) over the radius, 90th percentile of displacements over xi, with the mean's error carried on."""
    m = at.groupBy("condition").agg(F.avg("msd").alias("_m"), (F.stddev_samp("msd") / F.sqrt(F.count("*"))).alias("_e"))
    out = m.join(reach, "condition").join(cond, "condition")
    return out.withColumns({"crossing": F.sqrt("_m") / F.col("radius_um"), "crossing_error": F.col("_e") / (2 * F.sqrt("_m")) / F.col("radius_um"), "reach": F.col("r90") / xi})


def pool_health(per_particle: DataFrame, value: str = "msd", least: int = 10, limit: float = 5.0) -> DataFrame:
    """Per lag the numbers of particles, of values not positive, of outliers by robust z of log10 (median, 1.4826 MAD), and the top three's share."""
    from ..sources.io import stashed

    logs = stashed(per_particle.select("lag", *KEY, value).withColumn("_l", F.when(F.col(value) > 0, F.log10(value))), "pool")  # read by each quantile
    med = quantiles(logs, "_l", ["lag"], {"_m": 0.5})
    dev = logs.join(med, "lag").withColumn("_d", F.abs(F.col("_l") - F.col("_m")))
    mad = quantiles(dev, "_d", ["lag"], {"_d": 0.5}).select("lag", (1.4826 * F.col("_d")).alias("_mad"))
    # the three largest values of each part of a lag, then of the lag: a top-k limit that tasks apply before the shuffle
    part = F.pmod(F.xxhash64(*KEY), F.lit(PARTS))
    best = lambda df, *by: df.withColumn("_rank", F.row_number().over(Window.partitionBy("lag", *by).orderBy(F.desc(value), *KEY))).where("_rank <= 3").drop("_rank")
    top = best(best(logs.withColumn("_part", part), "_part"))
    top = top.groupBy("lag").agg(F.sum(value).alias("_top"))
    out = dev.join(mad, "lag", "left").join(top, "lag", "left")
    return out.groupBy("lag").agg(F.count("*").alias("n"), F.count(F.when(F.col(value) <= 0, 1)).alias("not_positive"), F.count(F.when(F.try_divide("_d", "_mad") > limit, 1)).alias("outliers"), (F.first("_top") / F.sum(value)).alias("top3")).where(F.col("n") >= least)
