"""Queries composed of the other operators: joins of field and track statistics, and summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import distributions as dist
from . import resample as res
from .kinematics import KEY


def summary(df: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Mean, sem and n of several columns per key."""
    cols = [c for v in values for c in (F.avg(v).alias(v), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{v}_sem"))]
    return df.groupBy(*keys).agg(*cols, F.count("*").alias("n"))


def experiment_records(tables: list[DataFrame], condition: DataFrame) -> DataFrame:
    """Per-experiment tables joined on exp (missing ones stay null), with the condition."""
    out = condition
    for t in tables:
        out = out.join(t, "exp", "left")
    return out


def two_level(df: DataFrame, value: str, unit: list[str], keys: list[str], least: int = 1) -> DataFrame:
    """Mean of units with enough rows, then mean, sem and n of units."""
    u = df.groupBy(*keys, *unit).agg(F.avg(value).alias("_m"), F.count(value).alias("_n")).where(F.col("_n") >= least)
    return u.groupBy(*keys).agg(F.avg("_m").alias("mean"), (F.stddev_samp("_m") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))


def order_and_displacement(order: DataFrame, displacement: DataFrame, stride: int) -> DataFrame:
    """Order near each particle with its displacement from the same frame on, every stride-th frame."""
    return order.where(F.col("frame") % stride == 0).join(displacement, [*KEY, "frame"])


def even_odd_moments(hist: DataFrame, keys: list[str], centre: str, density: str) -> DataFrame:
    """Two estimates of a tilt from the even and odd parts of a cosine histogram: k1 slope through the origin of atanh(odd / even) on c, k2 the slope on c^2 of ln even."""
    eo = dist.even_odd(hist, centre, density, keys).where(F.col(centre) > 0)
    t = F.try_divide("odd", "even")
    c = F.col(centre)
    a = F.when(F.abs(t) < 1, F.atanh(t))
    return eo.groupBy(*keys).agg(F.try_divide(F.sum(a * c), F.sum(F.when(a.isNotNull(), c * c))).alias("k1"), F.regr_slope(F.when(F.col("even") > 0, F.log("even")), c * c).alias("k2"))


def length_and_speed(lengths: DataFrame, speeds: DataFrame) -> DataFrame:
    """The correlation length around a particle in a frame beside its speed there."""
    return lengths.select("exp", "frame", "particle", "xi").join(speeds.where("v is not null").select("condition", "exp", "frame", "particle", "v"), ["exp", "frame", "particle"])


def persistence_time(orientation: DataFrame, keys: list[str]) -> DataFrame:
    """Of an orientation correlation by lag (lag, c; c(0) = 1) the integral to its first zero, by straight lines: tau."""
    w = Window.partitionBy(*keys).orderBy("lag")
    c = orientation.withColumns({"_c": F.coalesce(F.lag("c").over(w), F.lit(1.0)), "_l": F.coalesce(F.lag("lag").over(w), F.lit(0))})
    c = c.withColumn("_over", F.coalesce(F.max((F.col("c") <= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_over = 0")
    width = F.col("lag") - F.col("_l")
    part = F.when(F.col("c") > 0, (F.col("c") + F.col("_c")) / 2 * width).otherwise(F.col("_c") / 2 * width * F.col("_c") / (F.col("_c") - F.col("c") + 1e-12))
    return c.groupBy(*keys).agg(F.sum(part).alias("tau")).where("tau > 0")


def persistence_and_length(taus: DataFrame, lengths: DataFrame, radius: Column) -> DataFrame:
    """A particle's persistence time beside the correlation length around it and its radius over that."""
    return taus.join(lengths.where("xi > 0.05"), KEY).withColumn("x", radius / F.col("xi"))


def augmented(points: DataFrame, flow: DataFrame, lags: list[int]) -> DataFrame:
    """Points (with heading theta) with the flow's (u, v) around them and, for each frame lag, the turn of the heading over exactly that lag, its square and
    1 - cos of it, and the change of that turn over the next lag. New columns end in the lag; where a frame is missing they are null."""
    from ..functions.angles import wrap_closed

    out = points.join(flow.select(*KEY, "frame", "u", "v"), [*KEY, "frame"], "left")
    for k in lags:
        later = lambda df, c: df.select(*KEY, (F.col("frame") - k).alias("frame"), F.col(c).alias("_n"))  # noqa: E731, B023
        out = out.join(later(out, "theta"), [*KEY, "frame"], "left").withColumn(f"turn_{k}", wrap_closed(F.col("_n") - F.col("theta"))).drop("_n")
        out = out.join(later(out, f"turn_{k}"), [*KEY, "frame"], "left").withColumn(f"change_{k}", wrap_closed(F.col("_n") - F.col(f"turn_{k}"))).drop("_n")
        out = out.withColumns({f"square_{k}": F.col(f"turn_{k}") ** 2, f"dispersion_{k}": 1 - F.cos(f"turn_{k}")})
    return out


def residuals(df: DataFrame, x: str, y: str, key: str, z: float) -> DataFrame:
    """P10: linear fit per key, residuals with |z| up to a limit: mean, std, skewness (population), excess kurtosis, n."""
    f = df.groupBy(key).agg(F.regr_slope(y, x).alias("_s"), F.regr_intercept(y, x).alias("_i"))
    r = df.join(f, key).withColumn("_e", F.col(y) - F.col("_i") - F.col("_s") * F.col(x))
    r = r.withColumn("_z", F.try_divide(F.col("_e") - F.avg("_e").over(Window.partitionBy(key)), F.stddev_samp("_e").over(Window.partitionBy(key)))).where(F.abs("_z") <= z)
    return r.groupBy(key).agg(F.avg("_e").alias("mean"), F.stddev_samp("_e").alias("std"), F.skewness("_e").alias("skew"), F.kurtosis("_e").alias("kurtosis"), F.count("*").alias("n"))


def length_definitions(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation length as the first crossing of 1/e (interpolated) and as the trapezoid integral over c at the first point."""
    w = Window.partitionBy(*keys).orderBy("r")
    c = curve.withColumns({"_r": F.lag("r").over(w), "_c": F.lag("c").over(w), "_0": F.first("c").over(w)})
    e = F.col("_0") * F.exp(F.lit(-1.0))
    hit = F.when((F.col("c") < e) & (F.col("_c") >= e), F.col("_r") + (F.col("_c") - e) / (F.col("_c") - F.col("c")) * (F.col("r") - F.col("_r")))
    area = (F.col("c") + F.col("_c")) / 2 * (F.col("r") - F.col("_r"))
    return c.groupBy(*keys).agg(F.min(hit).alias("xi_e"), F.try_divide(F.sum(area), F.first("_0")).alias("xi_integral"))


def run_tumble_diffusion(base: DataFrame, rates: DataFrame, speeds: DataFrame, times: DataFrame, d0: float) -> DataFrame:
    """D = D0 + f v^2 tau / 2 per condition from joined summaries; missing parts count as no activity."""
    j = base.join(rates, "condition", "left").join(speeds, "condition", "left").join(times, "condition", "left")
    return j.withColumn("diffusion", F.lit(d0) + F.coalesce(F.col("f") * F.col("v") ** 2 * F.col("tau") / 2, F.lit(0.0)))


def follower(df: DataFrame) -> DataFrame:
    """Particle speed over the ring's mean flow and over its mean scalar speed, per condition: ratios of means."""
    return df.groupBy("condition").agg(F.try_divide(F.avg(F.hypot("vx", "vy")), F.avg(F.hypot("mu", "mv"))).alias("over_flow"), F.try_divide(F.avg(F.hypot("vx", "vy")), F.avg("speed")).alias("over_speed"), F.count("*").alias("n"))


def movie_table(df: DataFrame, observed: str, xi: DataFrame, radius: Column, model) -> DataFrame:
    """Observed order per movie against the model at R / xi, residual, rows; then weigh by rows."""
    m = df.groupBy("condition", "exp").agg(F.avg(observed).alias("observed"), F.count("*").alias("n")).join(xi, "exp").withColumn("x", radius / F.col("xi"))
    return m.withColumn("predicted", model(F.col("x"))).withColumn("residual", F.col("observed") - F.col("predicted"))


def size_table(movies: DataFrame) -> DataFrame:
    """Row-weighted means of a movie table by condition."""
    w = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    return movies.groupBy("condition").agg(w("observed").alias("observed"), w("predicted").alias("predicted"), w("residual").alias("residual"), F.sum("n").alias("n"))


def histogram_interval(df: DataFrame, bin_: Column, n_bins: int, unit: list[str], n: int) -> DataFrame:
    """P20: density share per bin with a cluster bootstrap interval over units, and the potential -ln p."""
    u = df.withColumn("bin", bin_).where("bin is not null").groupBy(*unit, "bin").agg(F.count("*").alias("_n"))
    whole = u.groupBy("bin").agg(F.sum("_n").alias("_c")).withColumn("p", F.col("_c") / F.sum("_c").over(Window.partitionBy())).drop("_c")
    reps = res.replicates(u, n, unit).groupBy("b", "bin").agg(F.sum(F.col("w") * F.col("_n")).alias("_c"))
    reps = reps.withColumn("v", F.col("_c") / F.sum("_c").over(Window.partitionBy("b")))
    return whole.join(res.interval(reps, "v", ["bin"]), "bin").withColumn("potential", F.when(F.col("p") > 0, -F.log("p")))


def _shapes(counts: DataFrame, n_bins: int) -> DataFrame:
    """counts (keys, an array _c of counts by bin) with arrays over bins: c (centres), p, even, odd, potential."""
    width = 2 / n_bins
    at = F.array(*[F.lit(-1 + (i + 0.5) * width) for i in range(n_bins)])
    total = F.aggregate("_c", F.lit(0.0), lambda a, x: a + x)
    d = counts.withColumn("c", at).withColumn("p", F.transform("_c", lambda x: F.try_divide(x, total * width)))
    half = lambda sign: F.zip_with("p", F.reverse("p"), lambda x, y: (x + sign * y) / 2)
    zero = F.get("p", (n_bins - 1) // 2)  # the bin nearest 0, the lower one of two
    potential = F.zip_with("p", "c", lambda p, c: F.when((p > 0) & (zero > 0), -F.log(F.sqrt(F.greatest(1 - c * c, F.lit(1e-6))) * p / zero)))
    return d.withColumns({"even": half(1), "odd": half(-1), "potential": potential})


def _shape_fits(shapes: DataFrame, keys: list[str]) -> DataFrame:
    """polar and nematic: A and kappa of U(c) = -A arctanh(c) + 2 kappa c^2, from the ratio of odd to even parts, then from the even part, over 0.05 < c <= 0.85."""
    each = shapes.select(*keys, F.explode(F.arrays_zip("c", "even", "odd")).alias("_e")).select(*keys, "_e.*").where("c > 0.05 and c <= 0.85 and even > 1e-4")
    ratio = F.atanh(F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col("odd") / F.col("even"))))
    polar = each.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.sum(ratio * F.atanh("c")) / F.sum(F.atanh("c") ** 2)).alias("polar"), F.count("*").alias("_m")).where("_m >= 2").drop("_m")
    y = F.log(F.greatest(F.sqrt(1 - F.col("c") ** 2) * F.col("even") / F.cosh(F.col("polar") * F.atanh("c")), F.lit(1e-6)))
    return each.join(polar, keys).groupBy(*keys, "polar").agg(F.greatest(F.lit(0.0), -F.regr_slope(y, F.col("c") ** 2) / 2).alias("nematic"))


def shape_replicates(df: DataFrame, cosine: str, unit: list[str], keys: list[str], n_bins: int = 28, n: int = 100, seed: int = 0) -> DataFrame:
    """P20: shapes of the histogram of a cosine, of all rows (b 0) and of each replicate b in which units (trajectories) are drawn anew: keys, b, and arrays over bins.

    Rows are first counted by unit and bin, so a replicate weighs counts; all bins of a replicate are one row.
    """
    bin_ = F.least(F.floor((F.col(cosine) + 1) * (n_bins / 2)), F.lit(n_bins - 1))
    u = df.where(F.col(cosine).between(-1, 1)).groupBy(*keys, *unit, bin_.alias("_bin")).agg(F.count("*").alias("_n"))
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("_bin") == i, F.col("w") * F.col("_n"))), F.lit(0)).cast("double") for i in range(n_bins)]).alias("_c")
    every = u.withColumns({"b": F.lit(0), "w": F.lit(1)}).unionByName(res.replicates(u, n, unit, seed))
    return _shapes(every.groupBy(*keys, "b").agg(counts), n_bins)


def shape_table(replicates: DataFrame, keys: list[str]) -> DataFrame:
    """P20: by bin the density p, its even and odd parts and the effective potential -ln(sqrt(1 - c^2) p / p(0)), each with the low and high end of its interval."""
    names = ["p", "even", "odd", "potential"]
    each = replicates.select(*keys, "b", F.posexplode(F.arrays_zip("c", *names)).alias("bin", "_e")).select(*keys, "b", "bin", "_e.*")
    out = each.where("b = 0").drop("b")
    for name in names:
        ends = res.interval(each.where("b > 0"), name, [*keys, "bin"]).select(*keys, "bin", F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
        out = out.join(ends, [*keys, "bin"], "left")
    return out


def shape_fit(replicates: DataFrame, keys: list[str]) -> DataFrame:
    """P20: polar and nematic strength of the shape, fitted to all rows and to each replicate, with errors and intervals over the replicates."""
    fits = _shape_fits(replicates, [*keys, "b"])
    out = fits.where("b = 0").drop("b")
    for name in ("polar", "nematic"):
        spread = res.interval(fits.where("b > 0"), name, keys)
        spread = spread.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("se", "low", "high")])
        out = out.join(spread, keys, "left") if keys else out.crossJoin(spread)  # single rows
    return out


def alignment_moments(df: DataFrame, value: str) -> DataFrame:
    """Per particle mean, std, and central moments 2, 3, 5 from power sums, then mean and sem over particles per condition."""
    s = [F.avg(F.col(value) ** k).alias(f"_{k}") for k in range(1, 6)]
    p = df.groupBy("condition", *KEY).agg(*s)
    m = F.col("_1")
    p = p.withColumns({"mean": m, "c2": F.col("_2") - m**2, "c3": F.col("_3") - 3 * m * F.col("_2") + 2 * m**3, "c5": F.col("_5") - 5 * m * F.col("_4") + 10 * m**2 * F.col("_3") - 10 * m**3 * F.col("_2") + 4 * m**5})
    return summary(p, ["mean", "c2", "c3", "c5"], ["condition"])
