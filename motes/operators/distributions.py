"""Distributions, binned profiles and summaries of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import filled, uniform
from .ranks import counted, quantiles, ranked, with_quantiles


def histogram(df: DataFrame, column: str, low: float, high: float, n: int, keys: list[str], edges: str = "last_closed", weight: Column | None = None) -> DataFrame:
    """Bin, count (or summed weight) and density of values per key, empty bins as zeros. edges as in functions.bins.uniform."""
    w = F.lit(1.0) if weight is None else weight
    got = df.withColumn("bin", uniform(F.col(column), low, high, n, edges)).where("bin is not null").groupBy(*keys, "bin").agg(F.sum(w).alias("count"))
    full = filled(got, keys, "bin", n, ["count"])
    total = F.sum("count").over(Window.partitionBy(*keys))
    return full.withColumn("density", F.try_divide("count", total * ((high - low) / n)))


def ensemble_histogram(df: DataFrame, column: str, low: float, high: float, n: int, least: int = 5) -> DataFrame:
    """One density per experiment with enough values, then mean, population std and sem over experiments, and the pooled density."""
    enough = df.where(F.col(column).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy("exp"))).where(F.col("_n") >= least)
    own = histogram(enough, column, low, high, n, ["condition", "exp"])
    both = own.groupBy("condition", "bin").agg(F.avg("density").alias("mean"), F.stddev_pop("density").alias("std"), (F.stddev_samp("density") / F.sqrt(F.count("*"))).alias("sem"), F.sum("count").alias("_c"), F.count("*").alias("n"))
    total = F.sum("_c").over(Window.partitionBy("condition"))
    return both.withColumn("pooled", F.try_divide("_c", total * ((high - low) / n))).drop("_c")


def ccdf(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """P(X >= x) at each distinct positive value, ties counted together."""
    count = counted(df.where(F.col(column) > 0).withColumn("x", F.col(column)), "x", keys)
    return count.withColumn("ccdf", (F.col("_all") - F.col("_up") + F.col("_n")) / F.col("_all")).drop("_n", "_up", "_all")


def reach(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Percentiles of 1 - CCDF (r1 r5 r10 r50 r90), mean, std, sem, n."""
    positive = df.where(F.col(column) > 0)
    out = positive.groupBy(*keys).agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), (F.stddev_samp(column) / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))
    return with_quantiles(out, positive, column, keys, {f"r{p}": p / 100 for p in (1, 5, 10, 50, 90)})


def log_thinned(curve: DataFrame, x: str, keys: list[str], points: int) -> DataFrame:
    """Of a rising curve the first point at or above each of so many log-spaced targets."""
    w = Window.partitionBy(*keys)
    k = (F.log(F.col(x)) - F.log(F.min(x).over(w))) / F.when(F.max(x).over(w) > F.min(x).over(w), (F.log(F.max(x).over(w)) - F.log(F.min(x).over(w))) / (points - 1))
    step = curve.withColumn("_k", F.floor(F.round(F.coalesce(k, F.lit(0.0)), 9)))
    before = F.lag("_k").over(w.orderBy(x))
    return step.withColumn("_b", before).where("_b is null or _k > _b").drop("_k", "_b")


def circular(df: DataFrame, angle: str, keys: list[str]) -> DataFrame:
    """mean_cos, mean_sin, resultant r, mean_angle, variance, circular std, mean |angle|, n."""
    out = df.where(F.col(angle).isNotNull()).groupBy(*keys).agg(F.avg(F.cos(angle)).alias("mean_cos"), F.avg(F.sin(angle)).alias("mean_sin"), F.avg(F.abs(angle)).alias("mean_abs"), F.count("*").alias("n"))
    r = F.hypot("mean_cos", "mean_sin")
    return out.withColumns({"r": r, "mean_angle": F.atan2("mean_sin", "mean_cos"), "variance": 1 - r, "std": F.sqrt(-2 * F.log(F.least(r, F.lit(1.0))))})


def axis_sums(field: DataFrame, theta: DataFrame, weight: Column) -> DataFrame:
    """Weighted sums of angles against the frame's axis: weight, cos, sin, cos 2, |angle|, aligned (within 30 degrees), anti-aligned."""
    d = field.join(theta, ["exp", "frame"]).withColumn("_d", F.atan2(F.sin(F.atan2("v", "u") - F.col("theta")), F.cos(F.atan2("v", "u") - F.col("theta")))).withColumn("_w", weight)
    w, a = F.col("_w"), F.col("_d")
    near = F.radians(F.lit(30.0))
    return d.groupBy("exp").agg(F.sum(w).alias("weight"), F.sum(w * F.cos(a)).alias("c1"), F.sum(w * F.sin(a)).alias("s1"), F.sum(w * F.cos(2 * a)).alias("c2"), F.sum(w * F.abs(a)).alias("abs"), F.sum(F.when(F.abs(a) < near, w).otherwise(0)).alias("aligned"), F.sum(F.when(F.abs(a) > F.lit(3.141592653589793) - near, w).otherwise(0)).alias("anti"))


def axis_sign(field: DataFrame, theta: DataFrame, margin: float = 0.05) -> DataFrame:
    """+1 or -1: the sign of the axis with the larger pooled <cos 2 delta>; + unless - leads by more than the margin. One row."""
    both = theta.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("theta", F.col("theta") * F.col("sign"))
    score = field.join(both, ["exp", "frame"]).groupBy("sign").agg(F.avg(F.cos(2 * (F.atan2("v", "u") - F.col("theta")))).alias("score"))
    plus, minus = (F.max(F.when(F.col("sign") == s, F.col("score"))) for s in (1, -1))
    return score.agg(plus.alias("plus"), minus.alias("minus")).withColumn("sign", F.when(F.col("minus") > F.col("plus") + margin, -1).otherwise(1))


def smoothed_circular(hist: DataFrame, value: str, keys: list[str], n: int, sigma: float) -> DataFrame:
    """Gaussian smoothing over bins with a periodic edge, kernel cut at 4 sigma."""
    import math

    half = min(int(4 * sigma + 0.5), n - 1)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-half, half + 1)]
    spread = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(w / sum(k)).alias("w")) for i, w in zip(range(-half, half + 1), k, strict=True)])
    out = hist.withColumn("_k", F.explode(spread)).withColumn("bin", F.pmod(F.col("bin") + F.col("_k.o"), F.lit(n)))
    return out.groupBy(*keys, "bin").agg(F.sum(F.col(value) * F.col("_k.w")).alias("smooth"))


def profile(df: DataFrame, bin_: Column, y: str, keys: list[str], least: int = 1) -> DataFrame:
    """Mean, std, sem, quartiles and n of y per bin."""
    rows = df.withColumn("bin", bin_).where("bin is not null")
    out = rows.groupBy(*keys, "bin").agg(F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), (F.stddev_samp(y) / F.sqrt(F.count(y))).alias("sem"), F.count(y).alias("n")).where(F.col("n") >= least)
    return with_quantiles(out, rows, y, [*keys, "bin"], {f"q{p}": p / 100 for p in (25, 50, 75)})


def two_level_profile(df: DataFrame, bin_: Column, y: str, least: int = 2) -> DataFrame:
    """Mean of y per experiment and bin with enough values, then mean, population std and n over experiments."""
    own = df.withColumn("bin", bin_).where("bin is not null").groupBy("condition", "exp", "bin").agg(F.avg(y).alias("_m"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    return own.groupBy("condition", "bin").agg(F.avg("_m").alias("mean"), F.stddev_pop("_m").alias("std"), F.count("*").alias("n"))


def ratio_profile(df: DataFrame, bin_: Column, y: str, least: int = 2) -> DataFrame:
    """As E12 after division by the experiment's mean."""
    m = F.avg(y).over(Window.partitionBy("exp"))
    return two_level_profile(df.withColumn("_r", F.try_divide(F.col(y), m)), bin_, "_r", least)


def forward_contrast(df: DataFrame, angle: str, speed: str, degrees: float = 20, least: int = 3) -> DataFrame:
    """(v_forward - v_reverse) / v_mean per experiment, then mean, sem and n; forward is within so many degrees of 0, reverse of 180."""
    a = F.degrees(F.abs(F.col(angle)))
    f, r = F.when(a <= degrees, F.col(speed)), F.when(a >= 180 - degrees, F.col(speed))
    own = df.groupBy("condition", "exp").agg(F.count(f).alias("_f"), F.count(r).alias("_r"), ((F.avg(f) - F.avg(r)) / F.avg(speed)).alias("_d")).where((F.col("_f") >= least) & (F.col("_r") >= least))
    return own.groupBy("condition").agg(F.avg("_d").alias("contrast"), (F.stddev_samp("_d") / F.sqrt(F.count("*"))).alias("sem"), F.count("*").alias("n"))


def joint_density(df: DataFrame, bx: Column, by: Column, keys: list[str]) -> DataFrame:
    """Share of a key's rows in each cell of two binnings."""
    got = df.withColumns({"xb": bx, "yb": by}).where("xb is not null and yb is not null").groupBy(*keys, "xb", "yb").agg(F.count("*").alias("n"))
    return got.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def percentile_profile(df: DataFrame, bin_: Column, y: str, keys: list[str], percents: list[int], least: int) -> DataFrame:
    """Percentiles of y per bin, one row each."""
    rows = df.withColumn("bin", bin_).where("bin is not null")
    got = with_quantiles(rows.groupBy(*keys, "bin").agg(F.count("*").alias("n")).where(F.col("n") >= least), rows, y, [*keys, "bin"], {f"_p{p}": p / 100 for p in percents})
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.col(f"_p{p}").alias("value")) for p in percents]))
    return got.select(*keys, "bin", "n", each.alias("_e")).select(*keys, "bin", "n", "_e.percent", "_e.value")


def quantile_bins(df: DataFrame, x: str, keys: list[str], n: int) -> DataFrame:
    """Rows with bin by equal-count edges of their key, equal edges merged; bins are left-closed, the last closed on both sides."""
    edges = [f"_e{i}" for i in range(n + 1)]
    e = quantiles(df, x, keys, {c: i / n for i, c in enumerate(edges)}).select(*keys, F.array_distinct(F.array(*edges)).alias("_e"))
    i = F.least(F.size(F.filter("_e", lambda v: v <= F.col(x))), F.size("_e") - 1) - 1
    return df.join(e, keys).withColumn("bin", F.greatest(i, F.lit(0))).drop("_e")


def bin_number(df: DataFrame, x: str, keys: list[str], rule: str = "fd") -> DataFrame:
    """Number of bins by Sturges or Freedman-Diaconis, and the range."""
    out = df.groupBy(*keys).agg(F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    out = with_quantiles(out, df, x, keys, {"_q1": 0.25, "_q3": 0.75})
    sturges = F.ceil(F.log2("n")) + 1
    width = 2 * (F.col("_q3") - F.col("_q1")) / F.cbrt("n")
    fd = F.coalesce(F.ceil(F.try_divide(F.col("high") - F.col("low"), width)), sturges)
    return out.withColumn("bins", sturges if rule == "sturges" else fd).drop("_q1", "_q3")


def log_bins(df: DataFrame, x: str, y: str, least: int, least_particles: int) -> DataFrame:
    """Per condition, Freedman-Diaconis bins of log10(x): median of y, geometric mean of x, numbers of rows and particles."""
    logs = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("_l", F.log10(x))
    b = bin_number(logs, "_l", ["condition"]).select("condition", "low", "high", "bins")
    i = F.least(F.floor((F.col("_l") - F.col("low")) / ((F.col("high") - F.col("low")) / F.col("bins"))), F.col("bins") - 1)
    got = logs.join(b, "condition").withColumn("bin", F.coalesce(F.when(F.col("high") > F.col("low"), i), F.lit(0)))
    out = got.groupBy("condition", "bin").agg(F.exp(F.avg(F.log(x))).alias("x_mean"), F.count("*").alias("n"), F.countDistinct("exp", "particle").alias("particles")).where((F.col("n") >= least) & (F.col("particles") >= least_particles))
    return with_quantiles(out, got, y, ["condition", "bin"], {"median": 0.5})


def merged_bins(df: DataFrame, bin_: Column, y: str, least: int) -> DataFrame:
    """Neighbouring bins of a condition are merged left to right until they hold `least` rows; a short tail joins the last: group, mean, n.

    Only per-bin counts meet in one array per condition; rows then look their bin's group up.
    """
    rows = df.withColumn("bin", bin_).where("bin is not null")
    counts = rows.groupBy("condition", "bin").agg(F.count("*").alias("n")).groupBy("condition").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("_b"))
    start = F.struct(F.lit(0).alias("g"), F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<bin:int,g:int>>").alias("out"))
    step = lambda a, b: F.struct(F.when(a["held"] + b["n"] >= least, a["g"] + 1).otherwise(a["g"]).alias("g"), F.when(a["held"] + b["n"] >= least, F.lit(0).cast("long")).otherwise(a["held"] + b["n"]).alias("held"), F.concat(a["out"], F.array(F.struct(b["bin"].cast("int").alias("bin"), a["g"].alias("g")))).alias("out"))
    done = counts.withColumn("_m", F.aggregate("_b", start, step))
    last = F.greatest(F.col("_m.g") - 1, F.lit(0))
    to = done.select("condition", last.alias("_last"), F.explode("_m.out").alias("_o")).select("condition", F.col("_o.bin").alias("bin"), F.least("_o.g", "_last").alias("group"))
    return rows.join(to, ["condition", "bin"]).groupBy("condition", "group").agg(F.avg(y).alias("mean"), F.count("*").alias("n"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))


def exceedance(df: DataFrame, bin_: Column, y: str, limits: list[float], least: int) -> DataFrame:
    """Per limit and bin: p = P(y > limit | bin), its binomial error, -ln p, odds p / P(y > limit), posterior P(bin | y > limit), their errors, mean of y above.

    The odds' error adds the relative errors of p and of P(y > limit); no binomial variance is taken below 1e-6.
    """
    rows = df.withColumn("bin", bin_).where("bin is not null").withColumn("limit", F.explode(F.array(*[F.lit(float(v)) for v in limits])))
    over = F.col(y) > F.col("limit")
    got = rows.groupBy("limit", "bin").agg(F.count("*").alias("n"), F.count(F.when(over, 1)).alias("k"), F.avg(F.when(over, F.col(y))).alias("mean_above"))
    w = Window.partitionBy("limit")
    got = got.withColumns({"_n": F.sum("n").over(w), "_k": F.sum("k").over(w)}).where(F.col("n") >= least).withColumn("p", F.col("k") / F.col("n"))
    got = got.withColumns({"error": F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), "potential": F.when(F.col("p") > 0, -F.log("p")), "odds": F.try_divide(F.col("p"), F.col("_k") / F.col("_n")), "posterior": F.try_divide("k", "_k")})
    binomial = lambda p, n: F.greatest(F.col(p) * (1 - F.col(p)), F.lit(1e-6)) / F.col(n)
    odds = F.col("odds") * F.sqrt(binomial("p", "n") / F.col("p") ** 2 + (1 - F.col("_k") / F.col("_n")) / F.col("_k"))
    return got.withColumns({"odds_error": F.when(F.col("odds") > 0, odds), "posterior_error": F.when(F.col("_k") > 0, F.sqrt(binomial("posterior", "_k")))}).drop("_n", "_k")


def kde(df: DataFrame, x: str, keys: list[str], low: float, high: float, points: int) -> DataFrame:
    """Gaussian kernel density on a grid, Silverman's bandwidth; the grid is a bounded array, so rows explode and combine before the shuffle."""
    s = df.groupBy(*keys).agg((F.stddev_samp(x) * F.pow(F.count(x) * 0.75, F.lit(-0.2))).alias("_h"), F.count(x).alias("_n"))
    grid = F.array(*[F.lit(low + (high - low) * i / (points - 1)) for i in range(points)])
    rows = df.join(s, keys).where("_h > 0").withColumn("at", F.explode(grid))
    k = F.exp(-0.5 * ((F.col("at") - F.col(x)) / F.col("_h")) ** 2) / (F.col("_n") * F.col("_h") * 2.5066282746310002)
    return rows.groupBy(*keys, "at").agg(F.sum(k).alias("density"))


def kde2(df: DataFrame, x: str, y: str, keys: list[str], limit: float, points: int) -> DataFrame:
    """2-D Gaussian kernel density with the sample covariance times n^(-1/3), effective potential -ln(P / Pmax)."""
    f = F.pow(F.count(x).cast("double"), F.lit(-1 / 3))
    s = df.groupBy(*keys).agg((F.var_samp(x) * f).alias("_a"), (F.var_samp(y) * f).alias("_c"), (F.covar_samp(x, y) * f).alias("_b"), F.count(x).alias("_n")).withColumn("_d", F.col("_a") * F.col("_c") - F.col("_b") ** 2).where("_d > 0")
    grid = [-limit + 2 * limit * i / (points - 1) for i in range(points)]
    rows = df.join(s, keys).withColumn("at", F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a in grid for b in grid])))
    u, v = F.col("at.x") - F.col(x), F.col("at.y") - F.col(y)
    q = (F.col("_c") * u * u - 2 * F.col("_b") * u * v + F.col("_a") * v * v) / F.col("_d")
    got = rows.groupBy(*keys, "at").agg(F.sum(F.exp(-q / 2) / (F.col("_n") * 6.283185307179586 * F.sqrt("_d"))).alias("density"))
    top = F.max("density").over(Window.partitionBy(*keys))
    return got.withColumns({"gx": F.col("at.x"), "gy": F.col("at.y"), "potential": -F.log(F.when(F.col("density") > 0, F.col("density") / top))}).drop("at")


def even_odd(curve: DataFrame, x: str, p: str, keys: list[str]) -> DataFrame:
    """Even and odd part of a curve on a symmetric grid."""
    other = curve.select(*keys, (-F.col(x)).alias(x), F.col(p).alias("_o"))
    return curve.join(other, [*keys, x]).withColumns({"even": (F.col(p) + F.col("_o")) / 2, "odd": (F.col(p) - F.col("_o")) / 2}).drop("_o")


def bimodality(hist: DataFrame, keys: list[str], split: int) -> DataFrame:
    """Of a histogram smoothed over 3 bins, the peaks below and from the split bin and the valley between, over the lower peak."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-1, 1)
    s = hist.withColumn("_s", F.avg("count").over(w))
    low, high = F.when(F.col("bin") < split, F.col("_s")), F.when(F.col("bin") >= split, F.col("_s"))
    first = lambda c: F.min_by("bin", F.struct(-c, F.col("bin")))
    peaks = s.groupBy(*keys).agg(first(F.coalesce(low, F.lit(-1.0))).alias("stop_bin"), F.max(low).alias("_l"), first(F.coalesce(high, F.lit(-1.0))).alias("run_bin"), F.max(high).alias("_h"))
    valley = s.join(peaks, keys).where(F.col("bin").between(F.col("stop_bin"), F.col("run_bin"))).groupBy(*keys).agg(F.min("_s").alias("_v"))
    return peaks.join(valley, keys).withColumn("valley_ratio", F.try_divide(F.col("_v"), F.least("_l", "_h"))).drop("_v", "_l", "_h")


def ratio_bins(df: DataFrame, bin_: Column, top: str, bottom: str, keys: list[str]) -> DataFrame:
    """sum(top) / sum(bottom) per bin with counts."""
    return df.withColumn("bin", bin_).where("bin is not null").groupBy(*keys, "bin").agg(F.try_divide(F.sum(top), F.sum(bottom)).alias("ratio"), F.count("*").alias("n"))


def long_table(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Wide to long: name, value."""
    return df.unpivot(ids, values, "name", "value")


def wide_table(df: DataFrame, ids: list[str], name: str, values: list[str], value: str) -> DataFrame:
    """Long to wide for known names."""
    return df.groupBy(*ids).pivot(name, values).agg(F.first(value))


def log_histogram(df: DataFrame, column: str, keys: list[str], low: float, high: float, n: int) -> DataFrame:
    """Density of ln(column) by bin against the normal density with the same mean and std at the bin's centre."""
    logs = df.where(F.col(column) > 0).withColumn("_l", F.log(column))
    h = histogram(logs, "_l", low, high, n, keys).join(log_moments(df, column, keys).select(*keys, "mean", "std"), keys)
    z = (F.lit(low) + (F.col("bin") + 0.5) * ((high - low) / n) - F.col("mean")) / F.col("std")
    return h.withColumn("normal", F.when(F.col("std") > 0, F.exp(-z * z / 2) / (F.col("std") * 2.5066282746310002)))


def scaled_histogram(df: DataFrame, column: str, keys: list[str], most: float, n: int) -> DataFrame:
    """Density of column over the key's mean by bin, against the exponential law of mean 1 and the Rayleigh law of mean 1 at the bin's centre."""
    scaled = df.join(df.groupBy(*keys).agg(F.avg(column).alias("_m")).where("_m > 0"), keys).withColumn("_t", F.col(column) / F.col("_m"))
    c = (F.col("bin") + 0.5) * (most / n)
    return histogram(scaled, "_t", 0.0, most, n, keys).withColumns({"exponential": F.exp(-c), "rayleigh": 1.5707963267948966 * c * F.exp(-0.7853981633974483 * c * c)})


def normal_qq(df: DataFrame, column: str, keys: list[str], order: list[str]) -> DataFrame:
    """ln(column) of positive rows against the normal law: slope, intercept and r2 of sorted values on normal quantiles (Filliben's positions), and KS, the distance to the normal law of the same mean and std.

    Ranks come from rows sorted across tasks, so no task sorts a whole key.
    """
    from ..functions.curves import normal_cdf, normal_quantile

    rows = ranked(df.where(F.col(column) > 0).withColumn("_l", F.log(column)), "_l", keys, order)
    i, n = F.col("rank"), F.col("total")
    position = F.when(i == n, F.lit(0.5) ** (1 / n)).when(i == 1, 1 - F.lit(0.5) ** (1 / n)).otherwise((i - 0.3175) / (n + 0.365))
    q = normal_quantile(position)
    moments = df.where(F.col(column) > 0).groupBy(*keys).agg(F.avg(F.log(column)).alias("_m"), F.stddev_pop(F.log(column)).alias("_s"))
    z = normal_cdf((F.col("_l") - F.col("_m")) / F.col("_s"))
    rows = rows.join(moments, keys).withColumns({"_q": q, "_d": F.greatest(i / n - z, z - (i - 1) / n)})
    return rows.groupBy(*keys).agg(F.regr_slope("_l", "_q").alias("slope"), F.regr_intercept("_l", "_q").alias("intercept"), F.regr_r2("_l", "_q").alias("r2"), F.max("_d").alias("ks"), F.count("*").alias("n"))


def log_moments(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Mean, std and n of ln(column) for positive values."""
    return df.where(F.col(column) > 0).groupBy(*keys).agg(F.avg(F.log(column)).alias("mean"), F.stddev_pop(F.log(column)).alias("std"), F.count("*").alias("n"))
