"""Correlations, tests and weighted medians."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues
from .ranks import average_rank, running


def correlations(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Pearson, spearman, slope, intercept, slope through the origin and its uncentred R2, n."""
    from ..sources.io import stashed

    both = stashed(df.dropna(subset=[x, y]).select(*dict.fromkeys([*keys, x, y])), "pairs")  # read for each rank and once more
    r = average_rank(average_rank(both, x, keys, "_rx", both), y, keys, "_ry", both)
    xy, xx, yy = F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) ** 2), F.sum(F.col(y) ** 2)
    return r.groupBy(*keys).agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.try_divide(xy, xx).alias("slope0"), F.try_divide(xy * xy, xx * yy).alias("r2_0"), F.count("*").alias("n"))


def within_correlation(df: DataFrame, x: str, y: str, group: list[str], keys: list[str]) -> DataFrame:
    """Correlation and slope after removing group means."""
    w = Window.partitionBy(*group)
    d = df.withColumns({"_x": F.col(x) - F.avg(x).over(w), "_y": F.col(y) - F.avg(y).over(w)})
    return d.groupBy(*keys).agg(F.corr("_x", "_y").alias("r"), F.try_divide(F.sum(F.col("_x") * F.col("_y")), F.sum(F.col("_x") ** 2)).alias("slope"), F.count("*").alias("n"))


def two_samples(df: DataFrame, value: str, first: str) -> DataFrame:
    """Welch's t with its degrees of freedom, and Mann-Whitney's U with its normal score; `first` marks the first sample. One row.

    The rank sum comes from counts for each distinct value, so ties and rows of one value meet nowhere.
    """
    a, b = F.when(F.col(first), F.col(value)), F.when(~F.col(first), F.col(value))
    moments = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"), F.count(a).cast("double").alias("na"), F.count(b).cast("double").alias("nb"))
    counts = df.groupBy(value).agg(F.count(a).alias("_a"), F.count(value).alias("_n"))
    ranks = running(counts, value, [], "_n", "_up", "_all").agg(F.sum(F.col("_a") * (F.col("_up") - (F.col("_n") - 1) / 2)).alias("ra"))
    s = moments.withColumn("_one", F.lit(1)).join(ranks.withColumn("_one", F.lit(1)), "_one")  # two single rows
    e = F.col("va") / F.col("na") + F.col("vb") / F.col("nb")
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2
    half = F.col("na") * F.col("nb")
    return s.select(((F.col("ma") - F.col("mb")) / F.sqrt(e)).alias("t"), (e * e / ((F.col("va") / F.col("na")) ** 2 / (F.col("na") - 1) + (F.col("vb") / F.col("nb")) ** 2 / (F.col("nb") - 1))).alias("df"), u.alias("u"), ((u - half / 2) / F.sqrt(half * (F.col("na") + F.col("nb") + 1) / 12)).alias("z"))


def signed_ranks(df: DataFrame, first: str, second: str) -> DataFrame:
    """Wilcoxon's signed ranks of pairs: w_plus, w_minus, n (pairs that differ) and the normal score z with ties corrected. One row."""
    d = df.withColumn("_d", F.col(first) - F.col(second)).where("_d <> 0").withColumn("_m", F.abs("_d"))
    c = d.groupBy("_m").agg(F.count("*").alias("_n"), F.count(F.when(F.col("_d") > 0, 1)).alias("_p"))
    r = running(c, "_m", [], "_n", "_up", "_all").withColumn("_r", F.col("_up") - (F.col("_n") - 1) / 2)
    s = r.agg(F.sum(F.col("_p") * F.col("_r")).alias("w_plus"), F.sum((F.col("_n") - F.col("_p")) * F.col("_r")).alias("w_minus"), F.sum("_n").alias("n"), F.sum(F.col("_n") ** 3 - F.col("_n")).alias("_t"))
    n = F.col("n")
    return s.select("w_plus", "w_minus", "n", ((F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_t") / 48)).alias("z"))


def with_p(stats: DataFrame) -> DataFrame:
    """Two-sided p-values of the statistics t (with df) and z that there are: p_t, p_z."""
    out = stats.withColumn("p_z", pvalues.of_normal(F.col("z"))) if "z" in stats.columns else stats
    return out.withColumn("p_t", pvalues.of_student(F.col("t"), F.col("df"))) if "t" in stats.columns else out


def ks_distance(df: DataFrame, value: str, first: str, keys: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance, from counts per distinct value."""
    c = df.groupBy(*keys, value).agg(F.count(F.when(F.col(first), 1)).alias("_a"), F.count(F.when(~F.col(first), 1)).alias("_b")).withColumn("_n", F.col("_a") + F.col("_b"))
    c = running(running(c, value, keys, "_n", "_nu", "_nw"), value, keys, "_a", "_au", "_aw")
    gap = F.abs(F.try_divide("_au", "_aw") - F.try_divide(F.col("_nu") - F.col("_au"), F.col("_nw") - F.col("_aw")))
    return c.withColumn("_g", gap).groupBy(*keys).agg(F.max("_g").alias("distance"))


def variance_split(df: DataFrame, value: str, group: str) -> DataFrame:
    """Variance between group means (weighted by rows), inside groups, and whole. One row."""
    m = df.withColumn("_m", F.avg(value).over(Window.partitionBy(group)))
    return m.agg(F.var_pop("_m").alias("between"), F.avg((F.col(value) - F.col("_m")) ** 2).alias("within"), F.var_pop(value).alias("whole"))


def weighted_median(df: DataFrame, value: str, weight: str, keys: list[str]) -> DataFrame:
    """The first value at which the running weight reaches half; equal values count together."""
    c = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return running(c, value, keys, "_w", "_run", "_all").where(F.col("_run") >= F.col("_all") / 2).groupBy(*keys).agg(F.min(value).alias("median"))
