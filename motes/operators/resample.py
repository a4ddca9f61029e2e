"""Resampling and null models with weights derived from md5, so that every plan and engine draws the same.

Replicates are exploded only after rows are reduced to the resampling unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered, quantiles

#: Cumulative Poisson(1) probabilities for weights 0..7.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def uniform(*parts) -> Column:
    """Number in [0, 1) from the md5 of the joined parts."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")
    return h / F.lit(4294967296.0)


def poisson(u: Column) -> Column:
    """Poisson(1) weight of a uniform number."""
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(u < POISSON[k], F.lit(k)).otherwise(out)
    return out


def replicates(df: DataFrame, n: int, unit: list[str], seed: int = 0) -> DataFrame:
    """Each row once for each replicate b with its Poisson weight; rows of weight 0 go."""
    return df.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("w", poisson(uniform(F.lit(seed), "b", *unit))).where("w > 0")


def interval(reps: DataFrame, value: str, keys: list[str], level: float = 0.95) -> DataFrame:
    """Standard error and percentile interval over replicates."""
    q = F.percentile(value, F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("_q")
    return reps.groupBy(*keys).agg(F.stddev_samp(value).alias("se"), q).select(*keys, "se", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def bootstrap_mean(df: DataFrame, value: str, unit: list[str], keys: list[str], n: int = 100, seed: int = 0) -> DataFrame:
    """Bootstrap of a mean over units (rows are first reduced to one mean a unit)."""
    u = df.groupBy(*keys, *unit).agg(F.avg(value).alias("_x"))
    reps = replicates(u, n, unit, seed).groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col("_x")) / F.sum("w")).alias("v"))
    return interval(reps, "v", keys)


def bootstrap_percentile(df: DataFrame, value: str, unit: list[str], keys: list[str], p: float, n: int = 50, seed: int = 0) -> DataFrame:
    """Bootstrap of a percentile over units' medians, with integer weights."""
    u = quantiles(df, value, [*keys, *unit], {"_x": 0.5})
    return interval(quantiles(replicates(u, n, unit, seed), "_x", [*keys, "b"], {"v": p}, "w"), "v", keys)


def bootstrap_ngp(df: DataFrame, r2: str, unit: list[str], keys: list[str], n: int = 100, seed: int = 0) -> DataFrame:
    """Bootstrap of the non-Gaussian parameter from sums of r^2 and r^4 of units."""
    u = df.groupBy(*keys, *unit).agg(F.sum(r2).alias("_2"), F.sum(F.col(r2) ** 2).alias("_4"), F.count("*").alias("_n"))
    s = lambda c: F.sum(F.col("w") * F.col(c))
    reps = replicates(u, n, unit, seed).groupBy(*keys, "b").agg((0.5 * (s("_4") / s("_n")) / (s("_2") / s("_n")) ** 2 - 1).alias("v"))
    return interval(reps, "v", keys)


def bootstrap_ratio(df: DataFrame, top: Column, bottom: Column, unit: list[str], keys: list[str], n: int = 100, seed: int = 0) -> DataFrame:
    """Cluster bootstrap of sum(top) / sum(bottom): sums of units first, one weight for both."""
    u = df.groupBy(*keys, *unit).agg(F.sum(top).alias("_t"), F.sum(bottom).alias("_b"))
    reps = replicates(u, n, unit, seed).groupBy(*keys, "b").agg(F.try_divide(F.sum(F.col("w") * F.col("_t")), F.sum(F.col("w") * F.col("_b"))).alias("v"))
    whole = u.groupBy(*keys).agg(F.try_divide(F.sum("_t"), F.sum("_b")).alias("ratio"))
    return whole.join(interval(reps, "v", keys), keys)


def _drawn(u: DataFrame, outer: str, inner: str, keys: list[str], n: int, seed: int) -> DataFrame:
    """u (one row for each inner unit) once for each replicate b and copy of its outer unit, with its weight w there; rows of weight 0 go."""
    drawn = u.select(*keys, outer).distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_w", poisson(uniform(F.lit(seed), "b", outer)).cast("int")).where("_w > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_w"))))
    return drawn.join(u, [*keys, outer]).withColumn("w", poisson(uniform(F.lit(seed), "b", outer, "copy", inner))).where("w > 0")


def hierarchical_weights(df: DataFrame, outer: str, inner: str, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """How often each inner unit (particle) counts in each replicate b when outer units (movies), and inside each drawn copy the inner ones, are drawn: keys, outer, inner, b, w."""
    return _drawn(df.select(*keys, outer, inner).distinct(), outer, inner, keys, n, seed).groupBy(*keys, outer, inner, "b").agg(F.sum("w").alias("w"))


def hierarchical(df: DataFrame, value: str, outer: str, inner: str, keys: list[str], n: int = 50, seed: int = 0) -> DataFrame:
    """Movies are weighed, and inside each drawn copy of a movie its particles anew; the mean over particles' means."""
    u = df.groupBy(*keys, outer, inner).agg(F.avg(value).alias("_x"))
    reps = _drawn(u, outer, inner, keys, n, seed).groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col("_x")) / F.sum("w")).alias("v"))
    return interval(reps, "v", keys)


def fixed_draws(df: DataFrame, value: str, unit: list[str], keys: list[str], n: int = 50, seed: int = 0) -> DataFrame:
    """Exactly as many draws with replacement as units: draw d of replicate b takes the unit with the rank floor(u n)."""
    u = numbered(df.groupBy(*keys, *unit).agg(F.avg(value).alias("_x")), keys, unit, "_i", "_n").withColumn("_i", F.col("_i") - 1)
    size = u.select(*keys, "_n").distinct()
    draws = size.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("_d", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).withColumn("_i", F.floor(uniform(F.lit(seed), "b", "_d") * F.col("_n")).cast("int"))
    reps = draws.join(u.drop("_n"), [*keys, "_i"]).groupBy(*keys, "b").agg(F.avg("_x").alias("v"))
    return interval(reps, "v", keys)


def group_difference(df: DataFrame, value: str, unit: list[str], group: str, a: str, b: str, n: int = 100, seed: int = 0) -> DataFrame:
    """Bootstrap of the difference of two groups' means, and the share of replicates with the other sign, doubled. One row."""
    u = df.groupBy(group, *unit).agg(F.avg(value).alias("_x"))
    mean = lambda g: F.sum(F.when(F.col(group) == g, F.col("w") * F.col("_x"))) / F.sum(F.when(F.col(group) == g, F.col("w")))
    reps = replicates(u, n, [group, *unit], seed).groupBy("b").agg((mean(a) - mean(b)).alias("v"))
    return reps.agg(F.avg("v").alias("difference"), F.stddev_samp("v").alias("se"), (2 * F.least(F.avg((F.col("v") <= 0).cast("double")), F.avg((F.col("v") >= 0).cast("double")))).alias("p"))


def time_shuffle(df: DataFrame, moved: list[str], keys: list[str], rounds: int, seed: int = 0) -> DataFrame:
    """For each round the columns `moved` permuted along their track against the others: two row orders joined on rank."""
    w = Window.partitionBy(*keys)
    fixed = df.drop(*moved).withColumn("_r", F.row_number().over(w.orderBy("frame")))
    src = df.select(*keys, "frame", *moved).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    src = src.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "round").orderBy(uniform(F.lit(seed), "round", *keys, "frame"), "frame"))).drop("frame")
    return fixed.join(src, [*keys, "_r"]).drop("_r")


def particle_swap(df: DataFrame, moved: list[str], rounds: int, seed: int = 0) -> DataFrame:
    """For each round the columns `moved` from another particle of the experiment, row by row, to the shorter track's end: particles in hash order each take the next one's."""
    p = df.select("exp", "particle").distinct().withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    p = numbered(p.withColumn("_u", uniform(F.lit(seed), "round", "exp", "particle")), ["exp", "round"], ["_u", "particle"], "_i", "_n").drop("_u")
    take = p.select("exp", "round", F.col("particle").alias("donor"), F.col("_i").alias("_j"))
    to = p.withColumn("_j", F.col("_i") % F.col("_n") + 1).join(take, ["exp", "round", "_j"]).where("particle <> donor").select("exp", "round", "particle", "donor")
    r = F.row_number().over(Window.partitionBy("exp", "particle").orderBy("frame"))
    fixed = df.drop(*moved).withColumn("_r", r)
    src = df.select("exp", F.col("particle").alias("donor"), *moved, r.alias("_r"))
    return fixed.join(to, ["exp", "particle"]).join(src, ["exp", "donor", "_r"]).drop("_r")


def block_shuffle(df: DataFrame, block: int, seed: int = 0) -> DataFrame:
    """Blocks of rows of an experiment dealt to its particles anew: a column dealt, the particle that a block goes to."""
    r = df.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("exp", "particle").orderBy("frame")) - 1) / block))
    b = r.select("exp", "particle", "block").distinct()
    a = numbered(b.withColumn("_u", uniform(F.lit(seed), "exp", "particle", "block")), ["exp"], ["_u", "particle", "block"], "_i").drop("_u", "total")
    c = numbered(b, ["exp"], ["particle", "block"], "_i").select("exp", F.col("particle").alias("dealt"), "_i")
    return r.join(a.join(c, ["exp", "_i"]).drop("_i"), ["exp", "particle", "block"])


def variation(df: DataFrame, top: str, bottom: str, unit: list[str], keys: list[str]) -> DataFrame:
    """Coefficients of variation over units of the numerator, the denominator and their ratio."""
    u = df.groupBy(*keys, *unit).agg(F.avg(top).alias("_t"), F.avg(bottom).alias("_b")).withColumn("_r", F.try_divide("_t", "_b"))
    cv = lambda c: F.try_divide(F.stddev_samp(c), F.abs(F.avg(c)))
    return u.groupBy(*keys).agg(cv("_t").alias("cv_top"), cv("_b").alias("cv_bottom"), cv("_r").alias("cv_ratio"), F.count("*").alias("n"))
