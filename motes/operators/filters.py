"""Filters on tracks and on tables of values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kinematics import KEY, track
from .ranks import quantiles, ranked, with_quantiles


def until_cutoff(tracks: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """frames up to the experiment's cut-off; experiments without one stay whole."""
    return tracks.join(cutoffs, "exp", "left").where("cutoff_frame is null or frame <= cutoff_frame").drop("cutoff_frame")


def only_active(tracks: DataFrame, active: DataFrame) -> DataFrame:
    """particles on a list."""
    return tracks.join(active, KEY, "left_semi")


def end_to_end(tracks: DataFrame) -> DataFrame:
    """distance from the first to the last point."""
    last = lambda c: F.max_by(c, "frame") - F.min_by(c, "frame")
    return tracks.groupBy(*KEY).agg(F.hypot(last("x"), last("y")).alias("distance"))


def without_fixed(tracks: DataFrame, threshold: float) -> DataFrame:
    """tracks whose end-to-end distance is not below the threshold."""
    return tracks.join(end_to_end(tracks).where(F.col("distance") < threshold), KEY, "left_anti")


def long_tracks(tracks: DataFrame, least: int) -> DataFrame:
    """tracks of at least so many rows."""
    return tracks.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where(F.col("_n") >= least).drop("_n")


def _fences(values: DataFrame, column: str, by: str, k: float) -> DataFrame:
    """by, _low and _high: max(0, Q1 - k IQR) and Q3 + k IQR of each group."""
    q = quantiles(values, column, [by], {"_q1": 0.25, "_q3": 0.75})
    reach = k * (F.col("_q3") - F.col("_q1"))
    return q.select(by, F.greatest(F.lit(0.0), F.col("_q1") - reach).alias("_low"), (F.col("_q3") + reach).alias("_high"))


def tukey(values: DataFrame, column: str, by: str = "condition", k: float = 1.5) -> DataFrame:
    """rows inside [max(0, Q1 - k IQR), Q3 + k IQR] of their group."""
    return values.join(_fences(values, column, by, k), by).where(F.col(column).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def tukey_statistics(values: DataFrame, column: str, by: str = "condition", k: float = 1.5) -> DataFrame:
    """n, mean, median and std of a group's values, raw and (ending in _in) inside its fences."""
    fenced = values.join(_fences(values, column, by, k), by).withColumn("_in", F.when(F.col(column).between(F.col("_low"), F.col("_high")), F.col(column)))
    cols = [a(c).alias(f"{name}{end}") for c, end in ((column, ""), ("_in", "_in")) for name, a in (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp))]
    out = with_quantiles(fenced.groupBy(by).agg(*cols), values, column, [by], {"median": 0.5})
    return with_quantiles(out, fenced, "_in", [by], {"median_in": 0.5})


def plotting_position(values: DataFrame, column: str, by: str, order: list[str]) -> DataFrame:
    """Filliben's position of each row among its group: 1 - 0.5^(1/n), (i - 0.3175) / (n + 0.365), 0.5^(1/n)."""
    return ranked(values, column, [by], order, "_i", "_n").withColumn("position", F.when(F.col("_i") == F.col("_n"), F.lit(0.5) ** (1 / F.col("_n"))).when(F.col("_i") == 1, 1 - F.lit(0.5) ** (1 / F.col("_n"))).otherwise((F.col("_i") - 0.3175) / (F.col("_n") + 0.365))).drop("_i", "_n")


def lognormal_core(values: DataFrame, column: str, by: str, order: list[str], tail: float) -> DataFrame:
    """positive rows whose plotting position of ln(column) lies in [tail, 1 - tail], tail being the normal law's mass beyond -z."""
    return plotting_position(values.where(F.col(column) > 0), column, by, order).where(F.col("position").between(tail, 1 - tail))


def valid_field(field: DataFrame, least: float = 0.0) -> DataFrame:
    """finite vectors longer than max(least, 0)."""
    return finite(field, ["u", "v"]).where(F.hypot("u", "v") > max(least, 0.0))


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows where all the columns are numbers, neither null, NaN nor infinite."""
    ok: list[Column] = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")) for c in columns]
    return df.where(reduce(lambda a, b: a & b, ok))


def outside(field: DataFrame, particles: DataFrame, radius: float) -> DataFrame:
    """pixels farther than radius from every particle of their frame."""
    from .spatial import near_pixels

    hit = near_pixels(particles, field, radius).select("exp", "frame", "px", "py").distinct()
    return field.join(hit, ["exp", "frame", "px", "py"], "left_anti")


def thinned(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """at most so many rows of a group, at evenly spaced ranks (first and last included)."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    steps = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.rint(k * (F.col("_n") - 1) / F.lit(max(1, most - 1))).cast("int")))
    return ranked.where((F.col("_n") <= most) | F.array_contains(steps, F.col("_i"))).drop("_i", "_n")


def condition_name(raw: Column) -> Column:
    """`06um`, `0.6`, `bead06um` to beads06um; names without particles to control."""
    low = F.lower(F.trim(raw))
    digits = F.regexp_replace(F.regexp_extract(low, r"([0-9]+\.?[0-9]*)", 1), r"\.", "")
    return F.when(low.isin("control", "w/o cargo", "none", "no cargo"), F.lit("control")).when(digits == "", low).otherwise(F.concat(F.lit("beads"), F.lpad(digits, 2, "0"), F.lit("um")))


def range_spec(df: DataFrame, column: str) -> DataFrame:
    """specs such as "8:32:8,40" as distinct integers, stop included: a column value."""
    rows = df.withColumn("_p", F.explode(F.split(column, ","))).withColumn("_p", F.split("_p", ":"))
    n = lambda i: F.col("_p")[i].cast("int")
    whole = F.when(F.size("_p") == 1, F.array(n(0))).when(F.size("_p") == 2, F.sequence(n(0), F.get("_p", F.lit(1)).cast("int"))).otherwise(F.sequence(n(0), F.get("_p", F.lit(1)).cast("int"), F.get("_p", F.lit(2)).cast("int")))
    return rows.withColumn("value", F.explode(whole)).drop("_p").distinct()


def checked_flow(pairs: DataFrame, moving: float, least: float) -> DataFrame:
    """(u, v) of a field against (tu, tv) of tracks: shares of moving and valid points, mean relative speed error and angle error."""
    a, b = F.hypot("u", "v"), F.hypot("tu", "tv")
    valid = (a > least) & (b > least)
    angle = F.abs(F.atan2(F.col("u") * F.col("tv") - F.col("v") * F.col("tu"), F.col("u") * F.col("tu") + F.col("v") * F.col("tv")))
    return pairs.groupBy("exp").agg(F.count("*").alias("n"), F.avg((b > moving).cast("double")).alias("moving"), F.avg(valid.cast("double")).alias("valid"), F.avg(F.when(valid, F.abs(a - b) / b)).alias("speed_error"), F.avg(F.when(valid, angle)).alias("angle_error"), (F.sum(F.col("u") * F.col("tu") + F.col("v") * F.col("tv")) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("correlation"))


def steps_on_field(tracks: DataFrame, field: DataFrame, size: int) -> DataFrame:
    """The step (tu, tv) of each particle to the next frame with the field (u, v) at its nearest pixel, clipped to the frame: an equi-join."""
    nxt = tracks.select(*KEY, (F.col("frame") - 1).alias("frame"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    pixel = lambda c: F.least(F.greatest(F.rint(c), F.lit(0)), F.lit(size - 1)).cast("int")
    rows = tracks.join(nxt, [*KEY, "frame"]).withColumns({"tu": F.col("_x") - F.col("x"), "tv": F.col("_y") - F.col("y"), "px": pixel("x"), "py": pixel("y")}).drop("_x", "_y")
    return rows.join(field, ["exp", "frame", "px", "py"])


def first_rows(tracks: DataFrame, n: int) -> DataFrame:
    """The first n rows of each track."""
    return tracks.withColumn("_i", F.row_number().over(track())).where(F.col("_i") <= n).drop("_i")
