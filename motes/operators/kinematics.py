"""Per-trajectory window operators. Tracks are (condition, exp, particle, frame, x, y, ...); undefined values are null.

Row lags ignore gaps in frames, frame lags need the exact frame. All windows share the partitioning (exp, particle), so a chain of
these operators shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.angles import heading, length, turn, wrap_closed

KEY = ["exp", "particle"]


def track() -> WindowSpec:
    """Rows of one track in order of frames."""
    return Window.partitionBy(*KEY).orderBy("frame")


def step(c: str) -> Column:
    return F.col(c) - F.lag(c).over(track())


def velocity(tracks: DataFrame, scale: float = 1.0, dt: float = 1.0) -> DataFrame:
    """Steps by row: dx, dy, distance, v, vx, vy, theta, unit vector (ex, ey), signed turn dtheta, omega, angle alpha of the unit vector's change, t.

    A step of length 0 has no angles and no unit vector; a unit vector that does not change has alpha 0.
    """
    out = tracks.withColumn("dx", step("x") * scale).withColumn("dy", step("y") * scale).withColumn("distance", length(F.col("dx"), F.col("dy")))
    moved = F.col("distance") > 0
    out = out.withColumns({"v": F.col("distance") / dt, "vx": F.col("dx") / dt, "vy": F.col("dy") / dt, "theta": F.when(moved, heading("dy", "dx")), "t": F.col("frame") * dt})
    before = [F.lag(c).over(track()) for c in ("dx", "dy", "distance")]
    out = out.withColumn("dtheta", F.when(moved & (before[2] > 0), turn(before[0], before[1], F.col("dx"), F.col("dy"))))
    out = out.withColumns({"omega": F.col("dtheta") / dt, "ex": F.when(moved, F.col("dx") / F.col("distance")), "ey": F.when(moved, F.col("dy") / F.col("distance"))})
    return out.withColumn("alpha", F.atan2(F.round(step("ey"), 12) + F.lit(0.0), F.round(step("ex"), 12) + F.lit(0.0)))


def gap_aware_speed(tracks: DataFrame, scale: float = 1.0, dt: float = 1.0) -> DataFrame:
    """Speed, null unless the frame before is there."""
    return tracks.withColumn("v", F.when(step("frame") == 1, length(step("x"), step("y")) * scale / dt))


def gap_dividing_speed(tracks: DataFrame, scale: float = 1.0, dt: float = 1.0) -> DataFrame:
    """Distance over the frames it took."""
    return tracks.withColumn("v", F.when(step("frame") > 0, length(step("x"), step("y")) * scale / (step("frame") * dt)))


def forward_unit(tracks: DataFrame) -> DataFrame:
    """Unit vector (ux, uy) to the next row, zero for no motion, null at the end."""
    dx, dy = F.lead("x").over(track()) - F.col("x"), F.lead("y").over(track()) - F.col("y")
    out = tracks.withColumns({"_dx": dx, "_dy": dy}).withColumn("_d", length(F.col("_dx"), F.col("_dy")))
    unit = lambda c: F.when(F.col("_d") > 0, F.col(c) / F.col("_d")).when(F.col("_d") == 0, 0.0)
    return out.withColumns({"ux": unit("_dx"), "uy": unit("_dy")}).drop("_dx", "_dy", "_d")


def rolling_mean(tracks: DataFrame, columns: list[str], window: int = 3, center: bool = True, min_periods: int | None = None) -> DataFrame:
    """Moving average by rows; fewer than min_periods values give null. New columns end in _mean."""
    back = window // 2 if center else window - 1
    w = track().rowsBetween(-back, window - 1 - back)
    least = window if min_periods is None else min_periods
    return tracks.withColumns({f"{c}_mean": F.when(F.count(c).over(w) >= least, F.avg(c).over(w)) for c in columns})


def rolling_circular_mean(tracks: DataFrame, column: str, window: int = 3, min_periods: int = 1) -> DataFrame:
    """Circular mean of an angle over centred rows, nulls ignored."""
    w = track().rowsBetween(-(window // 2), window - 1 - window // 2)
    return tracks.withColumn(f"{column}_mean", F.when(F.count(column).over(w) >= min_periods, F.atan2(F.avg(F.sin(column)).over(w), F.avg(F.cos(column)).over(w))))


def central_velocity(tracks: DataFrame, window: int = 3, dt: float = 1.0) -> DataFrame:
    """Moving average, then second-order differences for uneven times, one-sided at the ends: vx, vy."""
    out = rolling_mean(tracks, ["x", "y"], window, min_periods=1)
    t = F.col("frame") * dt
    a, b = t - F.lag("frame").over(track()) * dt, F.lead("frame").over(track()) * dt - t
    for c in ("x", "y"):
        m = f"{c}_mean"
        now, before, after = F.col(m), F.lag(m).over(track()), F.lead(m).over(track())
        inner = (a * a * after + (b * b - a * a) * now - b * b * before) / (a * b * (a + b))
        out = out.withColumn(f"v{c}", F.coalesce(inner, (now - before) / a, (after - now) / b))
    return out


def lag_displacement(tracks: DataFrame, tau: int, scale: float = 1.0) -> DataFrame:
    """(dx, dy, r) to the row tau rows later; rows without one are dropped."""
    out = tracks.withColumns({"dx": (F.lead("x", tau).over(track()) - F.col("x")) * scale, "dy": (F.lead("y", tau).over(track()) - F.col("y")) * scale})
    return out.where("dx is not null").withColumn("r", length(F.col("dx"), F.col("dy")))


def project(displacements: DataFrame, theta: DataFrame) -> DataFrame:
    """Parts parallel and perpendicular to an axis theta(exp, frame), their squares' share."""
    out = displacements.join(theta, ["exp", "frame"])
    par, perp = F.col("dx") * F.cos("theta") + F.col("dy") * F.sin("theta"), F.col("dy") * F.cos("theta") - F.col("dx") * F.sin("theta")
    out = out.withColumns({"parallel": par, "perpendicular": perp})
    return out.withColumn("share", F.try_divide(F.col("parallel") ** 2, F.col("parallel") ** 2 + F.col("perpendicular") ** 2))


def frame_displacement(tracks: DataFrame, lags: list[int]) -> DataFrame:
    """Displacements between exactly lag frames: one equi-join for all lags."""
    later = tracks.select(*KEY, F.col("frame").alias("_f"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    pairs = tracks.withColumn("lag", F.explode(F.array(*[F.lit(n) for n in lags]))).withColumn("_f", F.col("frame") + F.col("lag"))
    return pairs.join(later, [*KEY, "_f"]).withColumns({"dx": F.col("_x") - F.col("x"), "dy": F.col("_y") - F.col("y")}).drop("_f", "_x", "_y")


def unwrapped(tracks: DataFrame, column: str, extra: tuple[str, ...] = (), period: float = 1.0) -> DataFrame:
    """An angle made continuous along its track (and the extra keys); period 2 for headless axes: <column>_unwrapped."""
    w = Window.partitionBy(*KEY, *extra).orderBy("frame")
    jump = wrap_closed((F.col(column) - F.lag(column).over(w)) * period) / period
    out = tracks.withColumn("_j", F.coalesce(jump, F.lit(0.0)))
    return out.withColumn(f"{column}_unwrapped", F.first(column).over(w) + F.sum("_j").over(w)).drop("_j")


def turning_angle(tracks: DataFrame, tau: int = 1, dt: float = 1.0) -> DataFrame:
    """Angle at three rows exactly tau frames apart with both steps over 1e-5, and speeds v_in, v_out, v_mean."""
    at = lambda c, k: F.lead(c, k * tau).over(track())
    out = tracks.withColumns({"_ax": at("x", 1) - F.col("x"), "_ay": at("y", 1) - F.col("y"), "_bx": at("x", 2) - at("x", 1), "_by": at("y", 2) - at("y", 1), "_ok": (at("frame", 1) - F.col("frame") == tau) & (at("frame", 2) - at("frame", 1) == tau)})
    out = out.withColumns({"_a": F.col("_ax") ** 2 + F.col("_ay") ** 2, "_b": F.col("_bx") ** 2 + F.col("_by") ** 2}).where("_ok and _a > 1e-10 and _b > 1e-10")
    out = out.withColumns({"angle": turn(F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")), "v_in": F.sqrt("_a") / (tau * dt), "v_out": F.sqrt("_b") / (tau * dt)})
    return out.withColumn("v_mean", (F.col("v_in") + F.col("v_out")) / 2).drop("_ax", "_ay", "_bx", "_by", "_ok", "_a", "_b")


def segments(tracks: DataFrame, broken: Column | None = None) -> DataFrame:
    """Island number per track: a new one where the frame gap is not 1, or where `broken` holds."""
    new = step("frame") != 1
    if broken is not None:
        new = new | broken
    return tracks.withColumn("_new", F.coalesce(new, F.lit(False)).cast("int")).withColumn("segment", F.sum("_new").over(track())).drop("_new")


def tau_velocity(tracks: DataFrame, tau: int, dt: float = 1.0) -> DataFrame:
    """Velocity over tau frames inside contiguous segments: vx, vy, null where the segment ends before."""
    w = Window.partitionBy(*KEY, "segment").orderBy("frame")
    at = lambda c: (F.lead(c, tau).over(w) - F.col(c)) / (tau * dt)
    return segments(tracks).withColumns({"vx": at("x"), "vy": at("y")})


def savitzky_golay(tracks: DataFrame, column: str) -> DataFrame:
    """K10's smoothing: the quadratic through five rows (weights -3 12 17 12 -3 over 35); rows near a segment's ends keep their value."""
    w = Window.partitionBy(*KEY, "segment").orderBy("frame")
    at = lambda k: F.lag(column, -k).over(w) if k else F.col(column)
    smooth = (-3 * at(-2) + 12 * at(-1) + 17 * at(0) + 12 * at(1) - 3 * at(2)) / 35
    return segments(tracks).withColumn(f"{column}_smooth", F.coalesce(smooth, F.col(column)))


def centred(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Deviation from the group's mean: <column>_within."""
    return df.withColumn(f"{column}_within", F.col(column) - F.avg(column).over(Window.partitionBy(*by)))


def frame_windows(df: DataFrame, width: int, least: int = 1, keys: tuple[str, ...] = ("exp", "particle")) -> DataFrame:
    """Start of the frame window; a track's windows with fewer than `least` rows, or less than half of the width, are dropped."""
    out = df.withColumn("window", F.floor(F.col("frame") / width) * width)
    n = F.count("*").over(Window.partitionBy(*keys, "window"))
    return out.withColumn("_n", n).where((F.col("_n") >= least) & (F.col("_n") >= width / 2)).drop("_n")


def moving_ratio(df: DataFrame, top: str, bottom: str, k: int) -> DataFrame:
    """Eta over k gap-free rows: sum(top * bottom) / sum(bottom^2)."""
    w = track().rowsBetween(0, k - 1)
    whole = (F.max("frame").over(w) - F.col("frame") == k - 1) & (F.count("*").over(w) == k)
    return df.withColumn("eta", F.when(whole, F.try_divide(F.sum(F.col(top) * F.col(bottom)).over(w), F.sum(F.col(bottom) ** 2).over(w)))).where("eta is not null")


def scaled(df: DataFrame, radius: Column, xi: Column, speed: Column, lag: Column, msd: Column) -> DataFrame:
    """x = R / xi, tau* = lag v / xi, msd* = msd / xi^2."""
    return df.withColumns({"x_scaled": radius / xi, "lag_scaled": lag * speed / xi, "msd_scaled": msd / (xi * xi)})


def synchronised_mean(spans: DataFrame, series: DataFrame, column: str) -> DataFrame:
    """Mean of series(exp, frame, column) over each span's [first, last] frames, else the experiment's mean."""
    s = series.select("exp", F.col("frame").alias("_f"), F.col(column).alias("_v"))
    inside = spans.join(s, "exp").where(F.col("_f").between(F.col("first"), F.col("last"))).groupBy(*KEY).agg(F.avg("_v").alias("_in"))
    whole = s.groupBy("exp").agg(F.avg("_v").alias("_all"))
    return spans.join(inside, KEY, "left").join(whole, "exp", "left").withColumn(f"{column}_mean", F.coalesce("_in", "_all")).drop("_in", "_all")


def interpolated(rows: DataFrame, series: DataFrame, column: str) -> DataFrame:
    """series(exp, frame, column) at each row's frame by straight lines, constant beyond the ends; an as-of join in both directions."""
    known = series.select("exp", "frame", F.col(column).alias("_v"), F.lit(None).cast("struct<a:int>").alias("_none")).drop("_none")
    both = rows.select("exp", "frame").distinct().join(known, ["exp", "frame"], "full")
    w = Window.partitionBy("exp").orderBy("frame")
    down, up = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col("frame").alias("f"), F.col("_v").alias("v")))
    both = both.withColumns({"_a": F.last(point, True).over(down), "_b": F.first(point, True).over(up)})
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * F.coalesce(F.try_divide(F.col("frame") - F.col("_a.f"), F.col("_b.f") - F.col("_a.f")), F.lit(0.0))
    value = F.coalesce(line, F.col("_a.v"), F.col("_b.v"))
    return rows.join(both.select("exp", "frame", value.alias(column)), ["exp", "frame"], "left")


def nearest_level(df: DataFrame, keys: list[str], level: str, target: Column) -> DataFrame:
    """Rows at the level nearest the target, the smaller one on ties."""
    best = df.groupBy(*keys).agg(F.min_by(level, F.struct(F.abs(F.col(level) - target), F.col(level))).alias("_best"))
    return df.join(best, keys).where(F.col(level) == F.col("_best")).drop("_best")
