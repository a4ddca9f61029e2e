"""Joins of particles with particles and with pixels of a field, and what is summed over them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.angles import length


def near_pixels(particles: DataFrame, field: DataFrame, radius: float, inner: float = 0.0, cell: int | None = None) -> DataFrame:
    """(particle row, pixel row, d2) with inner <= distance <= radius in the same (exp, frame).

    Space is cut into cells about a radius wide; a particle goes to the cells its disk may touch (9 at most for
    the default), pixels to their own, and both meet by an equi-join on (exp, frame, cell).
    """
    c = cell or max(1, int(-(-radius // 1)))
    reach = lambda x: F.sequence(F.floor((F.col(x) - radius) / c), F.floor((F.col(x) + radius) / c))
    p = particles.withColumn("_cx", F.explode(reach("x"))).withColumn("_cy", F.explode(reach("y")))
    f = field.withColumns({"_cx": F.floor(F.col("px") / c), "_cy": F.floor(F.col("py") / c)})
    d2 = (F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2
    out = p.join(f, ["exp", "frame", "_cx", "_cy"]).withColumn("d2", d2).where((F.col("d2") <= radius * radius) & (F.col("d2") >= inner * inner))
    return out.drop("_cx", "_cy")


#: Second ends of pairs that one key of the pair join holds, about; it buffers no more (1 MB or so), however many particles a frame or a cell has. First ends are
#: written once for each block they visit, so small blocks would write the square of a crowded frame over the block.
PAIR_BLOCK = 8192


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session's shuffles have. Spark puts small partitions together by their bytes, which say nothing of the pairs that come from them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pairs(rows: DataFrame, keep: list[str], within: float | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """Pairs i < j of particles of the same frame with distance r; columns of the second end in _2.

    With a range, both go to cells of its width and meet in the 3 by 3 neighbourhood; without one, a frame is one cell, and all its pairs are asked for. A cell's particles are
    dealt to as many blocks as its number needs, and each first end visits the blocks of the cells it may reach, so no task holds a frame or a crowded cell.
    Blocks are dealt to tasks by number, not by bytes. What is summed over pairs next is summed in the task that joins: no pair is shuffled.
    """
    cols = ["particle", "x", "y", *keep]
    place = ["exp", "frame"] if within is None else ["exp", "frame", "_cx", "_cy"]
    cell = lambda x: F.floor(F.col(x) / within)
    a = rows.select("exp", "frame", *cols)
    b = rows.select("exp", "frame", *[F.col(c).alias(f"{c}_2") for c in cols])
    if within is not None:
        a = a.withColumn("_cx", F.explode(F.sequence(cell("x") - 1, cell("x") + 1))).withColumn("_cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
        b = b.withColumns({"_cx": cell("x_2"), "_cy": cell("y_2")})
    sizes = b.groupBy(*place).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    a = a.join(sizes, place).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    b = b.join(sizes, place).withColumn("_block", F.pmod(F.xxhash64("particle_2"), F.col("_blocks"))).drop("_blocks")
    r = length(F.col("x_2") - F.col("x"), F.col("y_2") - F.col("y"))
    key = [*place, "_block"]
    met = dealt(a, key).join(dealt(b, key), key).where("particle < particle_2").withColumn("r", r).drop("_cx", "_cy", "_block")
    return met if within is None else met.where(F.col("r") <= within)


def relative_displacements(pairs_: DataFrame) -> DataFrame:
    """Of pairs with (dx, dy), (dx_2, dy_2) and the director theta: dr, the length of the displacement relative to each other, phi, its axial angle to the director
    in [-pi/2, pi/2), and cos2 of twice that angle, 1 along and -1 across. What moves all particles of a frame alike drops out."""
    ddx, ddy = F.col("dx") - F.col("dx_2"), F.col("dy") - F.col("dy_2")
    out = pairs_.withColumns({"dr": length(ddx, ddy), "_phi": F.atan2(ddy, ddx) - F.col("theta")})
    return out.withColumns({"phi": F.pmod(F.col("_phi") + math.pi / 2, F.lit(math.pi)) - math.pi / 2, "cos2": F.cos(2 * F.col("_phi"))}).drop("_phi")


def relative_order(moved_pairs: DataFrame, keys: list[str], least_dr: float) -> DataFrame:
    """Over pairs whose relative displacement is at least least_dr: mean cos2 (above 0: transport along the director), its standard error, mean dr, n."""
    got = moved_pairs.where(F.col("dr") >= least_dr).groupBy(*keys).agg(F.avg("cos2").alias("order"), (F.stddev_samp("cos2") / F.sqrt(F.count("*"))).alias("error"), F.avg("dr").alias("dr"), F.count("*").alias("n"))
    return got.where("n > 1")


def cosine(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Cosine of the angle of two vectors, 0 where one is zero."""
    return F.coalesce(F.try_divide(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by)), F.when(ax.isNotNull() & bx.isNotNull(), F.lit(0.0)))


def pair_moments(rows: DataFrame, keys: list[str], width: float, most: float, block: int = PAIR_BLOCK) -> DataFrame:
    """Over all pairs of a frame nearer than `most`, by `keys` (exp or none), same (whether both ends are of one kind) and bin = floor(r / width): n, mean and m2 (sum of
    squares about the mean) of the cosine of their unit vectors (ux, uy). A particle has one row of (exp, frame, kind, x, y, ux, uy) a frame.

    Particles alike in all this count as one with a number. The others are dealt to blocks of about `block` in cells of the range; blocks meet as arrays, each two of them once,
    and numpy sums over their pairs in the task where they meet, so no row is made for a pair.
    """
    from ..sources.io import stashed
    from .pair_moments import over_blocks

    place = ["exp", "frame", "_cx", "_cy"]
    cell = lambda x: F.floor(F.col(x) / most)
    known = rows.where(reduce(lambda p, q: p & q, [F.abs(c) < float("inf") for c in ("x", "y")])).where("kind is not null and ux is not null and uy is not null")
    alike = known.groupBy("exp", "frame", F.col("kind").cast("int").alias("kind"), "x", "y", F.col("ux").alias("u"), F.col("uy").alias("v")).agg(F.count("*").alias("n"))
    alike = stashed(alike.withColumns({"_cx": cell("x"), "_cy": cell("y")}), "alike")
    sizes = alike.groupBy(*place).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    numbered = alike.join(sizes, place).withColumn("_block", F.pmod(F.xxhash64("x", "y", "u", "v"), F.col("_blocks")))
    held = numbered.groupBy(*place, "_block").agg(F.collect_list(F.struct("x", "y", "u", "v", "n", "kind")).alias("one"))
    # a cell meets itself and half of its neighbours, so that every two blocks meet once
    ahead = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    to = sizes.withColumnRenamed("_blocks", "_blocks_2").withColumnsRenamed({"_cx": "_tx", "_cy": "_ty"})
    visits = sizes.withColumn("_s", ahead).withColumns({"_tx": F.col("_cx") + F.col("_s.a"), "_ty": F.col("_cy") + F.col("_s.b")}).join(to, ["exp", "frame", "_tx", "_ty"])
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    visits = visits.withColumn("_block", number("_blocks")).withColumn("_to", number("_blocks_2")).withColumn("_own", (F.col("_tx") == F.col("_cx")) & (F.col("_ty") == F.col("_cy")))
    visits = visits.where("not _own or _block <= _to").select(*place, "_block", "_tx", "_ty", "_to", (F.col("_own") & (F.col("_block") == F.col("_to"))).alias("_own"))
    second = held.withColumnsRenamed({"_cx": "_tx", "_cy": "_ty", "_block": "_to", "one": "two"})
    met = visits.join(held, [*place, "_block"]).join(second, ["exp", "frame", "_tx", "_ty", "_to"]).select(*keys, "one", F.when(~F.col("_own"), F.col("two")).alias("two"))
    return met.mapInArrow(over_blocks(keys, width, most), T.StructType([*rows.select(*keys).schema.fields, *MOMENTS]))


#: What tasks of pair_moments return besides the keys.
MOMENTS = [T.StructField("same", T.BooleanType()), T.StructField("bin", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("n", "mean", "m2")]]


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """n, mean and m2 of groups from those of their parts, a few for each task, by differences of means: groups of values nearly alike keep their small spread."""
    def two(s, t):
        n, d = s["n"] + t["n"], t["mean"] - s["mean"]
        return F.struct(n.alias("n"), (s["mean"] + d * t["n"] / n).alias("mean"), (s["m2"] + t["m2"] + d * d * s["n"] * t["n"] / n).alias("m2"))

    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2")])
    return parts.groupBy(*keys).agg(F.collect_list(F.struct("n", "mean", "m2")).alias("_p")).select(*keys, F.aggregate("_p", none, two).alias("_m")).select(*keys, F.col("_m.n").cast("long").alias("n"), "_m.mean", "_m.m2")


def pair_correlation_bins(rows: DataFrame, width: float, most: float, least: int = 5, same: str = "even", other: str = "odd") -> DataFrame:
    """C(r): mean, std, sem and n of the pairs' cosine by distance bin, for ends of one kind, of two, and for all."""
    category = F.explode(F.array(F.when(F.col("same"), same).otherwise(other), F.lit("all")))
    got = merged_moments(pair_moments(rows, [], width, most).withColumn("category", category), ["bin", "category"]).where(F.col("n") >= least)
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return got.select("bin", "category", "n", "mean", std.alias("std"), (std / F.sqrt("n")).alias("sem"))


def short_range(pairs_: DataFrame, cutoff: float, least: int = 3) -> DataFrame:
    """Mean cos of pairs nearer than the cut-off per experiment."""
    return pairs_.where(F.col("r") <= cutoff).groupBy("exp").agg(F.avg("cos").alias("order"), F.count("cos").alias("n")).where(F.col("n") >= least)


def frame_pair_mean(rows: DataFrame, u: str, v: str) -> DataFrame:
    """Mean over all pairs of a frame of u_i . u_j, by (|sum u|^2 - sum |u|^2) / (n (n - 1)), without a join."""
    s = (F.sum(u) ** 2 + F.sum(v) ** 2 - F.sum(F.col(u) ** 2 + F.col(v) ** 2)).alias("_s")
    return rows.dropna(subset=[u, v]).groupBy("exp", "frame").agg(s, F.count("*").alias("n")).where("n > 1").select("exp", "frame", (F.col("_s") / (F.col("n") * (F.col("n") - 1))).alias("correlation"), "n")


def interaction(particles: DataFrame, field: DataFrame, radii: list[float], inner: float = 0.0, sigma: float | None = None) -> DataFrame:
    """Around each particle and for each radius: mean dot product and cos with the particle's (dx, dy), mean u and v, std of cos, n.

    One join at the largest radius; smaller disks are filters of its rows. With sigma pixels weigh exp(-d2 / (2 sigma^2)). Empty disks give zeros.
    """
    near = near_pixels(particles, field, max(radii), inner).withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii]))).where(F.col("d2") <= F.col("radius") ** 2)
    w = F.lit(1.0) if sigma is None else F.exp(-F.col("d2") / (2 * sigma * sigma))
    c = cosine(F.col("u"), F.col("v"), F.col("dx"), F.col("dy"))
    rows = near.withColumns({"_w": w, "_c": c, "_d": F.col("u") * F.col("dx") + F.col("v") * F.col("dy")})
    mean = lambda x: F.sum(F.col("_w") * x) / F.sum("_w")
    got = rows.groupBy("exp", "frame", "particle", "radius").agg(mean(F.col("_d")).alias("dot"), mean(F.col("_c")).alias("cos"), mean(F.col("u")).alias("u"), mean(F.col("v")).alias("v"), F.stddev_pop("_c").alias("cos_std"), F.count("*").alias("n"))
    every = particles.select("exp", "frame", "particle").withColumn("radius", F.explode(F.array(*[F.lit(float(r)) for r in radii])))
    return every.join(got, ["exp", "frame", "particle", "radius"], "left").fillna(0, ["dot", "cos", "u", "v", "cos_std", "n"])


def rings(particles: DataFrame, field: DataFrame, sizes: list[tuple[float, float]]) -> DataFrame:
    """For each ring (inner, outer): polar order |<unit flow>|, mean flow, mean speed, share of pixels against the ring's mean flow, nematic angle and order, n.

    The mean is needed before the opposite share: sums first, then the joined rows meet them again under the same partitioning.
    """
    near = near_pixels(particles, field.where("u <> 0 or v <> 0"), max(b for _, b in sizes))
    ring = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("inner"), F.lit(float(b)).alias("outer")) for a, b in sizes]))
    rows = near.withColumn("_r", ring).select("exp", "frame", "particle", "u", "v", "d2", "_r.inner", "_r.outer").where((F.col("d2") >= F.col("inner") ** 2) & (F.col("d2") <= F.col("outer") ** 2)).withColumn("_s", F.hypot("u", "v"))
    keys = ["exp", "frame", "particle", "inner", "outer"]
    ux, uy = F.col("u") / F.col("_s"), F.col("v") / F.col("_s")
    got = rows.groupBy(*keys).agg(F.hypot(F.avg(ux), F.avg(uy)).alias("order"), F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.avg("_s").alias("speed"), (F.atan2(F.avg(2 * ux * uy), F.avg(ux * ux - uy * uy)) / 2).alias("axis"), F.hypot(F.avg(2 * ux * uy), F.avg(ux * ux - uy * uy)).alias("nematic"), F.count("*").alias("n"))
    against = rows.join(got.select(*keys, "mu", "mv"), keys).groupBy(*keys).agg(F.avg((F.round(F.col("u") * F.col("mu") + F.col("v") * F.col("mv"), 12) < 0).cast("double")).alias("opposite"))
    return got.join(against, keys)


def order_by_size(particles: DataFrame, field: DataFrame, most: int) -> DataFrame:
    """Polar order in disks of every radius 1..most around each particle: pixels once by distance class, then running sums over it."""
    from pyspark.sql import Window

    near = near_pixels(particles, field.where("u <> 0 or v <> 0"), most).withColumns({"size": F.greatest(F.lit(1), F.ceil(F.sqrt("d2"))), "_s": F.hypot("u", "v")})
    got = near.groupBy("exp", "frame", "particle", "size").agg(F.sum(F.col("u") / F.col("_s")).alias("_u"), F.sum(F.col("v") / F.col("_s")).alias("_v"), F.count("*").alias("_n"))
    w = Window.partitionBy("exp", "frame", "particle").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    return got.withColumn("n", F.sum("_n").over(w)).withColumn("order", F.hypot(F.sum("_u").over(w), F.sum("_v").over(w)) / F.col("n")).drop("_u", "_v", "_n")


def farthest_cell(field: DataFrame, particles: DataFrame) -> DataFrame:
    """The pixel of each frame farthest from all its particles (smallest px, py on ties): distance to the nearest one.

    In rounds of doubled radius, until none is left: pixels with a particle within it know their distance, the others go on. So a pixel meets only
    particles around it; a round's pixels are written once.
    """
    from ..sources.io import stashed

    p = stashed(particles.select("exp", "frame", "x", "y"), "points")
    left = field.select("exp", "frame", "px", "py").join(p.select("exp", "frame").distinct(), ["exp", "frame"], "left_semi")
    parts, radius = [], 4.0
    while not parts or not left.isEmpty():
        got = stashed(near_pixels(p, left, radius).groupBy("exp", "frame", "px", "py").agg(F.min("d2").alias("_d")), "near")
        parts.append(got)
        left = stashed(left.join(got, ["exp", "frame", "px", "py"], "left_anti"), "left")
        radius *= 2
    near = reduce(DataFrame.unionByName, parts)
    best = F.max_by(F.struct("px", "py", "_d"), F.struct("_d", -F.col("px"), -F.col("py"))).alias("_b")
    return near.groupBy("exp", "frame").agg(best).select("exp", "frame", "_b.px", "_b.py", F.sqrt("_b._d").alias("distance"))


def ring_correlation(particles: DataFrame, field: DataFrame, most: int) -> DataFrame:
    """Per distance class 0..most around each particle the mean unit flow dotted with the flow at the particle's pixel: c, n."""
    unit = field.where("u <> 0 or v <> 0").withColumn("_s", F.hypot("u", "v")).select("exp", "frame", "px", "py", (F.col("u") / F.col("_s")).alias("u"), (F.col("v") / F.col("_s")).alias("v"))
    centre = particles.withColumns({"px": F.rint("x").cast("int"), "py": F.rint("y").cast("int")}).join(unit.withColumnsRenamed({"u": "cu", "v": "cv"}), ["exp", "frame", "px", "py"]).drop("px", "py")
    near = near_pixels(centre, unit, most).withColumn("distance", F.floor(F.sqrt("d2")))
    return near.groupBy("exp", "frame", "particle", "distance").agg(F.avg(F.col("u") * F.col("cu") + F.col("v") * F.col("cv")).alias("c"), F.count("*").alias("n"))


def sampled_pixels(field: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """N pixels of each frame as virtual particles, by rank of an md5 of seed and place: the same for every plan."""
    from pyspark.sql import Window

    key = F.md5(F.concat_ws("|", F.lit(seed), "exp", "frame", "px", "py"))
    w = Window.partitionBy("exp", "frame").orderBy("_k")
    ranked = field.where("u <> 0 or v <> 0").withColumn("_k", key).withColumn("particle", F.row_number().over(w))
    return ranked.where(F.col("particle") <= n).select("exp", "frame", "particle", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))


def baseline_corrected(curve: DataFrame, mean_square: DataFrame) -> DataFrame:
    """(c - m) / (1 - m) with m the frame's squared mean unit flow, then mean and sem over frames of each experiment and distance."""
    rows = curve.groupBy("exp", "frame", "distance").agg(F.avg("c").alias("c")).join(mean_square, ["exp", "frame"]).withColumn("c", F.try_divide(F.col("c") - F.col("m"), 1 - F.col("m")))
    return rows.groupBy("exp", "distance").agg(F.avg("c").alias("mean"), (F.stddev_samp("c") / F.sqrt(F.count("c"))).alias("sem"), F.count("c").alias("n"))


def pooled_from_sums(df: DataFrame, value: str, keys: list[str], parts: list[str]) -> DataFrame:
    """Mean and std of groups from the (n, sum, sum of squares) of their parts."""
    s = df.groupBy(*keys, *parts).agg(F.count(value).alias("_n"), F.sum(value).alias("_1"), F.sum(F.col(value) ** 2).alias("_2"))
    g = s.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_1").alias("_1"), F.sum("_2").alias("_2"))
    return g.select(*keys, "n", (F.col("_1") / F.col("n")).alias("mean"), F.sqrt(F.greatest(F.col("_2") / F.col("n") - (F.col("_1") / F.col("n")) ** 2, F.lit(0.0))).alias("std"))


def radial_speed(particles: DataFrame, field: DataFrame, edge: float, most: float, width: float, lag: int = 0) -> DataFrame:
    """Mean speed by distance from the particle's edge, over the far plateau's (outer half) of the frame and of the movie; lag: the flow so many frames before."""
    past = field.withColumn("frame", F.col("frame") + lag)
    near = near_pixels(particles, past, edge + most, edge).withColumns({"s": F.hypot("u", "v"), "bin": F.floor((F.sqrt("d2") - edge) / width)})
    # sums of bins in frames first; plateaus and ratios need nothing else
    b = near.groupBy("exp", "frame", "bin").agg(F.sum("s").alias("_s"), F.count("*").alias("_n"))
    far = (F.col("bin") + 0.5) * width > most / 2
    plateau = lambda *keys: F.try_divide(F.sum(F.when(far, F.col("_s"))).over(Window.partitionBy(*keys)), F.sum(F.when(far, F.col("_n"))).over(Window.partitionBy(*keys)))
    b = b.withColumns({"_f": plateau("exp", "frame"), "_m": plateau("exp")})
    n = F.sum("_n")
    by_frame = F.try_divide(F.sum(F.try_divide("_s", "_f")), F.sum(F.when(F.col("_f") != 0, F.col("_n"))))
    return b.groupBy("exp", "bin").agg((F.sum("_s") / n).alias("speed"), by_frame.alias("by_frame"), F.try_divide(F.sum("_s") / n, F.first("_m")).alias("by_movie"), n.alias("n"))


def depth_series(particles: DataFrame, field: DataFrame, edge: float, most: float, near: float, lags: list[int]) -> DataFrame:
    """The slowdown's depth by lag: exp, lag, depth and error. The flow so many frames before is compared around today's particle: depth is 1 less the mean speed
    within `near` of its edge over that of the outer half; the error comes from both standard errors.
    """
    past = field.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("frame", F.col("frame") + F.col("lag"))
    rows = near_pixels(particles, past, edge + most, edge).withColumns({"_s": F.hypot("u", "v"), "_r": F.sqrt("d2") - edge})
    inner, outer = F.when(F.col("_r") < near, F.col("_s")), F.when(F.col("_r") >= most / 2, F.col("_s"))
    sem = lambda x: F.stddev_samp(x) / F.sqrt(F.count(x))
    g = rows.groupBy("exp", "lag").agg(F.avg(inner).alias("_a"), F.avg(outer).alias("_b"), sem(inner).alias("_ea"), sem(outer).alias("_eb"))
    ratio = F.try_divide("_a", "_b")
    return g.select("exp", "lag", (1 - ratio).alias("depth"), (ratio * F.sqrt(F.try_divide("_ea", "_a") ** 2 + F.try_divide("_eb", "_b") ** 2)).alias("error"))


def disk_order(particles: DataFrame, spun: DataFrame, radius: float, least: int = 1) -> DataFrame:
    """Spins in a disk under each particle: magnetisation m, polar order p, n (pixels with a direction); disks with fewer than `least` of them go."""
    near = near_pixels(particles, spun, radius)
    got = near.groupBy("exp", "frame", "particle").agg(F.avg("spin").alias("m"), F.hypot(F.avg("u"), F.avg("v")).alias("p"), F.count("*").alias("n")).where(F.col("n") >= least)
    return particles.join(got, ["exp", "frame", "particle"])


def local_length_map(field: DataFrame, step: int, most: int, first: float = 0.05, least: float = 1e-3, bounds: tuple[float, float] = (0.05, 200.0), fit: float = 0.0) -> DataFrame:
    """Correlation length xi around every step-th pixel of a frame: exp, frame, px, py, xi, a, r2.

    The local curve is c(r), the mean unit flow at distance class r dotted with the flow at the pixel, r = 1..most. Pixels whose first c is not over `first`
    go; ln c = ln a - r / xi is fitted where c > least, at 3 points or more, to a falling line; xi stays inside bounds. A fit with
    r2 (of c itself) below `fit` stays only for xi under 2.
    """
    grid = field.where((F.col("px") % step == 0) & (F.col("py") % step == 0)).select("exp", "frame", (F.col("py").cast("long") * 1_000_000 + F.col("px")).alias("particle"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))
    curve = ring_correlation(grid, field, most + 1).where(F.col("distance").between(1, most)).select("exp", "frame", "particle", F.col("distance").cast("double").alias("r"), "c")
    keys = ["exp", "frame", "particle"]
    use = F.col("c") > least
    logc, r = F.when(use, F.log(F.when(use, F.col("c")))), F.when(use, F.col("r"))
    f = curve.groupBy(*keys).agg(F.min_by("c", "r").alias("_1"), F.regr_slope(logc, r).alias("_s"), F.regr_intercept(logc, r).alias("_i"), F.count(logc).alias("_n")).where((F.col("_1") > first) & (F.col("_n") >= 3) & (F.col("_s") < -1e-6))
    f = f.select(*keys, F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), -1 / F.col("_s"))).alias("xi"), F.least(F.lit(1.5), F.exp("_i")).alias("a"))
    e = (F.col("c") - F.col("a") * F.exp(-F.col("r") / F.col("xi"))) ** 2
    q = curve.join(f, keys).groupBy(*keys, "xi", "a").agg(F.sum(e).alias("_e"), (F.var_pop("c") * F.count("*")).alias("_t"))
    out = q.withColumn("r2", F.when(F.col("_t") > 1e-9, 1 - F.col("_e") / (F.col("_t") + 1e-9)).otherwise(0.0)).where((F.col("r2") >= fit) | (F.col("xi") < 2))
    return out.select("exp", "frame", (F.col("particle") % 1_000_000).alias("px"), F.floor(F.col("particle") / 1_000_000).alias("py"), "xi", "a", "r2")


def length_moments(lengths: DataFrame, keys: list[str], least: int = 10) -> DataFrame:
    """Mean, median and std (population) of the lengths, and alpha2 = <xi^4> / (3 <xi^2>^2) - 1; maps are first averaged over frames."""
    m = lengths.groupBy(*keys, "px", "py").agg(F.avg("xi").alias("xi"))
    return m.groupBy(*keys).agg(F.avg("xi").alias("mean"), F.percentile("xi", 0.5).alias("median"), F.stddev_pop("xi").alias("std"), (F.avg(F.col("xi") ** 4) / (3 * F.avg(F.col("xi") ** 2) ** 2) - 1).alias("alpha2"), F.count("*").alias("n")).where(F.col("n") >= least)


def slowdown(profiles: DataFrame, xi: DataFrame, near: float) -> DataFrame:
    """Of profiles(source, condition, exp, r, value), the speed over the far speed at distance r from the edge: per movie the slowdown 1 - value at the edge
    (the first point) and the mean one at r / xi < near."""
    rows = profiles.where("value is not null").join(xi.where("xi > 0"), "exp")
    keys = ["source", "condition", "exp", "xi"]
    return rows.groupBy(*keys).agg((1 - F.min_by("value", "r")).alias("edge"), (1 - F.avg(F.when(F.col("r") / F.col("xi") < near, F.col("value")))).alias("near"))


def slowdown_by_size(movies: DataFrame) -> DataFrame:
    """Mean and sem over movies of each source and condition."""
    cols = [c for v in ("edge", "near") for c in (F.avg(v).alias(v), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{v}_sem"))]
    return movies.groupBy("source", "condition").agg(*cols, F.count("*").alias("n"))


def on_scaled_grid(profiles: DataFrame, xi: DataFrame, grid: list[float]) -> DataFrame:
    """Each movie's profile at points of r / xi, by straight lines between its points (the first value before them, null after them), then the mean over movies."""
    w = Window.partitionBy("source", "condition", "exp").orderBy("q")
    p = profiles.where("value is not null").join(xi.where("xi > 0"), "exp").withColumn("q", F.col("r") / F.col("xi"))
    p = p.withColumns({"_q": F.lead("q").over(w), "_v": F.lead("value").over(w), "_first": F.row_number().over(w) == 1, "at": F.array(*[F.lit(float(g)) for g in grid])}).withColumn("at", F.explode("at"))
    inside = (F.col("at") >= F.col("q")) & ((F.col("at") < F.col("_q")) | (F.col("_q").isNull() & (F.col("at") == F.col("q"))))
    value = F.when(inside, F.coalesce(F.col("value") + (F.col("_v") - F.col("value")) * (F.col("at") - F.col("q")) / (F.col("_q") - F.col("q")), F.col("value"))).when(F.col("_first") & (F.col("at") < F.col("q")), F.col("value"))
    return p.withColumn("y", value).where("y is not null").groupBy("source", "condition", "at").agg(F.avg("y").alias("mean"), F.count("*").alias("n"))


def sampled_field(particles: DataFrame, field: DataFrame, column: str) -> DataFrame:
    """Bilinear value of a field column at each particle, null unless all four corners exist."""
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    p = particles.withColumn("_c", corners).withColumns({"px": (F.floor("x") + F.col("_c.a")).cast("int"), "py": (F.floor("y") + F.col("_c.b")).cast("int")})
    w = (1 - F.abs(F.col("x") - F.col("px"))) * (1 - F.abs(F.col("y") - F.col("py")))
    got = p.join(field.select("exp", "frame", "px", "py", F.col(column).alias("_v")), ["exp", "frame", "px", "py"], "left")
    return got.groupBy("exp", "frame", "particle").agg(F.when(F.count("_v") == 4, F.sum(w * F.col("_v"))).alias(column))


def radial_distribution(particles: DataFrame, field: DataFrame, value: Column, most: int) -> DataFrame:
    """Mean value by integer distance around particles over the frame's mean, and -ln of it."""
    f = field.withColumn("_v", value)
    mean = f.groupBy("exp", "frame").agg(F.avg("_v").alias("_m"))
    near = near_pixels(particles, f, most).withColumn("distance", F.floor(F.sqrt("d2"))).where(F.col("distance") < most)
    g = near.join(mean, ["exp", "frame"]).groupBy("exp", "distance").agg((F.avg("_v") / F.avg("_m")).alias("g"), F.count("*").alias("n"))
    return g.withColumn("potential", F.when(F.col("g") > 0, -F.log("g")))


def hidden_vector(df: DataFrame, keys: list[str], u: str, v: str, d: str) -> DataFrame:
    """The vector (hx, hy) of each group whose dot products with (u, v) are d, by least squares; the shortest one if all (u, v) are collinear."""
    s = df.groupBy(*keys).agg(F.sum(F.col(u) ** 2).alias("_a"), F.sum(F.col(u) * F.col(v)).alias("_b"), F.sum(F.col(v) ** 2).alias("_c"), F.sum(F.col(u) * F.col(d)).alias("_p"), F.sum(F.col(v) * F.col(d)).alias("_q"))
    s = s.where("_a is not null")  # groups without a known product
    det, trace = F.col("_a") * F.col("_c") - F.col("_b") ** 2, F.col("_a") + F.col("_c")
    full = det > 1e-9 * trace * trace  # below, rounding of the sums would decide
    safe = F.when(full, det)
    return s.select(*keys, F.when(full, (F.col("_c") * F.col("_p") - F.col("_b") * F.col("_q")) / safe).otherwise(F.try_divide("_p", trace)).alias("hx"), F.when(full, (F.col("_a") * F.col("_q") - F.col("_b") * F.col("_p")) / safe).otherwise(F.try_divide("_q", trace)).alias("hy"))
