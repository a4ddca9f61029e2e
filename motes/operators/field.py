"""Operators on a field alone: blocks, neighbourhoods, two-point statistics, gradients. Fields are (exp, frame, px, py, u, v); missing pixels are absent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import cosine


def unit(field: DataFrame) -> DataFrame:
    """u and v as unit vectors; zero vectors go."""
    s = F.hypot("u", "v")
    return field.where("u <> 0 or v <> 0").withColumns({"u": F.col("u") / s, "v": F.col("v") / s})


def frame_order(field: DataFrame) -> DataFrame:
    """Per frame the nematic axis and order, polar order, n."""
    f = unit(field)
    c, s = F.avg(F.col("u") ** 2 - F.col("v") ** 2), F.avg(2 * F.col("u") * F.col("v"))
    return f.groupBy("exp", "frame").agg((F.atan2(s, c) / 2).alias("axis"), F.hypot(c, s).alias("nematic"), F.hypot(F.avg("u"), F.avg("v")).alias("polar"), (F.avg("u") ** 2 + F.avg("v") ** 2).alias("m"), F.count("*").alias("n"))


def spins(field: DataFrame, theta: DataFrame) -> DataFrame:
    """Spin +1 or -1 of each pixel along its frame's axis, 0 if perpendicular."""
    return unit(field).join(theta, ["exp", "frame"]).withColumn("spin", F.signum(F.round(F.col("u") * F.cos("theta") + F.col("v") * F.sin("theta"), 12))).drop("theta")


def spin_fractions(spun: DataFrame, keys: list[str]) -> DataFrame:
    """Fractions of + and -, bias (mean spin)."""
    s = F.col("spin")
    return spun.groupBy(*keys).agg(F.avg((s > 0).cast("double")).alias("plus"), F.avg((s < 0).cast("double")).alias("minus"), F.avg(s).alias("bias"), F.count("*").alias("n"))


def blocks(spun: DataFrame, window: int, step: int, low: float, size: int) -> DataFrame:
    """Magnetisation m and polar order p of every whole block of a size x size frame with a share `low` of valid pixels, and their relative gap.

    A pixel goes to the (window / step)^2 blocks that cover it.
    """
    starts = lambda p: F.filter(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(p) - window + 1) / step)), F.floor(F.col(p) / step)), lambda i: i * step + window <= size)
    ok = F.greatest(F.lit(0), F.ceil((F.col("px") - window + 1) / step)) <= F.floor(F.col("px") / step)
    ok = ok & (F.greatest(F.lit(0), F.ceil((F.col("py") - window + 1) / step)) <= F.floor(F.col("py") / step))
    rows = spun.where(ok).withColumn("bx", F.explode(starts("px"))).withColumn("by", F.explode(starts("py")))
    got = rows.groupBy("exp", "frame", "bx", "by").agg(F.avg("spin").alias("m"), F.hypot(F.avg("u"), F.avg("v")).alias("p"), F.count("*").alias("n")).where(F.col("n") >= low * window * window)
    return got.withColumn("gap", F.try_divide(F.abs(F.col("p") - F.abs("m")), F.col("p")))


def block_curve(spun: DataFrame, windows: list[int], low: float, size: int) -> DataFrame:
    """Mean |m|, m, m^2, p and number of blocks for each window, without overlap: one pass, a pixel once for each window."""
    rows = spun.withColumn("window", F.explode(F.array(*[F.lit(w) for w in windows]))).withColumns({"bx": F.floor(F.col("px") / F.col("window")), "by": F.floor(F.col("py") / F.col("window"))})
    rows = rows.where(((F.col("bx") + 1) * F.col("window") <= size) & ((F.col("by") + 1) * F.col("window") <= size))
    b = rows.groupBy("exp", "frame", "window", "bx", "by").agg(F.avg("spin").alias("m"), F.hypot(F.avg("u"), F.avg("v")).alias("p"), F.count("*").alias("n")).where(F.col("n") >= low * F.col("window") ** 2)
    return b.groupBy("exp", "window").agg(F.avg(F.abs("m")).alias("abs_m"), F.avg("m").alias("m"), F.avg(F.col("m") ** 2).alias("m2"), F.avg("p").alias("p"), F.count("*").alias("blocks"))


def disks(spun: DataFrame, radius: int, step: int) -> DataFrame:
    """M and p in disks around every step-th pixel position: pixels go to the centres that they are near."""
    near = lambda p: F.sequence(F.ceil((F.col(p) - radius) / step), F.floor((F.col(p) + radius) / step))
    rows = spun.withColumn("cx", F.explode(near("px"))).withColumn("cy", F.explode(near("py"))).where((F.col("cx") * step - F.col("px")) ** 2 + (F.col("cy") * step - F.col("py")) ** 2 <= radius * radius)
    return rows.groupBy("exp", "frame", "cx", "cy").agg(F.avg("spin").alias("m"), F.hypot(F.avg("u"), F.avg("v")).alias("p"), F.count("*").alias("n"))


def order_moments(disk: DataFrame) -> DataFrame:
    """Mean and population variance of the disks' order per experiment."""
    return disk.groupBy("exp").agg(F.avg("p").alias("mean"), F.var_pop("p").alias("variance"), F.count("*").alias("n"))


def neighbourhood_order(field: DataFrame, reach: int) -> DataFrame:
    """2 <cos^2 d - 1/2> of each pixel against the others of its square, then the frame's median; needs only sums of cos 2 and sin 2, first along rows, then down columns."""
    f = unit(field).withColumns({"c": F.col("u") ** 2 - F.col("v") ** 2, "s": 2 * F.col("u") * F.col("v")})
    # sums over each row of the square for every px that it reaches, then sums of those down the columns
    strip = f.withColumn("_at", F.explode(F.sequence(F.col("px") - reach, F.col("px") + reach))).groupBy("exp", "frame", "py", "_at").agg(F.sum("c").alias("_c"), F.sum("s").alias("_s"), F.count("*").alias("_n"))
    col = Window.partitionBy("exp", "frame", "_at").orderBy("py").rangeBetween(-reach, reach)
    whole = strip.withColumns({"_C2": F.sum("_c").over(col), "_S2": F.sum("_s").over(col), "_N2": F.sum("_n").over(col)}).select("exp", "frame", "py", F.col("_at").alias("px"), "_C2", "_S2", "_N2")
    got = f.select("exp", "frame", "px", "py", "c", "s").join(whole, ["exp", "frame", "px", "py"]).where("_N2 > 1")
    # <cos 2 d> over the others: (C c + S s - 1) / (N - 1)
    order = (F.col("_C2") * F.col("c") + F.col("_S2") * F.col("s") - 1) / (F.col("_N2") - 1)
    return got.withColumn("order", order).groupBy("exp", "frame").agg(F.percentile("order", 0.5).alias("median"), F.avg("order").alias("mean"), F.count("*").alias("n"))


def offsets(most: int) -> list[tuple[int, int]]:
    """Half of the offsets (dx, dy) with length 1..most, one of each opposite pair."""
    return [(x, y) for x in range(0, most + 1) for y in range(-most, most + 1) if (x > 0 or y > 0) and x * x + y * y <= most * most]


def two_point(field: DataFrame, most: int, size: int | None = None) -> DataFrame:
    """Per distance class (floor) the mean of unit-vector dot products c, of c^2, their four-point part <c^2> - <c>^2, n pairs.

    Without size pairs end at the frame's edge; with it the frame is a torus of size x size pixels, as for a circular convolution. Pixels are moved by each offset of a fixed list and meet by an equi-join; sums per frame combine before the shuffle.
    """
    f = unit(field)
    o = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(int((x * x + y * y) ** 0.5)).alias("d")) for x, y in offsets(most)]))
    at = lambda p, c: F.col(p) + F.col(c) if size is None else F.pmod(F.col(p) + F.col(c), F.lit(size))
    moved = f.withColumn("_o", o).select("exp", "frame", at("px", "_o.x").alias("px"), at("py", "_o.y").alias("py"), F.col("_o.d").alias("distance"), F.col("u").alias("u2"), F.col("v").alias("v2"))
    c = F.col("u") * F.col("u2") + F.col("v") * F.col("v2")
    got = moved.join(f, ["exp", "frame", "px", "py"]).withColumn("_c", c).groupBy("exp", "distance").agg(F.avg("_c").alias("c"), F.avg(F.col("_c") ** 2).alias("c2"), F.count("*").alias("n"))
    return got.withColumn("four_point", F.col("c2") - F.col("c") ** 2)


def gradients(field: DataFrame) -> DataFrame:
    """Normal and shear strain, vorticity and Q by central differences of neighbouring pixels, one-sided at edges and holes; pixels without a neighbour on an axis go."""
    out = field
    for axis, other in (("px", "py"), ("py", "px")):
        w = Window.partitionBy("exp", "frame", other).orderBy(axis)
        before, after = F.lag(axis).over(w) == F.col(axis) - 1, F.lead(axis).over(w) == F.col(axis) + 1
        for c in ("u", "v"):
            a, b = F.lag(c).over(w), F.lead(c).over(w)
            out = out.withColumn(f"_{c}{axis[1]}", F.when(before & after, (b - a) / 2).when(after, b - F.col(c)).when(before, F.col(c) - a))
    out = out.dropna(subset=["_ux", "_uy", "_vx", "_vy"])
    out = out.withColumns({"normal": F.col("_ux") - F.col("_vy"), "shear": F.col("_vx") + F.col("_uy"), "vorticity": F.col("_vx") - F.col("_uy")}).drop("_ux", "_uy", "_vx", "_vy")
    return out.withColumn("q", F.col("normal") ** 2 + F.col("shear") ** 2 - F.col("vorticity") ** 2)


def mergeable(df: DataFrame, value: Column, keys: list[str]) -> DataFrame:
    """N, sum, sum of squares and sign counts, from which mean, variance and fractions follow for any union of groups."""
    return df.withColumn("_v", value).groupBy(*keys).agg(F.count("_v").alias("n"), F.sum("_v").alias("sum"), F.sum(F.col("_v") ** 2).alias("square"), F.count_if(F.col("_v") > 0).alias("positive"), F.count_if(F.col("_v") < 0).alias("negative"))


def area_fraction(field: DataFrame, inside: Column) -> DataFrame:
    """Share of pixels of each frame."""
    return field.groupBy("exp", "frame").agg(F.avg(inside.cast("double")).alias("fraction"))


def transfer(df: DataFrame, keys: list[str]) -> DataFrame:
    """G39, G41, G42 of rows (vx, vy, u, v): efficiency sum v.u / sqrt(sum v^2 sum u^2), gain sum v.u / sum u^2, alignment A = <cos>, speed ratio, eta A."""
    dot = F.col("vx") * F.col("u") + F.col("vy") * F.col("v")
    vv, uu = F.col("vx") ** 2 + F.col("vy") ** 2, F.col("u") ** 2 + F.col("v") ** 2
    c = cosine(F.col("vx"), F.col("vy"), F.col("u"), F.col("v"))
    out = df.groupBy(*keys).agg(F.try_divide(F.sum(dot), F.sqrt(F.sum(vv) * F.sum(uu))).alias("efficiency"), F.try_divide(F.sum(dot), F.sum(uu)).alias("gain"), F.avg(c).alias("alignment"), F.try_divide(F.avg(F.sqrt(vv)), F.avg(F.sqrt(uu))).alias("eta"), F.count("*").alias("n"))
    return out.withColumn("eta_alignment", F.col("eta") * F.col("alignment"))
