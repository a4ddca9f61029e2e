"""Scans and sinks of tracks, fields and dimension tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.kinematics import KEY

TRACKS = T.StructType([T.StructField("frame", T.IntegerType()), T.StructField("particle", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def read_track_csvs(spark: SparkSession, root: str, name: str = "beads_tracks.csv", schema: T.StructType = TRACKS) -> DataFrame:
    """All <root>/<condition>/<date>/<exp>/<name> as one DataFrame; the path gives condition, date and exp."""
    path = F.input_file_name()
    part = lambda i: F.element_at(F.split(path, "/"), -i)
    return spark.read.option("header", True).schema(schema).csv(f"{root}/*/*/*/{name}").withColumns({"condition": part(4), "date": part(3), "exp": part(2)})


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Hive-partitioned Parquet (condition=.../exp=...); filters on these prune folders."""
    return spark.read.parquet(path)


def read_wide_series(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A labelled array stored as Parquet with its dimensions as columns, without the holes."""
    return spark.read.parquet(path).where(F.col(name).isNotNull() & ~F.isnan(name))


def strided(field: DataFrame, frames: int = 1, pixels: int = 1) -> DataFrame:
    """Every so many frames and pixels; the predicate reaches the scan of a Parquet field."""
    return field.where((F.col("frame") % frames == 0) & (F.col("px") % pixels == 0) & (F.col("py") % pixels == 0))


def carried_axis(field: DataFrame, frames: int) -> DataFrame:
    """Nematic axis of each frame, the last known one carried forward to `frames` frames."""
    angle = F.atan2("v", "u")
    axis = field.where("u <> 0 or v <> 0").groupBy("exp", "frame").agg((F.atan2(F.avg(F.sin(2 * angle)), F.avg(F.cos(2 * angle))) / 2).alias("_a"))
    grid = axis.select("exp").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    w = Window.partitionBy("exp").orderBy("frame")
    return grid.join(axis, ["exp", "frame"], "left").withColumn("theta", F.last("_a", True).over(w)).drop("_a")


def mean_speed_series(speeds: DataFrame) -> DataFrame:
    """Mean speed per (exp, frame)."""
    return speeds.where("v is not null").groupBy("exp", "frame").agg(F.avg("v").alias("mean_v"))


def dimension_with_fallback(rows: DataFrame, by_exp: DataFrame, by_condition: DataFrame, column: str, default: float) -> DataFrame:
    """A column by experiment, else by condition, else the default."""
    out = rows.join(by_exp.withColumnRenamed(column, "_e"), "exp", "left").join(by_condition.withColumnRenamed(column, "_c"), "condition", "left")
    return out.withColumn(column, F.coalesce("_e", "_c", F.lit(default))).drop("_e", "_c")


def reuse(dense: DataFrame, point: str, points: int, stride: int, cutoff: int) -> DataFrame:
    """A request with fewer points and a coarser stride, from a denser result."""
    return dense.where((F.col("frame") % stride == 0) & (F.col(point) < points) & (F.col("frame") <= cutoff))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that the cluster names (spark.checkpoint.dir); a local session without one gets a temporary folder.

    All that an application writes so lies in one folder there, which clear() deletes.
    """
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="motes-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/motes-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has stashed, once no result that reads it is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stashed(df: DataFrame, name: str = "stash") -> DataFrame:
    """df written to the shared folder and read back: computed once, whoever reads it, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet") -> None:
    """One table; Spark's commit makes it appear whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).format(kind).option("header", True).save(path)


def save_tracks(tracks: DataFrame, path: str) -> None:
    """Tracks partitioned by condition and exp, sorted by particle and frame inside files."""
    save(tracks.repartition("condition", "exp").sortWithinPartitions(*KEY, "frame"), path, ["condition", "exp"])
