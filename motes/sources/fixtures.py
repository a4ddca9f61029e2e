"""Views of tracks and fields over the driver's tables, as Spark DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Start of the 6-hour slots of tracks_gap.
EPOCH = "2024-01-01 00:00:00"


class Views:
    """tracks(condition, exp, particle, frame, x, y), gaps (the same with missing frames), field(exp, frame, px, py, u, v) and dimensions."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tracks(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("condition"), F.concat(F.lit("e"), F.col("user_id") % 6).alias("exp"), F.col("user_id").alias("particle"), (F.row_number().over(w) - 1).alias("frame"), F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))

    @cached_property
    def gaps(self) -> DataFrame:
        slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / 21600e6).cast("int")
        w = Window.partitionBy("user_id", "frame").orderBy("ts", "event_id")
        rows = self.table("events").withColumn("frame", slot).withColumn("_n", F.row_number().over(w)).where("_n = 1")
        return rows.select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("condition"), F.concat(F.lit("e"), F.col("user_id") % 6).alias("exp"), F.col("user_id").alias("particle"), "frame", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))

    @cached_property
    def field(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.concat(F.lit("e"), F.col("l_linenumber") % 6).alias("exp"), (F.year("l_shipdate") - 1995).cast("int").alias("frame"), (F.col("l_partkey") % 32).cast("int").alias("px"), (F.col("l_suppkey") % 32).cast("int").alias("py"))
            .agg(F.round(F.avg(F.col("l_discount") - 0.05), 9).alias("u"), F.round(F.avg(F.col("l_tax") - 0.04), 9).alias("v"))
        )

    @cached_property
    def on_field(self) -> DataFrame:
        """One position per (particle, frame modulo 7) inside the field."""
        return self.tracks.groupBy("condition", "exp", "particle", (F.col("frame") % 7).alias("frame")).agg((F.min("x") % 32).alias("x"), (F.min("y") % 32).alias("y"))

    @cached_property
    def cond(self) -> DataFrame:
        return self.spark.createDataFrame([("c0", 0.63, 0.315), ("c1", 3.37, 1.685), ("c2", 7.24, 3.62)], "condition string, diameter_um double, radius_um double")

    @cached_property
    def cutoffs(self) -> DataFrame:
        return self.spark.createDataFrame([("e1", 60), ("e4", 30)], "exp string, cutoff_frame int")

    @cached_property
    def active(self) -> DataFrame:
        return self.tracks.groupBy("exp", "particle").count().where("count >= 60").select("exp", "particle")

    @cached_property
    def theta(self) -> DataFrame:
        """Nematic axis of the field per (exp, frame)."""
        angle = F.atan2("v", "u")
        return self.field.where("u <> 0 or v <> 0").groupBy("exp", "frame").agg((F.atan2(F.avg(F.sin(2 * angle)), F.avg(F.cos(2 * angle))) / 2).alias("theta"))


#: The same as DuckDB common table expressions.
CTES = {
    "tracks": "select 'c'||(user_id%3) as condition, 'e'||(user_id%6) as exp, user_id as particle, row_number() over (partition by user_id order by ts, event_id) - 1 as frame, value as x, json_extract_string(props,'$.k')::double as y from events",
    "gaps": "select 'c'||(user_id%3) as condition, 'e'||(user_id%6) as exp, user_id as particle, frame, value as x, json_extract_string(props,'$.k')::double as y from (select *, floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 21600e6)::int as frame from events) qualify row_number() over (partition by user_id, frame order by ts, event_id) = 1",
    "field": "select 'e'||(l_linenumber%6) as exp, (year(l_shipdate)-1995)::int as frame, (l_partkey%32)::int as px, (l_suppkey%32)::int as py, round(avg(l_discount-0.05),9) as u, round(avg(l_tax-0.04),9) as v from lineitem group by 1,2,3,4",
    "on_field": "select condition, exp, particle, frame%7 as frame, min(x)%32 as x, min(y)%32 as y from tracks group by 1,2,3,4",
    "cond": "select * from (values ('c0',0.63::double,0.315::double),('c1',3.37,1.685),('c2',7.24,3.62)) t(condition,diameter_um,radius_um)",
    "cutoffs": "select * from (values ('e1',60),('e4',30)) t(exp,cutoff_frame)",
    "active": "select exp, particle from tracks group by 1,2 having count(*) >= 60",
    "theta": "select exp, frame, atan2(avg(sin(2*atan2(v,u))), avg(cos(2*atan2(v,u))))/2 as theta from field where u<>0 or v<>0 group by 1,2",
}
NEEDS = {"on_field": ("tracks",), "active": ("tracks",), "theta": ("field",)}
