"""Registered queries that write and read: scans, sinks and streams over files that Spark makes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kinematics as kin
from ..operators import lagstats as lag
from ..sources import io
from ..streaming import forms
from .fields import CORR
from .lags import IMSD, L
from .registry import register
from .states import HYS
from .tracks import GSTEP


def _stored(t, df, kind: str = "parquet", by: list[str] | None = None):
    """df written once and read again, as any later step does."""
    path = io.scratch(t.spark, "stored")
    io.save(df, path, by, kind)
    return t.spark.read.option("header", True).schema(df.schema).format(kind).load(path)


def _tracks(t):
    path = io.scratch(t.spark, "tracks")
    io.save_tracks(t.tracks, path)
    return io.read_tracks(t.spark, path)


def _stream(t, df, schema_columns: list[str]):
    """A stream over df's rows as files."""
    path = io.scratch(t.spark, "arriving")
    rows = df.select(*schema_columns)
    io.save(rows, path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


def _drained(t, stream):
    return forms.drained(stream, "result", io.scratch(t.spark, "stream"))


register("s01_partitioned_tracks", "condition exp | particle frame | x y", lambda t: _tracks(t).where("condition <> 'c1' and exp >= 'e2'"), "select * from tracks where condition<>'c1' and exp>='e2'")
register("s04_labelled_series", "exp | distance n | mean", lambda t: _series(t).groupBy("exp", "distance").agg(F.avg("c").alias("mean"), F.count("c").alias("n")), f"with {CORR} select exp, distance, avg(c) as mean, count(c) as n from rc group by 1,2")
register("s07_materialised", "condition exp | particle lag n | msd", lambda t: _stored(t, lag.imsd(t.tracks, L).select("condition", "exp", "particle", "lag", "n", "msd")), f"with {IMSD} select * from im")
register("s09_csv_summary", "condition exp | n | x", lambda t: _stored(t, t.tracks.groupBy("condition", "exp").agg(F.count("*").alias("n"), F.avg("x").alias("x")), "csv"), "select condition, exp, count(*) as n, avg(x) as x from tracks group by 1,2")
register("s10_fleet", "condition exp | particles rows | path", lambda t: kin.lag_displacement(_tracks(t), 1).groupBy("condition", "exp").agg(F.countDistinct("particle").alias("particles"), F.count("r").alias("rows"), F.sum("r").alias("path")), "with s as (select condition, exp, particle, sqrt(pow(lead(x) over w-x,2)+pow(lead(y) over w-y,2)) as r from tracks window w as (partition by exp, particle order by frame)) select condition, exp, count(distinct particle) filter (where r is not null) as particles, count(r) as rows, sum(r) as path from s group by 1,2")


def _series(t):
    """Ring correlations as a labelled array (distance, frame, particle) with its holes, stored and read without them."""
    from ..operators import spatial as spa

    path = io.scratch(t.spark, "series")
    curve = spa.ring_correlation(t.on_field, t.field, 5).select("exp", "distance", "frame", "particle", "c")
    grid = curve.select("exp", "frame", "particle").distinct().withColumn("distance", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    io.save(grid.join(curve, ["exp", "distance", "frame", "particle"], "left"), path)
    return io.read_wide_series(t.spark, path, "c")


ROWS = ["exp", "particle", "frame", "x", "y"]
timed = lambda t: forms.with_time(_stream(t, t.gaps, ROWS), 4)
# what the watermark (the last event's time less a second) has passed
register("o01_window_moments", "exp | slot n positive | sum square", lambda t: _drained(t, forms.window_moments(timed(t), "x", "40 seconds", "1 second")).withColumn("slot", F.floor((F.unix_micros("window.start") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 40e6)),
         "with e as (select max(frame)*4-1 as late from gaps) select exp, floor(frame*4/40) as slot, count(*) as n, sum(x) as sum, sum(x*x) as square, count(*) filter (where x>0) as positive from gaps cross join e group by exp, floor(frame*4/40), late having (floor(frame*4/40)+1)*40<=late")
register("o01_window_histogram", "exp | slot n vortex strain neutral bin count | sum square least most", lambda t: _drained(t, forms.window_statistics(timed(t), "x", "40 seconds", 0.0, 100.0, 10, "1 second")).select("*", F.posexplode("counts").alias("bin", "count")).withColumn("slot", F.floor((F.unix_micros("window.start") - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 40e6)),
         "with e as (select max(frame)*4-1 as late from gaps), g as (select exp, floor(frame*4/40) as slot, count(x) as n, sum(x) as sum, sum(x*x) as square, count(*) filter (where x<0) as vortex, count(*) filter (where x>0) as strain, count(*) filter (where x=0) as neutral, min(x) as least, max(x) as most from gaps cross join e group by exp, floor(frame*4/40), late having (floor(frame*4/40)+1)*40<=late), h as (select exp, floor(frame*4/40) as slot, least(floor(x/10),9) as bin, count(*) as c from gaps where x between 0 and 100 group by all) select g.*, b.bin, coalesce(h.c,0) as \"count\" from g cross join (select unnest(range(10)) as bin) b left join h on h.exp=g.exp and h.slot=g.slot and h.bin=b.bin")
register("o02_dwell_runs", "exp | particle state first last n censored | ", lambda t: _drained(t, forms.dwell_runs(_stream(t, t.gaps, ROWS), "y", 20.0, 60.0)),
         f"with {HYS}, rc as (select *, sum(case when state<>ps or segment<>pg then 1 else 0 end) over (partition by exp, particle order by frame) as run from (select *, lag(state) over w as ps, lag(segment) over w as pg from st window w as (partition by exp, particle order by frame))), rn as (select exp, particle, run, any_value(state) as state, any_value(segment) as segment, min(frame) as first, max(frame) as last, count(*) as n from rc group by 1,2,3), nx as (select *, lead(segment) over (partition by exp, particle order by run) as ng from rn) select exp, particle, state, first, last, n, (ng<>segment)::int as censored from nx where ng is not null")
# rows in the order of another column; only what lies before the watermark (a minute behind the last event) is taken, and tracks silent for 100 seconds before it are closed
shuffled = lambda t: forms.with_time(_stream(t, t.gaps.orderBy(F.xxhash64("particle", "frame")), ROWS), 4)
register("o02_ordered_runs", "exp | particle state first last n censored | ", lambda t: _drained(t, forms.ordered_runs(shuffled(t), "y", 20.0, 60.0, "60 seconds", 100_000)),
         f"with {HYS.replace('from gaps', 'from (select * from gaps cross join (select max(frame)*4-60 as late from gaps) where frame*4<late)')}, rc as (select *, sum(case when state<>ps or segment<>pg then 1 else 0 end) over (partition by exp, particle order by frame) as run from (select *, lag(state) over w as ps, lag(segment) over w as pg from st window w as (partition by exp, particle order by frame))), rn as (select exp, particle, run, any_value(state) as state, any_value(segment) as segment, min(frame) as first, max(frame) as last, count(*) as n, any_value(late) as late from rc group by 1,2,3), nx as (select *, lead(segment) over (partition by exp, particle order by run) as ng from rn) select exp, particle, state, first, last, n, (ng is null or ng<>segment)::int as censored from nx where ng is not null or last*4+100<late")
register("o03_arriving_steps", "exp | particle frame | v turn", lambda t: _drained(t, forms.arriving_steps(_stream(t, t.gaps, ROWS))),
         f"with {GSTEP}, p as (select *, lag(dx) over w as bx, lag(dy) over w as b2, lag(df) over w as bf from steps window w as (partition by exp, particle order by frame)) select exp, particle, frame, case when df=1 then sqrt(dx*dx+dy*dy) end as v, case when df=1 and bf=1 and dx*dx+dy*dy>1e-10 and bx*bx+b2*b2>1e-10 then atan2(case when bx*dy-b2*dx=0 then 0 else bx*dy-b2*dx end, bx*dx+b2*dy) end as turn from p")
register("o03_ordered_steps", "exp | particle frame | v turn", lambda t: _drained(t, forms.ordered_steps(shuffled(t), "60 seconds", 100_000)),
         f"with {GSTEP.replace('from gaps', 'from (select * from gaps cross join (select max(frame)*4-60 as late from gaps) where frame*4<late)')}, p as (select *, lag(dx) over w as bx, lag(dy) over w as b2, lag(df) over w as bf from steps window w as (partition by exp, particle order by frame)) select exp, particle, frame, case when df=1 then sqrt(dx*dx+dy*dy) end as v, case when df=1 and bf=1 and dx*dx+dy*dy>1e-10 and bx*bx+b2*b2>1e-10 then atan2(case when bx*dy-b2*dx=0 then 0 else bx*dy-b2*dx end, bx*dx+b2*dy) end as turn from p")
register("o04_segments", "exp | particle first last n | ", lambda t: _drained(t, forms.segments(timed(t), "5 seconds", "1 second")),
         f"with {GSTEP}, sg as (select *, sum(case when df<>1 then 1 else 0 end) over (partition by exp, particle order by frame) as segment from steps), e as (select max(frame)*4-1 as late from gaps) select exp, particle, min(frame) as first, max(frame) as last, count(*) as n from sg cross join e group by exp, particle, segment, late having max(frame)*4+5<=late")
