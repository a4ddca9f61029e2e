"""Registered queries: scans, filters and per-trajectory windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import angles, curves
from ..operators import filters as flt
from ..operators import kinematics as kin
from ..operators import smoothing
from ..sources import io
from .registry import register

ID = "exp | particle frame"
STEP = """steps as (select *, x - lag(x) over w as dx, y - lag(y) over w as dy, frame - lag(frame) over w as df from tracks window w as (partition by exp, particle order by frame))"""
GSTEP = STEP.replace("from tracks", "from gaps")

register("s05_mean_speed_series", "exp | particle frame | v mean_v", lambda t: kin.gap_aware_speed(t.gaps).where("v is not null").join(io.mean_speed_series(kin.gap_aware_speed(t.gaps)), ["exp", "frame"]),
         f"with {GSTEP}, s as (select *, case when df = 1 then sqrt(dx*dx+dy*dy) end as v from steps) select exp, particle, frame, v, avg(v) over (partition by exp, frame) as mean_v from s where v is not null")
register("s06_dimension_fallback", "exp condition | | xi_um", lambda t: io.dimension_with_fallback(t.tracks.select("exp", "condition").distinct(), t.field.groupBy("exp").agg(F.avg(F.abs("u")).alias("xi_um")).where("exp < 'e3'"), t.tracks.where("condition = 'c1'").groupBy("condition").agg(F.avg("y").alias("xi_um")), "xi_um", 2.5),
         "select a.exp, a.condition, coalesce(b.xi, c.xi, 2.5) as xi_um from (select distinct exp, condition from tracks) a left join (select exp, avg(abs(u)) as xi from field where exp < 'e3' group by exp) b on a.exp=b.exp left join (select condition, avg(y) as xi from tracks where condition='c1' group by condition) c on a.condition=c.condition")
register("s02_strided_field", "exp | frame px py | u v", lambda t: io.strided(t.field, 2, 4), "select * from field where frame%2=0 and px%4=0 and py%4=0")
register("s03_global_axis", "exp | frame | theta", lambda t: io.carried_axis(t.field.where("frame % 3 <> 1"), 7),
         "with axis as (select exp, frame, atan2(avg(sin(2*atan2(v,u))), avg(cos(2*atan2(v,u))))/2 as a from field where frame%3<>1 and (u<>0 or v<>0) group by 1,2), grid as (select exp, unnest(range(7)) as frame from (select distinct exp from axis)) select exp, frame, last_value(a ignore nulls) over (partition by exp order by frame) as theta from grid left join axis using (exp, frame)")
register("s08_reuse_by_subset", "exp | frame px | u", lambda t: io.reuse(t.field, "px", 20, 2, 4), "select exp, frame, px, u from field where frame%2=0 and px<20 and frame<=4")
register("f01_cutoff", "exp | particle frame | x y", lambda t: flt.until_cutoff(t.tracks, t.cutoffs), "select t.* from tracks t left join cutoffs c on t.exp=c.exp where cutoff_frame is null or frame<=cutoff_frame")
register("f02_active", "exp | particle frame | x y", lambda t: flt.only_active(t.tracks, t.active), "select t.* from tracks t semi join active a on t.exp=a.exp and t.particle=a.particle")
register("f04_without_fixed", "exp | particle frame | x y", lambda t: flt.without_fixed(t.tracks, 40.0), "with d as (select exp, particle, sqrt(pow(max_by(x,frame)-min_by(x,frame),2)+pow(max_by(y,frame)-min_by(y,frame),2)) as d from tracks group by 1,2) select t.* from tracks t join d using (exp, particle) where d >= 40")
register("f05_end_to_end", "exp | particle | distance", lambda t: flt.end_to_end(t.tracks), "select exp, particle, sqrt(pow(max_by(x,frame)-min_by(x,frame),2)+pow(max_by(y,frame)-min_by(y,frame),2)) as distance from tracks group by 1,2")
register("f06_long_tracks", "exp | particle frame | x y", lambda t: flt.long_tracks(t.tracks, 65), "select * from tracks qualify count(*) over (partition by exp, particle) >= 65")
register("f07_tukey", "condition exp | particle frame | v", lambda t: flt.tukey(kin.gap_aware_speed(t.gaps).where("v is not null"), "v", k=0.5),
         f"with {GSTEP}, s as (select *, sqrt(dx*dx+dy*dy) as v from steps where df=1), q as (select condition, quantile_cont(v,0.25) as a, quantile_cont(v,0.75) as b from s group by 1) select s.* from s join q using (condition) where v between greatest(0, a-0.5*(b-a)) and b+0.5*(b-a)")
register("f08_lognormal_core", "condition | particle frame | v position", lambda t: flt.lognormal_core(kin.velocity(t.tracks).where("v is not null"), "v", "condition", ["particle", "frame"], 0.0227501319),
         f"with {STEP}, s as (select *, sqrt(dx*dx+dy*dy) as v from steps where dx is not null), p as (select *, row_number() over (partition by condition order by v, particle, frame) as i, count(*) over (partition by condition) as n from s where v>0), q as (select *, case when i=n then pow(0.5,1.0/n) when i=1 then 1-pow(0.5,1.0/n) else (i-0.3175)/(n+0.365) end as position from p) select * from q where position between 0.0227501319 and 1-0.0227501319")
register("f09_valid_field", "exp | frame px py | u v", lambda t: flt.valid_field(t.field), "select * from field where u*u+v*v>0")
register("f10_outside_particles", "exp | frame px py | u v", lambda t: flt.outside(t.field, t.on_field, 3.0), "select f.* from field f where not exists (select 1 from on_field p where p.exp=f.exp and p.frame=f.frame and pow(f.px-p.x,2)+pow(f.py-p.y,2)<=9)")
register("f11_thinned", "exp | particle frame | x", lambda t: flt.thinned(t.tracks, kin.KEY, ["frame"], 7),
         "with r as (select *, row_number() over (partition by exp, particle order by frame)-1 as i, count(*) over (partition by exp, particle) as n from tracks) select * from r where n<=7 or i in (select round_even(k*(n-1)/6.0,0) from (select unnest(range(7)) as k))")
register("f12_finite", "exp | frame px | ratio", lambda t: flt.finite(t.field.withColumn("ratio", F.try_divide("u", "v")), ["ratio"]).select("exp", "frame", "px", "ratio").groupBy("exp", "frame", "px").agg(F.sum("ratio").alias("ratio")), "select exp, frame, px, sum(u/v) as ratio from field where v<>0 group by 1,2,3")
register("f13_condition_names", "name | n | ", lambda t: t.tracks.select(flt.condition_name(F.concat(F.lit(" Bead"), (F.col("particle") % 7) / 10, F.lit("um "))).alias("name")).groupBy("name").agg(F.count("*").alias("n")),
         "select 'beads'||lpad(replace(((particle%7)/10)::varchar,'.',''),2,'0')||'um' as name, count(*) as n from tracks group by 1")
register("f14_range_spec", "exp | value | ", lambda t: flt.range_spec(t.tracks.groupBy("exp").agg(F.max("frame").alias("last")).withColumn("spec", F.concat(F.lit("8:"), F.col("last") + 8, F.lit(":8,16,100"))), "spec").select("exp", "value"),
         "select distinct exp, unnest(list_concat(range(8, last+9, 8), [16,100])) as value from (select exp, max(frame) as last from tracks group by 1)")
register("f15_flow_check", "exp | n | moving valid speed_error angle_error correlation", lambda t: flt.checked_flow(t.on_field.withColumn("px", F.floor("x").cast("int")).withColumn("py", F.floor("y").cast("int")).join(t.field, ["exp", "frame", "px", "py"]).withColumns({"tu": F.col("x") / 100 - 0.1, "tv": F.col("y") / 100 - 0.1}), 0.1, 1e-3),
         "with j as (select f.exp, u, v, p.x/100-0.1 as tu, p.y/100-0.1 as tv from on_field p join field f on p.exp=f.exp and p.frame=f.frame and floor(p.x)=f.px and floor(p.y)=f.py), n as (select *, sqrt(u*u+v*v) as a, sqrt(tu*tu+tv*tv) as b from j) select exp, count(*) as n, avg((b>0.1)::int) as moving, avg((a>1e-3 and b>1e-3)::int) as valid, avg(case when a>1e-3 and b>1e-3 then abs(a-b)/b end) as speed_error, avg(case when a>1e-3 and b>1e-3 then abs(atan2(u*tv-v*tu,u*tu+v*tv)) end) as angle_error, sum(u*tu+v*tv)/sqrt(sum(a*a)*sum(b*b)) as correlation from n group by 1")
register("k01_velocity", f"{ID} | v vx vy theta dtheta omega ex ey alpha", lambda t: kin.velocity(t.tracks, 0.11, 4.0),
         f"with {STEP}, s as (select *, dx*0.11 as sx, dy*0.11 as sy from steps), p as (select *, lag(sx) over w as bx, lag(sy) over w as b2 from s window w as (partition by exp, particle order by frame)), q as (select *, case when sx*sx+sy*sy>0 and bx*bx+b2*b2>0 then atan2(case when bx*sy-b2*sx=0 then 0 else bx*sy-b2*sx end, bx*sx+b2*sy) end as dtheta from p), e as (select *, case when sx*sx+sy*sy>0 then sx/sqrt(sx*sx+sy*sy) end as ex, case when sx*sx+sy*sy>0 then sy/sqrt(sx*sx+sy*sy) end as ey from q) select *, atan2(round(ey-lag(ey) over w,12)+0.0, round(ex-lag(ex) over w,12)+0.0) as alpha, sqrt(sx*sx+sy*sy)/4 as v, sx/4 as vx, sy/4 as vy, case when sx*sx+sy*sy>0 then atan2(sy,sx) end as theta, dtheta/4 as omega from e window w as (partition by exp, particle order by frame)")
register("k02_gap_aware_speed", f"{ID} | v", lambda t: kin.gap_aware_speed(t.gaps, 0.11, 4.0), f"with {GSTEP} select *, case when df=1 then sqrt(dx*dx+dy*dy)*0.11/4 end as v from steps")
register("k03_gap_dividing_speed", f"{ID} | v", lambda t: kin.gap_dividing_speed(t.gaps, 0.11, 4.0), f"with {GSTEP} select *, case when df>0 then sqrt(dx*dx+dy*dy)*0.11/(df*4) end as v from steps")
register("k04_forward_unit", f"{ID} | ux uy", lambda t: kin.forward_unit(t.tracks),
         "with s as (select *, lead(x) over w - x as dx, lead(y) over w - y as dy from tracks window w as (partition by exp, particle order by frame)) select *, case when dx*dx+dy*dy>0 then dx/sqrt(dx*dx+dy*dy) when dx is not null then 0 end as ux, case when dx*dx+dy*dy>0 then dy/sqrt(dx*dx+dy*dy) when dx is not null then 0 end as uy from s")
register("k05_rolling_mean", f"{ID} | x_mean y_mean", lambda t: kin.rolling_mean(t.tracks, ["x", "y"], 5),
         "select *, case when count(x) over w = 5 then avg(x) over w end as x_mean, case when count(y) over w = 5 then avg(y) over w end as y_mean from tracks window w as (partition by exp, particle order by frame rows between 2 preceding and 2 following)")
register("k06_rolling_circular_mean", f"{ID} | theta_mean", lambda t: kin.rolling_circular_mean(kin.velocity(t.tracks), "theta", 5, 3),
         f"with {STEP}, s as (select *, case when dx*dx+dy*dy>0 then atan2(dy,dx) end as theta from steps) select *, case when count(theta) over w >= 3 then atan2(avg(sin(theta)) over w, avg(cos(theta)) over w) end as theta_mean from s window w as (partition by exp, particle order by frame rows between 2 preceding and 2 following)")
register("k09_central_velocity", f"{ID} | vx", lambda t: kin.central_velocity(t.gaps, 3),
         "with m as (select *, avg(x) over (partition by exp, particle order by frame rows between 1 preceding and 1 following) as m from gaps), s as (select *, frame-lag(frame) over w as a, lead(frame) over w-frame as b, lag(m) over w as p, lead(m) over w as q from m window w as (partition by exp, particle order by frame)) select *, coalesce((a*a*q+(b*b-a*a)*m-b*b*p)/(a*b*(a+b)), (m-p)/a, (q-m)/b) as vx from s")
SEG = "seg as (select *, sum(case when df<>1 then 1 else 0 end) over (partition by exp, particle order by frame) as segment from steps)"
register("k10_tau_velocity", f"{ID} segment | vx vy", lambda t: kin.tau_velocity(t.gaps, 2),
         f"with {GSTEP}, {SEG} select *, (lead(x,2) over w - x)/2 as vx, (lead(y,2) over w - y)/2 as vy from seg window w as (partition by exp, particle, segment order by frame)")
register("k10_savitzky_golay", f"{ID} | x_smooth", lambda t: kin.savitzky_golay(t.gaps, "x"),
         f"with {GSTEP}, {SEG} select *, coalesce((-3*lag(x,2) over w+12*lag(x) over w+17*x+12*lead(x) over w-3*lead(x,2) over w)/35, x) as x_smooth from seg window w as (partition by exp, particle, segment order by frame)")
register("k11_lag_displacement", f"{ID} | dx dy r", lambda t: kin.lag_displacement(t.tracks, 3, 0.11),
         "with s as (select *, (lead(x,3) over w - x)*0.11 as dx, (lead(y,3) over w - y)*0.11 as dy from tracks window w as (partition by exp, particle order by frame)) select *, sqrt(dx*dx+dy*dy) as r from s where dx is not null")
register("k12_frame_displacement", "exp | particle frame lag | dx dy", lambda t: kin.frame_displacement(t.gaps, [1, 2, 5]),
         "select a.exp, a.particle, a.frame, b.frame-a.frame as lag, b.x-a.x as dx, b.y-a.y as dy from gaps a join gaps b on a.exp=b.exp and a.particle=b.particle and b.frame-a.frame in (1,2,5)")
register("k13_parallel_perpendicular", f"{ID} | parallel perpendicular share", lambda t: kin.project(kin.lag_displacement(t.tracks, 1), t.theta),
         "with s as (select *, lead(x) over w - x as dx, lead(y) over w - y as dy from tracks window w as (partition by exp, particle order by frame)), p as (select s.*, dx*cos(theta)+dy*sin(theta) as parallel, dy*cos(theta)-dx*sin(theta) as perpendicular from s join theta using (exp, frame) where dx is not null) select *, pow(parallel,2)/nullif(pow(parallel,2)+pow(perpendicular,2),0) as share from p")
register("k14_wraps", f"{ID} | a b", lambda t: t.tracks.withColumns({"a": F.round(angles.wrap(F.col("x") + 0.01), 9), "b": F.round(angles.fold(F.col("y") + 0.01), 9)}),
         "select *, round((x+0.01+pi()) - 2*pi()*floor((x+0.01+pi())/(2*pi())) - pi(), 9) as a, round((y+0.01+pi()/2) - pi()*floor((y+0.01+pi()/2)/pi()) - pi()/2, 9) as b from tracks")
register("k15_unwrapped", f"{ID} | theta_unwrapped", lambda t: kin.unwrapped(kin.velocity(t.tracks).where("theta is not null"), "theta"),
         f"with {STEP}, s as (select *, atan2(dy,dx) as theta from steps where dx*dx+dy*dy>0), j as (select *, coalesce(atan2(sin(theta-lag(theta) over w), cos(theta-lag(theta) over w)),0) as j from s window w as (partition by exp, particle order by frame)) select *, first_value(theta) over w + sum(j) over w as theta_unwrapped from j window w as (partition by exp, particle order by frame)")
TURN = "t3 as (select *, lead(x,{k}) over w-x as ax, lead(y,{k}) over w-y as ay, lead(x,2*{k}) over w-lead(x,{k}) over w as bx, lead(y,2*{k}) over w-lead(y,{k}) over w as b2, lead(frame,{k}) over w-frame as f1, lead(frame,2*{k}) over w-lead(frame,{k}) over w as f2 from gaps window w as (partition by exp, particle order by frame)), t4 as (select *, atan2(case when ax*b2-ay*bx=0 then 0 else ax*b2-ay*bx end, ax*bx+ay*b2) as angle, sqrt(ax*ax+ay*ay)/{k} as v_in, sqrt(bx*bx+b2*b2)/{k} as v_out from t3 where f1={k} and f2={k} and ax*ax+ay*ay>1e-10 and bx*bx+b2*b2>1e-10)"
register("k16_turning_angle", f"{ID} | angle", lambda t: kin.turning_angle(t.gaps), f"with {TURN.format(k=1)} select * from t4")
register("k17_speed_and_turning", f"{ID} | angle v_in v_out v_mean", lambda t: kin.turning_angle(t.tracks, 2), f"with {TURN.format(k=2).replace('from gaps', 'from tracks')} select *, (v_in+v_out)/2 as v_mean from t4")
register("k18_segments", f"{ID} segment | ", lambda t: kin.segments(t.gaps), f"with {GSTEP}, {SEG} select * from seg")
register("k19_centred", f"{ID} | x_within", lambda t: kin.centred(t.tracks, "x", kin.KEY), "select *, x - avg(x) over (partition by exp, particle) as x_within from tracks")
register("k20_frame_windows", f"{ID} window | x", lambda t: kin.frame_windows(t.gaps, 20, 3), "with w as (select *, floor(frame/20)*20 as \"window\" from gaps) select * from w qualify count(*) over (partition by exp, particle, \"window\") >= 10")
register("k21_moving_ratio", f"{ID} | eta", lambda t: kin.moving_ratio(t.gaps, "x", "y", 3),
         "with s as (select *, max(frame) over w - frame as span, count(*) over w as n, sum(x*y) over w as a, sum(y*y) over w as b from gaps window w as (partition by exp, particle order by frame rows between current row and 2 following)) select *, a/b as eta from s where span=2 and n=3 and b<>0")
register("k22_scaled", "exp | particle | x_scaled lag_scaled msd_scaled", lambda t: kin.scaled(flt.end_to_end(t.tracks).join(t.tracks.select("exp", "condition").distinct(), "exp").join(t.cond, "condition"), F.col("radius_um"), F.lit(2.0), F.lit(0.5), F.lit(10.0), F.col("distance")),
         "select exp, particle, radius_um/2.0 as x_scaled, 10*0.5/2.0 as lag_scaled, sqrt(pow(max_by(x,frame)-min_by(x,frame),2)+pow(max_by(y,frame)-min_by(y,frame),2))/4.0 as msd_scaled from tracks join cond using (condition) group by exp, particle, radius_um")
register("k23_curves", "condition | | master diffusion order stokes", lambda t: t.cond.withColumns({"master": curves.master(F.col("radius_um")), "diffusion": curves.unified_diffusion(F.col("radius_um"), 0.5, 20.0, 40.0), "order": curves.disk_order(F.col("radius_um")), "stokes": curves.stokes_einstein(F.col("diameter_um"))}).join(t.tracks.select("condition").distinct(), "condition", "left_semi"),
         """with g as (select (k+0.5)/64 as s from (select unnest(range(64)) as k)) select condition, (1-exp(-radius_um))/radius_um as master, 0.125/(1/20.0+1/(40.0*(1+radius_um))) as diffusion, (select sqrt(sum(16/pi()*s*(acos(s)-s*sqrt(1-s*s))/64*exp(-2*radius_um*s))) from g) as "order", 1.380649e-23*298/(3*pi()*1e-3)*1e18/diameter_um as stokes from cond where condition in (select condition from tracks)""")
register("k24_synchronised_mean", "exp | particle | x_mean", lambda t: kin.synchronised_mean(t.gaps.groupBy(*kin.KEY).agg(F.min("frame").alias("first"), F.max("frame").alias("last")), t.gaps.groupBy("exp", "frame").agg(F.avg("x").alias("x")), "x"),
         "with s as (select exp, frame, avg(x) as x from gaps group by 1,2), p as (select exp, particle, min(frame) as a, max(frame) as b from gaps group by 1,2) select p.exp, p.particle, avg(s.x) as x_mean from p join s on p.exp=s.exp and s.frame between a and b group by 1,2")
register("k25_interpolated", f"{ID} | u", lambda t: kin.interpolated(t.gaps.select("exp", "particle", "frame"), t.gaps.where("frame % 10 = 0").groupBy("exp", "frame").agg(F.avg("x").alias("u")), "u"),
         "with s as (select exp, frame, avg(x) as v from gaps where frame%10=0 group by 1,2), r as (select distinct exp, frame from gaps), n as (select r.exp, r.frame, max_by(a.v,a.frame) as va, max(a.frame) as fa from r left join s a on a.exp=r.exp and a.frame<=r.frame group by 1,2), m as (select r.exp, r.frame, min_by(b.v,b.frame) as vb, min(b.frame) as fb from r left join s b on b.exp=r.exp and b.frame>=r.frame group by 1,2) select g.exp, g.particle, g.frame, coalesce(va+(vb-va)*coalesce((g.frame-fa)/nullif(fb-fa,0),0), va, vb) as u from gaps g join n using (exp, frame) join m using (exp, frame)")
register("k27_nearest_level", "exp | particle frame | x", lambda t: kin.nearest_level(t.gaps, kin.KEY, "frame", F.lit(50)), "select * from gaps qualify row_number() over (partition by exp, particle order by abs(frame-50), frame)=1")
register("k07_kalman_velocity", f"{ID} | vx vy vx_error vy_error", lambda t: smoothing.kalman_velocity(t.gaps, 1.0, 10.0))
register("k08_spline_velocity", f"{ID} | x_smooth y_smooth vx vy", lambda t: smoothing.spline_velocity(t.gaps))
