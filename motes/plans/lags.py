"""Registered queries: lag statistics and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kinematics as kin
from ..operators import lagstats as lag
from .registry import register
from .tracks import STEP

L = 20
PAIRS = "pr as (select a.condition, a.exp, a.particle, a.frame, b.frame-a.frame as lag, b.x-a.x as dx, b.y-a.y as dy from tracks a join tracks b on a.exp=b.exp and a.particle=b.particle and b.frame-a.frame between 1 and 20)"
IMSD = f"{PAIRS}, im as (select condition, exp, particle, lag, avg(dx*dx+dy*dy) as msd, avg(dx*dx+dy*dy)/2 as msd_axis_mean, count(*) as n from pr group by 1,2,3,4)"
GPAIRS = PAIRS.replace("tracks", "gaps")
QUANT = ", ".join(f"quantile_cont({{v}},{p}) as q{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))
ALPHA = "al as (select condition, exp, particle, regr_slope(log10(msd), log10(lag)) filter (where msd>0 and lag between 2 and 10) as alpha, max(lag) as longest from im group by 1,2,3)"

register("d01_imsd", "condition exp | particle lag n | msd msd_axis_mean", lambda t: lag.imsd(t.tracks, L), f"with {IMSD} select * from im")
register("d02_msd_from_first", "exp | particle lag | msd", lambda t: lag.msd_from_first(t.tracks), "with s as (select *, row_number() over w - 1 as lag, pow(x-first_value(x) over w,2)+pow(y-first_value(y) over w,2) as msd from tracks window w as (partition by exp, particle order by frame)) select * from s where lag>0")
register("d03_ensemble_msd", "condition | lag n | mean sem", lambda t: lag.ensemble(lag.imsd(t.tracks, L), "msd", ["condition", "lag"]), f"with {IMSD} select condition, lag, avg(msd) as mean, stddev_samp(msd)/sqrt(count(*)) as sem, count(*) as n from im group by 1,2")
register("d05_at_lag", "condition exp | particle | msd", lambda t: lag.at_lag(lag.imsd(t.gaps, L, "frame"), "msd", 15, 3), f"with {IMSD.replace('tracks', 'gaps')} select condition, exp, particle, arg_min(msd, abs(lag-15)*1000+lag) as msd from im where abs(lag-15)<=3 group by 1,2,3")
register("d06_alpha", "condition exp | particle longest | alpha", lambda t: lag.alpha(lag.imsd(t.tracks, L), "msd", 2, 10), f"with {IMSD}, {ALPHA} select * from al")
register("f03_by_alpha", "exp | particle frame | x", lambda t: lag.by_alpha(t.tracks, L, 0.0), f"with {IMSD}, a as (select exp, particle from im group by 1,2 having regr_slope(log10(msd), log10(lag))>0) select t.* from tracks t join a using (exp, particle)")
register("d07_slope_summary", "condition | n | mean std q10 q25 q50 q75 q90", lambda t: lag.slope_summary(lag.imsd(t.tracks, L), 2, 10, 20), f"with {IMSD}, {ALPHA} select condition, avg(alpha) as mean, stddev_samp(alpha) as std, count(*) as n, {QUANT.format(v='alpha')} from al where longest>=20 group by 1")
register("d08_local_exponent", "condition | lag | x_mid exponent", lambda t: lag.local_exponent(lag.ensemble(lag.imsd(t.tracks, L), "msd", ["condition", "lag"]), ["condition"], "lag", "mean"), f"with {IMSD}, e as (select condition, lag, avg(msd) as m from im group by 1,2), l as (select *, lead(lag) over w as l2, lead(m) over w as m2 from e window w as (partition by condition order by lag)) select condition, lag, sqrt(lag*l2) as x_mid, ln(m2/m)/ln(l2/lag) as exponent from l where m2 is not null")
register("d09_tamsd_frames", "condition exp | particle lag n | msd", lambda t: lag.imsd(t.gaps, L, "frame"), f"with {IMSD.replace('tracks', 'gaps')} select * from im")
register("d10_ergodicity_breaking", "condition | lag n | eb eb_error", lambda t: lag.ergodicity_breaking(lag.imsd(t.tracks, L)), f"with {IMSD}, e as (select condition, lag, var_samp(msd)/pow(avg(msd),2) as eb, count(*) as n from im group by 1,2 having count(*)>=2) select *, eb*sqrt(2.0/(n-1)) as eb_error from e")
r2 = lambda: (F.col("x_2") - F.col("x")) ** 2 + (F.col("y_2") - F.col("y")) ** 2
register("d11_ngp", "condition | n | ngp", lambda t: lag.ngp(kin.lag_displacement(t.tracks, 3), F.col("r") ** 2, ["condition"]), f"with {PAIRS} select condition, count(*) as n, 0.5*avg(pow(dx*dx+dy*dy,2))/pow(avg(dx*dx+dy*dy),2)-1 as ngp from pr where lag=3 group by 1")
register("d12_ngp_by_particle", "exp | particle lag n | ngp", lambda t: lag.ngp(lag.lagged(t.tracks, ["x", "y"], L), r2(), ["exp", "particle", "lag"]), f"with {PAIRS} select exp, particle, lag, count(*) as n, 0.5*avg(pow(dx*dx+dy*dy,2))/pow(avg(dx*dx+dy*dy),2)-1 as ngp from pr group by 1,2,3 having count(*)>=4")
register("d13_excess", "exp | particle | excess", lambda t: lag.excess(kin.lag_displacement(t.tracks, 1), "dx", ["exp", "particle"]), f"with {PAIRS} select exp, particle, (avg(pow(dx,4))-3*pow(avg(dx*dx),2))/pow(avg(dx*dx),2) as excess from pr where lag=1 group by 1,2")
UNIT = f"{PAIRS}, un as (select *, dx/sqrt(dx*dx+dy*dy) as ux, dy/sqrt(dx*dx+dy*dy) as uy from pr where dx<>0 or dy<>0)"
register("d14_resultant_length", "condition | lag n | mean sem", lambda t: lag.resultant_length(t.tracks, L), f"with {UNIT}, m as (select condition, exp, particle, lag, sqrt(pow(avg(ux),2)+pow(avg(uy),2)) as l from un group by 1,2,3,4) select condition, lag, avg(l) as mean, stddev_samp(l)/sqrt(count(*)) as sem, count(*) as n from m group by 1,2")
register("d35_axial_resultant_length", "condition | lag n | mean sem", lambda t: lag.resultant_length(t.tracks, L, True), f"with {UNIT}, m as (select condition, exp, particle, lag, sqrt(pow(avg(ux*ux-uy*uy),2)+pow(avg(2*ux*uy),2)) as l from un group by 1,2,3,4) select condition, lag, avg(l) as mean, stddev_samp(l)/sqrt(count(*)) as sem, count(*) as n from m group by 1,2")
register("d15_skewness", "| lag | skew_x skew_y", lambda t: lag.skewness(t.tracks, L), f"with {PAIRS}, s as (select exp, particle, lag, case when var_pop(dx)>1e-20 then skewness(dx) end as sx, case when var_pop(dy)>1e-20 then skewness(dy) end as sy from pr group by 1,2,3) select lag, avg(sx) as skew_x, avg(sy) as skew_y from s group by 1")
register("d16_evolution", "condition | lag n | mean std sem median msd", lambda t: lag.evolution(t.tracks, L, ["condition"]), f"with {PAIRS}, r as (select *, sqrt(dx*dx+dy*dy) as r from pr) select condition, lag, count(*) as n, avg(r) as mean, stddev_pop(r) as std, stddev_pop(r)/sqrt(count(*)) as sem, quantile_cont(r,0.5) as median, avg(r*r) as msd from r group by 1,2")


def acf_sql(source: str, dot: str, select: str, lags: int = 10, norm: bool = True, track: str = "condition, exp, particle") -> str:
    divide = "/max(case when lag=0 then m end) over (partition by condition)" if norm else ""
    return f"{source}, z as ({select}), q as (select a.condition, a.exp, a.particle, b.frame-a.frame as lag, avg({dot}) as c from z a join z b on a.exp=b.exp and a.particle=b.particle and b.frame-a.frame between 0 and {lags} group by 1,2,3,4), e as (select condition, lag, avg(c) as m, stddev_samp(c)/sqrt(count(c)) as s, count(c) as n from q group by 1,2) select condition, lag, m{divide} as mean, s{divide.replace('max(', 'abs(max(', 1).replace('over (partition by condition)', 'over (partition by condition))') if norm else ''} as sem, n from e"


VEL = "select *, dx as vx, dy as vy, sqrt(dx*dx+dy*dy) as v from steps where dx is not null"
ANG = "select *, cos(atan2(dy,dx)) as vx, sin(atan2(dy,dx)) as vy from steps where dx<>0 or dy<>0"
GSTEP = STEP.replace("from tracks", "from gaps")
vel = lambda d: kin.velocity(d)
register("d17_displacement_autocorrelation", "condition | lag n | mean sem", lambda t: lag.autocorrelation(kin.frame_displacement(t.gaps, [2]).drop("lag"), ["dx", "dy"], 10),
         acf_sql("with d as (select a.*, b.x-a.x as dx, b.y-a.y as dy from gaps a join gaps b on a.exp=b.exp and a.particle=b.particle and b.frame=a.frame+2)", "a.dx*b.dx+a.dy*b.dy", "select * from d"))
register("d18_vacf_velocity", "condition | lag n | mean sem", lambda t: lag.autocorrelation(vel(t.gaps), ["vx", "vy"], 10), acf_sql(f"with {GSTEP}", "a.vx*b.vx+a.vy*b.vy", VEL))
register("d18_vacf_orientation", "condition | lag n | mean sem", lambda t: lag.autocorrelation(vel(t.gaps).withColumns({"c": F.cos("theta"), "s": F.sin("theta")}), ["c", "s"], 10, normalise=False), acf_sql(f"with {GSTEP}", "a.vx*b.vx+a.vy*b.vy", ANG, norm=False))
register("d18_vacf_speed", "condition | lag n | mean sem", lambda t: lag.autocorrelation(vel(t.gaps), ["v"], 10), acf_sql(f"with {GSTEP}", "a.v*b.v", VEL))
register("d18_vacf_speed_fluctuation", "condition | lag n | mean sem", lambda t: lag.autocorrelation(kin.centred(vel(t.gaps).where("v is not null"), "v", kin.KEY), ["v_within"], 10), acf_sql(f"with {GSTEP}", "a.v*b.v", f"select * replace (v - avg(v) over (partition by exp, particle) as v) from ({VEL})"))
register("d18_vacf_velocity_fluctuation", "condition | lag n | mean sem", lambda t: lag.autocorrelation(kin.centred(kin.centred(vel(t.gaps).where("v is not null"), "vx", kin.KEY), "vy", kin.KEY), ["vx_within", "vy_within"], 10), acf_sql(f"with {GSTEP}", "a.vx*b.vx+a.vy*b.vy", f"select * replace (vx - avg(vx) over (partition by exp, particle) as vx, vy - avg(vy) over (partition by exp, particle) as vy) from ({VEL})"))
register("d18_vacf_angle_change", "condition | lag n | mean sem", lambda t: lag.autocorrelation(vel(t.gaps), ["dtheta"], 10), acf_sql(f"with {GSTEP}, s2 as (select *, lag(dx) over w as bx, lag(dy) over w as b2 from steps window w as (partition by exp, particle order by frame))", "a.d*b.d", "select *, atan2(case when bx*dy-b2*dx=0 then 0 else bx*dy-b2*dx end, bx*dx+b2*dy) as d from s2 where dx*dx+dy*dy>0 and bx*bx+b2*b2>0"))
register("d19_row_lag_autocorrelation", "condition | lag n | mean sem", lambda t: lag.autocorrelation(vel(t.tracks), ["vx", "vy"], 10, "row", False), acf_sql(f"with {STEP}", "a.vx*b.vx+a.vy*b.vy", VEL, norm=False))
register("d20_angle_autocorrelation", "condition | lag n | mean sem", lambda t: lag.autocorrelation(t.tracks.withColumns({"c": F.cos("x"), "s": F.sin("x")}), ["c", "s"], 10, "row", False), acf_sql("with t0 as (select 1)", "cos(b.x-a.x)", "select * from tracks", norm=False))
register("d21_irregular_autocorrelation", "condition | n | dt raw normalised centred", lambda t: lag.irregular_autocorrelation(t.gaps.withColumn("time", F.col("frame") * 0.25), "y", "time", 5.0, 5, 20),
         "with p as (select a.condition, round((b.frame-a.frame)*0.25::double,3) as dt, avg(a.y*b.y) as raw, count(*) as n from gaps a join gaps b on a.exp=b.exp and a.particle=b.particle and b.frame-a.frame between 1 and 20 group by 1,2 having count(*)>=5), w as (select condition, avg(y) as m, var_pop(y) as s, avg(y*y) as z from gaps group by 1) select p.*, raw/z as normalised, (raw-m*m)/s as centred from p join w using (condition)")
register("d22_field_autocorrelation", "exp | lag n | c", lambda t: lag.field_autocorrelation(t.field, 4), "select a.exp, b.frame-a.frame as lag, sum(a.u*b.u+a.v*b.v)/count(*) as c, count(*) as n from field a join field b on a.exp=b.exp and a.px=b.px and a.py=b.py and b.frame-a.frame between 0 and 4 group by 1,2")
register("d22_field_autocorrelation_wrapped", "exp | lag n | c", lambda t: lag.field_autocorrelation(t.field, 4, 7), "select a.exp, l as lag, avg(a.u*b.u+a.v*b.v) as c, count(*) as n from field a cross join (select unnest(range(5)) as l) join field b on a.exp=b.exp and a.px=b.px and a.py=b.py and b.frame=(a.frame+l)%7 group by 1,2")
HEAD = f"with {GSTEP}, seg as (select *, sum(case when df<>1 then 1 else 0 end) over (partition by exp, particle order by frame) as segment from steps), h0 as (select *, atan2(dy,dx) as h from seg where df=1 and (dx<>0 or dy<>0)), h1 as (select *, coalesce(atan2(sin(h-lag(h) over w),cos(h-lag(h) over w)),0) as j, row_number() over w as r from h0 window w as (partition by exp, particle, segment order by frame) qualify count(*) over (partition by exp, particle, segment)>=3), h2 as (select *, first_value(h) over w + sum(j) over w as g from h1 window w as (partition by exp, particle, segment order by frame)), ms as (select a.condition, a.exp, a.particle, b.r-a.r as lag, avg(pow(b.g-a.g,2)) as msad, count(*) as n from h2 a join h2 b on a.exp=b.exp and a.particle=b.particle and a.segment=b.segment and b.r-a.r between 1 and 5 group by 1,2,3,4)"
register("d23_msad", "condition exp | particle lag n | msad", lambda t: lag.msad(t.gaps, 5), f"{HEAD} select * from ms")
register("d24_msad_fit", "condition | n | diffusion offset", lambda t: lag.linear_fit(lag.msad(t.gaps, 5), ["condition"], "lag", "msad"), f"{HEAD} select condition, count(*) as n, regr_slope(msad,lag)/2 as diffusion, regr_intercept(msad,lag) as \"offset\" from ms group by 1")
STATE = "(x>50)::int"
ISL = f"with s0 as (select *, {STATE} as state from gaps), s1 as (select *, coalesce(frame-lag(frame) over w<>1 or state<>lag(state) over w, false)::int as n1, coalesce(frame-lag(frame) over w<>1, false)::int as n2 from s0 window w as (partition by exp, particle order by frame)), s2 as (select *, sum(n1) over w as g1, sum(n2) over w as g2 from s1 window w as (partition by exp, particle order by frame)), isl as (select condition, exp, particle, frame, x, y, state, g1 as g from s2 union all select condition, exp, particle, frame, x, y, -1, g2 from s2), pr as (select a.condition, a.state, b.frame-a.frame as lag, a.x as xa, b.x as xb, a.y as ya, b.y as yb from isl a join isl b on a.exp=b.exp and a.particle=b.particle and a.state=b.state and a.g=b.g and b.frame-a.frame between 1 and 6)"
stated = lambda t: t.gaps.withColumn("state", (F.col("x") > 50).cast("int"))
register("d25_state_msd", "condition | state lag n | msd", lambda t: lag.state_msd(stated(t), 6), f"{ISL} select condition, state, lag, avg(pow(xb-xa,2)+pow(yb-ya,2)) as msd, count(*) as n from pr group by 1,2,3")
register("d26_state_autocorrelation", "condition | state lag n | c", lambda t: lag.state_autocorrelation(stated(t), ["x", "y"], 6), f"{ISL}, z as (select condition, state, avg(x*x+y*y) as z from isl group by 1,2) select p.condition, p.state, lag, avg(xa*xb+ya*yb)/any_value(z) as c, count(*) as n from pr p join z on p.condition=z.condition and p.state=z.state group by 1,2,3")
register("d31_segment_msd", "condition | lag n | msd", lambda t: lag.state_msd(t.gaps.withColumn("state", F.lit(0)), 6).where("state = 0"), f"{ISL.replace(STATE, '0')} select condition, lag, avg(pow(xb-xa,2)+pow(yb-ya,2)) as msd, count(*) as n from pr where state=0 group by 1,2")
curve = lambda t: t.gaps.groupBy("condition", F.col("frame").alias("lag")).agg((F.avg("y") - 50).alias("mean"))
CURVE = "cv as (select condition, frame as lag, avg(y)-50 as c from gaps group by 1,2), a1 as (select *, lag(c) over w as b, lag(lag) over w as xb from cv window w as (partition by condition order by lag)), a2 as (select *, coalesce((c+b)/2*(lag-xb),0) as area from a1), a3 as (select *, sum(area) over (partition by condition order by lag) as run, min(case when c<0 then lag end) over (partition by condition) as f from a2)"
register("d27_green_kubo", "condition | | whole to_zero peak median", lambda t: lag.green_kubo(curve(t), ["condition"]), f"with {CURVE} select condition, max_by(run,lag)/2 as whole, coalesce(max(case when lag=f then run-area+b*b/(b-c)/2*(lag-xb) end), max_by(run,lag))/2 as to_zero, max(run)/2 as peak, quantile_cont(run,0.5)/2 as median from a3 group by 1")
register("d28_integral_time", "condition | | whole to_zero", lambda t: lag.green_kubo(curve(t).withColumn("mean", F.col("mean") + 1.0), ["condition"], 2.0), f"with {CURVE.replace('avg(y)-50', 'avg(y)-50+1.0').replace('*(lag-xb)', '*(lag-xb)*2')} select condition, max_by(run,lag)/2 as whole, coalesce(max(case when lag=f then run-area+b*b/(b-c)/2*(lag-xb)*2 end), max_by(run,lag))/2 as to_zero from a3 group by 1")
#: Where the curve is nearly flat, the lag may fall below the smallest number: 0, whose logarithm is -inf (Spark's is null).
log_lag = lambda x: F.when(x == 0, F.lit(float("-inf"))).otherwise(F.round(F.log10(x), 5))
register("d29_crossing_lag", "exp | particle | lag_at_target", lambda t: lag.crossing_lag(lag.imsd(t.tracks, L), ["exp", "particle"], "msd", 3400.0).withColumn("lag_at_target", log_lag(F.col("lag_at_target"))), f"with {IMSD}, n as (select *, lag(lag) over w as xb, lag(msd) over w as yb, max(lag) over (partition by exp, particle) as last from im window w as (partition by exp, particle order by lag)), h as (select *, min(case when msd>=3400 then lag end) over (partition by exp, particle) as hit from n where yb is not null) select exp, particle, round(log10(xb*exp(ln(3400/yb)/(ln(msd/yb)/ln(lag/xb)))), 5) as lag_at_target from h where lag=coalesce(hit,last) and msd<>yb")
register("d30_increment_autocorrelation", "exp | particle lag | c", lambda t: lag.increment_autocorrelation(t.tracks, "x", 10), f"with {STEP}, c as (select exp, particle, frame, dx - avg(dx) over (partition by exp, particle) as c from steps where dx is not null), s as (select exp, particle, sum(c*c) as s from c group by 1,2) select a.exp, a.particle, b.frame-a.frame as lag, sum(a.c*b.c)/any_value(s.s) as c from c a join c b on a.exp=b.exp and a.particle=b.particle and b.frame-a.frame between 1 and 10 join s on s.exp=a.exp and s.particle=a.particle group by 1,2,3")
register("d32_gap_bias", "| lag | by_row by_frame bias", lambda t: lag.gap_bias(t.gaps, 10), "with g as (select *, row_number() over (partition by exp, particle order by frame) as r from gaps), a as (select b.r-a.r as lag, avg(pow(b.x-a.x,2)+pow(b.y-a.y,2)) as by_row from g a join g b on a.exp=b.exp and a.particle=b.particle and b.r-a.r between 1 and 10 group by 1), c as (select b.frame-a.frame as lag, avg(pow(b.x-a.x,2)+pow(b.y-a.y,2)) as by_frame from g a join g b on a.exp=b.exp and a.particle=b.particle and b.frame-a.frame between 1 and 10 group by 1) select *, by_row/by_frame as bias from a join c using (lag)")
register("d33_transport_efficiency", "condition | lag n | eta eta_mean eta_median", lambda t: lag.transport_efficiency(lag.imsd(t.tracks, L), 0.5), f"with {IMSD} select condition, lag, sqrt(avg(msd))/(0.5*lag) as eta, avg(sqrt(msd)/(0.5*lag)) as eta_mean, quantile_cont(sqrt(msd)/(0.5*lag),0.5) as eta_median, count(*) as n from im group by 1,2")
register("d34_domain_reach", "condition | | crossing crossing_error reach", lambda t: lag.domain_reach(lag.at_lag(lag.imsd(t.tracks, L), "msd", 15, 3), kin.lag_displacement(t.tracks, 15).groupBy("condition").agg(F.percentile("r", 0.9).alias("r90")), t.cond, 2.5), f"with {IMSD}, m as (select condition, avg(msd) as m, stddev_samp(msd)/sqrt(count(*)) as e from im where lag=15 group by 1), r as (select condition, quantile_cont(sqrt(dx*dx+dy*dy),0.9) as r90 from pr where lag=15 group by 1) select condition, sqrt(m)/radius_um as crossing, e/(2*sqrt(m))/radius_um as crossing_error, r90/2.5 as reach from m join r using (condition) join cond using (condition)")
register("d36_pool_health", "| lag n not_positive outliers | top3", lambda t: lag.pool_health(lag.imsd(t.tracks, L)), f"with {IMSD}, l as (select *, log10(msd) as l from im), m as (select lag, quantile_cont(l,0.5) as m from l group by 1), d as (select l.*, abs(l-m) as d, row_number() over (partition by lag order by msd desc, exp, particle) as r from l join m using (lag)), w as (select lag, 1.4826*quantile_cont(d,0.5) as mad from d group by 1) select lag, count(*) as n, count(*) filter (where msd<=0) as not_positive, count(*) filter (where d/mad>5) as outliers, sum(msd) filter (where r<=3)/sum(msd) as top3 from d join w using (lag) group by 1 having count(*)>=10")
