"""Registered queries: distributions, profiles, fits, correlations and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bins import by_edges, uniform
from ..functions.curves import master
from ..operators import association as assoc
from ..operators import distributions as dist
from ..operators import fits
from ..operators import kinematics as kin
from ..operators import lagstats as lag
from .lags import IMSD, L
from .registry import register
from .tracks import STEP, TURN

y10 = lambda: uniform(F.col("y"), 0.0, 100.0, 10)
YBIN = "least(floor(y/10),9)"
VSTEP = f"{STEP}, vs as (select *, sqrt(dx*dx+dy*dy) as v, case when dx<>0 or dy<>0 then atan2(dy,dx) end as theta from steps where dx is not null)"
vel = lambda t: kin.velocity(t.tracks).where("v is not null")
HIST = "h as (select condition, exp, bin, coalesce(n,0) as n from (select distinct condition, exp from tracks) k cross join (select unnest(range(10)) as bin) b left join (select condition, exp, least(floor(y/10),9) as bin, count(*) as n from tracks where y between 0 and 100 group by 1,2,3) c using (condition, exp, bin))"

register("e01_histogram", "exp | bin | count density", lambda t: dist.histogram(t.tracks, "y", 0, 100, 10, ["exp"]), f"with {HIST} select exp, bin, n as count, n/(sum(n) over (partition by exp)*10) as density from h")
register("e02_clipped_histogram", "condition | bin | count density", lambda t: dist.histogram(t.tracks, "y", 20, 80, 6, ["condition"], "clip", F.col("x")), "with h as (select condition, greatest(0,least(5,floor((y-20)/10))) as bin, sum(x) as n from tracks group by 1,2) select condition, bin, n as count, n/(sum(n) over (partition by condition)*10) as density from h")
register("e03_ensemble_histogram", "condition | bin n | mean std sem pooled", lambda t: dist.ensemble_histogram(t.tracks, "y", 0, 100, 10), f"with {HIST}, d as (select *, n/(sum(n) over (partition by exp)*10.0) as d from h) select condition, bin, count(*) as n, avg(d) as mean, stddev_pop(d) as std, stddev_samp(d)/sqrt(count(*)) as sem, sum(d.n)/(sum(sum(d.n)) over (partition by condition)*10) as pooled from d group by condition, bin")
register("e04_ccdf", "condition | | x ccdf", lambda t: dist.ccdf(t.tracks.withColumn("q", F.round("y", 0)), "q", ["condition"]), "with c as (select condition, round(y,0) as x, count(*) as n from tracks where round(y,0)>0 group by 1,2) select condition, x, sum(n) over (partition by condition order by x desc)/sum(n) over (partition by condition) as ccdf from c")
register("e05_reach", "condition | n | r1 r5 r10 r50 r90 mean std sem", lambda t: dist.reach(kin.lag_displacement(t.tracks, 4), "r", ["condition"]), f"with s as (select *, sqrt(pow(lead(x,4) over w-x,2)+pow(lead(y,4) over w-y,2)) as r from tracks window w as (partition by exp, particle order by frame)) select condition, count(*) as n, {', '.join(f'quantile_cont(r,{p}) as r{int(p * 100)}' for p in (0.01, 0.05, 0.1, 0.5, 0.9))}, avg(r) as mean, stddev_samp(r) as std, stddev_samp(r)/sqrt(count(*)) as sem from s where r>0 group by 1")
register("e06_log_thinned", "condition | | x ccdf", lambda t: dist.log_thinned(dist.ccdf(t.tracks.withColumn("q", F.round("y", 0)), "q", ["condition"]), "x", ["condition"], 12), "with c as (select condition, round(y,0) as x, count(*) as n from tracks where round(y,0)>0 group by 1,2), d as (select condition, x, sum(n) over (partition by condition order by x desc)/sum(n) over (partition by condition) as ccdf from c), k as (select *, floor(round((ln(x)-ln(min(x) over w))/((ln(max(x) over w)-ln(min(x) over w))/11),9)) as k from d window w as (partition by condition)) select condition, x, ccdf from k qualify lag(k) over (partition by condition order by x) is null or k>lag(k) over (partition by condition order by x)")
register("e07_circular", "condition | n | mean_cos mean_sin mean_abs r mean_angle variance std", lambda t: dist.circular(vel(t), "theta", ["condition"]), f"with {VSTEP}, c as (select condition, count(*) as n, avg(cos(theta)) as mean_cos, avg(sin(theta)) as mean_sin, avg(abs(theta)) as mean_abs from vs where theta is not null group by 1) select *, sqrt(mean_cos*mean_cos+mean_sin*mean_sin) as r, atan2(mean_sin,mean_cos) as mean_angle, 1-sqrt(mean_cos*mean_cos+mean_sin*mean_sin) as variance, sqrt(-2*ln(sqrt(mean_cos*mean_cos+mean_sin*mean_sin))) as std from c")
DEV = "d as (select f.*, theta, atan2(sin(atan2(v,u)-theta),cos(atan2(v,u)-theta)) as d, sqrt(u*u+v*v) as w from field f join theta using (exp, frame) where u<>0 or v<>0)"
moving = lambda t: t.field.where("u <> 0 or v <> 0")
register("e08_axis_sums", "exp | | weight c1 s1 c2 abs aligned anti", lambda t: dist.axis_sums(moving(t), t.theta, F.hypot("u", "v")), f"with {DEV} select exp, sum(w) as weight, sum(w*cos(d)) as c1, sum(w*sin(d)) as s1, sum(w*cos(2*d)) as c2, sum(w*abs(d)) as abs, sum(case when abs(d)<radians(30) then w else 0 end) as aligned, sum(case when abs(d)>pi()-radians(30) then w else 0 end) as anti from d group by 1")
register("e09_axis_sign", "| sign | plus minus", lambda t: dist.axis_sign(moving(t), t.theta), f"with {DEV}, s as (select avg(cos(2*(atan2(v,u)-theta))) as plus, avg(cos(2*(atan2(v,u)+theta))) as minus from d) select *, case when minus>plus+0.05 then -1 else 1 end as sign from s")
register("e10_condition_histogram", "condition | bin n | mean sem pooled", lambda t: dist.ensemble_histogram(vel(t).withColumn("a", F.degrees("theta")).where("a is not null"), "a", -180, 180, 12), f"with {VSTEP}, a as (select *, least(floor((degrees(theta)+180)/30),11) as bin from vs where theta is not null), h as (select condition, exp, bin, coalesce(n,0) as n from (select distinct condition, exp from a) k cross join (select unnest(range(12)) as bin) b left join (select condition, exp, bin, count(*) as n from a group by 1,2,3) c using (condition, exp, bin)), d as (select *, n/(sum(n) over (partition by exp)*30.0) as d from h) select condition, bin, count(*) as n, avg(d) as mean, stddev_samp(d)/sqrt(count(*)) as sem, sum(d.n)/(sum(sum(d.n)) over (partition by condition)*30) as pooled from d group by condition, bin")
register("e11_smoothed_circular", "exp | bin | smooth", lambda t: dist.smoothed_circular(dist.histogram(t.tracks, "y", 0, 100, 10, ["exp"]), "count", ["exp"], 10, 1.0), f"with {HIST}, k as (select o, exp(-0.5*o*o) as w from (select unnest(range(-4,5)) as o)), z as (select sum(w) as s from k) select exp, ((bin+o)%10+10)%10 as bin, sum(n*w/s) as smooth from h cross join k cross join z group by 1,2")
abin = lambda: uniform(F.col("angle"), -3.1416, 3.1416, 8)
TN = f"{TURN.format(k=1).replace('from gaps', 'from tracks')}, tb as (select *, (v_in+v_out)/2 as v, floor((angle+3.1416)/(6.2832/8)) as bin from t4)"
turns = lambda t: kin.turning_angle(t.tracks)
register("e12_speed_vs_angle", "condition | bin n | mean std", lambda t: dist.two_level_profile(turns(t), abin(), "v_mean"), f"with {TN}, m as (select condition, exp, bin, avg(v) as m from tb group by 1,2,3 having count(*)>=2) select condition, bin, count(*) as n, avg(m) as mean, stddev_pop(m) as std from m group by 1,2")
register("e13_speed_ratio", "condition | bin n | mean std", lambda t: dist.ratio_profile(turns(t), abin(), "v_mean"), f"with {TN}, r as (select *, v/avg(v) over (partition by exp) as r from tb), m as (select condition, exp, bin, avg(r) as m from r group by 1,2,3 having count(*)>=2) select condition, bin, count(*) as n, avg(m) as mean, stddev_pop(m) as std from m group by 1,2")
register("e14_forward_contrast", "condition | n | contrast sem", lambda t: dist.forward_contrast(turns(t), "angle", "v_mean"), f"with {TN}, o as (select condition, exp, (avg(v) filter (where degrees(abs(angle))<=20) - avg(v) filter (where degrees(abs(angle))>=160))/avg(v) as d from tb group by 1,2 having count(*) filter (where degrees(abs(angle))<=20)>=3 and count(*) filter (where degrees(abs(angle))>=160)>=3) select condition, count(*) as n, avg(d) as contrast, stddev_samp(d)/sqrt(count(*)) as sem from o group by 1")
RANKS = "rk as (select *, rank() over (partition by condition order by a) + (count(*) over (partition by condition, a)-1)/2 as ra, rank() over (partition by condition order by b) + (count(*) over (partition by condition, b)-1)/2 as rb from ab)"
register("e15_speed_angle_correlation", "condition | n | pearson spearman slope intercept", lambda t: assoc.correlations(turns(t).withColumn("a", F.abs("angle")), "a", "v_mean", ["condition"]), f"with {TN}, ab as (select condition, abs(angle) as a, v as b from tb), {RANKS} select condition, count(*) as n, corr(a,b) as pearson, corr(ra,rb) as spearman, regr_slope(b,a) as slope, regr_intercept(b,a) as intercept from rk group by 1")
register("e16_joint_density", "condition | xb yb n | share", lambda t: dist.joint_density(t.tracks, by_edges(F.col("x"), [0, 1, 10, 50, 100, 1000]), y10(), ["condition"]), f"with j as (select condition, case when x<0 or x>1000 then null when x<1 then 0 when x<10 then 1 when x<50 then 2 when x<100 then 3 else 4 end as xb, {YBIN} as yb from tracks where y between 0 and 100) select condition, xb, yb, count(*) as n, count(*)/sum(count(*)) over (partition by condition) as share from j where xb is not null group by 1,2,3")
register("e17_percentile_profile", "condition | bin n percent | value", lambda t: dist.percentile_profile(t.tracks, y10(), "x", ["condition"], [80, 90, 95], 10), f"with q as (select condition, {YBIN} as bin, count(*) as n, quantile_cont(x,[0.8,0.9,0.95]) as q from tracks where y between 0 and 100 group by 1,2 having count(*)>=10) select condition, bin, n, unnest([80,90,95]) as percent, unnest(q) as value from q")
PROF = "avg({y}) as mean, stddev_samp({y}) as std, stddev_samp({y})/sqrt(count({y})) as sem, quantile_cont({y},0.25) as q25, quantile_cont({y},0.5) as q50, quantile_cont({y},0.75) as q75, count({y}) as n"
register("e18_quantile_bins", "condition | bin n | mean std sem q25 q50 q75", lambda t: dist.profile(dist.quantile_bins(t.tracks.withColumn("k", F.floor("y")), "k", ["condition"], 8), F.col("bin"), "x", ["condition"]), f"with e as (select condition, list_sort(list_distinct(quantile_cont(floor(y),[0,0.125,0.25,0.375,0.5,0.625,0.75,0.875,1]))) as e from tracks group by 1), b as (select t.*, greatest(0, least(len(list_filter(e, lambda v: v<=floor(y))), len(e)-1)-1) as bin from tracks t join e using (condition)) select condition, bin, {PROF.format(y='x')} from b group by 1,2")
register("e19_equal_bins", "condition | bin n | q50", lambda t: dist.profile(t.tracks, y10(), "x", ["condition"], 5), f"select condition, {YBIN} as bin, {PROF.format(y='x')} from tracks where y between 0 and 100 group by 1,2 having count(x)>=5")
register("e20_given_edges", "condition | bin n | mean std sem q25 q50 q75", lambda t: dist.profile(t.tracks, by_edges(F.col("y"), [0, 5, 20, 60, 100], "right"), "x", ["condition"]), f"select condition, case when y<0 or y>100 then null when y<=5 then 0 when y<=20 then 1 when y<=60 then 2 else 3 end as bin, {PROF.format(y='x')} from tracks where y between 0 and 100 group by 1,2")
register("e21_bin_number", "condition | n bins | low high", lambda t: dist.bin_number(t.tracks, "y", ["condition"]), "with s as (select condition, count(y) as n, min(y) as low, max(y) as high, quantile_cont(y,0.75)-quantile_cont(y,0.25) as iqr from tracks group by 1) select *, coalesce(ceil((high-low)/nullif(2*iqr/cbrt(n),0)), ceil(log2(n))+1) as bins from s")
register("e21_sturges", "condition | n bins | ", lambda t: dist.bin_number(t.tracks, "y", ["condition"], "sturges"), "select condition, count(y) as n, ceil(log2(count(y)))+1 as bins from tracks group by 1")
register("e22_log_bins", "condition | bin n particles | median x_mean", lambda t: dist.log_bins(t.tracks, "x", "y", 3, 2), "with l as (select *, log10(x) as l from tracks where x>0 and y>0), s as (select condition, min(l) as lo, max(l) as hi, ceil((max(l)-min(l))/(2*(quantile_cont(l,0.75)-quantile_cont(l,0.25))/cbrt(count(l)))) as k from l group by 1), b as (select l.*, least(floor((l-lo)/((hi-lo)/k)),k-1) as bin from l join s using (condition)) select condition, bin, count(*) as n, count(distinct particle) as particles, quantile_cont(y,0.5) as median, exp(avg(ln(x))) as x_mean from b group by 1,2 having count(*)>=3 and count(distinct particle)>=2")
register("e24_exceedance", "| bin n k | limit p error potential", lambda t: dist.exceedance(t.tracks, y10(), "x", [20, 60, 100], 5), f"with b as (select *, {YBIN} as bin from tracks where y between 0 and 100), g as (select l as \"limit\", bin, count(*) as n, count(*) filter (where x>l) as k from b cross join (select unnest([20.0,60.0,100.0]) as l) group by 1,2 having count(*)>=5) select *, k/n as p, sqrt(k/n*(1-k/n)/n) as error, case when k>0 then -ln(k/n) end as potential from g")
register("e25_odds_posterior", "| bin | limit odds posterior odds_error posterior_error", lambda t: dist.exceedance(t.tracks, y10(), "x", [20, 60, 100], 5), f"with b as (select *, {YBIN} as bin from tracks where y between 0 and 100), g as (select l as \"limit\", bin, count(*) as n, count(*) filter (where x>l) as k from b cross join (select unnest([20.0,60.0,100.0]) as l) group by 1,2), s as (select *, k/n as p, sum(k) over w as kk, sum(k) over w/sum(n) over w as pp from g window w as (partition by \"limit\")), o as (select *, p/nullif(pp,0) as odds, k/nullif(kk,0) as posterior from s) select \"limit\", bin, odds, posterior, case when odds>0 then odds*sqrt(greatest(p*(1-p),1e-6)/n/(p*p)+(1-pp)/kk) end as odds_error, case when kk>0 then sqrt(greatest(posterior*(1-posterior),1e-6)/kk) end as posterior_error from o")
register("e26_mean_above", "| bin | limit mean_above", lambda t: dist.exceedance(t.tracks, y10(), "x", [20, 60, 100], 5), f"with b as (select *, {YBIN} as bin from tracks where y between 0 and 100) select l as \"limit\", bin, avg(x) filter (where x>l) as mean_above from b cross join (select unnest([20.0,60.0,100.0]) as l) group by 1,2 having count(*)>=5")
register("e28_kde_2d", "condition | | gx gy density potential", lambda t: dist.kde2(vel(t).withColumns({"a": F.col("vx") / 50, "b": F.col("vy") / 50}), "a", "b", ["condition"], 2.0, 5), f"with {VSTEP}, p as (select condition, dx/50 as a, dy/50 as b from vs), s as (select condition, var_samp(a)*pow(count(*),-1/3.0) as sa, var_samp(b)*pow(count(*),-1/3.0) as sc, covar_samp(a,b)*pow(count(*),-1/3.0) as sb, count(*) as n from p group by 1), g as (select gx, gy from (select unnest([-2.0,-1.0,0.0,1.0,2.0]) as gx) cross join (select unnest([-2.0,-1.0,0.0,1.0,2.0]) as gy)), d as (select condition, gx, gy, sum(exp(-(sc*(gx-a)*(gx-a)-2*sb*(gx-a)*(gy-b)+sa*(gy-b)*(gy-b))/(sa*sc-sb*sb)/2)/(n*2*pi()*sqrt(sa*sc-sb*sb))) as density from p join s using (condition) cross join g group by 1,2,3) select *, -ln(density/max(density) over (partition by condition)) as potential from d")
register("e29_even_odd", "exp | bin | even odd", lambda t: dist.even_odd(dist.histogram(t.tracks, "y", 0, 100, 10, ["exp"]).withColumn("s", F.col("bin") - 4.5), "s", "density", ["exp"]), f"with {HIST}, d as (select *, n/(sum(n) over (partition by exp)*10.0) as d from h) select a.exp, a.bin, (a.d+b.d)/2 as even, (a.d-b.d)/2 as odd from d a join d b on a.exp=b.exp and a.bin=9-b.bin")
register("e30_kde", "condition | | at density", lambda t: dist.kde(t.tracks, "y", ["condition"], 0.0, 100.0, 11), "with s as (select condition, stddev_samp(y)*pow(count(y)*0.75,-0.2) as h, count(y) as n from tracks group by 1) select condition, pt as \"at\", sum(exp(-0.5*pow((pt-y)/h,2))/(n*h*2.5066282746310002)) as density from tracks join s using (condition) cross join (select unnest(range(11))*10.0 as pt) group by 1,2")
register("e31_bimodality", "exp | stop_bin run_bin | valley_ratio", lambda t: dist.bimodality(dist.histogram(t.tracks, "y", 0, 100, 10, ["exp"]), ["exp"], 5), f"with {HIST}, s as (select *, avg(n) over (partition by exp order by bin rows between 1 preceding and 1 following) as s from h), p as (select exp, max(s) filter (where bin<5) as l, max(s) filter (where bin>=5) as r from s group by 1), q as (select exp, min(bin) filter (where bin<5 and s=l) as stop_bin, min(bin) filter (where bin>=5 and s=r) as run_bin, any_value(l) as l, any_value(r) as r from s join p using (exp) group by 1) select exp, stop_bin, run_bin, min(s)/least(any_value(l),any_value(r)) as valley_ratio from q join s using (exp) where bin between stop_bin and run_bin group by 1,2,3")
register("e32_direction_histogram", "condition | bin | count density", lambda t: dist.histogram(kin.lag_displacement(t.tracks, 3).withColumn("a", F.degrees(F.atan2("dy", "dx"))), "a", -180, 180, 12, ["condition"]), "with s as (select *, degrees(atan2(lead(y,3) over w-y, lead(x,3) over w-x)) as a from tracks window w as (partition by exp, particle order by frame)), h as (select condition, least(floor((a+180)/30),11) as bin, count(*) as n from s where a is not null group by 1,2) select condition, bin, n as count, n/(sum(n) over (partition by condition)*30) as density from h")
register("e33_ratio_bins", "condition | bin n | ratio", lambda t: dist.ratio_bins(t.tracks, y10(), "x", "y", ["condition"]), f"select condition, {YBIN} as bin, count(*) as n, sum(x)/nullif(sum(y),0) as ratio from tracks where y between 0 and 100 group by 1,2")
register("e34_long_table", "exp name | particle frame | value", lambda t: dist.long_table(t.tracks, ["exp", "particle", "frame"], ["x", "y"]), "select exp, particle, frame, 'x' as name, x as value from tracks union all select exp, particle, frame, 'y', y from tracks")
register("e34_wide_table", "exp | | c0 c1 c2", lambda t: dist.wide_table(t.tracks.groupBy("exp", "condition").agg(F.avg("x").alias("m")), ["exp"], "condition", ["c0", "c1", "c2"], "m"), "select exp, avg(x) filter (where condition='c0') as c0, avg(x) filter (where condition='c1') as c1, avg(x) filter (where condition='c2') as c2 from tracks group by 1")
register("e36_log_moments", "condition | n | mean std", lambda t: dist.log_moments(vel(t), "v", ["condition"]), f"with {VSTEP} select condition, count(*) as n, avg(ln(v)) as mean, stddev_pop(ln(v)) as std from vs where v>0 group by 1")


curve = lambda t: t.tracks.groupBy("exp", (F.floor(F.col("y") / 10) + 1).alias("r")).agg(F.exp(-(F.floor(F.first(F.col("y")) / 10) + 1) / 3).alias("_e"), (F.avg("x") / 500).alias("_m"), F.count("*").alias("n")).select("exp", "r", (F.exp(-F.col("r") / 3) * (1 + F.col("_m"))).alias("c"), (F.lit(0.1) / F.sqrt("n")).alias("sem"))
CURVE = "cv as (select exp, floor(y/10)+1 as r, exp(-(floor(y/10)+1)/3)*(1+avg(x)/500) as c, 0.1/sqrt(count(*)) as sem from tracks group by exp, floor(y/10)+1)"
PEAK = f"{CURVE}, pk as (select *, arg_max(r, c) over (partition by exp) as p, max(c) over (partition by exp) as m from cv), on_ as (select *, row_number() over (partition by exp order by r) as i from pk where r>=p)"
WLS = "s as (select exp, sum(w) as s0, sum(w*x) as s1, sum(w*y) as t1, sum(w*x*x) as s2, sum(w*x*y) as sxy, sum(w*y*y) as syy, count(*) as n from wl group by 1), f as (select *, (s0*sxy-s1*t1)/(s0*s2-s1*s1) as slope, (s2*t1-s1*sxy)/(s0*s2-s1*s1) as icpt from s), e as (select *, sqrt(greatest(syy-slope*sxy-icpt*t1,0)/(n-2)*s0/(s0*s2-s1*s1)) as err from f)"
register("x01_correlation_length", "exp | n | xi a", lambda t: fits.correlation_length(curve(t), ["exp"]), f"with {PEAK} select exp, -1/regr_slope(ln(c),r) as xi, exp(regr_intercept(ln(c),r)) as a, count(*) as n from on_ where c>=0.01 group by 1 having count(*)>=3 and regr_slope(ln(c),r)<-1e-6")
register("x02_weighted_length", "exp | n | xi xi_error", lambda t: fits.weighted_length(curve(t), ["exp"]), f"with {CURVE}, wl as (select exp, r as x, ln(c) as y, pow(c/sem,2) as w from cv where c>=0.01), {WLS} select exp, n, -1/slope as xi, err/pow(slope,2) as xi_error from e where slope<-1e-6 and n>=3")
register("x02_gaussian_length", "exp | n | xi xi_error", lambda t: fits.weighted_length(curve(t), ["exp"], gaussian=True), f"with {CURVE}, wl as (select exp, r*r as x, ln(c) as y, pow(c/sem,2) as w from cv where c>=0.01), {WLS} select exp, n, 1/sqrt(-slope) as xi, err/2*pow(-slope,-1.5) as xi_error from e where slope<-1e-6 and n>=3")
register("x03_until_drop", "exp | | r c", lambda t: fits.until_drop(curve(t), ["exp"]), f"with {PEAK}, q as (select *, min(case when c<exp(-1)*m then i end) over (partition by exp) as e from on_) select exp, r, c from q where e is null or i<=greatest(e,3)")
register("x04_many_lengths", "exp | particle n | xi", lambda t: fits.correlation_length(t.tracks.groupBy("exp", "particle", (F.floor(F.col("y") / 25) + 1).alias("r")).agg((F.max("x") / 1000).alias("c")), ["exp", "particle"]), "with cv as (select exp, particle, floor(y/25)+1 as r, max(x)/1000 as c from tracks group by 1,2,3), p as (select *, first_value(r) over (partition by exp, particle order by c desc, r) as p from cv) select exp, particle, count(*) as n, -1/regr_slope(ln(c),r) as xi from p where r>=p and c>=0.01 group by 1,2 having count(*)>=3 and regr_slope(ln(c),r)<-1e-6")
register("x05_power_law", "condition | n | exponent amplitude r2", lambda t: fits.power_law(lag.ensemble(lag.imsd(t.tracks, L), "msd", ["condition", "lag"]), "lag", "mean", ["condition"]), f"with {IMSD}, e as (select condition, lag, avg(msd) as m from im group by 1,2) select condition, count(*) as n, -regr_slope(ln(m),ln(lag)) as exponent, exp(regr_intercept(ln(m),ln(lag))) as amplitude, regr_r2(ln(m),ln(lag)) as r2 from e group by 1")
register("x06_exponential_pdf", "exp | n | length length_error", lambda t: fits.exponential_pdf(dist.histogram(t.tracks, "x", 0, 300, 10, ["exp"]), "bin", "density", F.sqrt("count"), ["exp"], 0, 8), "with h as (select exp, least(floor(x/30),9) as bin, count(*) as n from tracks where x between 0 and 300 group by 1,2), d as (select *, n/(sum(n) over (partition by exp)*30) as d from h), wl as (select exp, bin as x, ln(d) as y, n as w from d where bin<=8), " + WLS + " select exp, n, -1/slope as length, err/pow(slope,2) as length_error from e where slope<0")
register("x07_exponential_ccdf", "condition | n | tau", lambda t: fits.exponential_ccdf(dist.ccdf(t.tracks, "x", ["condition"]), t.tracks, ["condition"], "x"), "with c as (select condition, x, count(*) as k from tracks where x>0 group by 1,2), d as (select condition, x, sum(k) over (partition by condition order by x desc)/sum(k) over (partition by condition) as s, sum(k) over (partition by condition) as n from c) select condition, any_value(n) as n, -1/(sum(s*n*x*ln(s))/sum(s*n*x*x)) as tau from d group by 1")
register("x09_von_mises", "condition | | r mean_angle kappa", lambda t: fits.von_mises(dist.circular(vel(t), "theta", ["condition"])), f"with {VSTEP}, c as (select condition, sqrt(pow(avg(cos(theta)),2)+pow(avg(sin(theta)),2)) as r, atan2(avg(sin(theta)),avg(cos(theta))) as mean_angle from vs where theta is not null group by 1) select *, case when r<0.53 then 2*r+pow(r,3)+5*pow(r,5)/6 when r<0.85 then -0.4+1.39*r+0.43/(1-r) else 1/(pow(r,3)-4*r*r+3*r) end as kappa from c")
register("x10_ols", "condition | n | slope intercept slope_error intercept_error r2 aic loo_rmse", lambda t: fits.ols(t.tracks, "y", "x", ["condition"]), "with s as (select condition, count(*) as n, avg(y) as mx, regr_sxx(x,y) as sxx, regr_slope(x,y) as slope, regr_intercept(x,y) as intercept, regr_r2(x,y) as r2 from tracks group by 1), e as (select t.condition, x-intercept-slope*y as e, 1/n+pow(y-mx,2)/sxx as h from tracks t join s using (condition)), g as (select condition, sum(e*e) as rss, sqrt(avg(pow(e/(1-h),2))) as loo_rmse from e group by 1) select condition, n, slope, intercept, sqrt(rss/(n-2)/sxx) as slope_error, sqrt(rss/(n-2)*(1/n+mx*mx/sxx)) as intercept_error, r2, n*ln(rss/n)+4 as aic, loo_rmse from s join g using (condition)")
register("x12_within_slope", "condition | n | r slope", lambda t: assoc.within_correlation(t.tracks, "y", "x", kin.KEY, ["condition"]), "with d as (select condition, y-avg(y) over w as a, x-avg(x) over w as b from tracks window w as (partition by exp, particle)) select condition, count(*) as n, corr(a,b) as r, sum(a*b)/sum(a*a) as slope from d group by 1")
register("x13_inverse_variance", "condition | n | mean error", lambda t: fits.inverse_variance_mean(t.tracks.groupBy("condition", "exp", "particle").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s")), "m", "s", ["condition"]), "with p as (select condition, exp, particle, avg(y) as m, stddev_samp(y) as s from tracks group by 1,2,3) select condition, count(*) as n, sum(m/(s*s))/sum(1/(s*s)) as mean, 1/sqrt(sum(1/(s*s))) as error from p where s>0 group by 1")
register("x15_selection_bias", "condition | | median_ratio regression", lambda t: fits.selection_bias(vel(t), "vx", "vy", 20.0, ["condition"]), f"with {VSTEP} select condition, quantile_cont(case when abs(dy)>20 then dx/dy end,0.5) as median_ratio, sum(dx*dy)/sum(dy*dy) as regression from vs group by 1")
register("x16_curve_fits", "condition model | n rank | ", lambda t: fits.curve_fits(lag.ensemble(lag.imsd(t.tracks, L), "msd", ["condition", "lag"]).select("condition", F.col("lag").cast("double").alias("x"), F.col("mean").alias("y"), F.col("sem").alias("sigma")), ["condition"], sorted(fits.MODELS)))
register("x17_scaled_curve", "condition | | xi v0 rss", lambda t: fits.scaled_curve(lag.ensemble(lag.imsd(t.tracks, L), "msd", ["condition", "lag"]).withColumn("m", F.col("mean") / 1000), "lag", "m", master, [0.5 + 0.5 * i for i in range(16)], ["condition"]), f"with {IMSD}, e as (select condition, lag, avg(msd)/1000 as y from im group by 1,2), g as (select *, (1-exp(-lag/xi))/(lag/xi) as g from e cross join (select 0.5+0.5*unnest(range(16)) as xi)), s as (select condition, xi, sum(y*g)/sum(g*g) as v0, sum(y*y)-pow(sum(y*g),2)/sum(g*g) as rss from g group by 1,2) select * from s qualify row_number() over (partition by condition order by rss, xi)=1")
register("x18_sign_change", "exp | particle | crossing", lambda t: fits.sign_change(t.tracks.withColumn("z", F.col("y") - 50), kin.KEY, "frame", "z"), "with n as (select exp, particle, frame, y-50 as z, lag(frame) over w as f0, lag(y-50) over w as z0 from tracks window w as (partition by exp, particle order by frame)) select exp, particle, min(f0-z0*(frame-f0)/(z-z0)) as crossing from n where z0*z<0 group by 1,2")
register("x18_hermite", "exp | particle | at value", lambda t: fits.hermite(t.gaps, kin.KEY, "frame", "y", [10.5, 40.25, 80.75]), "with c as (select *, lead(frame) over w-frame as h, (lead(y) over w-y)/(lead(frame) over w-frame) as d from gaps window w as (partition by exp, particle order by frame)), p as (select *, lag(h) over w as h0, lag(d) over w as d0 from c window w as (partition by exp, particle order by frame)), m as (select *, case when d0 is null then d when d is null then d0 when d0*d<=0 then 0 else (3*h+3*h0)/((2*h+h0)/d0+(h+2*h0)/d) end as m from p), q as (select *, lead(y) over w as y2, lead(m) over w as m2 from m window w as (partition by exp, particle order by frame)), a as (select *, (pt-frame)/h as t from q cross join (select unnest([10.5,40.25,80.75]) as pt) where h is not null and pt>=frame and pt<frame+h) select exp, particle, pt as \"at\", (2*t*t*t-3*t*t+1)*y+(t*t*t-2*t*t+t)*h*m+(-2*t*t*t+3*t*t)*y2+(t*t*t-t*t)*h*m2 as value from a")
register("j01_correlations", "condition | n | pearson spearman slope intercept slope0 r2_0", lambda t: assoc.correlations(t.tracks.withColumn("k", F.floor("y")), "k", "x", ["condition"]), f"with ab as (select condition, floor(y) as a, x as b from tracks), {RANKS} select condition, count(*) as n, corr(a,b) as pearson, corr(ra,rb) as spearman, regr_slope(b,a) as slope, regr_intercept(b,a) as intercept, sum(a*b)/sum(a*a) as slope0, pow(sum(a*b),2)/(sum(a*a)*sum(b*b)) as r2_0 from rk group by 1")
register("j02_within_correlation", "exp | n | r slope", lambda t: assoc.within_correlation(t.tracks, "x", "y", ["exp", "particle"], ["exp"]), "with d as (select exp, x-avg(x) over w as a, y-avg(y) over w as b from tracks window w as (partition by exp, particle)) select exp, count(*) as n, corr(a,b) as r, sum(a*b)/sum(a*a) as slope from d group by 1")
register("j03_two_samples", "| | t df u z", lambda t: assoc.two_samples(t.tracks.groupBy("exp", "particle").agg(F.avg("y").alias("m")).withColumn("first", F.col("exp") < "e3"), "m", "first"), "with p as (select exp, particle, avg(y) as m, exp<'e3' as f from tracks group by 1,2), r as (select *, rank() over (order by m) + (count(*) over (partition by m)-1)/2 as r from p), s as (select avg(m) filter (where f) as ma, avg(m) filter (where not f) as mb, var_samp(m) filter (where f) as va, var_samp(m) filter (where not f) as vb, (count(*) filter (where f))::double as na, (count(*) filter (where not f))::double as nb, sum(r) filter (where f) as ra from r) select (ma-mb)/sqrt(va/na+vb/nb) as t, pow(va/na+vb/nb,2)/(pow(va/na,2)/(na-1)+pow(vb/nb,2)/(nb-1)) as df, ra-na*(na+1)/2 as u, (ra-na*(na+1)/2-na*nb/2)/sqrt(na*nb*(na+nb+1)/12) as z from s")
register("j04_ks_distance", "condition | | distance", lambda t: assoc.ks_distance(t.tracks.withColumn("f", F.col("frame") < 20), "x", "f", ["condition"]), "with c as (select condition, x, count(*) filter (where frame<20) as a, count(*) filter (where frame>=20) as b from tracks group by 1,2), g as (select condition, abs(sum(a) over w/sum(a) over (partition by condition)-sum(b) over w/sum(b) over (partition by condition)) as g from c window w as (partition by condition order by x)) select condition, max(g) as distance from g group by 1")
register("j05_variance_split", "| | between within whole", lambda t: assoc.variance_split(t.tracks, "y", "exp"), "with m as (select y, avg(y) over (partition by exp) as m from tracks) select var_pop(m) as \"between\", avg(pow(y-m,2)) as within, var_pop(y) as whole from m")
register("j06_weighted_median", "condition | | median", lambda t: assoc.weighted_median(t.tracks, "y", "x", ["condition"]), "with c as (select condition, y, sum(x) as w from tracks group by 1,2), r as (select *, sum(w) over (partition by condition order by y) as run, sum(w) over (partition by condition) as total from c) select condition, min(y) as median from r where run>=total/2 group by 1")
register("e23_merged_bins", "condition | group n first_bin last_bin | mean", lambda t: dist.merged_bins(t.tracks, uniform(F.col("x"), 0, 500, 50, "clip"), "y", 200),
         "with recursive r as (select condition, greatest(0,least(49,floor(x/10)))::int as bin, y from tracks where x is not null), b as (select condition, bin, count(*) as n, row_number() over (partition by condition order by bin) as i from r group by 1,2), w as (select condition, i, bin, 0 as g, n as held from b where i=1 union all select b.condition, b.i, b.bin, case when w.held>=200 then w.g+1 else w.g end, case when w.held>=200 then b.n else w.held+b.n end from w join b on w.condition=b.condition and b.i=w.i+1), f as (select *, greatest(0, count(*) filter (where held>=200) over (partition by condition)-1) as last from w) select condition, least(g,last) as \"group\", count(*) as n, min(bin) as first_bin, max(bin) as last_bin, avg(y) as mean from r join f using (condition, bin) group by 1,2")
register("x11_weighted_design", "| i | beta", lambda t: t.spark.createDataFrame(list(enumerate(fits.weighted_design(t.tracks, "x", "y", ["frame"]))), "i int, beta double"), "with g as (select sum(y*y) as a, sum(y*y*frame) as b, sum(y*y*frame*frame) as d, sum(y*x) as p, sum(y*frame*x) as q from tracks) select 0 as i, (d*p-b*q)/(a*d-b*b) as beta from g union all select 1, (a*q-b*p)/(a*d-b*b) from g")
