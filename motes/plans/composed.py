"""Registered queries composed of several operators, and streaming forms on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bins import uniform
from ..functions.curves import master
from ..operators import composed as com
from ..operators import distributions as dist
from ..operators import field as fld
from ..operators import kinematics as kin
from ..operators import lagstats as lag
from ..operators import spatial as spa
from ..operators import states as sta
from .fields import NEAR, ON, SPIN, UNIT, on_flow, spun
from .lags import IMSD, L
from .registry import register
from .states import POIS, U
from .tracks import STEP

exps = lambda t: t.tracks.select("exp", "condition").distinct()
register("p01_field_and_msd", "condition | n | msd msd_sem polar polar_sem", lambda t: com.summary(com.experiment_records([lag.at_lag(lag.imsd(t.tracks, L), "msd", 10, 0).groupBy("exp").agg(F.avg("msd").alias("msd")), fld.frame_order(t.field).groupBy("exp").agg(F.avg("polar").alias("polar"))], exps(t)), ["msd", "polar"], ["condition"]),
         f"with {IMSD}, {UNIT}, a as (select exp, avg(msd) as msd from im where lag=10 group by 1), f as (select exp, frame, sqrt(pow(avg(u),2)+pow(avg(v),2)) as p from un group by 1,2), b as (select exp, avg(p) as polar from f group by 1), r as (select distinct exp, condition from tracks) select condition, count(*) as n, avg(msd) as msd, stddev_samp(msd)/sqrt(count(msd)) as msd_sem, avg(polar) as polar, stddev_samp(polar)/sqrt(count(polar)) as polar_sem from r left join a using (exp) left join b using (exp) group by 1")
COSV = "case when (u=0 and v=0) or (vx=0 and vy=0) then 0 else (vx*u+vy*v)/(sqrt(vx*vx+vy*vy)*sqrt(u*u+v*v)) end"
cosed = lambda t: on_flow(t).withColumn("c", spa.cosine(F.col("vx"), F.col("vy"), F.col("u"), F.col("v")))
register("p02_direction_agreement", "condition | n | mean sem", lambda t: com.two_level(cosed(t), "c", kin.KEY, ["condition"], 2), f"with {ON}, p as (select condition, exp, particle, avg({COSV}) as m from tr group by 1,2,3 having count(*)>=2) select condition, count(*) as n, avg(m) as mean, stddev_samp(m)/sqrt(count(*)) as sem from p group by 1")
register("p03_instantaneous_table", "exp | frame particle | c order", lambda t: cosed(t).join(spa.order_by_size(t.on_field, t.field, 3).where("size = 3"), ["exp", "frame", "particle"]), f"with {ON.replace('p.condition, ', 'p.condition, p.frame, ')}, {NEAR.format(r=3)}, o as (select exp, frame, particle, sqrt(pow(avg(u/sqrt(u*u+v*v)),2)+pow(avg(v/sqrt(u*u+v*v)),2)) as \"order\" from nr where u<>0 or v<>0 group by 1,2,3 having count(*) filter (where ceil(sqrt(d2))=3)>0) select tr.exp, tr.frame, tr.particle, {COSV} as c, \"order\" from tr join o on tr.exp=o.exp and tr.frame=o.frame and tr.particle=o.particle")
register("p04_tilt", "condition | | k1 k2", lambda t: com.even_odd_moments(dist.histogram(kin.velocity(t.tracks).where("theta is not null").withColumn("c", F.cos("theta")), "c", -1, 1, 10, ["condition"]).withColumn("m", F.col("bin") - 4.5), ["condition"], "m", "density"), f"with {STEP}, b as (select condition, least(floor((cos(atan2(dy,dx))+1)/0.2),9) as bin from steps where dx<>0 or dy<>0), h as (select condition, bin, count(*) as n from b group by 1,2), d as (select *, n/(sum(n) over (partition by condition)*0.2) as d from h), e as (select a.condition, a.bin-4.5 as c, (a.d+b.d)/2 as ev, (a.d-b.d)/2 as od from d a join d b on a.condition=b.condition and a.bin=9-b.bin where a.bin>4) select condition, sum(0.5*ln((1+od/ev)/(1-od/ev))*c)/sum(c*c) as k1, regr_slope(ln(ev),c*c) as k2 from e group by 1")
register("p05_order_and_displacement", "exp | frame particle | order dx dy", lambda t: com.order_and_displacement(spa.rings(t.on_field, t.field, [(0.0, 3.0)]), kin.lag_displacement(t.tracks, 3), 2).select("exp", "frame", "particle", "order", "dx", "dy"), f"with {NEAR.format(r=3)}, o as (select exp, frame, particle, sqrt(pow(avg(u/sqrt(u*u+v*v)),2)+pow(avg(v/sqrt(u*u+v*v)),2)) as \"order\" from nr where (u<>0 or v<>0) and frame%2=0 group by 1,2,3), d as (select *, lead(x,3) over w-x as dx, lead(y,3) over w-y as dy from tracks window w as (partition by exp, particle order by frame)) select o.exp, o.frame, o.particle, \"order\", dx, dy from o join d on o.exp=d.exp and o.particle=d.particle and o.frame=d.frame where dx is not null")
register("p06_order_vs_scaled_radius", "condition exp | n | observed x predicted residual", lambda t: com.movie_table(spa.rings(t.on_field, t.field, [(0.0, 3.0)]).join(exps(t), "exp"), "order", t.field.groupBy("exp").agg((F.avg(F.hypot("u", "v")) * 100).alias("xi")), F.lit(3.0), master), f"with {NEAR.format(r=3)}, o as (select exp, frame, particle, sqrt(pow(avg(u/sqrt(u*u+v*v)),2)+pow(avg(v/sqrt(u*u+v*v)),2)) as o from nr where u<>0 or v<>0 group by 1,2,3), m as (select condition, exp, count(*) as n, avg(o) as observed from o join (select distinct exp, condition from tracks) using (exp) group by 1,2), x as (select m.*, 3.0/xi as x from m join (select exp, avg(sqrt(u*u+v*v))*100 as xi from field group by 1) using (exp)) select *, (1-exp(-x))/x as predicted, observed-(1-exp(-x))/x as residual from x")
register("p10_residuals", "condition | n | mean std skew kurtosis", lambda t: com.residuals(t.tracks, "y", "x", "condition", 2.5), "with f as (select condition, regr_slope(x,y) as s, regr_intercept(x,y) as i from tracks group by 1), e as (select condition, x-i-s*y as e from tracks join f using (condition)), z as (select *, (e-avg(e) over (partition by condition))/stddev_samp(e) over (partition by condition) as z from e), k as (select condition, e, avg(e) over (partition by condition) as m from z where abs(z)<=2.5) select condition, count(*) as n, avg(e) as mean, stddev_samp(e) as std, avg(pow(e-m,3))/pow(var_pop(e),1.5) as skew, avg(pow(e-m,4))/pow(var_pop(e),2)-3 as kurtosis from k group by 1")
register("p11_length_definitions", "exp | | xi_e xi_integral", lambda t: com.length_definitions(t.tracks.groupBy("exp", (F.floor(F.col("y") / 10) + 1).alias("r")).agg((F.exp(-(F.floor(F.first("y") / 10) + 1) / 3) * (1 + F.avg("x") / 500)).alias("c")), ["exp"]), "with cv as (select exp, floor(y/10)+1 as r, exp(-(floor(y/10)+1)/3)*(1+avg(x)/500) as c from tracks group by exp, floor(y/10)+1), l as (select *, lag(r) over w as r0, lag(c) over w as c0, first_value(c) over w as f from cv window w as (partition by exp order by r)) select exp, min(case when c<f*exp(-1.0) and c0>=f*exp(-1.0) then r0+(c0-f*exp(-1.0))/(c0-c)*(r-r0) end) as xi_e, sum((c+c0)/2*(r-r0))/any_value(f) as xi_integral from l group by 1")
register("p12_speed_table", "condition exp | n | v v_sem", lambda t: com.summary(kin.gap_dividing_speed(t.gaps).where("v is not null"), ["v"], ["condition", "exp"]), f"with {STEP.replace('from tracks', 'from gaps')}, s as (select *, sqrt(dx*dx+dy*dy)/df as v from steps where df>0) select condition, exp, count(*) as n, avg(v) as v, stddev_samp(v)/sqrt(count(v)) as v_sem from s group by 1,2")
register("p13_run_tumble_diffusion", "condition | | diffusion", lambda t: com.run_tumble_diffusion(exps(t).select("condition").distinct(), sta.dwell_statistics(kin.velocity(t.tracks).where("v is not null").withColumn("state", (F.col("v") >= 60).cast("int")), kin.KEY, []).where("state = 1").selectExpr("'c0' as condition", "rate as f"), kin.velocity(t.tracks).groupBy("condition").agg(F.avg("v").alias("v")), t.tracks.groupBy("condition").agg((F.avg("y") / 10).alias("tau")), 0.1), f"with {STEP}, v as (select condition, avg(sqrt(dx*dx+dy*dy)) as v from steps group by 1), st as (select *, (sqrt(dx*dx+dy*dy)>=60)::int as state from steps where dx is not null), rc as (select *, lead(state) over (partition by exp, particle order by frame) as ns from st), f as (select count(*) filter (where ns=0)/count(*) as f from rc where state=1) select condition, 0.1+case when condition='c0' then (select f from f)*v*v*(select avg(y)/10 from tracks t where t.condition=v.condition)/2 else 0 end as diffusion from v")
register("p14_follower", "condition | n | over_flow over_speed", lambda t: com.follower(spa.rings(t.on_field, t.field, [(1.0, 3.0)]).join(t.on_field.select("condition", "exp", "frame", "particle", (F.col("x") / 100).alias("vx"), (F.col("y") / 100).alias("vy")), ["exp", "frame", "particle"])), f"with {NEAR.format(r=3)}, g as (select exp, frame, particle, avg(u) as mu, avg(v) as mv, avg(sqrt(u*u+v*v)) as speed from nr where (u<>0 or v<>0) and d2>=1 group by 1,2,3) select condition, count(*) as n, avg(sqrt(x*x+y*y)/100)/avg(sqrt(mu*mu+mv*mv)) as over_flow, avg(sqrt(x*x+y*y)/100)/avg(speed) as over_speed from g join on_field using (exp, frame, particle) group by 1")
register("p15_m2_scaling", "exp | window | m2 x", lambda t: fld.block_curve(spun(t), [2, 4, 8], 0.5, 32).join(t.field.groupBy("exp").agg((F.avg(F.hypot("u", "v")) * 100).alias("xi")), "exp").withColumn("x", F.col("window") / F.col("xi")), f"with {SPIN}, b as (select exp, frame, w as \"window\", floor(px/w) as bx, floor(py/w) as b2, avg(spin) as m from sp cross join (select unnest([2,4,8]) as w) group by 1,2,3,4,5 having count(*)>=0.5*w*w), c as (select exp, \"window\", avg(m*m) as m2 from b group by 1,2) select exp, \"window\", m2, \"window\"/xi as x from c join (select exp, avg(sqrt(u*u+v*v))*100 as xi from field group by 1) using (exp)")
register("p16_summary_by_diameter", "| diameter n | y y_sem", lambda t: com.summary(t.tracks.withColumn("diameter", F.regexp_extract("condition", r"([0-9]+)", 1).cast("int")), ["y"], ["diameter"]), "select regexp_extract(condition,'([0-9]+)',1)::int as diameter, count(*) as n, avg(y) as y, stddev_samp(y)/sqrt(count(y)) as y_sem from tracks group by 1")
register("p17_size_table", "condition | n | observed residual", lambda t: com.size_table(com.movie_table(t.tracks.withColumn("o", F.col("y") / 100), "o", t.field.groupBy("exp").agg((F.avg(F.hypot("u", "v")) * 100).alias("xi")), F.lit(3.0), master)), "with m as (select condition, exp, avg(y/100) as o, count(*) as n from tracks group by 1,2), x as (select m.*, 3.0/xi as x from m join (select exp, avg(sqrt(u*u+v*v))*100 as xi from field group by 1) using (exp)) select condition, sum(n) as n, sum(n*o)/sum(n) as observed, sum(n*(o-(1-exp(-x))/x))/sum(n) as residual from x group by 1")
register("p18_interaction_by_radius", "condition | n | radius mean sem", lambda t: com.two_level(spa.interaction(t.on_field.withColumns({"dx": F.col("x"), "dy": F.col("y")}), t.field, [1.5, 3.0]).join(exps(t), "exp"), "u", ["exp"], ["condition", "radius"]), f"with {NEAR.format(r=3)}, ra as (select unnest([1.5,3.0]) as radius), g as (select exp, frame, particle, radius, avg(u) as u from nr cross join ra where d2<=radius*radius group by 1,2,3,4), e as (select p.exp, p.condition, radius, avg(coalesce(u,0)) as m from on_field p cross join ra left join g using (exp, frame, particle, radius) group by 1,2,3) select condition, radius, count(*) as n, avg(m) as mean, stddev_samp(m)/sqrt(count(*)) as sem from e group by 1,2")
register("p19_pooled_ergodicity", "condition | lag n | eb ngp", lambda t: lag.ergodicity_breaking(lag.imsd(t.tracks, L)).join(lag.ngp(lag.lagged(t.tracks, ["x", "y"], L), (F.col("x_2") - F.col("x")) ** 2 + (F.col("y_2") - F.col("y")) ** 2, ["condition", "lag"]).drop("n"), ["condition", "lag"]), f"with {IMSD}, a as (select condition, lag, count(*) as n, var_samp(msd)/pow(avg(msd),2) as eb from im group by 1,2), b as (select condition, lag, 0.5*avg(pow(dx*dx+dy*dy,2))/pow(avg(dx*dx+dy*dy),2)-1 as ngp from pr group by 1,2) select * from a join b using (condition, lag)")
W = POIS.format(u=U.format(p="0,b,particle"))
register("p20_histogram_interval", "| bin | p se low high potential", lambda t: com.histogram_interval(t.tracks, uniform(F.col("y"), 0, 100, 5), 5, ["particle"], 30), f"with u as (select particle, least(floor(y/20),4) as bin, count(*) as n from tracks where y between 0 and 100 group by 1,2), p as (select bin, sum(n)/(sum(sum(n)) over ()) as p from u group by 1), r as (select b, bin, sum(w*n)/(sum(sum(w*n)) over (partition by b)) as v from (select *, {W} as w from u cross join (select unnest(range(1,31)) as b)) where w>0 group by 1,2), i as (select bin, stddev_samp(v) as se, quantile_cont(v,0.025) as low, quantile_cont(v,0.975) as high from r group by 1) select *, -ln(p) as potential from p join i using (bin)")
headings = lambda t: kin.velocity(t.tracks).where("vx <> 0 or vy <> 0").withColumn("c", F.col("vx") / F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
shapes = lambda t: com.shape_replicates(headings(t), "c", ["exp", "particle"], ["condition"], 28, 20)
SHAPE = f"{STEP}, hc as (select condition, exp, particle, least(floor((dx/sqrt(dx*dx+dy*dy)+1)*14),27)::int as bin from steps where dx<>0 or dy<>0), hu as (select condition, exp, particle, bin, count(*) as n from hc group by all), hw as (select *, {POIS.format(u=U.format(p='0,b,exp,particle'))} as w from hu cross join (select unnest(range(1,21)) as b) union all select *, 0, 1 from hu), hs as (select condition, b, bin, sum(w*n) as k from hw where w>0 group by all), hg as (select condition, b, bin, coalesce(k,0) as k from (select distinct condition, b from hs) cross join (select unnest(range(28)) as bin) left join hs using (condition, b, bin)), hp as (select condition, b, bin, -1+(bin+0.5)/14 as c, k/(sum(k) over (partition by condition, b)/14) as p from hg), sh as (select a.*, (a.p+z.p)/2 as even, (a.p-z.p)/2 as odd, case when a.p>0 and o.p>0 then -ln(sqrt(greatest(1-a.c*a.c,1e-6))*a.p/o.p) end as potential from hp a join hp z on a.condition=z.condition and a.b=z.b and z.bin=27-a.bin join hp o on a.condition=o.condition and a.b=o.b and o.bin=13)"
ENDS = ", ".join(f"quantile_cont({c},0.025) filter (where b>0) as {c}_low, quantile_cont({c},0.975) filter (where b>0) as {c}_high" for c in ("p", "even", "odd", "potential"))
register("p20_shape", "condition | bin | c p even odd potential p_low p_high even_low even_high odd_low odd_high potential_low potential_high", lambda t: com.shape_table(shapes(t), ["condition"]),
         f"with {SHAPE} select * from (select condition, bin, c, p, even, odd, potential from sh where b=0) join (select condition, bin, {ENDS} from sh group by all) using (condition, bin)")
register("p20_shape_fit", "condition | | polar nematic polar_se polar_low polar_high nematic_se nematic_low nematic_high", lambda t: com.shape_fit(shapes(t), ["condition"]),
         f"with {SHAPE}, fe as (select * from sh where c>0.05 and c<=0.85 and even>1e-4), fa as (select condition, b, greatest(0,sum(atanh(greatest(-0.999,least(0.999,odd/even)))*atanh(c))/sum(pow(atanh(c),2))) as polar from fe group by all having count(*)>=2), fk as (select condition, b, polar, greatest(0,-regr_slope(ln(greatest(sqrt(1-c*c)*even/cosh(polar*atanh(c)),1e-6)),c*c)/2) as nematic from fe join fa using (condition, b) group by all) "
         "select * from (select condition, polar, nematic from fk where b=0) join (select condition, stddev_samp(polar) as polar_se, quantile_cont(polar,0.025) as polar_low, quantile_cont(polar,0.975) as polar_high, stddev_samp(nematic) as nematic_se, quantile_cont(nematic,0.025) as nematic_low, quantile_cont(nematic,0.975) as nematic_high from fk where b>0 group by all) using (condition)")
register("p21_alignment_moments", "condition | n | mean mean_sem c2 c2_sem c3 c3_sem c5 c5_sem", lambda t: com.alignment_moments(kin.velocity(t.tracks).where("theta is not null").withColumn("c", F.cos("theta")), "c"), f"with {STEP}, c as (select condition, exp, particle, cos(atan2(dy,dx)) as c from steps where dx<>0 or dy<>0), d as (select *, avg(c) over (partition by exp, particle) as m from c), p as (select condition, exp, particle, any_value(m) as mean, avg(pow(c-m,2)) as c2, avg(pow(c-m,3)) as c3, avg(pow(c-m,5)) as c5 from d group by 1,2,3) select condition, count(*) as n, {', '.join(f'avg({k}) as {k}, stddev_samp({k})/sqrt(count(*)) as {k}_sem' for k in ('mean', 'c2', 'c3', 'c5'))} from p group by 1")
