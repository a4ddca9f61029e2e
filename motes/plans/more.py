"""Registered queries: statistics of pooled lags, tails and laws of speeds, tests, Markov checks, local lengths, slowdown, flow against tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curves
from ..operators import association as assoc
from ..operators import composed as com
from ..operators import distributions as dist
from ..operators import filters as flt
from ..operators import fits
from ..operators import kinematics as kin
from ..operators import lagstats as lag
from ..operators import spatial as spa
from ..operators import states as sta
from ..sources import io
from .fields import CORR, NEAR, RAD, SAMP, SPIN, UNIT, moved, spun
from .lags import IMSD, QUANT, L
from .registry import also, register
from .spread import VSTEP, vel
from .states import BS, CI, HYS, KS, POIS, SEG, U, hys
from .tracks import GSTEP


def polynomial(x: str, coefficients: tuple) -> str:
    out = repr(float(coefficients[0]))
    for c in coefficients[1:]:
        out = f"({out}*{x}+{float(c)!r})"
    return out


def quantile(p: str) -> str:
    """Normal quantile in SQL, the same approximation as curves.normal_quantile."""
    q, t = f"({p}-0.5)", f"sqrt(-2*ln(least({p},1-{p})))"
    middle = f"{polynomial(f'({q}*{q})', curves.NORMAL_MIDDLE[0])}*{q}/{polynomial(f'({q}*{q})', curves.NORMAL_MIDDLE[1])}"
    tail = f"{polynomial(t, curves.NORMAL_TAIL[0])}/{polynomial(t, curves.NORMAL_TAIL[1])}"
    return f"case when least({p},1-{p})>={curves.NORMAL_EDGE} then {middle} when {p}<0.5 then {tail} else -({tail}) end"


def cdf(z: str) -> str:
    """Normal distribution function in SQL, below 7 standard deviations."""
    a = f"abs({z})"
    tail = f"exp(-{a}*{a}/2)*{polynomial(a, curves.NORMAL_CDF[0])}/{polynomial(a, curves.NORMAL_CDF[1])}"
    return f"case when {z}>0 then 1-{tail} else {tail} end"


W = POIS.format(u=U.format(p="0,b,particle"))
register("d04_pooled_msd", "condition | lag n | mean std q10 q25 q50 q75 q90 se low high", lambda t: (lambda im: lag.bootstrapped(lag.pooled(im, "msd", ["condition", "lag"], 3), im, "msd", ["condition", "lag"], 20))(io.stashed(lag.imsd(t.tracks, L))),
         f"with {IMSD}, u as (select condition, lag, particle, avg(msd) as x from im group by 1,2,3), {BS.format(n=20)}, r as (select condition, lag, b, sum(w*x)/sum(w) as v from (select *, {W} as w from u cross join bs) where w>0 group by 1,2,3), ci as (select condition, lag, {CI} from r group by 1,2), s as (select condition, lag, avg(msd) as mean, stddev_samp(msd) as std, count(*) as n, {QUANT.format(v='msd')} from im group by 1,2 having count(*)>=3) select * from s join ci using (condition, lag)")

SPEED = f"{GSTEP}, sv as (select *, sqrt(dx*dx+dy*dy) as v from steps where df=1), q as (select condition, quantile_cont(v,0.25) as a, quantile_cont(v,0.75) as b from sv group by 1), fe as (select sv.*, v between greatest(0, a-0.5*(b-a)) and b+0.5*(b-a) as inside from sv join q using (condition))"
speeds = lambda t: kin.gap_aware_speed(t.gaps).where("v is not null")
register("f07_statistics", "condition | n n_in | mean median std mean_in median_in std_in", lambda t: flt.tukey_statistics(speeds(t), "v", k=0.5),
         f"with {SPEED} select condition, count(*) as n, avg(v) as mean, quantile_cont(v,0.5) as median, stddev_samp(v) as std, count(*) filter (where inside) as n_in, avg(v) filter (where inside) as mean_in, quantile_cont(case when inside then v end,0.5) as median_in, stddev_samp(v) filter (where inside) as std_in from fe group by 1")
register("f07_experiment_means", "condition exp | n | v v_sem", lambda t: com.summary(flt.tukey(speeds(t), "v", k=0.5), ["v"], ["condition", "exp"]), f"with {SPEED} select condition, exp, count(*) as n, avg(v) as v, stddev_samp(v)/sqrt(count(*)) as v_sem from fe where inside group by 1,2")

POSITION = "case when i=n then pow(0.5,1.0/n) when i=1 then 1-pow(0.5,1.0/n) else (i-0.3175)/(n+0.365) end"
register("e27_lognormal_qq", "condition | n | slope intercept r2 ks", lambda t: dist.normal_qq(t.tracks, "x", ["condition"], ["particle", "frame"]),
         f"with s as (select condition, ln(x) as l, row_number() over (partition by condition order by x, particle, frame) as i, count(*) over (partition by condition) as n, avg(ln(x)) over (partition by condition) as m, stddev_pop(ln(x)) over (partition by condition) as sd from tracks where x>0), p as (select *, {POSITION} as p, (l-m)/sd as z from s), q as (select *, {quantile('p')} as q, {cdf('z')} as c from p) select condition, count(*) as n, regr_slope(l,q) as slope, regr_intercept(l,q) as intercept, regr_r2(l,q) as r2, max(greatest(i/n-c, c-(i-1)/n)) as ks from q group by 1")
register("e36_log_histogram", "condition | bin | count density normal", lambda t: dist.log_histogram(vel(t), "v", ["condition"], -2.0, 6.0, 8),
         f"with {VSTEP}, l as (select condition, ln(v) as l from vs where v>0), m as (select condition, avg(l) as m, stddev_pop(l) as sd from l group by 1), c as (select condition, least(floor(l+2),7) as bin, count(*) as n from l where l between -2 and 6 group by 1,2), f as (select condition, m, sd, bin from m cross join (select unnest(range(8)) as bin)), h as (select f.*, coalesce(n,0) as n from f left join c using (condition, bin)) select condition, bin, n as count, n/sum(n) over (partition by condition) as density, exp(-pow((bin-1.5-m)/sd,2)/2)/(sd*2.5066282746310002) as normal from h")
register("e36_scaled_histogram", "condition | bin | count density exponential rayleigh", lambda t: dist.scaled_histogram(vel(t), "v", ["condition"], 4.0, 8),
         f"with {VSTEP}, l as (select condition, v/avg(v) over (partition by condition) as l from vs), c as (select condition, least(floor(l*2),7) as bin, count(*) as n from l where l between 0 and 4 group by 1,2), f as (select condition, bin from (select distinct condition from l) cross join (select unnest(range(8)) as bin)), h as (select f.*, coalesce(n,0) as n, (bin+0.5)/2 as x from f left join c using (condition, bin)) select condition, bin, n as count, n/(sum(n) over (partition by condition)*0.5) as density, exp(-x) as exponential, pi()/2*x*exp(-pi()/4*x*x) as rayleigh from h")

register("x08_power_tail", "condition | n | x_min x_max exponent distance slope r2", lambda t: fits.power_tail(t.tracks, "x", ["condition"]),
         "with p as (select condition, x, row_number() over (partition by condition order by x)-1 as i, count(*) over (partition by condition) as n from tracks where x>0 qualify n>=20), e as (select condition, x as x_max, n-20 as stop, case when floor(n*0.15)<n-20 then floor(n*0.15) else greatest(0,n-50) end::bigint as start from p where i=n-5), k as (select *, least(250, stop-start+1) as cnt from e), g as (select distinct condition, x_max, p.x as x_min from (select *, start+floor(unnest(range(cnt))*(stop-start)/greatest(cnt-1,1))::bigint as i from k) join p using (condition, i)), t as (select g.*, p.x, count(*) over w as m, count(*) over w/nullif(sum(ln(p.x/x_min)) over w,0) as a, row_number() over (partition by condition, x_min order by p.x) as r from g join p using (condition) where p.x>=x_min and p.x<=x_max window w as (partition by condition, x_min)), d as (select condition, x_min, any_value(x_max) as x_max, max(abs(r/m-(1-pow(x_min/x,a)))) as distance, any_value(a)+1 as exponent, any_value(m) as n from t where m>=15 and a is not null group by 1,2), b as (select * from d qualify row_number() over (partition by condition order by distance, x_min)=1), f as (select condition, regr_slope(log10((p.n-i)/p.n),log10(x)) as slope, regr_r2(log10((p.n-i)/p.n),log10(x)) as r2 from p join b using (condition) where x between x_min and x_max group by 1) select * from b join f using (condition)")

means = lambda t: t.tracks.groupBy("exp", "particle").agg(F.avg("x").alias("a"), F.avg("y").alias("m"))
register("j03_signed_ranks", "| n | w_plus w_minus z", lambda t: assoc.signed_ranks(means(t).withColumns({"a": F.round("a", 0), "m": F.round("m", 0)}), "a", "m"),
         "with d as (select round(avg(x),0)-round(avg(y),0) as d from tracks group by exp, particle), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d))-1)/2 as r, count(*) over (partition by abs(d)) as k from d where d<>0), s as (select sum(r) filter (where d>0) as w_plus, sum(r) filter (where d<0) as w_minus, count(*)::double as n, sum(k*k-1) as t from r) select n, w_plus, w_minus, (w_plus-n*(n+1)/4)/sqrt(n*(n+1)*(2*n+1)/24-t/48) as z from s")
register("j03_p_values", "| | t z p_t p_z", lambda t: assoc.with_p(assoc.two_samples(means(t).withColumn("first", F.col("exp") < "e3"), "m", "first")))

STEPS = f"{HYS}, r as (select *, row_number() over (partition by {KS} order by frame) as r from st), tr as (select b.r-a.r as step, a.state as f, b.state as g, count(*) as n, count(*)/sum(count(*)) over (partition by b.r-a.r, a.state) as p from r a join r b on a.exp=b.exp and a.particle=b.particle and a.segment=b.segment and b.r-a.r between 1 and 3 group by 1,2,3)"
register("h11_markov", "| step | gap eigenvalue predicted timescale", lambda t: sta.markov_checks(sta.transitions(hys(t), [1, 2, 3], SEG)),
         f"with {STEPS}, m as (select step, coalesce(max(p) filter (where f<g),0) as a, coalesce(max(p) filter (where f>g),0) as b from tr group by 1), o as (select a as a1, b as b1 from m where step=1), e as (select *, 1-a-b as eigenvalue, pow(1-a1-b1,step) as predicted from m cross join o) select step, eigenvalue, predicted, greatest(abs(a-a1/(a1+b1)*(1-predicted)), abs(b-b1/(a1+b1)*(1-predicted))) as gap, case when eigenvalue>0 and eigenvalue<0.9999 then -step/ln(eigenvalue) end as timescale from e")
register("h11_state_autocorrelation", "| step n | correlation", lambda t: sta.state_autocorrelation(hys(t), [1, 2, 3], SEG),
         f"with {HYS}, r as (select *, row_number() over (partition by {KS} order by frame) as r, avg(state) over () as mu, var_pop(state) over () as s2 from st) select b.r-a.r as step, count(*) as n, avg((a.state-a.mu)*(b.state-a.mu))/any_value(a.s2) as correlation from r a join r b on a.exp=b.exp and a.particle=b.particle and a.segment=b.segment and b.r-a.r between 1 and 3 group by 1")
DWELLS = "rc as (select *, sum(case when state<>ps then 1 else 0 end) over (partition by exp, particle order by frame) as run from (select *, lag(state) over (partition by exp, particle order by frame) as ps from st)), rn as (select exp, particle, run, any_value(state) as state, count(*) as n from rc group by 1,2,3), cl as (select * from (select *, lag(run) over w as a, lead(run) over w as b from rn window w as (partition by exp, particle order by run)) where a is not null and b is not null)"
register("h11_dwell_ks", "| state n | distance mean", lambda t: sta.dwell_ks(t.tracks.withColumn("state", (F.col("y") < 50).cast("int")), kin.KEY),
         f"with st as (select exp, particle, frame, (y<50)::int as state from tracks), {DWELLS}, c as (select state, n as len, count(*) as k from cl group by 1,2), u as (select *, sum(k) over (partition by state) as tot, sum(len*k) over (partition by state)/sum(k) over (partition by state) as m, sum(k) over (partition by state order by len) as up from c) select state, any_value(tot) as n, any_value(m) as mean, max(greatest(up/tot-(1-exp(-len/m)), 1-exp(-len/m)-(up-k)/tot)) as distance from u where tot>=8 group by 1")

register("g20_disk_order", "exp | frame particle n | m p dx dy", lambda t: spa.disk_order(moved(t), spun(t), 3.0),
         f"with {SPIN} select p.exp, p.frame, p.particle, count(*) as n, avg(spin) as m, sqrt(pow(avg(s.u),2)+pow(avg(s.v),2)) as p, any_value(p.x)-16 as dx, any_value(p.y)-16 as dy from on_field p join sp s on p.exp=s.exp and p.frame=s.frame and pow(s.px-p.x,2)+pow(s.py-p.y,2)<=9 group by 1,2,3")
MAP = f"{UNIT}, gc as (select g.exp, g.frame, g.px, g.py, floor(sqrt(pow(f.px-g.px,2)+pow(f.py-g.py,2))) as r, avg(f.u*g.u+f.v*g.v) as c from un g join un f on g.exp=f.exp and g.frame=f.frame and pow(f.px-g.px,2)+pow(f.py-g.py,2)<=36 where g.px%4=0 and g.py%4=0 group by 1,2,3,4,5), gr as (select * from gc where r between 1 and 5), gl as (select exp, frame, px, py, regr_slope(ln(c),r) filter (where c>0.001) as s, regr_intercept(ln(c),r) filter (where c>0.001) as i, count(*) filter (where c>0.001) as n, arg_min(c,r) as c1 from (select exp, frame, px, py, r, case when c>0.001 then c end as c, c as craw from gr) group by 1,2,3,4), gf as (select exp, frame, px, py, greatest(0.05,least(200,-1/s)) as xi, least(1.5,exp(i)) as a from gl where n>=3 and s<-1e-6), gq as (select exp, frame, px, py, xi, a, sum(pow(c-a*exp(-r/xi),2)) as e, var_pop(c)*count(*) as t, arg_min(c,r) as first from gr join gf using (exp, frame, px, py) group by 1,2,3,4,5,6), gm as (select *, case when t>1e-9 then 1-e/(t+1e-9) else 0 end as r2 from gq where first>0.05), lm as (select * from gm where r2>=0 or xi<2)"
register("g28_local_length_map", "exp | frame px py | xi a r2", lambda t: spa.local_length_map(t.field, 4, 5), f"with {MAP} select * from lm")
register("g28_length_moments", "exp | n | mean median std alpha2", lambda t: spa.length_moments(spa.local_length_map(t.field, 4, 5), ["exp"]), f"with {MAP}, m as (select exp, px, py, avg(xi) as xi from lm group by 1,2,3) select exp, count(*) as n, avg(xi) as mean, quantile_cont(xi,0.5) as median, stddev_pop(xi) as std, avg(pow(xi,4))/(3*pow(avg(xi*xi),2))-1 as alpha2 from m group by 1 having count(*)>=10")


def _profiles(t):
    made = [spa.radial_speed(p, t.field, 1.0, 4.0, 1.0).select(F.lit(s).alias("source"), "exp", F.col("bin").cast("double").alias("r"), F.col("by_frame").alias("value")) for s, p in (("cargo", t.on_field), ("tracer", spa.sampled_pixels(t.field, 5)))]
    return made[0].unionByName(made[1]).join(t.tracks.select("exp", "condition").distinct(), "exp")


xi_of = lambda t: t.field.groupBy("exp").agg((F.avg(F.hypot("u", "v")) * 100).alias("xi"))
TRACER = RAD.format(near=NEAR.format(r=5).replace("on_field", "vp").replace("nr as", "nv as")).replace("from nr where", "from nv where").replace("rb as", "rv as").replace("from rb)", "from rv)").replace("rn as", "ru as").replace("from rn ", "from ru ")
CARGO = RAD.format(near=NEAR.format(r=5))
_split = lambda sql: (sql[: sql.rindex(") select") + 1], sql[sql.rindex(") select") + 2 :])
PROFILES = f"{SAMP}, {_split(CARGO)[0]}, {_split(TRACER)[0]}, pf as (select s.*, condition, xi from (select 'cargo' as source, exp, bin as r, by_frame as value from ({_split(CARGO)[1]}) union all select 'tracer', exp, bin, by_frame from ({_split(TRACER)[1]})) s join (select distinct exp, condition from tracks) k using (exp) join (select exp, avg(sqrt(u*u+v*v))*100 as xi from field group by 1) x using (exp) where value is not null), mv as (select source, condition, exp, 1-arg_min(value,r) as edge, 1-avg(value) filter (where r/xi<0.5) as near from pf group by 1,2,3)"
register("g32_slowdown", "source condition exp | | edge near", lambda t: spa.slowdown(_profiles(t), xi_of(t), 0.5), f"with {PROFILES} select * from mv")
register("g32_slowdown_by_size", "source condition | n | edge edge_sem near near_sem", lambda t: spa.slowdown_by_size(spa.slowdown(_profiles(t), xi_of(t), 0.5)), f"with {PROFILES} select source, condition, count(*) as n, avg(edge) as edge, stddev_samp(edge)/sqrt(count(edge)) as edge_sem, avg(near) as near, stddev_samp(near)/sqrt(count(near)) as near_sem from mv group by 1,2")
register("g32_scaled_profiles", "source condition | n | at mean", lambda t: spa.on_scaled_grid(_profiles(t), xi_of(t), [0.0, 0.25, 0.5, 0.8]),
         f"with {PROFILES}, n as (select *, r/xi as q, lead(r/xi) over w as q2, lead(value) over w as v2, row_number() over w as i from pf window w as (partition by source, condition, exp order by r)), y as (select source, condition, pt as \"at\", case when pt<q and i=1 then value when q2 is null then value else value+(v2-value)*(pt-q)/(q2-q) end as y from n cross join (select unnest([0.0,0.25,0.5,0.8]) as pt) where (pt<q and i=1) or (pt>=q and (pt<q2 or (q2 is null and pt=q)))) select source, condition, \"at\", count(*) as n, avg(y) as mean from y group by 1,2,3")
register("g32_wide_table", "condition | | cargo tracer", lambda t: dist.wide_table(spa.slowdown_by_size(spa.slowdown(_profiles(t), xi_of(t), 0.5)), ["condition"], "source", ["cargo", "tracer"], "edge"), f"with {PROFILES} select condition, avg(edge) filter (where source='cargo') as cargo, avg(edge) filter (where source='tracer') as tracer from mv group by 1")
register("g37_flow_against_tracks", "exp | n | moving valid speed_error angle_error correlation", lambda t: flt.checked_flow(flt.steps_on_field(t.on_field, t.field, 32), 2.0, 1e-3),
         "with j as (select f.exp, f.u, f.v, b.x-a.x as tu, b.y-a.y as tv from on_field a join on_field b on a.exp=b.exp and a.particle=b.particle and b.frame=a.frame+1 join field f on f.exp=a.exp and f.frame=a.frame and f.px=greatest(0,least(31,round_even(a.x,0))) and f.py=greatest(0,least(31,round_even(a.y,0)))), n as (select *, sqrt(u*u+v*v) as a, sqrt(tu*tu+tv*tv) as b from j) select exp, count(*) as n, avg((b>2)::int) as moving, avg((a>1e-3 and b>1e-3)::int) as valid, avg(case when a>1e-3 and b>1e-3 then abs(a-b)/b end) as speed_error, avg(case when a>1e-3 and b>1e-3 then abs(atan2(u*tv-v*tu,u*tu+v*tv)) end) as angle_error, sum(u*tu+v*tv)/sqrt(sum(a*a)*sum(b*b)) as correlation from n group by 1")

lengths = lambda t: fits.correlation_length(spa.ring_correlation(t.on_field, t.field, 5).withColumnRenamed("distance", "r"), ["exp", "frame", "particle"])
LENGTHS = "pk as (select *, first_value(distance) over (partition by exp, frame, particle order by c desc, distance) as p from rc), xl as (select exp, frame, particle, -1/regr_slope(ln(c),distance) as xi from pk where distance>=p and c>=0.01 group by 1,2,3 having count(*)>=3 and regr_slope(ln(c),distance)<-1e-6)"
register("p07_length_and_speed", "condition exp | frame particle | xi v", lambda t: com.length_and_speed(lengths(t), kin.gap_aware_speed(t.on_field)),
         f"with {CORR}, {LENGTHS} select b.condition, exp, frame, particle, xi, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) as v from xl join on_field b using (exp, frame, particle) join on_field a on a.exp=b.exp and a.particle=b.particle and a.frame=b.frame-1")
oriented = lambda t: lag.lagged(kin.forward_unit(t.tracks).where("ux <> 0 or uy <> 0"), ["ux", "uy"], 8, "frame").groupBy("exp", "particle", "lag").agg(F.avg(F.col("ux") * F.col("ux_2") + F.col("uy") * F.col("uy_2")).alias("c"))
HEADS = "fu as (select * from (select exp, particle, frame, dx/nullif(sqrt(dx*dx+dy*dy),0) as ux, dy/nullif(sqrt(dx*dx+dy*dy),0) as uy from (select *, lead(x) over w-x as dx, lead(y) over w-y as dy from tracks window w as (partition by exp, particle order by frame))) where ux is not null), fr as (select *, row_number() over (partition by exp, particle order by frame) as i from fu), oc as (select a.exp, a.particle, b.frame-a.frame as lag, avg(a.ux*b.ux+a.uy*b.uy) as c from fr a join fr b on a.exp=b.exp and a.particle=b.particle and b.frame-a.frame between 1 and 8 group by 1,2,3)"
TAU = "ol as (select *, coalesce(lag(c) over w,1.0) as c0, coalesce(lag(lag) over w,0) as l0, coalesce(max((c<=0)::int) over (partition by exp, particle order by lag rows between unbounded preceding and 1 preceding),0) as done from oc window w as (partition by exp, particle order by lag)), pt as (select exp, particle, sum(case when c>0 then (c+c0)/2*(lag-l0) else c0/2*(lag-l0)*c0/(c0-c+1e-12) end) as tau from ol where done=0 group by 1,2)"
register("p08_persistence_and_length", "exp | particle | tau xi x", lambda t: com.persistence_and_length(com.persistence_time(oriented(t), kin.KEY), lengths(t).groupBy("exp", "particle").agg(F.avg("xi").alias("xi")), F.lit(3.0)),
         f"with {CORR}, {LENGTHS}, {HEADS}, {TAU} select pt.exp, pt.particle, tau, xi, 3/xi as x from pt join (select exp, particle, avg(xi) as xi from xl group by 1,2) l using (exp, particle) where tau>0 and xi>0.05")
points = lambda t: kin.velocity(t.gaps).where("theta is not null").select("exp", "particle", "frame", "theta")
flow = lambda t: spa.interaction(moved(t), t.field, [3.0])
TURNS = "p{k} as (select a.*, atan2(sin(b.theta-a.theta),cos(b.theta-a.theta)) as turn_{k} from {p} a left join {p} b on a.exp=b.exp and a.particle=b.particle and b.frame=a.frame+{k}), q{k} as (select a.*, atan2(sin(b.turn_{k}-a.turn_{k}),cos(b.turn_{k}-a.turn_{k})) as change_{k} from p{k} a left join p{k} b on a.exp=b.exp and a.particle=b.particle and b.frame=a.frame+{k})"
register("p09_augmented", "exp | particle frame | u v turn_1 change_1 turn_5 square_5 dispersion_5", lambda t: com.augmented(points(t), flow(t), [1, 5]),
         f"with {GSTEP}, p0 as (select exp, particle, frame, atan2(dy,dx) as theta from steps where dx<>0 or dy<>0), {NEAR.format(r=3)}, fl as (select p.exp, p.frame, p.particle, coalesce(avg(u),0) as u, coalesce(avg(v),0) as v from on_field p left join nr using (exp, frame, particle) group by 1,2,3), {TURNS.format(k=1, p='p0')}, {TURNS.format(k=5, p='q1')} select a.exp, a.particle, a.frame, u, v, turn_1, change_1, turn_5, turn_5*turn_5 as square_5, 1-cos(turn_5) as dispersion_5 from q5 a left join fl using (exp, frame, particle)")

# the same over whole tables: names from when the plain ones were cut
for plain in ("x08_power_tail", "x14_retention", "g17_overlapping_blocks", "g19_block_pairs", "k26_hidden_vector"):
    also(f"{plain}_whole", plain)
