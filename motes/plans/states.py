"""Registered queries: states and events, resampling, null models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kinematics as kin
from ..operators import resample as res
from ..operators import states as sta
from .registry import register
from .tracks import STEP

GSTEP = STEP.replace("from tracks", "from gaps")
speeds = lambda t: kin.gap_aware_speed(t.gaps)
SPEED = f"{GSTEP}, sv as (select *, sqrt(dx*dx+dy*dy) as v from steps where df=1), sg as (select *, sum(case when frame-pf<>1 then 1 else 0 end) over (partition by exp, particle order by frame) as segment from (select *, lag(frame) over (partition by exp, particle order by frame) as pf from sv))"
RUNS = "rc as (select *, sum(case when state<>ps then 1 else 0 end) over (partition by {k} order by frame) as run from (select *, lag(state) over (partition by {k} order by frame) as ps from st)), rn as (select {k}, run, any_value(state) as state, min(frame) as first, max(frame) as last, count(*) as n from rc group by {k}, run), re as (select *, lead(state) over (partition by {k} order by run) as next_state, lag(run) over (partition by {k} order by run) is not null as cl, lead(run) over (partition by {k} order by run) is not null as cr from rn)"
KS = "exp, particle, segment"
register("h01_run_tumble", "exp | particle segment state first last n | ", lambda t: sta.thresholded(speeds(t), F.lit(60.0)), f"with {SPEED}, st as (select *, (v>=60)::int as state from sg), {RUNS.format(k=KS)} select * from re where cl and cr")
register("h01b_condition_threshold", "exp | particle segment state first n | ", lambda t: sta.by_condition_threshold(speeds(t), True, drop_edges=False), f"with {SPEED}, th as (select condition, quantile_cont(v,0.5) as th from sv group by 1), st as (select sg.*, (v>=th)::int as state from sg join th using (condition)), {RUNS.format(k=KS)} select * from re")
register("h02_low_intervals", "exp | particle first last length | ", lambda t: sta.low_intervals(t.tracks, "y", 40.0, 2), "with st as (select *, (y<40)::int as state, row_number() over (partition by exp, particle order by frame) as i from tracks), rc as (select *, sum(case when state<>ps then 1 else 0 end) over (partition by exp, particle order by frame) as run from (select *, lag(state) over (partition by exp, particle order by frame) as ps from st)), rn as (select exp, particle, run, any_value(state) as state, min(frame) as first, max(frame) as last, max(i)-min(i) as length, max(run) over (partition by exp, particle) as top from rc group by 1,2,3) select * from rn where state=1 and length>=2 and run<top")
register("e35_waiting_times", "length | n | ", lambda t: sta.low_intervals(t.tracks, "y", 40.0, 1).groupBy(F.col("length").cast("string").alias("length")).agg(F.count("*").alias("n")), "with st as (select *, (y<40)::int as state, row_number() over (partition by exp, particle order by frame) as i from tracks), rc as (select *, sum(case when state<>ps then 1 else 0 end) over (partition by exp, particle order by frame) as run from (select *, lag(state) over (partition by exp, particle order by frame) as ps from st)), rn as (select exp, particle, run, any_value(state) as state, max(i)-min(i) as length, max(run) over (partition by exp, particle) as top from rc group by 1,2,3) select length::varchar as length, count(*) as n from rn where state=1 and length>=1 and run<top group by 1")
HYS = f"{GSTEP}, sg as (select *, sum(case when df<>1 then 1 else 0 end) over (partition by exp, particle order by frame) as segment from steps), mk as (select *, case when abs(y)<20 then 1 when y>60 then 0 when row_number() over w=1 then (y<40)::int end as m from sg window w as (partition by exp, particle, segment order by frame)), st as (select *, last_value(m ignore nulls) over (partition by exp, particle, segment order by frame) as state from mk)"
hys = lambda t: sta.hysteresis(t.gaps, "y", 20.0, 60.0)
SEG = ["exp", "particle", "segment"]
register("h03_hysteresis", "exp | particle frame segment state | ", hys, f"with {HYS} select * from st")
DWELL = "select {g} state, count(*) filter (where cl and cr) as runs, avg(n) filter (where cl and cr) as mean_length, count(*) filter (where not (cl and cr)) as censored, sum(n) as rows, count(next_state) as transitions, sum(n)/(sum(sum(n)) over ({p})) as occupancy, count(next_state)/sum(n) as rate from re group by {g} state"
register("h04_dwell_statistics", "exp | state runs censored rows transitions | mean_length occupancy rate", lambda t: sta.dwell_statistics(hys(t), SEG, ["exp"]), f"with {HYS}, {RUNS.format(k=KS)} " + DWELL.format(g="exp,", p="partition by exp"))
register("h10_dwell_times", "| state runs censored | mean_length occupancy", lambda t: sta.dwell_statistics(hys(t), SEG, []), f"with {HYS}, {RUNS.format(k=KS)} " + DWELL.format(g="", p=""))
register("h05_event_average", "| kind offset n | mean", lambda t: sta.event_average(hys(t), "x", 3, SEG), f"with {HYS}, nb as (select *, row_number() over (partition by {KS} order by frame) as r, lag(state) over (partition by {KS} order by frame) as ps from st) select a.state as kind, b.r-a.r as \"offset\", avg(b.x) as mean, count(*) as n from nb a join nb b on a.exp=b.exp and a.particle=b.particle and a.segment=b.segment and b.r-a.r between -3 and 3 where a.state<>a.ps group by 1,2")
register("h06_observations", "exp | particle frame segment | obs", lambda t: sta.observations(t.gaps, 1, 0.01), "with d as (select a.exp, a.particle, a.frame, ln(sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2))+0.01) as obs from gaps a join gaps b on a.exp=b.exp and a.particle=b.particle and b.frame=a.frame+1) select exp, particle, frame, obs, sum(case when frame-pf<>1 then 1 else 0 end) over (partition by exp, particle order by frame) as segment from (select *, lag(frame) over (partition by exp, particle order by frame) as pf from d)")
register("h07_hmm_fit", "| state | mean var stay", lambda t: _hmm(t))
register("h08_decoded", "exp | particle frame state | ", lambda t: (lambda o: sta.decode(o, sta.fit_hmm(o, 2, 3)))(sta.observations(t.gaps, 1, 0.01)))
register("h09_without_glitches", "exp | particle segment frame state | ", lambda t: sta.without_glitches(hys(t), SEG, 2))
register("h11_transitions", "| step from to n | p", lambda t: sta.transitions(hys(t), [1, 2, 3], SEG), f"with {HYS}, r as (select *, row_number() over (partition by {KS} order by frame) as r from st) select b.r-a.r as step, a.state as \"from\", b.state as \"to\", count(*) as n, count(*)/sum(count(*)) over (partition by b.r-a.r, a.state) as p from r a join r b on a.exp=b.exp and a.particle=b.particle and a.segment=b.segment and b.r-a.r between 1 and 3 group by 1,2,3")
register("h11_triplet_chi2", "| cells freedom | chi2", lambda t: sta.triplet_chi2(hys(t), SEG), f"with {HYS}, t as (select a, state as b, c, count(*) as n from (select state, lag(state) over w as a, lead(state) over w as c from st window w as (partition by {KS} order by frame)) where a is not null and c is not null group by 1,2,3), e as (select *, sum(n) over (partition by a,b)*sum(n) over (partition by b,c)/sum(n) over (partition by b) as e from t), f as (select b, count(*) as cells, (count(distinct a)-1)*(count(distinct c)-1) as freedom, sum(pow(n-e,2)/e-e)+sum(n) as x from e group by 1) select sum(cells) as cells, sum(freedom) as freedom, sum(x) as chi2 from f")
register("h12_state_turns", "kind | n | mean_turn resultant", lambda t: sta.state_turns(kin.velocity(t.tracks).where("theta is not null").withColumn("state", (F.col("v") >= 60).cast("int")), kin.KEY), f"with {STEP}, s as (select *, atan2(dy,dx) as theta, (sqrt(dx*dx+dy*dy)>=60)::int as state from steps where dx<>0 or dy<>0), n as (select state, lead(state) over w as ns, atan2(sin(lead(theta) over w-theta),cos(lead(theta) over w-theta)) as t from s window w as (partition by exp, particle order by frame)), k as (select unnest(['all', case when state=1 and ns=1 then 'run_run' else 'any_tumble' end]) as kind, t from n where t is not null) select kind, count(*) as n, avg(abs(t)) as mean_turn, sqrt(pow(avg(cos(t)),2)+pow(avg(sin(t)),2)) as resultant from k group by 1")


def _hmm(t):
    m = sta.fit_hmm(sta.observations(t.gaps, 1, 0.01), 2, 6)
    return t.spark.createDataFrame([(i, float(m["mean"][i]), float(m["var"][i]), float(m["a"][i, i])) for i in range(2)], "state int, mean double, var double, stay double")


U = "('0x'||substr(md5(concat_ws('|',{p})),1,8))::bigint/4294967296.0"
POIS = "(" + "+".join(f"(({{u}})>={p!r})::int" for p in res.POISSON) + ")"
BS = "bs as (select unnest(range(1,{n}+1)) as b)"
CI = "stddev_samp(v) as se, quantile_cont(v,0.025) as low, quantile_cont(v,0.975) as high"
W = POIS.format(u=U.format(p="0,b,{unit}"))

# changes and controls: deviations of x from the particle's mean, 3 rows on either side
TRIG = f"{HYS}, nb as (select *, row_number() over (partition by {KS} order by frame) as r, lag(state) over (partition by {KS} order by frame) as ps, x-avg(x) over (partition by condition, exp, particle) as d from st), tr as (select a.condition, a.exp, a.particle, 1-a.ps as kind, (a.state=a.ps)::int as control, b.r-a.r as off, b.d from nb a join nb b on a.exp=b.exp and a.particle=b.particle and a.segment=b.segment and b.r-a.r between -3 and 3 where a.ps is not null), su as (select condition, exp, particle, kind, control, off, sum(d) as s, count(*) as n from tr group by all)"
triggered = lambda t: sta.triggered_sums(hys(t), "x", 3, SEG, ["condition", "exp", "particle"])
register("h05_triggered_curves", "condition | kind offset n n_control | event control difference", lambda t: sta.triggered_curves(triggered(t), ["condition"]),
         f"with {TRIG}, c as (select condition, kind, off, sum(s) filter (where control=0)/sum(n) filter (where control=0) as event, sum(s) filter (where control=1)/sum(n) filter (where control=1) as control, coalesce(sum(n) filter (where control=0),0) as n, coalesce(sum(n) filter (where control=1),0) as n_control from su group by all) select condition, kind, off as \"offset\", event, control, event-control as difference, n, n_control from c")
register("h05_pre_difference", "condition | kind events | difference se low high", lambda t: sta.pre_difference(triggered(t), ["condition"], "exp", "particle", n=20),
         f"with {TRIG}, {BS.format(n=20)}, m as (select condition, exp, b, {W.format(unit='exp')} as mw from (select distinct condition, exp from su) cross join bs), c as (select condition, exp, b, unnest(range(1,mw+1)) as copy from m), dw as (select condition, exp, particle, b, sum(w) as w from (select c.condition, c.exp, particle, b, {POIS.format(u=U.format(p='0,b,exp,copy,particle'))} as w from c join (select distinct condition, exp, particle from su) using (condition, exp)) group by all), "
         "aw as (select su.*, b, w from su join dw using (condition, exp, particle) union all select *, 0, 1 from su), cu as (select condition, b, kind, off, sum(w*s) filter (where control=0)/sum(w*n) filter (where control=0)-sum(w*s) filter (where control=1)/sum(w*n) filter (where control=1) as d from aw where off between -3 and -1 and w>0 group by all), ef as (select condition, b, kind, avg(d) as v from cu group by all), ev as (select condition, kind, coalesce(sum(n) filter (where control=0 and off=0),0) as events from su group by all) "
         f"select ev.condition, ev.kind, events, difference, se, low, high from ev join (select condition, kind, v as difference from ef where b=0) using (condition, kind) join (select condition, kind, {CI} from ef where b>0 group by all) using (condition, kind)")
register("r01_bootstrap_mean", "condition | | se low high", lambda t: res.bootstrap_mean(t.tracks, "y", ["particle"], ["condition"], 50), f"with u as (select condition, particle, avg(y) as x from tracks group by 1,2), {BS.format(n=50)}, r as (select condition, b, sum(w*x)/sum(w) as v from (select *, {W.format(unit='particle')} as w from u cross join bs) where w>0 group by 1,2) select condition, {CI} from r group by 1")
register("r02_bootstrap_percentile", "condition | | se low high", lambda t: res.bootstrap_percentile(t.tracks, "x", ["particle"], ["condition"], 0.9, 20), f"with u as (select condition, particle, quantile_cont(x,0.5) as x from tracks group by 1,2), {BS.format(n=20)}, r as (select condition, b, quantile_cont(x,0.9) as v from (select condition, b, x, unnest(range(w)) from (select *, {W.format(unit='particle')} as w from u cross join bs)) group by 1,2) select condition, {CI} from r group by 1")
register("r03_bootstrap_ngp", "condition | | se low high", lambda t: res.bootstrap_ngp(kin.lag_displacement(t.tracks, 2).withColumn("r2", F.col("r") ** 2), "r2", ["particle"], ["condition"], 30), f"with d as (select condition, particle, pow(lead(x,2) over w-x,2)+pow(lead(y,2) over w-y,2) as r2 from tracks window w as (partition by exp, particle order by frame)), u as (select condition, particle, sum(r2) as a, sum(r2*r2) as c, count(*) as n from d where r2 is not null group by 1,2), {BS.format(n=30)}, r as (select condition, b, 0.5*(sum(w*c)/sum(w*n))/pow(sum(w*a)/sum(w*n),2)-1 as v from (select *, {W.format(unit='particle')} as w from u cross join bs) where w>0 group by 1,2) select condition, {CI} from r group by 1")
register("r04_bootstrap_ratio", "condition | | ratio se low high", lambda t: res.bootstrap_ratio(t.tracks, F.col("x"), F.col("y"), ["particle"], ["condition"], 50), f"with u as (select condition, particle, sum(x) as t, sum(y) as d from tracks group by 1,2), {BS.format(n=50)}, r as (select condition, b, sum(w*t)/sum(w*d) as v from (select *, {W.format(unit='particle')} as w from u cross join bs) where w>0 group by 1,2) select condition, (select sum(t)/sum(d) from u where u.condition=r.condition) as ratio, {CI} from r group by 1")
register("r05_hierarchical", "condition | | se low high", lambda t: res.hierarchical(t.tracks, "y", "exp", "particle", ["condition"], 20), f"with u as (select condition, exp, particle, avg(y) as x from tracks group by 1,2,3), {BS.format(n=20)}, m as (select condition, exp, b, {W.format(unit='exp')} as mw from (select distinct condition, exp from u) cross join bs), c as (select condition, exp, b, unnest(range(1,mw+1)) as copy from m), r as (select condition, b, sum(w*x)/sum(w) as v from (select c.condition, b, x, {POIS.format(u=U.format(p='0,b,exp,copy,particle'))} as w from c join u using (condition, exp)) where w>0 group by 1,2) select condition, {CI} from r group by 1")
register("r06_fixed_draws", "condition | | se low high", lambda t: res.fixed_draws(t.tracks, "y", ["particle"], ["condition"], 20), f"with u as (select *, row_number() over (partition by condition order by particle)-1 as i, count(*) over (partition by condition) as n from (select condition, particle, avg(y) as x from tracks group by 1,2)), {BS.format(n=20)}, d as (select condition, b, floor({U.format(p='0,b,d')}*n)::int as i from (select condition, n, b, unnest(range(1,n+1)) as d from (select distinct condition, n from u) cross join bs)), r as (select d.condition, b, avg(x) as v from d join u on d.condition=u.condition and d.i=u.i group by 1,2) select condition, {CI} from r group by 1")
register("r07_group_difference", "| | difference se p", lambda t: res.group_difference(t.tracks, "y", ["particle"], "condition", "c0", "c1", 50), f"with u as (select condition, particle, avg(y) as x from tracks group by 1,2), {BS.format(n=50)}, r as (select b, sum(w*x) filter (where condition='c0')/sum(w) filter (where condition='c0') - sum(w*x) filter (where condition='c1')/sum(w) filter (where condition='c1') as v from (select *, {W.format(unit='condition,particle')} as w from u cross join bs) where w>0 group by 1) select avg(v) as difference, stddev_samp(v) as se, 2*least(avg((v<=0)::int),avg((v>=0)::int)) as p from r")
register("r08_movie_bootstrap", "condition | | se low high", lambda t: res.bootstrap_mean(t.tracks, "y", ["exp"], ["condition"], 30), f"with u as (select condition, exp, avg(y) as x from tracks group by 1,2), {BS.format(n=30)}, r as (select condition, b, sum(w*x)/sum(w) as v from (select *, {W.format(unit='exp')} as w from u cross join bs) where w>0 group by 1,2) select condition, {CI} from r group by 1")
register("r09_time_shuffle", "condition | round | v", lambda t: res.time_shuffle(t.tracks, ["y"], kin.KEY, 3).groupBy("condition", "round").agg(F.avg(F.col("x") * F.col("y")).alias("v")), f"with f as (select *, row_number() over (partition by exp, particle order by frame) as r from tracks), s as (select exp, particle, round, y, row_number() over (partition by exp, particle, round order by {U.format(p='0,round,exp,particle,frame')}, frame) as r from tracks cross join (select unnest([1,2,3]) as round)) select condition, s.round as \"round\", avg(x*s.y) as v from f join s on f.exp=s.exp and f.particle=s.particle and f.r=s.r group by 1,2")
register("r10_particle_swap", "condition | round n | v", lambda t: res.particle_swap(t.tracks, ["y"], 2).groupBy("condition", "round").agg(F.avg(F.col("x") * F.col("y")).alias("v"), F.count("*").alias("n")), f"with p as (select exp, particle, round, row_number() over (partition by exp, round order by {U.format(p='0,round,exp,particle')}, particle) as i, count(*) over (partition by exp, round) as n from (select distinct exp, particle from tracks) cross join (select unnest([1,2]) as round)), q as (select a.exp, a.round, a.particle, b.particle as donor from p a join p b on a.exp=b.exp and a.round=b.round and a.i%a.n+1=b.i where a.particle<>b.particle), r as (select *, row_number() over (partition by exp, particle order by frame) as r from tracks) select f.condition, q.round as \"round\", count(*) as n, avg(f.x*s.y) as v from r f join q on f.exp=q.exp and f.particle=q.particle join r s on s.exp=q.exp and s.particle=q.donor and s.r=f.r group by 1,2")
register("r11_block_shuffle", "exp | dealt n | v", lambda t: res.block_shuffle(t.tracks, 10).groupBy("exp", "dealt").agg(F.avg("y").alias("v"), F.count("*").alias("n")), f"with r as (select *, floor((row_number() over (partition by exp, particle order by frame)-1)/10)::bigint as block from tracks), b as (select distinct exp, particle, block from r), a as (select *, row_number() over (partition by exp order by {U.format(p='0,exp,particle,block')}, particle, block) as i from b), c as (select exp, particle as dealt, row_number() over (partition by exp order by particle, block) as i from b) select r.exp, dealt, count(*) as n, avg(y) as v from r join a on r.exp=a.exp and r.particle=a.particle and r.block=a.block join c on c.exp=a.exp and c.i=a.i group by 1,2")
register("r12_variation", "condition | n | cv_top cv_bottom cv_ratio", lambda t: res.variation(t.tracks, "x", "y", ["exp", "particle"], ["condition"]), "with u as (select condition, exp, particle, avg(x) as t, avg(y) as d from tracks group by 1,2,3) select condition, count(*) as n, stddev_samp(t)/abs(avg(t)) as cv_top, stddev_samp(d)/abs(avg(d)) as cv_bottom, stddev_samp(t/d)/abs(avg(t/d)) as cv_ratio from u group by 1")
