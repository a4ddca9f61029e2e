"""Registered queries: particles on a field, pairs of particles, fields alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import field as fld
from ..operators import fits
from ..operators import kinematics as kin
from ..operators import spatial as spa
from .registry import register
from .tracks import STEP

NEAR = "nr as (select p.exp, p.frame, p.particle, p.x, p.y, f.px, f.py, f.u, f.v, pow(f.px-p.x,2)+pow(f.py-p.y,2) as d2 from on_field p join field f on p.exp=f.exp and p.frame=f.frame and abs(f.px-p.x)<={r} and abs(f.py-p.y)<={r} where pow(f.px-p.x,2)+pow(f.py-p.y,2)<={r}*{r})"
UNIT = "un as (select exp, frame, px, py, u/sqrt(u*u+v*v) as u, v/sqrt(u*u+v*v) as v from field where u<>0 or v<>0)"
SPIN = f"{UNIT}, sp as (select un.*, sign(round(u*cos(theta)+v*sin(theta),12)) as spin from un join theta using (exp, frame))"
moved = lambda t: t.on_field.withColumns({"dx": F.col("x") - 16, "dy": F.col("y") - 16})
heads = lambda t: kin.forward_unit(t.gaps).where("ux is not null")
FU = "fu as (select * from (select *, (lead(x) over w-x)/nullif(sqrt(pow(lead(x) over w-x,2)+pow(lead(y) over w-y,2)),0) as ux, (lead(y) over w-y)/nullif(sqrt(pow(lead(x) over w-x,2)+pow(lead(y) over w-y,2)),0) as uy from gaps window w as (partition by exp, particle order by frame)) where ux is not null)"
PAIR = f"{FU}, pr as (select a.exp, a.frame, a.particle, b.particle as particle_2, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) as r, a.ux*b.ux+a.uy*b.uy as cos from fu a join fu b on a.exp=b.exp and a.frame=b.frame and a.particle<b.particle)"
turned = lambda t: heads(t).where("ux <> 0 or uy <> 0")
with_cos = lambda t, r=None: spa.pairs(turned(t), ["ux", "uy"], r).withColumn("cos", F.col("ux") * F.col("ux_2") + F.col("uy") * F.col("uy_2"))

register("g01_pairs", "exp | frame particle particle_2 | r cos", lambda t: with_cos(t), f"with {PAIR} select * from pr")
register("g01_pairs_within", "exp | frame particle particle_2 | r", lambda t: with_cos(t, 20.0), f"with {PAIR} select * from pr where r<=20")
register("g02_frame_pair_mean", "exp | frame n | correlation", lambda t: spa.frame_pair_mean(heads(t), "ux", "uy"), "with fu as (select *, case when dx=0 and dy=0 then 0 else dx/sqrt(dx*dx+dy*dy) end as ux, case when dx=0 and dy=0 then 0 else dy/sqrt(dx*dx+dy*dy) end as uy from (select *, lead(x) over w-x as dx, lead(y) over w-y as dy from gaps window w as (partition by exp, particle order by frame)) where dx is not null) select exp, frame, count(*) as n, (pow(sum(ux),2)+pow(sum(uy),2)-sum(ux*ux+uy*uy))/(count(*)*(count(*)-1)) as correlation from fu group by 1,2 having count(*)>1")
register("g03_pair_bins", "category | bin n | mean std sem", lambda t: spa.pair_correlation_bins(turned(t).withColumn("kind", F.pmod("particle", F.lit(2))), 10.0, 100.0), f"with {PAIR}, c as (select *, case when (particle+particle_2)%2=0 then 'even' else 'odd' end as category, floor(r/10) as bin from pr where r<100) select coalesce(category,'all') as category, bin, count(*) as n, avg(cos) as mean, stddev_samp(cos) as std, stddev_samp(cos)/sqrt(count(*)) as sem from c group by grouping sets ((category, bin),(bin)) having count(*)>=5")
register("g04_short_range", "exp | n | order", lambda t: spa.short_range(with_cos(t, 30.0), 30.0), f"with {PAIR} select exp, count(*) as n, avg(cos) as \"order\" from pr where r<=30 group by 1 having count(*)>=3")
register("g05_relative_displacements", "exp | frame particle particle_2 | along", lambda t: spa.pairs(kin.frame_displacement(t.gaps, [2]).join(t.theta, ["exp", "frame"]), ["dx", "dy", "theta"]).withColumn("along", (F.col("dx_2") - F.col("dx")) * F.cos("theta") + (F.col("dy_2") - F.col("dy")) * F.sin("theta")), "with d as (select a.exp, a.frame, a.particle, b.x-a.x as dx, b.y-a.y as dy from gaps a join gaps b on a.exp=b.exp and a.particle=b.particle and b.frame=a.frame+2) select a.exp, a.frame, a.particle, b.particle as particle_2, (b.dx-a.dx)*cos(theta)+(b.dy-a.dy)*sin(theta) as along from d a join d b on a.exp=b.exp and a.frame=b.frame and a.particle<b.particle join theta t on t.exp=a.exp and t.frame=a.frame")
D2 = "d as (select a.exp, a.condition, a.frame, a.particle, b.x-a.x as dx, b.y-a.y as dy from gaps a join gaps b on a.exp=b.exp and a.particle=b.particle and b.frame=a.frame+2)"
REL = (
    f"{D2}, pd as (select a.condition, a.exp, a.frame, a.particle, b.particle as particle_2, a.dx-b.dx as x, a.dy-b.dy as y, theta from d a join d b "
    "on a.exp=b.exp and a.frame=b.frame and a.particle<b.particle join theta t on t.exp=a.exp and t.frame=a.frame), "
    "pg as (select *, sqrt(x*x+y*y) as dr, atan2(y,x)-theta as p, fmod(atan2(y,x)-theta+pi()/2, pi()) as q from pd), "
    "rel as (select *, case when q<0 then fmod(q+pi(),pi()) else q end-pi()/2 as phi, cos(2*p) as cos2 from pg)"
)


def relative(t):
    """Pairs of a frame with their relative displacement over two frames."""
    steps = kin.frame_displacement(t.gaps, [2]).select("condition", "exp", "frame", "particle", "x", "y", "dx", "dy").join(t.theta, ["exp", "frame"])
    return spa.relative_displacements(spa.pairs(steps, ["dx", "dy", "theta", "condition"]))


register("g05_relative_directions", "exp | frame particle particle_2 | dr phi cos2", relative, f"with {REL} select exp, frame, particle, particle_2, dr, phi, cos2 from rel")
register("g05_relative_order", "condition | n | order error dr", lambda t: spa.relative_order(relative(t), ["condition"], 0.5),
         f"with {REL} select condition, count(*) as n, avg(cos2) as \"order\", stddev_samp(cos2)/sqrt(count(*)) as error, avg(dr) as dr from rel where dr>=0.5 group by 1 having count(*)>1")
COS = "case when (u=0 and v=0) or (dx=0 and dy=0) then 0 else (u*dx+v*dy)/(sqrt(u*u+v*v)*sqrt(dx*dx+dy*dy)) end"
INT = "with {near}, it as (select *, x-16 as dx, y-16 as dy, {w} as w from nr), ic as (select *, {cos} as c, u*dx+v*dy as d from it), ra as (select unnest([1.5,3.0]) as radius), ag as (select exp, frame, particle, radius, sum(w*d)/sum(w) as dot, sum(w*c)/sum(w) as cos, sum(w*u)/sum(w) as u, sum(w*v)/sum(w) as v, stddev_pop(c) as cos_std, count(*) as n from ic cross join ra where d2<=radius*radius group by 1,2,3,4) select p.exp, p.frame, p.particle, ra.radius, coalesce(dot,0) as dot, coalesce(cos,0) as cos, coalesce(u,0) as u, coalesce(v,0) as v, coalesce(cos_std,0) as cos_std, coalesce(n,0) as n from on_field p cross join ra left join ag using (exp, frame, particle, radius)"
register("g06_interaction", "exp | frame particle n | radius dot cos u v cos_std", lambda t: spa.interaction(moved(t), t.field, [1.5, 3.0]), INT.format(near=NEAR.format(r=3), w="1.0", cos=COS))
register("g07_gaussian_interaction", "exp | frame particle n | radius dot cos u v", lambda t: spa.interaction(moved(t), t.field, [1.5, 3.0], sigma=1.5), INT.format(near=NEAR.format(r=3), w="exp(-d2/4.5)", cos=COS))
RING = "with {near}, rs as (select * from (values {sizes}) s(\"inner\",\"outer\")), rw as (select *, sqrt(u*u+v*v) as s from nr join rs on d2>=\"inner\"*\"inner\" and d2<=\"outer\"*\"outer\" where u<>0 or v<>0), g as (select exp, frame, particle, \"inner\", \"outer\", sqrt(pow(avg(u/s),2)+pow(avg(v/s),2)) as \"order\", avg(u) as mu, avg(v) as mv, avg(s) as speed, atan2(avg(2*u*v/(s*s)), avg((u*u-v*v)/(s*s)))/2 as axis, sqrt(pow(avg(2*u*v/(s*s)),2)+pow(avg((u*u-v*v)/(s*s)),2)) as nematic, count(*) as n from rw group by 1,2,3,4,5), o as (select exp, frame, particle, \"inner\", \"outer\", avg((round(u*mu+v*mv,12)<0)::int) as opposite from rw join g using (exp, frame, particle, \"inner\", \"outer\") group by 1,2,3,4,5) select * from g join o using (exp, frame, particle, \"inner\", \"outer\")"
register("g08_footprint_ring", "exp | frame particle n | order mu mv speed opposite", lambda t: spa.rings(t.on_field, t.field, [(1.0, 3.0)]), RING.format(near=NEAR.format(r=3), sizes="(1.0,3.0)"))
register("g09_ring_sweep", "exp | frame particle n | inner outer order opposite", lambda t: spa.rings(t.on_field, t.field, [(0.0, 2.0), (1.0, 3.0), (2.0, 4.0)]), RING.format(near=NEAR.format(r=4), sizes="(0.0,2.0),(1.0,3.0),(2.0,4.0)"))
register("g13_ring_director", "exp | frame particle n | nematic", lambda t: spa.rings(t.on_field, t.field, [(1.0, 4.0)]), RING.format(near=NEAR.format(r=4), sizes="(1.0,4.0)"))
register("g10_order_by_size", "exp | frame particle size n | order", lambda t: spa.order_by_size(t.on_field, t.field, 4), f"with {NEAR.format(r=4)}, c as (select exp, frame, particle, greatest(1,ceil(sqrt(d2))) as size, sum(u/sqrt(u*u+v*v)) as su, sum(v/sqrt(u*u+v*v)) as sv, count(*) as k from nr where u<>0 or v<>0 group by 1,2,3,4) select exp, frame, particle, size, sum(k) over w as n, sqrt(pow(sum(su) over w,2)+pow(sum(sv) over w,2))/sum(k) over w as \"order\" from c window w as (partition by exp, frame, particle order by size)")
register("g11_farthest_cell", "exp | frame px py | distance", lambda t: spa.farthest_cell(t.field, t.on_field), "with d as (select f.exp, f.frame, f.px, f.py, min(pow(f.px-p.x,2)+pow(f.py-p.y,2)) as d from field f join on_field p on f.exp=p.exp and f.frame=p.frame group by 1,2,3,4) select exp, frame, px, py, sqrt(d) as distance from d qualify row_number() over (partition by exp, frame order by d desc, px, py)=1")
register("g12_frame_order", "exp | frame n | axis nematic polar", lambda t: fld.frame_order(t.field), f"with {UNIT} select exp, frame, count(*) as n, atan2(avg(2*u*v),avg(u*u-v*v))/2 as axis, sqrt(pow(avg(2*u*v),2)+pow(avg(u*u-v*v),2)) as nematic, sqrt(pow(avg(u),2)+pow(avg(v),2)) as polar from un group by 1,2")
register("g14_neighbourhood_order", "exp | frame n | median mean", lambda t: fld.neighbourhood_order(t.field, 1), f"with {UNIT}, o as (select a.exp, a.frame, a.px, a.py, avg((a.u*a.u-a.v*a.v)*(b.u*b.u-b.v*b.v)+4*a.u*a.v*b.u*b.v) as o from un a join un b on a.exp=b.exp and a.frame=b.frame and abs(a.px-b.px)<=1 and abs(a.py-b.py)<=1 and (a.px<>b.px or a.py<>b.py) group by 1,2,3,4) select exp, frame, count(*) as n, quantile_cont(o,0.5) as median, avg(o) as mean from o group by 1,2")
DISK = f"{SPIN}, ds as (select s.exp, s.frame, cx, cy, avg(spin) as m, sqrt(pow(avg(u),2)+pow(avg(v),2)) as p, count(*) as n from sp s join (select a as cx, b as cy from (select unnest(range(-2,12)) as a) cross join (select unnest(range(-2,12)) as b)) c on pow(cx*4-px,2)+pow(cy*4-py,2)<=9 group by 1,2,3,4)"
spun = lambda t: fld.spins(t.field, t.theta)
register("g15_order_moments", "exp | n | mean variance", lambda t: fld.order_moments(fld.disks(spun(t), 3, 4)), f"with {DISK} select exp, count(*) as n, avg(p) as mean, var_pop(p) as variance from ds group by 1")
register("g16_spin_fractions", "exp | frame n | plus minus bias", lambda t: fld.spin_fractions(spun(t), ["exp", "frame"]), f"with {SPIN} select exp, frame, count(*) as n, avg((spin>0)::int) as plus, avg((spin<0)::int) as minus, avg(spin) as bias from sp group by 1,2")
register("g17_block_curve", "exp | window blocks | abs_m m m2 p", lambda t: fld.block_curve(spun(t), [2, 4, 8], 0.5, 32), f"with {SPIN}, b as (select exp, frame, w as \"window\", floor(px/w) as bx, floor(py/w) as b2, avg(spin) as m, sqrt(pow(avg(u),2)+pow(avg(v),2)) as p from sp cross join (select unnest([2,4,8]) as w) group by 1,2,3,4,5 having count(*)>=0.5*w*w) select exp, \"window\", count(*) as blocks, avg(abs(m)) as abs_m, avg(m) as m, avg(m*m) as m2, avg(p) as p from b group by 1,2")
register("g17_overlapping_blocks", "exp | frame bx row n | m p", lambda t: fld.blocks(spun(t), 8, 4, 0.5, 32).withColumnRenamed("by", "row"), f"with {SPIN}, s as (select a as bx, b as b2 from (select unnest(range(7)) as a) cross join (select unnest(range(7)) as b)) select exp, frame, bx, b2 as \"row\", count(*) as n, avg(spin) as m, sqrt(pow(avg(u),2)+pow(avg(v),2)) as p from sp join s on px>=bx*4 and px<bx*4+8 and py>=b2*4 and py<b2*4+8 group by 1,2,3,4 having count(*)>=32")
register("g18_disks", "exp | frame cx cy n | m p", lambda t: fld.disks(spun(t), 3, 4), f"with {DISK} select * from ds")
register("g19_block_pairs", "exp | frame bx row n | gap", lambda t: fld.blocks(spun(t), 4, 4, 0.5, 32).withColumnRenamed("by", "row"), f"with {SPIN}, b as (select exp, frame, floor(px/4) as bx, floor(py/4) as \"row\", count(*) as n, avg(spin) as m, sqrt(pow(avg(u),2)+pow(avg(v),2)) as p from sp group by 1,2,3,4 having count(*)>=8) select *, abs(p-abs(m))/nullif(p,0) as gap from b")
CORR = f"{UNIT}, ct as (select p.*, u.u as cu, u.v as cv from on_field p join un u on p.exp=u.exp and p.frame=u.frame and round_even(p.x,0)=u.px and round_even(p.y,0)=u.py), rc as (select c.exp, c.frame, c.particle, floor(sqrt(pow(f.px-c.x,2)+pow(f.py-c.y,2))) as distance, avg(f.u*cu+f.v*cv) as c, count(*) as n from ct c join un f on c.exp=f.exp and c.frame=f.frame and pow(f.px-c.x,2)+pow(f.py-c.y,2)<=25 group by 1,2,3,4)"
register("g21_ring_correlation", "exp | frame particle distance n | c", lambda t: spa.ring_correlation(t.on_field, t.field, 5), f"with {CORR} select * from rc")
SAMP = "vp as (select exp, frame, row_number() over (partition by exp, frame order by md5(concat_ws('|',0,exp,frame,px,py))) as particle, px::double as x, py::double as y from field where u<>0 or v<>0 qualify row_number() over (partition by exp, frame order by md5(concat_ws('|',0,exp,frame,px,py)))<=5)"
register("g22_virtual_points", "exp | frame particle distance n | c", lambda t: spa.ring_correlation(spa.sampled_pixels(t.field, 5), t.field, 5), f"with {SAMP}, {CORR.replace('on_field', 'vp')} select * from rc")
register("g23_baseline_corrected", "exp | distance n | mean sem", lambda t: spa.baseline_corrected(spa.ring_correlation(t.on_field, t.field, 5), fld.frame_order(t.field).select("exp", "frame", "m")), f"with {CORR}, m as (select exp, frame, pow(avg(u),2)+pow(avg(v),2) as m from un group by 1,2), a as (select exp, frame, distance, avg(c) as c from rc group by 1,2,3), b as (select *, (c-m)/(1-m) as k from a join m using (exp, frame)) select exp, distance, count(*) as n, avg(k) as mean, stddev_samp(k)/sqrt(count(*)) as sem from b group by 1,2")
register("g24_pooled_from_sums", "condition | n | mean std", lambda t: spa.pooled_from_sums(t.tracks, "y", ["condition"], ["exp"]), "select condition, count(*) as n, avg(y) as mean, stddev_pop(y) as std from tracks group by 1")
TWO = f"{UNIT}, tp as (select a.exp, floor(sqrt(pow(a.px-b.px,2)+pow(a.py-b.py,2))) as distance, a.u*b.u+a.v*b.v as c from un a join un b on a.exp=b.exp and a.frame=b.frame and b.px-a.px between 0 and 3 and abs(b.py-a.py)<=3 and (b.px>a.px or b.py>a.py) and pow(a.px-b.px,2)+pow(a.py-b.py,2)<=9)"
register("g25_two_point", "exp | distance n | c", lambda t: fld.two_point(t.field, 3), f"with {TWO} select exp, distance, count(*) as n, avg(c) as c from tp group by 1,2")
WRAP = f"{UNIT}, tw as (select a.exp, floor(sqrt(ox*ox+oy*oy)) as distance, a.u*b.u+a.v*b.v as c from un a cross join (select x as ox, y as oy from (select unnest(range(0,4)) as x) cross join (select unnest(range(-3,4)) as y) where (x>0 or y>0) and x*x+y*y<=9) join un b on a.exp=b.exp and a.frame=b.frame and b.px=(a.px+ox+32)%32 and b.py=(a.py+oy+32)%32)"
register("g25_two_point_wrapped", "exp | distance n | c four_point", lambda t: fld.two_point(t.field, 3, 32), f"with {WRAP} select exp, distance, count(*) as n, avg(c) as c, avg(c*c)-pow(avg(c),2) as four_point from tw group by 1,2")
register("g26_four_point", "exp | distance | four_point", lambda t: fld.two_point(t.field, 3), f"with {TWO} select exp, distance, avg(c*c)-pow(avg(c),2) as four_point from tp group by 1,2")
register("g27_dot_product_ngp", "exp | distance n | c2", lambda t: fld.two_point(t.field, 3).where("n >= 30"), f"with {TWO} select exp, distance, count(*) as n, avg(c*c) as c2 from tp group by 1,2 having count(*)>=30")
register("g29_mode_split_flow", "mode | distance n | c", lambda t: spa.ring_correlation(t.on_field, t.field, 5).withColumn("mode", F.explode(F.array(F.when(F.col("particle") % 2 == 0, "run").otherwise("tumble"), F.lit("all")))).groupBy("mode", "distance").agg(F.avg("c").alias("c"), F.count("*").alias("n")), f"with {CORR} select coalesce(mode,'all') as mode, distance, count(*) as n, avg(c) as c from (select *, case when particle%2=0 then 'run' else 'tumble' end as mode from rc) group by grouping sets ((mode,distance),(distance))")
RAD = "{near}, rb as (select *, sqrt(u*u+v*v) as s, floor(sqrt(d2)-1) as bin from nr where d2>=1), rn as (select *, avg(case when bin+0.5>2 then s end) over (partition by exp, frame) as f, avg(case when bin+0.5>2 then s end) over (partition by exp) as m from rb) select exp, bin, count(*) as n, avg(s) as speed, avg(s/nullif(f,0)) as by_frame, avg(s/nullif(m,0)) as by_movie from rn group by 1,2"
register("g30_radial_speed", "exp | bin n | speed by_frame by_movie", lambda t: spa.radial_speed(t.on_field, t.field, 1.0, 4.0, 1.0), "with " + RAD.format(near=NEAR.format(r=5)))
register("g31_lagged_radial_speed", "exp | bin n | speed by_frame by_movie", lambda t: spa.radial_speed(t.on_field, t.field, 1.0, 4.0, 1.0, 2), "with " + RAD.format(near=NEAR.format(r=5).replace("p.frame=f.frame", "p.frame=f.frame+2")))
register("g33_gradients", "exp | frame px py | normal shear vorticity q", lambda t: fld.gradients(t.field), "with g as (select f.*, l.u as lu, l.v as lv, r.u as ru, r.v as rv, d.u as du, d.v as dv, t.u as tu, t.v as tv from field f left join field l on l.exp=f.exp and l.frame=f.frame and l.py=f.py and l.px=f.px-1 left join field r on r.exp=f.exp and r.frame=f.frame and r.py=f.py and r.px=f.px+1 left join field d on d.exp=f.exp and d.frame=f.frame and d.px=f.px and d.py=f.py-1 left join field t on t.exp=f.exp and t.frame=f.frame and t.px=f.px and t.py=f.py+1), h as (select *, coalesce((ru-lu)/2, ru-u, u-lu) as ux, coalesce((rv-lv)/2, rv-v, v-lv) as vx, coalesce((tu-du)/2, tu-u, u-du) as uy, coalesce((tv-dv)/2, tv-v, v-dv) as vy from g) select exp, frame, px, py, ux-vy as normal, vx+uy as shear, vx-uy as vorticity, pow(ux-vy,2)+pow(vx+uy,2)-pow(vx-uy,2) as q from h where ux is not null and uy is not null")
register("g34_bilinear", "exp | frame particle | u", lambda t: spa.sampled_field(t.on_field, t.field, "u"), "select p.exp, p.frame, p.particle, case when count(f.u)=4 then sum((1-abs(p.x-f.px))*(1-abs(p.y-f.py))*f.u) end as u from on_field p left join field f on f.exp=p.exp and f.frame=p.frame and f.px in (floor(p.x),floor(p.x)+1) and f.py in (floor(p.y),floor(p.y)+1) group by 1,2,3")
register("g35_mergeable_moments", "exp | n positive negative | sum square", lambda t: fld.mergeable(t.field, F.col("u"), ["exp"]), "select exp, count(u) as n, count(*) filter (where u>0) as positive, count(*) filter (where u<0) as negative, sum(u) as sum, sum(u*u) as square from field group by 1")
register("g36_radial_distribution", "exp | distance n | g potential", lambda t: spa.radial_distribution(t.on_field, t.field, F.hypot("u", "v"), 4), f"with {NEAR.format(r=4)}, m as (select exp, frame, avg(sqrt(u*u+v*v)) as m from field group by 1,2), g as (select exp, floor(sqrt(d2)) as distance, count(*) as n, avg(sqrt(u*u+v*v))/avg(m) as g from nr join m using (exp, frame) where floor(sqrt(d2))<4 group by 1,2) select *, -ln(g) as potential from g")
register("g38_area_fraction", "exp | frame | fraction", lambda t: fld.area_fraction(t.field, F.col("u") > 0), "select exp, frame, avg((u>0)::int) as fraction from field group by 1,2")
ON = "tr as (select p.condition, p.exp, p.particle, p.x/100-0.1 as vx, p.y/100-0.1 as vy, f.u, f.v from on_field p join field f on p.exp=f.exp and p.frame=f.frame and floor(p.x)=f.px and floor(p.y)=f.py)"
on_flow = lambda t: t.on_field.withColumns({"px": F.floor("x").cast("int"), "py": F.floor("y").cast("int")}).join(t.field, ["exp", "frame", "px", "py"]).withColumns({"vx": F.col("x") / 100 - 0.1, "vy": F.col("y") / 100 - 0.1})
TCOS = "avg(case when (u=0 and v=0) or (vx=0 and vy=0) then 0 else (vx*u+vy*v)/(sqrt(vx*vx+vy*vy)*sqrt(u*u+v*v)) end)"
TRANS = f"sum(vx*u+vy*v)/nullif(sqrt(sum(vx*vx+vy*vy)*sum(u*u+v*v)),0) as efficiency, sum(vx*u+vy*v)/nullif(sum(u*u+v*v),0) as gain, {TCOS} as alignment, avg(sqrt(vx*vx+vy*vy))/nullif(avg(sqrt(u*u+v*v)),0) as eta, avg(sqrt(vx*vx+vy*vy))/nullif(avg(sqrt(u*u+v*v)),0)*{TCOS} as eta_alignment"
register("g39_transfer_efficiency", "condition | n | efficiency", lambda t: fld.transfer(on_flow(t), ["condition"]), f"with {ON} select condition, count(*) as n, {TRANS} from tr group by 1")
register("g41_decomposition", "exp | particle n | alignment eta eta_alignment", lambda t: fld.transfer(on_flow(t), ["exp", "particle"]), f"with {ON} select exp, particle, count(*) as n, {TRANS} from tr group by 1,2")
register("g42_transfer_gain", "condition exp | n | gain efficiency", lambda t: fld.transfer(on_flow(t), ["condition", "exp"]), f"with {ON} select condition, exp, count(*) as n, {TRANS} from tr group by 1,2")
register("g40_energy_split", "condition | n | mean sem", lambda t: kin.project(kin.lag_displacement(t.tracks, 1), t.theta).groupBy("condition", "exp", "particle").agg(F.avg("share").alias("s")).groupBy("condition").agg(F.avg("s").alias("mean"), (F.stddev_samp("s") / F.sqrt(F.count("s"))).alias("sem"), F.count("s").alias("n")), f"with {STEP}, d as (select condition, exp, particle, frame-1 as frame, dx, dy from steps where dx is not null), s as (select condition, d.exp, particle, avg(pow(dx*cos(theta)+dy*sin(theta),2)/nullif(dx*dx+dy*dy,0)) as s from d join theta t on d.exp=t.exp and d.frame=t.frame group by 1,2,3) select condition, count(s) as n, avg(s) as mean, stddev_samp(s)/sqrt(count(s)) as sem from s group by 1")
register("k26_hidden_vector", "exp | frame particle | hx hy", lambda t: spa.hidden_vector(spa.interaction(moved(t), t.field, [1.5, 3.0]).where("n > 0"), ["exp", "frame", "particle"], "u", "v", "dot").withColumns({c: F.round(c, 4) for c in ("hx", "hy")}),
         f"with {NEAR.format(r=3)}, it as (select *, u*(x-16)+v*(y-16) as d from nr), ra as (select unnest([1.5,3.0]) as radius), rw as (select exp, frame, particle, radius, avg(d) as d, avg(u) as u, avg(v) as v from it cross join ra where d2<=radius*radius group by all), s as (select exp, frame, particle, sum(u*u) as a, sum(u*v) as b, sum(v*v) as c, sum(u*d) as p, sum(v*d) as q from rw group by all) select exp, frame, particle, round(case when a*c-b*b>1e-9*pow(a+c,2) then (c*p-b*q)/(a*c-b*b) else p/nullif(a+c,0) end, 4) as hx, round(case when a*c-b*b>1e-9*pow(a+c,2) then (a*q-b*p)/(a*c-b*b) else q/nullif(a+c,0) end, 4) as hy from s")
DEPTH = NEAR.format(r=5).replace("p.frame=f.frame", "p.frame-f.frame between 0 and 2").replace("p.frame, p.particle", "p.frame, p.frame-f.frame as lag, p.particle")
register("x14_retention", "exp | | retention error tau_low", lambda t: fits.retention(spa.depth_series(t.on_field, t.field, 1.0, 4.0, 1.0, [0, 1, 2]), ["exp"], "lag", "depth", "error"),
         f"with {DEPTH}, rs as (select exp, lag, sqrt(u*u+v*v) as s, sqrt(d2)-1 as r from nr where d2>=1), ab as (select exp, lag, avg(s) filter (where r<1) as a, avg(s) filter (where r>=2) as b, stddev_samp(s) filter (where r<1)/sqrt(count(*) filter (where r<1)) as ea, stddev_samp(s) filter (where r>=2)/sqrt(count(*) filter (where r>=2)) as eb from rs group by all), ds as (select exp, lag, 1-a/b as d, a/b*sqrt(pow(ea/a,2)+pow(eb/b,2)) as e from ab), g as (select exp, arg_min(struct_pack(d:=d,e:=e),lag) as a, arg_max(struct_pack(d:=d,e:=e),lag) as b, max(lag) as t from ds group by all), r as (select exp, t, b.d/a.d as retention, abs(b.d/a.d)*sqrt(pow(a.e/a.d,2)+pow(b.e/b.d,2)) as error from g) select exp, retention, error, case when retention-error>0 and retention-error<1 then t/-ln(retention-error) end as tau_low from r")
