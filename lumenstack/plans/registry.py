"""Queries of the array operators, by name, over the driver's tables, and the SQL that gives the same rows.

The stack is the table of embeddings: vec_id is time, 64 values are an 8 x 8 frame.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenstack import model
from lumenstack.functions import arrays, sequences
from lumenstack.operators import filters, neurons, noise, pairwise, regions, registration, renorm, traces
from lumenstack.sources import config

SHAPE = (8, 8)

# Parts that the SQL of several queries shares.
PX = """px as (select vec_id t, i//8 y, i%8 x, v
  from (select vec_id, generate_subscripts(embedding,1)-1 i, unnest(embedding)::double v from embeddings))"""
TAPS = "k(o,w) as (values (-2,0.0625),(-1,0.25),(0,0.375),(1,0.25),(2,0.0625))"
LAST = "(select max(vec_id) from embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.frames(table(spark, sf_dir, "embeddings"), SHAPE, "vec_id", "embedding")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.to_pixels(frames(spark, sf_dir))


def sizes(stack: DataFrame) -> dict[str, int]:
    """The length of each axis; time counts from 0."""
    return {"t": stack.agg(F.max("t")).first()[0] + 1, "y": SHAPE[0], "x": SHAPE[1]}


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def rounded(column: str, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return (F.round(column, digits) + F.lit(0.0)).alias(column)


QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"with {PX} select t,y,x,round(v-avg(v) over(partition by t),6)+0.0 v from px")
def zeroed_mean_images(spark, sf_dir):
    return model.to_pixels(renorm.zeroed_mean_images(frames(spark, sf_dir))).select("t", "y", "x", rounded("v"))


@query(f"with {PX}, n as (select *,sqrt(sum(v*v) over(partition by t)) n from px) select t,y,x,round(case when n<>0 then v/n else v end,6)+0.0 v from n")
def renormalized_images_l2(spark, sf_dir):
    return model.to_pixels(renorm.renormalized_images(frames(spark, sf_dir))).select("t", "y", "x", rounded("v"))


@query(f"with {PX}, n as (select *,max(abs(v)) over(partition by t) n from px) select t,y,x,round(case when n<>0 then v/n else v end,6)+0.0 v from n")
def renormalized_images_inf(spark, sf_dir):
    return model.to_pixels(renorm.renormalized_images(frames(spark, sf_dir), float("inf"))).select("t", "y", "x", rounded("v"))


@query(
    f"""with {PX}, m as (select t,y,x,v-avg(v) over(partition by t) v from px), n as (select *,sqrt(sum(v*v) over(partition by t)) n from m)
select t,y,x,round(case when n<>0 then v/n else v end,6)+0.0 v from n"""
)
def normalize_data(spark, sf_dir):
    return model.to_pixels(renorm.normalize_data(frames(spark, sf_dir))).select("t", "y", "x", rounded("v"))


@query(f"with {PX} select y,x,round(max(v),6) mx,round(avg(v),6)+0.0 mn from px group by y,x")
def max_mean_projection(spark, sf_dir):
    return renorm.projections(pixels(spark, sf_dir)).select("y", "x", F.round("mx", 6).alias("mx"), rounded("mn"))


@query(
    f"""with {PX}, s as (select t,avg(v) m,stddev_pop(v) s from px group by t)
select t,round(stddev_pop(v),6) noise from px join s using(t) where abs(v-m)<3.0*s group by t"""
)
def estimate_noise(spark, sf_dir):
    return noise.estimate_noise(pixels(spark, sf_dir)).select("t", rounded("noise"))


_NOISE = f"""{PX}, s as (select t,avg(v) m,stddev_pop(v) s from px group by t),
n as (select t,any_value(m) m,stddev_pop(v) n from px join s using(t) where abs(v-m)<3.0*s group by t)"""


@query(f"with {_NOISE} select t,y,x from px join n using(t) where abs(v-m)>=2.0*n")
def significant_mask(spark, sf_dir):
    return noise.significant_mask(pixels(spark, sf_dir), 2.0).filter("significant").select("t", "y", "x")


@query(f"with {_NOISE} select t,count(*) quiet from px join n using(t) where not abs(v-m)>=2.0*n group by t")
def noise_mask(spark, sf_dir):
    return noise.noise_mask(pixels(spark, sf_dir), 2.0).filter("noise").groupBy("t").agg(F.count("*").alias("quiet"))


@query(
    f"""with {PX}, {TAPS}, s as (select a.t,a.y,a.x,any_value(a.v) v,sum(k.w*b.v) sm from px a cross join k
join px b on b.t=a.t and b.y=a.y and b.x=7-abs(7-abs(a.x+k.o)) group by a.t,a.y,a.x) select t,y,x,round(v-sm,6)+0.0 w from s"""
)
def wavelet_level1_x(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return filters.wavelet_transform(px, {"x": 1}, {"x": SHAPE[1]}).select("t", "y", "x", F.col("v").alias("w")).select("t", "y", "x", rounded("w"))


@query(
    f"""with {PX}, {TAPS}, q(o,w) as (select 2*o,w from k),
a1 as (select p.t,p.y,p.x,sum(k.w*b.v) v from px p cross join k join px b on b.t=p.t and b.x=p.x and b.y=7-abs(7-abs(p.y+k.o)) group by all),
s1 as (select p.t,p.y,p.x,sum(k.w*b.v) v from a1 p cross join k join a1 b on b.t=p.t and b.y=p.y and b.x=7-abs(7-abs(p.x+k.o)) group by all),
a2 as (select p.t,p.y,p.x,sum(q.w*b.v) v from s1 p cross join q join s1 b on b.t=p.t and b.x=p.x and b.y=7-abs(7-abs(p.y+q.o)) group by all),
s2 as (select p.t,p.y,p.x,sum(q.w*b.v) v from a2 p cross join q join a2 b on b.t=p.t and b.y=p.y and b.x=7-abs(7-abs(p.x+q.o)) group by all)
select 1 band,t,y,x,round(px.v-s1.v,6)+0.0 v from px join s1 using(t,y,x) union all select 2,t,y,x,round(s1.v-s2.v,6)+0.0 from s1 join s2 using(t,y,x)"""
)
def wavelet_bands(spark, sf_dir):
    found = model.to_pixels(filters.frame_wavelets(frames(spark, sf_dir), 2, include_lower_scales=True))
    return found.select("band", "t", "y", "x", rounded("v"))


@query(
    f"""with {PX}, o as (select unnest(range(-5,6)) o), s as (select a.t,a.y,a.x,list_sort(list(b.v)) l from px a cross join o
join px b on b.y=a.y and b.x=a.x and b.t={LAST}-abs({LAST}-abs(a.t+o)) group by a.t,a.y,a.x) select t,y,x,round(l[6],6) f0 from s"""
)
def rank_filter_t(spark, sf_dir):
    px = pixels(spark, sf_dir)
    found = filters.rank_filter(px, 5, 0.5, sizes(px)["t"])
    return found.select("t", "y", "x", F.round("v", 6).alias("f0"))


def _gauss(stdev: float) -> str:
    return ",".join(f"({o},{w!r})" for o, w in filters.gaussian_kernel(stdev, 3.0).items())


@query(
    f"""with {PX}, g(o,w) as (values {_gauss(1.0)}), o as (select unnest(range(-3,4)) o),
a as (select p.t,p.y,p.x,sum(g.w*b.v) v from px p cross join g join px b on b.y=p.y and b.x=p.x and b.t={LAST}-abs({LAST}-abs(p.t+g.o)) group by all),
r as (select p.t,p.y,p.x,list_sort(list(b.v))[4] v from a p cross join o join a b on b.y=p.y and b.x=p.x and b.t={LAST}-abs({LAST}-abs(p.t+o.o)) group by p.t,p.y,p.x),
u as (select p.t,p.y,p.x,sum(g.w*b.v) v from r p cross join g join r b on b.t=p.t and b.x=p.x and b.y=7-abs(7-abs(p.y+g.o)) group by all),
f as (select p.t,p.y,p.x,sum(g.w*b.v) v from u p cross join g join u b on b.t=p.t and b.y=p.y and b.x=7-abs(7-abs(p.x+g.o)) group by all)
select t,y,x,round((px.v-f.v)/(f.v+(select 1-min(v) from px)),6)+0.0 v from px join f using(t,y,x)"""
)
def extract_f0(spark, sf_dir):
    px = pixels(spark, sf_dir)
    found = traces.extract_f0(px, half_window_size=3, which_quantile=0.5, sizes=sizes(px), temporal_stdev=1.0, spatial_stdev=1.0, window_size=3.0)
    return found.select("t", "y", "x", rounded("v"))


@query(f"with {PX}, m as (select t,y,x from px where v>0.1) select distinct a.t,a.y,a.x from px a join m on m.t=a.t and abs(m.y-a.y)<=1 and abs(m.x-a.x)<=1")
def binary_dilation_3x3(spark, sf_dir):
    return filters.binary_dilation(pixels(spark, sf_dir).filter("v > 0.1").select("t", "y", "x"), filters.box(1, 1), SHAPE)


@query(
    f"""with {PX}, m as (select t,y,x from px where not v>0.0) select a.t,a.y,a.x from px a
where not exists(select 1 from m where m.t=a.t and abs(m.y-a.y)<=1 and m.x=a.x)"""
)
def binary_erosion_3x1(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return filters.binary_erosion(px.filter("v > 0.0").select("t", "y", "x"), px, filters.box(1, 0), SHAPE)


_LABELS = f"""{PX}, m as (select t,y,x,y*8+x i from px where v>0.05), r(t,i,root) as (select t,i,i from m union
select p.t,p.i,r.root from r join m q on q.t=r.t and q.i=r.i join m p on p.t=r.t and abs(p.y-q.y)+abs(p.x-q.x)=1),
c as (select t,i,min(root) root from r group by t,i), l as (select t,i,dense_rank() over(partition by t order by root) as label from c)"""


@query(f"with recursive {_LABELS} select t,i,label from l")
def label_components(spark, sf_dir):
    return regions.label_components(frames(spark, sf_dir), 0.05).select("t", (F.col("y") * 8 + F.col("x")).alias("i"), "label")


@query(
    f"""with recursive {_LABELS}, p as (select l.t,label,px.y,px.x,v from l join px on px.t=l.t and px.y=l.i//8 and px.x=l.i%8),
s as (select t,label,count(*) area,sum(y) sy,sum(x) sx,sum(y*y) syy,sum(x*x) sxx,sum(y*x) syx,max(v) mf,max(y)-min(y)+1 h,max(x)-min(x)+1 w from p group by all),
k as (select *,(area*syy-sy*sy)::double/(area*area) a,(area*sxx-sx*sx)::double/(area*area) b,(area*syx-sy*sx)::double/(area*area) d from s)
select t,label,area,round(sy/area,6) cy,round(sx/area,6) cx,round(d,6)+0.0 cyx,round(mf,6) max_f,round(area/(h*w),6) extent,
round(4*sqrt((a+b)/2+sqrt(((a-b)/2)**2+d**2)),6) major from k"""
)
def region_props(spark, sf_dir):
    found = regions.region_properties(regions.label_components(frames(spark, sf_dir), 0.05), ["t", "label"])
    six = [F.round(c, 6).alias(c) for c in ("cy", "cx", "max_f", "extent")]
    return found.select("t", "label", "area", *six, rounded("cyx"), F.round("major_axis_length", 6).alias("major"))


@query(
    f"""with recursive {_LABELS}, p as (select l.t,label,count(*) area,max(l.i%8)-min(l.i%8)+1 w from l group by all)
select t,label,area from p where area>=3 and area<=8"""
)
def match_regions(spark, sf_dir):
    props = regions.region_properties(regions.label_components(frames(spark, sf_dir), 0.05), ["t", "label"])
    return regions.match_regions_properties(props, {"area": {"min": 3, "max": 8}}).select("t", "label", "area")


_MAXIMA = f"""{PX}, m as (select a.t,a.y,a.x,any_value(a.v) v from px a join px b on a.t=b.t and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1
where a.v>0 group by a.t,a.y,a.x having max(b.v)<=any_value(a.v))"""


@query(f"with {_MAXIMA} select t,y,x,round(v,6) v from m")
def local_maxima_3x3(spark, sf_dir):
    return regions.local_maxima(pixels(spark, sf_dir)).select("t", "y", "x", F.round("v", 6).alias("v"))


@query(
    f"""with {_MAXIMA} select a.t,a.y,a.x from m a where not exists(select 1 from m b where b.t=a.t and (b.y<>a.y or b.x<>a.x)
and sqrt((a.y-b.y)**2+(a.x-b.x)**2)<3.0 and (b.v>a.v or (b.v=a.v and b.y*8+b.x<a.y*8+a.x)))"""
)
def too_close_pairs(spark, sf_dir):
    found = regions.remove_too_close_local_maxima(regions.local_maxima(pixels(spark, sf_dir)), 3.0, ["t"])
    return found.select("t", "y", "x")


@query(
    f"""with {PX}, m as (select t,y,x from px where v>0.05), n as (select m.t,m.y,m.x,count(p.t) k from m left join m p
on p.t=m.t and abs(p.y-m.y)+abs(p.x-m.x)=1 group by all) select t,y,x from n where k<4"""
)
def contours(spark, sf_dir):
    return regions.contour(pixels(spark, sf_dir).filter("v > 0.05").select("t", "y", "x"), SHAPE, ["t"])


@query(
    """select a.vec_id i,b.vec_id j,round(list_cosine_similarity(a.embedding::double[],b.embedding::double[]),6) c from embeddings a join embeddings b
on a.vec_id<b.vec_id where list_cosine_similarity(a.embedding::double[],b.embedding::double[])>0.4"""
)
def dot_product_normalized(spark, sf_dir):
    found = pairwise.products_over(vectors(spark, sf_dir), None, 0.4)
    return found.select("i", "j", F.round("value", 6).alias("c"))


@query(
    f"""with {PX}, m as (select t,y,x from px where v>0.1), a as (select t,count(*) a from m group by t)
select i.t ti,j.t tj,round(count(*)/(any_value(ai.a)+any_value(aj.a)-count(*)),6) iou from m i join m j on i.y=j.y and i.x=j.x and i.t<j.t
join a ai on ai.t=i.t join a aj on aj.t=j.t group by i.t,j.t"""
)
def masks_overlap(spark, sf_dir):
    m = pixels(spark, sf_dir).filter("v > 0.1").select(F.col("t").alias("ti"), "y", "x")
    found = pairwise.masks_overlap(m, None, "ti", "tj")
    return found.select("ti", "tj", F.round("overlap", 6).alias("iou"))


_MAPPED = """m as (select a.vec_id i,b.vec_id j from embeddings a join embeddings b on a.vec_id<>b.vec_id
where list_cosine_similarity(a.embedding::double[],b.embedding::double[])>0.4)"""


def _mapping(spark, sf_dir) -> DataFrame:
    """All pairs of different vectors with a cosine above 0.4, each way round; a pair is computed once."""
    half = model.cut(pairwise.products_over(vectors(spark, sf_dir), None, 0.4).select("i", "j"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j")))


@query(f"with {_MAPPED} select i,j from m qualify count(*) over(partition by i)=1 and count(*) over(partition by j)=1")
def unique_mapping(spark, sf_dir):
    return pairwise.unique_mapping(_mapping(spark, sf_dir))


@query(
    """with e as (select l.doc_id i,d.doc_id j from (select doc_id from labels where quality=1) l join documents d on d.doc_id=l.doc_id where n_chars>500),
n as (select (select count(*) from labels where quality=1) ni,(select count(*) from documents where n_chars>500) nj)
select round(count(*)/any_value(ni),6) recall,round(count(*)/any_value(nj),6) as "precision" from e cross join n"""
)
def mapping_relevance(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("i"))
    long = table(spark, sf_dir, "documents").filter("n_chars > 500").select(F.col("doc_id").alias("j"))
    edges = good.join(long, F.col("i") == F.col("j"))
    found = pairwise.compute_mapping_relevance(edges, good.count(), long.count())
    return found.select(F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(
    """with s as (select event_type,value v,row_number() over(partition by event_type order by value,event_id) r,count(*) over(partition by event_type) n from events),
p(q) as (values (0.25::double),(0.5),(0.75)), a as (select *,n*q+0.5 al,floor(least(greatest(n*q+0.5,1),n-1)) k from s cross join p)
select event_type,q,round(sum(case when r=k then v*(1-(al-k)) when r=k+1 then v*(al-k) else 0 end),6) as "value" from a group by event_type,q"""
)
def quantile_hazen(spark, sf_dir):
    return arrays.quantile(table(spark, sf_dir, "events"), "value", 3, ["event_type"]).select("event_type", "q", F.round("value", 6).alias("value"))


@query("select l_returnflag,round(quantile_cont(l_extendedprice,0.5),4) median from lineitem group by l_returnflag")
def lineitem_medians(spark, sf_dir):
    found = arrays.quantile(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.5, ["l_returnflag"])
    return found.select("l_returnflag", F.round("l_extendedprice", 4).alias("median"))


@query(f"with {PX} select t,(y+2)%8 y,(x-3+8)%8 x,round(v,6) v,((y+2)>7 or (x-3)<0) masked from px")
def roll_masked(spark, sf_dir):
    return registration.roll(pixels(spark, sf_dir), 2, -3, SHAPE).select("t", "y", "x", F.round("v", 6).alias("v"), "masked")


@query(f"with {PX} select t,y-2 y,x x,round(v,6) v from (select t,y+2 y,x-3 x,v from px) where y<=7 and x>=0")
def truncate_masked(spark, sf_dir):
    rolled = registration.roll(pixels(spark, sf_dir), 2, -3, SHAPE)
    return registration.truncate_masked(rolled).select("t", "y", "x", F.round("v", 6).alias("v"))


@query(
    f"""with {PX}, tm as (select y,x,avg(v) tv from px group by y,x), c as (select p.t,(p.y-tm.y+8)%8 dy,(p.x-tm.x+8)%8 dx,abs(sum(p.v*tm.tv)) cc
from px p cross join tm group by all) select t,-dy dy,-dx dx from c qualify row_number() over(partition by t order by round(cc,12) desc,dy,dx)=1"""
)
def find_offsets(spark, sf_dir):
    stack = frames(spark, sf_dir)
    return registration.find_offsets(stack, registration.mean_frame(stack, SHAPE))


@query()
def register_mean_offsets(spark, sf_dir):
    return registration.register_mean_offsets(frames(spark, sf_dir), SHAPE, max_iters=3, tell=True)


@query(
    f"""with {PX}, f as (select t,y,x,v-avg(v) over(partition by t) v from px), g as (select t,y,x,v/nullif(sqrt(sum(v*v) over(partition by t)),0) v from f),
r as (select y//4*2+x//4 roi,t,avg(v) tr from g group by all), z as (select roi,t,tr-avg(tr) over(partition by roi) tr from r),
u as (select roi,t,tr/sqrt(sum(tr*tr) over(partition by roi)) tr from z) select roi,y,x,round(sum(tr*v),6)+0.0 corr from u join g using(t) group by roi,y,x"""
)
def expand_rois(spark, sf_dir):
    found = traces.expand_rois(pixels(spark, sf_dir), F.expr("(y div 4) * 2 + x div 4"))
    return found.select("roi", "y", "x", rounded("corr"))


@query("select user_id,event_id,lead(event_id,1) over w l1,lead(event_id,2) over w l2 from events window w as (partition by user_id order by ts,event_id)")
def lagged_generators(spark, sf_dir):
    return pairwise.lagged(table(spark, sf_dir, "events"), "event_id", 3, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "l1", "l2")


@query(
    """select user_id,event_id,list(event_id) over w as ids from events
window w as (partition by user_id order by ts,event_id rows between current row and 2 following) qualify len(ids)=3""".replace("list(event_id) over w as ids", "array_to_string(list(event_id) over w,',') ids").replace(
        "qualify len(ids)=3", "qualify count(*) over w=3"
    )
)
def sliding_window(spark, sf_dir):
    found = sequences.sliding_window(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "event_id", 3, ["user_id"], ["ts", "event_id"])
    return found.select("user_id", "event_id", F.array_join(F.col("window").cast("array<string>"), ",").alias("ids"))


@query("select doc_id,lpad(doc_id::varchar,(select max(length(doc_id::varchar)) from documents)::int,'0') padded from documents")
def filled_numbers(spark, sf_dir):
    return sequences.filled_stringify_numbers(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("select event_id from events where event_id not in (select doc_id from labels)")
def skip_values(spark, sf_dir):
    skipped = table(spark, sf_dir, "labels").select("doc_id")
    return sequences.skip_values(table(spark, sf_dir, "events").select("event_id"), "event_id", skipped)


@query(r"select url from pages where regexp_full_match(url,'/*https?:/+[^/]+/+(en|fr)/+[^/]+/*')")
def path_match(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(config.matches_path(F.col("url"), "https?:/.+/(en|fr)/.+")).select("url")


@query(
    """with b as (select 1-min(value) bias from events), f as (select event_id,user_id,value,quantile_disc(value,0.15) over(partition by user_id
order by ts,event_id rows between 5 preceding and 5 following) f0 from events) select event_id,round((value-f0)/(f0+bias),6)+0.0 df from f cross join b"""
)
def events_df_over_f(spark, sf_dir):
    found = traces.rolling_df_over_f(table(spark, sf_dir, "events"), 5, 0.15, "user_id", ["ts", "event_id"], "value")
    return found.select("event_id", rounded("df"))


@query(
    """select vec_id t,round(list_aggregate(list_transform(embedding,lambda e: abs(e::double)),'max'),6) largest,
list_position(list_transform(embedding,lambda e: abs(e)),list_aggregate(list_transform(embedding,lambda e: abs(e)),'max'))-1 as at from embeddings"""
)
def max_abs(spark, sf_dir):
    found = frames(spark, sf_dir).withColumn("m", arrays.max_abs(F.col("data")))
    return found.select("t", F.round(F.abs("m.value"), 6).alias("largest"), F.col("m.index").alias("at"))


@query("select vec_id t,unnest(range(8)) y,unnest(list_transform(range(8),lambda y: round(embedding[y*8+4]::double,6))) v from embeddings")
def index_axis(spark, sf_dir):
    column = arrays.index_axis_at_pos(F.col("data"), SHAPE, 1, 3)
    return frames(spark, sf_dir).select("t", F.posexplode(column).alias("y", "v")).select("t", F.col("y").cast("bigint").alias("y"), F.round("v", 6).alias("v"))


@query(
    f"""with recursive {_LABELS}, p as (select l.t,label,px.y,px.x,v from l join px on px.t=l.t and px.y=l.i//8 and px.x=l.i%8)
select t,label,count(*)::double area,round(max(v),6) max_f,round(avg(y),6) my,round(avg(x),6) mx,
case when count(*)>1 then round((count(*)*sum(y*y)-sum(y)*sum(y))::double/(count(*)*(count(*)-1)),6) end vyy from p group by t,label"""
)
def extract_neurons(spark, sf_dir):
    found = neurons.extract_neurons(regions.label_components(frames(spark, sf_dir), 0.05), ["t", "label"])
    mean, cov = F.col("gaussian_mean"), F.col("gaussian_cov")
    vyy = F.when(F.col("area") > 1, F.round(cov[0][0], 6)).alias("vyy")
    return found.select("t", "label", "area", F.round("max_F", 6).alias("max_f"), F.round(mean[0], 6).alias("my"), F.round(mean[1], 6).alias("mx"), vyy)


@query()
def merge_neurons(spark, sf_dir):
    found = neurons.extract_neurons(regions.label_components(frames(spark, sf_dir), 0.25), ["t", "label"])
    return neurons.merge_neuron_sets(found, SHAPE, 0.9, 0.9, chains="reference").select("neuron", "area", F.round("max_F", 6).alias("max_f"))


@query()
def merge_neurons_once(spark, sf_dir):
    """The neurons of odd frames merged into those of even ones."""
    found = neurons.extract_neurons(regions.label_components(frames(spark, sf_dir), 0.25), ["t", "label"])
    sets = [found.filter(F.col("t") % 2 == k) for k in (0, 1)]
    return neurons.merge_neuron_sets_once(*sets, SHAPE, 0.9, 0.9).select("neuron", "area", F.round("max_F", 6).alias("max_f"))


@query(
    f"""with recursive {_LABELS}, p as (select l.t,label,px.y,px.x,v from l join px on px.t=l.t and px.y=l.i//8 and px.x=l.i%8),
e as (select t,label,p.y,p.x,v,(select count(*) from p q where q.t=p.t and q.label=p.label and abs(q.y-p.y)+abs(q.x-p.x)=1)<4 as edge from p)
select t,label,count(*)::double area,string_agg(y*8+x,',' order by y*8+x) mask,coalesce(string_agg(y*8+x,',' order by y*8+x) filter (where edge),'') contour,
round(sum(v),6)+0.0 total from e group by t,label"""
)
def neuron_records(spark, sf_dir):
    """Whole records, their mask and contour told as lists of pixels."""
    found = neurons.extract_neurons(regions.label_components(frames(spark, sf_dir), 0.05), ["t", "label"])
    named = found.withColumn("neuron", F.col("t") * 100 + F.col("label"))
    records = neurons.neuron_records(named, SHAPE)

    def listed(flags: str) -> Column:
        at = F.filter(F.transform(flags, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
        return F.array_join(at.cast("array<string>"), ",").alias(flags)

    total = F.aggregate("image", F.lit(0.0), lambda a, x: a + x)
    return records.select(F.expr("neuron div 100").alias("t"), (F.col("neuron") % 100).cast("int").alias("label"), "area", listed("mask"), listed("contour"), (F.round(total, 6) + 0.0).alias("total"))


# Eight frames that follow each other are the planes of a volume.
_VOLUMES = """px as (select vec_id//8 t,vec_id%8 z,i//8 y,i%8 x,v
  from (select vec_id, generate_subscripts(embedding,1)-1 i, unnest(embedding)::double v from embeddings))"""
_VOLUME_LABELS = f"""{_VOLUMES}, m as (select t,z,y,x,(z*8+y)*8+x i,v from px where v>0.12), r(t,i,root) as (select t,i,i from m union
select p.t,p.i,r.root from r join m q on q.t=r.t and q.i=r.i join m p on p.t=r.t and abs(p.z-q.z)+abs(p.y-q.y)+abs(p.x-q.x)=1),
c as (select t,i,min(root) root from r group by t,i), l as (select t,i,dense_rank() over(partition by t order by root) as label from c)"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select(F.expr("t div 8").alias("t"), (F.col("t") % 8).alias("z"), "shape", "data")


def volume_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of volumes, labelled in slabs of three planes."""
    return regions.label_planes(planes(spark, sf_dir), 0.12, depth=3)


@query(f"with recursive {_VOLUME_LABELS} select t,i,label from l")
def label_volumes(spark, sf_dir):
    return volume_regions(spark, sf_dir).select("t", ((F.col("z") * 8 + F.col("y")) * 8 + F.col("x")).alias("i"), "label")


@query(
    f"""with recursive {_VOLUME_LABELS}, p as (select l.t,label,z,y,x,v from l join m using(t,i)), s as (select t,label,count(*) area,sum(z) sz,sum(y) sy,sum(x) sx,
sum(z*z) szz,sum(y*y) syy,sum(x*x) sxx,sum(z*y) szy,sum(z*x) szx,sum(y*x) syx,max(v) mf,(max(z)-min(z)+1)*(max(y)-min(y)+1)*(max(x)-min(x)+1) box from p group by all),
k as (select *,(area*szz-sz*sz)::double/(area*area) a,(area*syy-sy*sy)::double/(area*area) b,(area*sxx-sx*sx)::double/(area*area) d,
(area*szy-sz*sy)::double/(area*area) e,(area*szx-sz*sx)::double/(area*area) f,(area*syx-sy*sx)::double/(area*area) g from s),
q as (select *,(a+b+d)/3 q from k), w as (select *,sqrt(((a-q)**2+(b-q)**2+(d-q)**2+2*(e**2+f**2+g**2))/6) p from q),
u as (select *,case when p=0 then 1 else greatest(-1,least(1,((a-q)*((b-q)*(d-q)-g*g)-e*(e*(d-q)-g*f)+f*(e*g-(b-q)*f))/(2*p**3))) end r from w)
select t,label,area,round(sz/area,6) cz,round(sy/area,6) cy,round(sx/area,6) cx,round(mf,6) max_f,round(area/box,6) extent,
round(4*sqrt(q+2*p*cos(acos(r)/3)),4) major from u"""
)
def volume_props(spark, sf_dir):
    found = regions.region_properties(volume_regions(spark, sf_dir), ["t", "label"])
    return found.select("t", "label", "area", *[F.round(c, 6).alias(c) for c in ("cz", "cy", "cx", "max_f", "extent")], F.round("major_axis_length", 4).alias("major"))


@query(
    f"""with {_VOLUMES}, m as (select a.t,a.z,a.y,a.x,any_value(a.v) v from px a join px b on a.t=b.t and abs(a.z-b.z)<=1 and abs(a.y-b.y)<=1 and abs(a.x-b.x)<=1
where a.v>0 group by a.t,a.z,a.y,a.x having max(b.v)<=any_value(a.v)) select t,z,y,x,round(v,6) v from m"""
)
def volume_maxima(spark, sf_dir):
    return regions.local_maxima(volume_pixels(spark, sf_dir)).select("t", "z", "y", "x", F.round("v", 6).alias("v"))


def volume_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.to_pixels(planes(spark, sf_dir)).select("t", "z", "y", "x", "v")


_BAND = f"""{PX}, d as (select a.t,a.y,a.x,any_value(a.v) v,min((a.y-b.y)**2+(a.x-b.x)**2) d2 from px a join px b on a.t=b.t
where a.v>0.0 and not b.v>0.0 group by a.t,a.y,a.x), e as (select t,y,x,v from d where sqrt(d2)>=0.9 and sqrt(d2)<=1.6)"""


def positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose values that aren't above 0 are 0."""
    return frames(spark, sf_dir).withColumn("data", F.transform("data", lambda v: F.when(v > 0, v).otherwise(F.lit(0.0))))


@query(f"with {_BAND} select t,y,x,round(v,6) v from e")
def band_contours(spark, sf_dir):
    found = model.to_pixels(regions.band_contours(positive(spark, sf_dir), 1.25, 0.7))
    return found.filter("v <> 0").select("t", "y", "x", F.round("v", 6).alias("v"))


@query(
    f"""with recursive {_BAND}, m as (select t,y,x,y*8+x i from e), r(t,i,root) as (select t,i,i from m union
select p.t,p.i,r.root from r join m q on q.t=r.t and q.i=r.i join m p on p.t=r.t and abs(p.y-q.y)<=1 and abs(p.x-q.x)<=1),
c as (select t,i,min(root) root from r group by t,i) select t,i,dense_rank() over(partition by t order by root) as label from c"""
)
def labeled_contours(spark, sf_dir):
    found = regions.labeled_contours(positive(spark, sf_dir), 1.25, 0.7)
    return found.select("t", F.posexplode("labels").alias("i", "label")).filter("label > 0").select("t", F.col("i").cast("bigint").alias("i"), "label")


@query(f"with {PX}, m as (select t,y,x from px where v>0.3), n as (select t,row_number() over(order by t) k from (select distinct t from m)) select y,x,max(k) number from m join n using(t) group by y,x")
def enumerate_masks_max(spark, sf_dir):
    return regions.enumerate_masks_max(pixels(spark, sf_dir).filter("v > 0.3").select("t", "y", "x"), [], "t")


@query(
    """with n as (select user_id,event_id,row_number() over(order by user_id,event_id)-1 as "index" from events)
select user_id,event_id,"index",lpad("index"::varchar,(select max(length("index"::varchar)) from n)::int,'0') padded from n"""
)
def filled_enumerate(spark, sf_dir):
    return sequences.filled_stringify_enumerate(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id", "event_id"])
