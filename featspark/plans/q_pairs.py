"""Queries: correlation, information and causality between features."""

from pyspark.sql import functions as F

from ..operators import pairs as P
from ..operators.quantiles import digitize, ranks
from ..sources import views as S
from .registry import query

NC = "case when not isnan({0}) then {0} end"
CORR = NC.format("corr(a.value,b.value)")
SAME = "act a join act b on a.protein_id=b.protein_id and a.pos=b.pos and a.layer=b.layer"
NEXT = "act a join act b on a.protein_id=b.protein_id and a.pos=b.pos and b.layer=a.layer+1"
COV = """cv as materialized (select a.layer, a.feature as i, b.feature as j, covar_pop(a.value,b.value) as cov from """ + SAME + " group by all)"


@query("W16_ordinal_ranks", 'select protein_id, pos, layer, feature, row_number() over (partition by layer, feature order by value, protein_id, pos) as "rank" from act', "act")
def _(s, p):
    return ranks(S.activations(s, p), ["layer", "feature"], "value", "ordinal", ["protein_id", "pos"]).drop("value")


@query("W16_average_ranks", """select protein_id, pos, layer, feature, rank() over (partition by layer, feature order by value)
 + (count(*) over (partition by layer, feature, value)-1)/2.0::double as "rank" from act""", "act", d="rank")
def _(s, p):
    return ranks(S.activations(s, p), ["layer", "feature"], "value").drop("value")


DIGI = """ed as materialized (select layer, feature, """ + ", ".join(f"quantile_cont(value, {k}/9.0::double) as e{k}" for k in range(10)) + """ from act group by all),
dg as materialized (select a.protein_id, a.pos, a.layer, a.feature, """ + "+".join(f"(value>=e{k})::int" for k in range(10)) + """ as code from act a join ed using (layer, feature))"""
DIGI = DIGI.replace("/9.0::double", "/9.0")


@query("W17_digitize", "select protein_id, pos, layer, feature, code from dg", "act", i="code", extra=DIGI)
def _(s, p):
    return digitize(S.activations(s, p), ["layer", "feature"]).drop("value")


@query("Q1_pearson", f"select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, {CORR} as corr from {SAME} and a.feature<b.feature group by all", "act", d="corr")
def _(s, p):
    return P.pearson_matrix(S.activations_vec(s, p))


@query("Q1_pearson_standardized", f"""select a.layer as la, b.layer as lb, a.feature as i, b.feature as j,
 covar_pop(a.value,b.value)/((stddev_samp(a.value)+1e-8)*(stddev_samp(b.value)+1e-8)) as corr from {NEXT} group by all""", "act", d="corr")
def _(s, p):
    return P.pearson_standardized(S.activations_vec(s, p))


@query("Q1_mean_abs_correlation", f"select avg(abs(corr)) as feature_correlation from (select a.feature, b.feature, {CORR} as corr from {SAME} and a.feature<b.feature group by all)",
       "act", d="feature_correlation")
def _(s, p):
    return P.mean_abs_correlation(S.activations_vec(s, p))


@query("Q2_spearman", """select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, case when not isnan(corr(a.r,b.r)) then corr(a.r,b.r) end as spearman
 from rk a join rk b on a.protein_id=b.protein_id and a.pos=b.pos and b.layer=a.layer+1 group by all""", "act", d="spearman",
       extra="""rk as materialized (select protein_id, pos, layer, feature, rank() over (partition by layer, feature order by value)
 + (count(*) over (partition by layer, feature, value)-1)/2.0::double as r from act)""")
def _(s, p):
    return P.spearman_matrix(S.activations_vec(s, p))


CSP = """sp as materialized (select protein_id, layer, pos, s, conservation, rank() over (partition by protein_id, layer order by s)
  + (count(*) over (partition by protein_id, layer, s)-1)/2.0::double as a,
 rank() over (partition by protein_id, layer order by conservation) + (count(*) over (partition by protein_id, layer, conservation)-1)/2.0::double as b
 from (select protein_id, layer, pos, avg(abs(value)) as s from act group by all) join tok using (protein_id, pos)),
cs as (select protein_id, layer, corr(a,b) as spearman, count(*) as n from sp group by all having count(*)>10)"""


@query("Q2_conservation_spearman", "select * from cs", "act tok", d="spearman", extra=CSP)
def _(s, p):
    return P.conservation_spearman(S.activations_vec(s, p), S.token_residues(s, p))


@query("Q2_conservation_correlation", "select avg(spearman) as value, stddev_pop(spearman) as std from cs", "act tok", d="value std", extra=CSP)
def _(s, p):
    return P.conservation_correlation(S.activations_vec(s, p), S.token_residues(s, p))


def mi_sql(src, keys):
    return f"""(select {keys}, i, j, sum(p*ln(p/(px*py+1e-10))) as mutual_info from (select {keys}, i, j, n::double/sum(n) over w as p,
 sum(n) over (partition by {keys}, i, j, bx)::double/sum(n) over w as px, sum(n) over (partition by {keys}, i, j, "by")::double/sum(n) over w as py from {src}
 window w as (partition by {keys}, i, j)) group by all)"""


@query("Q3_mutual_info", "select * from " + mi_sql("""(select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, a.code as bx, b.code as "by", count(*) as n
 from dg a join dg b on a.protein_id=b.protein_id and a.pos=b.pos and b.layer=a.layer+1 group by all)""", "la, lb"), "act", d="mutual_info", extra=DIGI)
def _(s, p):
    return P.binned_mutual_info(S.activations_vec(s, p))


@query("Q4_info_flow_median", "select la, avg(mi) as information_flow from (select la, lb, i, j, sum(p*ln(p/(px*py))) as mi from " +
       """(select la, lb, i, j, n::double/sum(n) over w as p, sum(n) over (partition by la, i, j, bx)::double/sum(n) over w as px,
 sum(n) over (partition by la, i, j, "by")::double/sum(n) over w as py from (select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, a.b as bx, b.b as "by", count(*) as n
 from md a join md b on a.protein_id=b.protein_id and a.pos=b.pos and b.layer=a.layer+1 group by all) window w as (partition by la, i, j)) group by all) group by la""",
       "act", d="information_flow", extra="""md as materialized (select protein_id, pos, layer, feature, value>m as b from act
 join (select layer, feature, quantile_cont(value,0.5) as m from act group by all) using (layer, feature))""")
def _(s, p):
    return P.info_flow_median(S.activations_vec(s, p))


@query("Q5_layer_flow_mi", "select la, lb, mutual_info as flow from " + mi_sql("""(select a.layer as la, b.layer as lb, 0 as i, 0 as j, a.c as bx, b.c as "by", count(*) as n
 from lc a join lc b on a.protein_id=b.protein_id and a.pos=b.pos and a.feature=b.feature and a.layer<>b.layer group by all)""", "la, lb"), "act", d="flow",
       extra="""lc as materialized (select protein_id, pos, layer, feature, least(9, floor((value-lo)/(hi-lo)*10)) as c from act
 join (select layer, min(value) as lo, max(value) as hi from act group by layer) using (layer))""")
def _(s, p):
    return P.layer_flow(S.activations_vec(s, p))


@query("Q5_layer_flow_corr", """select a.layer as la, b.layer as lb, abs(corr(a.value,b.value)) as flow
 from act a join act b on a.protein_id=b.protein_id and a.pos=b.pos and a.feature=b.feature and a.layer<>b.layer group by all""", "act", d="flow")
def _(s, p):
    return P.layer_flow(S.activations_vec(s, p), "correlation")


@query("W4_lagged", """select protein_id, layer, feature, pos, lag(value,1) over w as x, value as y from act qualify x is not null
 window w as (partition by protein_id, layer, feature order by pos)""".replace("qualify x is not null\n window w as (partition by protein_id, layer, feature order by pos)",
 "window w as (partition by protein_id, layer, feature order by pos) qualify lag(value,1) over w is not null"), "act", d="x y")
def _(s, p):
    from pyspark.sql import Window
    w = Window.partitionBy("protein_id", "layer", "feature").orderBy("pos")
    return S.activations(s, p).withColumn("x", F.lag("value").over(w)).filter("x is not null").withColumnRenamed("value", "y")


CAUSAL = f"""cz as materialized (select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, ({CORR}+1)/2 as causal_strength
 from act a join act b on a.protein_id=b.protein_id and b.pos=a.pos+1 and a.layer<=b.layer and (a.layer<b.layer or a.feature<b.feature) group by all)"""


@query("Q6_causal_strength", "select * from cz", "act", d="causal_strength", extra=CAUSAL)
def _(s, p):
    return P.causal_strength(S.activations_vec(s, p))


GR = """lg as materialized (select a.layer, l.lag, a.protein_id, a.pos, a.feature, b.value as p, a.value as v from act a join act b
 on a.protein_id=b.protein_id and a.layer=b.layer and a.feature=b.feature join range(1,4) l(lag) on b.pos=a.pos-l.lag),
fs as materialized (select layer, lag, feature, case when isnan(corr(p,v)) then 0 else corr(p,v) end as c1, sum(p*p) as yy, sum(v*v) as cc, sum(p*v) as yc, count(*) as n from lg group by all),
xs as materialized (select x.layer, x.lag, x.feature as i, y.feature as j, sum(x.p*y.p) as xy, sum(x.p*y.v) as xc from lg x join lg y
 on x.layer=y.layer and x.lag=y.lag and x.protein_id=y.protein_id and x.pos=y.pos and x.feature<>y.feature group by all),
g0 as (select xs.layer, xs.lag, i, j, xy, xc, fx.yy as xx, fy.yy as yy, fy.cc, fy.yc, fy.c1, fy.n, fy.yy*fx.yy-xy*xy as det from xs
 join fs fx on fx.layer=xs.layer and fx.lag=xs.lag and fx.feature=i join fs fy on fy.layer=xs.layer and fy.lag=xs.lag and fy.feature=j),
g1 as (select *, (cc-2*c1*yc+c1*c1*yy)/n as mse1, (cc - case when det>1e-9*yy*xx then (yc*xx-xc*xy)/det*yc+(xc*yy-yc*xy)/det*xc when yy>0 then yc/yy*yc else 0 end)/n as mse2 from g0)"""


@query("Q7_granger_f", "select layer, lag, i, j, case when mse2<mse1 and mse2>1e-12 then (mse1-mse2)/mse2*(n-2) end as f_stat, n-2 as dof from g1", "act",
       d="f_stat", i="dof", extra=GR)
def _(s, p):
    return P.granger_f(S.activations_vec(s, p))


@query("Q7_granger")
def _(s, p):
    return P.granger(S.activations_vec(s, p))


TE = """uc as materialized (select protein_id, pos, layer, feature, case when hi>lo then greatest(0, least(9, floor((value-lo)/(hi-lo)*10)))::int else 0 end as c from act
 join (select layer, feature, min(value) as lo, max(value) as hi from act group by all) using (layer, feature)),
ul as materialized (select a.layer, a.protein_id, a.pos, a.feature, b.c as was, a.c as now from uc a join uc b on a.protein_id=b.protein_id and a.layer=b.layer and a.feature=b.feature and b.pos=a.pos-1),
tc as materialized (select x.layer, x.feature as i, y.feature as j, x.was as x1, y.now as y, y.was as y1, count(*) as n from ul x join ul y
 on x.layer=y.layer and x.protein_id=y.protein_id and x.pos=y.pos and x.feature<>y.feature group by all)"""


@query("Q8_transfer_entropy", """select layer, i, j, greatest(0, sum(n::double/t*ln(n*y1n/(yy*xy)))) as transfer_entropy from (select layer, i, j, n,
 sum(n) over (partition by layer,i,j)::double as t, sum(n) over (partition by layer,i,j,y,y1)::double as yy, sum(n) over (partition by layer,i,j,x1,y1)::double as xy,
 sum(n) over (partition by layer,i,j,y1)::double as y1n from tc) group by all""", "act", d="transfer_entropy", extra=TE)
def _(s, p):
    return P.transfer_entropy(S.activations_vec(s, p))


@query("Q9_partial_corr")
def _(s, p):
    return P.partial_corr(P.covariances(S.activations_vec(s, p)))


PC1 = """(select layer, i, j, case when vx>1e-15 and vy>1e-15 then abs(xy/sqrt(vx*vy)) else 0 end as partial_corr from (select c.layer, c.i, c.j,
 c.cov-a.cov*b.cov/z.cov as xy, vi.cov-a.cov*a.cov/z.cov as vx, vj.cov-b.cov*b.cov/z.cov as vy from cv c join cv a on a.layer=c.layer and a.i=c.i and a.j=63
 join cv b on b.layer=c.layer and b.i=c.j and b.j=63 join cv z on z.layer=c.layer and z.i=63 and z.j=63 join cv vi on vi.layer=c.layer and vi.i=c.i and vi.j=c.i
 join cv vj on vj.layer=c.layer and vj.i=c.j and vj.j=c.j where c.i<>c.j and c.i<>63 and c.j<>63))"""


@query("Q9_partial_corr_one", f"select * from {PC1}", "act", d="partial_corr", extra=COV)
def _(s, p):
    return P.partial_corr(P.covariances(S.activations_vec(s, p)), zs=[63]).filter("i <> 63 and j <> 63")


@query("Q10_pairwise_causality")
def _(s, p):
    return P.pairwise_causality(S.activations_vec(s, p))


EDG = """ed0 as materialized (select la as layer, i as cause, j as effect, causal_strength as strength, causal_strength as confidence from cz where la=lb and causal_strength>0.54)"""
MED = """md as materialized (select layer, i as cause, j as effect, k as mediator, strength, confidence from (select q.*,
 abs(c-coalesce(case when vx*vy>0 then num/sqrt(vx*vy) end,0)) as strength from (select *, cij-b*cik-a*ckj+a*b*vk as num, vi-2*a*cik+a*a*vk as vx, vj-2*b*ckj+b*b*vk as vy from
 (select e1.layer, e1.cause as i, e2.effect as j, e1.effect as k, least(e1.strength,e2.strength) as confidence, ik.cov as cik, kj.cov as ckj, ij.cov as cij, vi.cov as vi, vj.cov as vj, vk.cov as vk,
  ik.cov/sqrt(vi.cov*vk.cov) as a, kj.cov/sqrt(vk.cov*vj.cov) as b, ij.cov/sqrt(vi.cov*vj.cov) as c
  from ed0 e1 join ed0 e2 on e1.layer=e2.layer and e1.effect=e2.cause and e1.cause<>e2.effect
  join cv ik on ik.layer=e1.layer and ik.i=e1.cause and ik.j=e1.effect join cv kj on kj.layer=e1.layer and kj.i=e1.effect and kj.j=e2.effect
  join cv ij on ij.layer=e1.layer and ij.i=e1.cause and ij.j=e2.effect join cv vi on vi.layer=e1.layer and vi.i=e1.cause and vi.j=e1.cause
  join cv vj on vj.layer=e1.layer and vj.i=e2.effect and vj.j=e2.effect join cv vk on vk.layer=e1.layer and vk.i=e1.effect and vk.j=e1.effect
  where not exists (select 1 from ed0 e where e.layer=e1.layer and e.cause=e1.cause and e.effect=e2.effect))) q) where strength>0.005)"""


def direct_edges(vec, thr=0.54):
    e = P.causal_strength(vec).filter(f"la = lb and causal_strength > {thr}")
    return e.select(F.col("la").alias("layer"), F.col("i").alias("cause"), F.col("j").alias("effect"), F.col("causal_strength").alias("strength"), F.col("causal_strength").alias("confidence"))


@query("Q11_mediation", "select * from md", "act", d="strength confidence", extra=",".join([COV, CAUSAL, EDG, MED]))
def _(s, p):
    vec = S.activations_vec(s, p)
    return P.mediation(direct_edges(vec), P.covariances(vec), 0.005)


@query("Q12_adjust_confounders", f"""select e.layer, e.cause, e.effect, partial_corr as strength, confidence*0.9 as confidence from ed0 e join {PC1} pc
 on pc.layer=e.layer and pc.i=e.cause and pc.j=e.effect where partial_corr>0.02 and cause<>63 and effect<>63""", "act", d="strength confidence", extra=",".join([COV, CAUSAL, EDG]))
def _(s, p):
    vec = S.activations_vec(s, p)
    return P.adjust_confounders(direct_edges(vec), P.covariances(vec), [63], 0.02)


TEMP = """tp as materialized (select la as layer, i as cause, j as effect, abs(c) as strength, 0.8::double as confidence from (select a.layer as la, a.feature as i, b.feature as j, corr(a.v,b.v) as c
 from pm a join pm b on a.pos=b.pos and b.layer=a.layer+1 group by all) where not isnan(c) and abs(c)>0.3)"""
PM = "pm as materialized (select layer, pos, feature, avg(value) as v from act group by all)"


@query("Q13_temporal_causality", "select *, 1 as lag from tp", "act", d="strength confidence", i="lag", extra=PM + "," + TEMP)
def _(s, p):
    return P.temporal_causality(S.activations_vec(s, p))


RELS = """rel as materialized (select layer, cause, effect, strength, confidence, 'direct' as mechanism, 0 as lag, '' as mediators from ed0 union all select layer, cause, effect, strength, confidence, 'mediated', 0, mediator::varchar from md
 union all select layer, cause, effect, strength, confidence, 'temporal', 1, '' from tp)"""
ALLREL = ",".join([COV, CAUSAL, EDG, MED, PM, TEMP, RELS])


def all_relations(vec):
    e = direct_edges(vec)
    return P.union_relations(direct=e, mediated=P.mediation(e, P.covariances(vec), 0.005), temporal=P.temporal_causality(vec))


@query("SO1_union_relations", "select * from rel", "act", d="strength confidence", i="lag", extra=ALLREL)
def _(s, p):
    return all_relations(S.activations_vec(s, p)).withColumn("mediators", F.array_join("mediators", ","))


@query("Q14_causality_summary", """select count(*) as n_relations, sum((mechanism='direct')::int) as n_direct, sum((mechanism='mediated')::int) as n_mediated,
 sum((mechanism='temporal')::int) as n_temporal, avg(strength) as avg_strength, avg(confidence) as avg_confidence from rel""", "act", d="avg_strength avg_confidence",
       i="n_direct n_mediated n_temporal", extra=ALLREL)
def _(s, p):
    return P.causality_summary(all_relations(S.activations_vec(s, p)))


GED = """ce as materialized (select layer, cause, effect, strength, confidence, mechanism from (select *, row_number() over (partition by layer, cause, effect order by
 case mechanism when 'mediated' then 2 when 'direct' then 1 else 0 end desc, round(strength,9) desc) as rn from rel) where rn=1)"""


@query("G16_causal_edges", "select layer, cause, effect, strength, mechanism from ce", "act", d="strength", extra=ALLREL + "," + GED)
def _(s, p):
    return P.causal_edges(all_relations(S.activations_vec(s, p))).drop("confidence")


@query("G16_causal_edges_confidence", "select layer, cause, effect, strength, confidence, mechanism from ce", "act", d="strength confidence", extra=ALLREL + "," + GED)
def _(s, p):
    return P.causal_edges(all_relations(S.activations_vec(s, p)))


for _side in ("cause", "effect"):
    @query(f"T7_top_{_side}s", f"select {_side} as feature, sum(strength) as degree from ce group by all order by degree desc, feature limit 5", "act", d="degree", extra=ALLREL + "," + GED)
    def _(s, p, side=_side):
        return P.top_causes(P.causal_edges(all_relations(S.activations_vec(s, p))), 5, side)


MATCH = {
    "cosine": "sum(a.v*b.v)/(sqrt(sum(a.v*a.v))*sqrt(sum(b.v*b.v)))", "correlation": "corr(a.v,b.v)", "l2": "-sqrt(sum((a.v-b.v)*(a.v-b.v)))"}
EMB = """da as materialized (select vec_id as id, d.k, embedding[d.k+1]::double as v from embeddings, range(64) d(k)),
db as materialized (select label::bigint as id, d.k, avg(embedding[d.k+1]::double) as v from embeddings, range(64) d(k) group by all)"""


def dictionaries(s, p):
    e = S.table(s, p, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    m = e.select(F.col("label").cast("long").alias("id"), F.posexplode("embedding").alias("k", "v")).groupBy("id", "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    b = m.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x.v).alias("vec"))
    return a, b


for _m, _sql in MATCH.items():
    @query(f"J11_match_{_m}", f"""select id, max_by("match", score) as "match", max(score) as score from (select a.id, b.id as "match", {_sql} as score from da a join db b using (k) group by all) group by id""",
           d="score", extra=EMB)
    def _(s, p, metric=_m):
        return P.match_dictionaries(*dictionaries(s, p), metric)


@query("T8_match_summary", f"""select avg(score) as mean, min(score) as min, max(score) as max from (select id, max(score) as score from (select a.id, b.id as "match", {MATCH['cosine']} as score
 from da a join db b using (k) group by all) group by id)""", d="mean min max", extra=EMB)
def _(s, p):
    return P.match_summary(P.match_dictionaries(*dictionaries(s, p)))


@query("Q40_bootstrap_ci")
def _(s, p):
    return P.bootstrap_ci(S.activations(s, p).withColumn("id", F.concat_ws("-", "protein_id", "pos", "layer", "feature")), "id", "value")
