"""Queries: activation statistics, interpretability components and layer evolution."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evolution as E
from ..sources import views as S
from .registry import query

ADJ = """adj as materialized (select a.protein_id, a.pos, a.layer, a.feature, a.value, b.value as next_value
 from act a join act b on a.protein_id=b.protein_id and a.pos=b.pos and a.feature=b.feature and b.layer=a.layer+1)"""
STATE = """st as materialized (select protein_id, layer, feature, avg(abs(value)) as magnitude,
 avg(case when abs(value)>0.1 then 1.0::double else 0 end) as frequency from act group by all having max(abs(value))>0.1)"""
TRANS = ADJ + """, tr0 as (select protein_id, layer, feature, max(abs(value))>0.1 as s_on, max(abs(next_value))>0.1 as d_on,
 avg(abs(value)) as src, avg(abs(next_value)) as dst, case when isnan(corr(value,next_value)) then 0 else corr(value,next_value) end as correlation from adj group by all),
tr as materialized (select protein_id, feature, layer as source_layer, layer+1 as target_layer, dst-src as magnitude_change, correlation,
 case when not s_on and d_on then 'emerged' when s_on and not d_on then 'vanished'
  when correlation>0.7 then case when dst>src*1.2 then 'amplified' when dst<src*0.8 then 'diminished' else 'preserved' end
  else 'transformed' end as transformation_type from tr0 where s_on or d_on)"""
XADJ = """tm as materialized (select a.layer as la, a.feature as i, b.feature as j, count(*) as n, sum(a.value*b.value) as sxy,
 sum(a.value*a.value) as sxx, sum(b.value*b.value) as syy, case when not isnan(corr(a.value,b.value)) then corr(a.value,b.value) end as corr
 from act a join act b on a.protein_id=b.protein_id and a.pos=b.pos and b.layer=a.layer+1 group by all)"""
ON = "avg(case when abs(value)>0.1 then 1.0::double else 0 end)"


@query("A1_feature_stats", f"select feature, {ON} as frequency, avg(abs(value)) as mean_abs, stddev_samp(value) as std from act group by feature",
       "act", d="frequency mean_abs std")
def _(s, p):
    return A.feature_stats(S.activations(s, p))


@query("A2_layer_stats", f"select layer, {ON} as active_frac, avg(abs(value)) as mean_abs, max(abs(value)) as max_abs from act group by layer",
       "act", d="active_frac mean_abs max_abs")
def _(s, p):
    return A.layer_stats(S.activations(s, p))


@query("A3_describe", """select layer, avg(value) as mean, stddev_samp(value) as std, min(value) as min, max(value) as max,
 avg(abs(value)) as l1_mean, sqrt(sum(value*value)) as l2_norm, avg(case when abs(value)>0.01 then 1.0::double else 0 end) as active_frac_001,
 quantile_cont(value,0.25) as p25, quantile_cont(value,0.5) as p50, quantile_cont(value,0.75) as p75, quantile_cont(value,0.9) as p90,
 quantile_cont(value,0.95) as p95, quantile_cont(value,0.99) as p99 from act group by layer""", "act",
       d="mean std min max l1_mean l2_norm active_frac_001 p25 p50 p75 p90 p95 p99")
def _(s, p):
    return A.describe(S.activations(s, p), ["layer"])


@query("A4_layer_state", "select * from st", "act", d="magnitude frequency", extra=STATE)
def _(s, p):
    return A.layer_state(S.activations(s, p))


@query("A4_layer_totals", """select protein_id, layer, sum(s) as total_activation, sum(case when o then 1 else 0 end) as n_active,
 avg(case when o then 1.0::double else 0 end) as active_feature_frac from (select protein_id, layer, feature, sum(abs(value)) as s,
 max(abs(value))>0.1 as o from act group by all) group by all""", "act", d="total_activation active_feature_frac", i="n_active")
def _(s, p):
    return A.layer_totals(S.activations(s, p))


SEQ = """select protein_id, max(pos)+1 as length, avg(value) as mean, stddev_pop(value) as std,
 avg(case when abs(value)<0.01 then 1.0::double else 0 end) as inactive_frac_001 from act group by protein_id"""


@query("A5_sequence_stats", SEQ, "act", d="mean std inactive_frac_001")
def _(s, p):
    return A.sequence_stats(S.activations_vec(s, p))


@query("A5_sequence_averages", f"""select count(*) as n_sequences, avg(length) as avg_length, avg(mean) as avg_mean, avg(std) as avg_std,
 avg(inactive_frac_001) as avg_inactive from ({SEQ})""", "act", d="avg_length avg_mean avg_std avg_inactive")
def _(s, p):
    return A.sequence_averages(A.sequence_stats(S.activations_vec(s, p)))


@query("A6_feature_importance", "select layer, feature, avg(abs(value)) as importance from act group by all", "act", d="importance")
def _(s, p):
    return A.feature_importance(S.activations(s, p))


MAG = """mag as (select layer, avg(nrm) as magnitude, avg(sd) as diversity from (select layer, protein_id, pos, sqrt(sum(value*value)) as nrm,
 stddev_samp(value) as sd from act group by all) group by layer)"""


@query("A7_layer_magnitude", "select * from mag", "act", d="magnitude diversity", extra=MAG)
def _(s, p):
    return A.layer_magnitude(S.activations_vec(s, p))


@query("A8_node_stats", "select layer, feature, avg(value) as activation_mean, stddev_samp(value) as activation_std from act group by all",
       "act", d="activation_mean activation_std")
def _(s, p):
    return A.node_stats(S.activations(s, p))


COACT = """onn as materialized (select protein_id, pos, layer, feature from act where abs(value)>0.1),
nt as (select count(*)/64 as n from act), fs as (select f from range(64) r(f)),
co0 as (select a.feature as i, b.feature as j, count(*) as k from onn a join onn b using (protein_id,pos,layer) group by all),
co as materialized (select x.f as i, y.f as j, coalesce(k,0)::double/n as p from fs x cross join fs y cross join nt left join co0 on co0.i=x.f and co0.j=y.f)"""
PURITY = """select greatest(0, least(1, d/(o+1e-8))) as concept_purity from (select avg(case when i=j then p end) as d,
 avg(case when i=j then 0 else p end) as o from co)"""


@query("A9_coactivation", "select * from co", "act", d="p", extra=COACT)
def _(s, p):
    return A.coactivation(S.activations_vec(s, p))


@query("A9_concept_purity", PURITY, "act", d="concept_purity", extra=COACT)
def _(s, p):
    return A.concept_purity(A.coactivation(S.activations_vec(s, p)))


@query("A10_dead_features", "select layer, feature, max(abs(value)) as max_abs from act group by all having max(abs(value))<=0.25 and count(*)>=10",
       "act", d="max_abs")
def _(s, p):
    return A.dead_features(S.activations(s, p), 0.25, 10, ("layer", "feature"))


@query("A10_dead_ratio", "select avg(case when m<0.01 then 1.0::double else 0 end) as dead_ratio from (select max(abs(value)) as m from act group by feature)",
       "act", d="dead_ratio")
def _(s, p):
    return A.dead_ratio(S.activations(s, p))


@query("A11_sparsity_metrics", f"""select (select avg(case when abs(value)>0.01 then 1.0::double else 0 end) from act) as l0_sparsity,
 (select avg(abs(value)) from act) as l1_sparsity, avg(f) as freq_mean, stddev_samp(f) as freq_std from (select feature, {ON} as f from act group by feature)""",
       "act", d="l0_sparsity l1_sparsity freq_mean freq_std")
def _(s, p):
    return A.sparsity_metrics(S.activations(s, p))


@query("A12_feature_entropy", """select -sum(p*ln(p+1e-8)) as feature_entropy from (select e/sum(e) over (partition by pos) as p
 from (select pos, feature, exp(avg(abs(value))) as e from act group by all))""", "act", d="feature_entropy")
def _(s, p):
    return A.feature_entropy(S.activations(s, p))


@query("A13_reconstruction_metrics", """select avg((o-r)*(o-r)) as mse, avg(abs(o-r)) as mae, (select avg(ne) from t) as normalized_error,
 (select stddev_samp(ne) from t) as normalized_error_std, (select avg(c) from t) as cosine_similarity,
 1-var_samp(o-r)/var_samp(o) as variance_explained, 1-sum((o-r)*(o-r))/(var_samp(o)*(count(*)-1)) as r2 from pr""", "act",
       d="mse mae normalized_error normalized_error_std cosine_similarity variance_explained r2",
       extra="""pr as materialized (select a.protein_id, a.pos, a.feature, a.value as o, b.value as r from act a join act b
 on a.protein_id=b.protein_id and a.pos=b.pos and a.feature=b.feature and a.layer=0 and b.layer=1),
t as (select sqrt(sum((o-r)*(o-r)))/(sqrt(sum(o*o))+1e-8) as ne, sum(o*r)/(sqrt(sum(o*o))*sqrt(sum(r*r))) as c from pr group by protein_id, pos)""")
def _(s, p):
    v = S.activations_vec(s, p)
    return A.reconstruction_metrics(v.filter("layer = 0"), v.filter("layer = 1"), ("protein_id", "pos"))


@query("A14_activation_rate", f"select layer, feature, {ON} as activation_rate from act group by all", "act", d="activation_rate")
def _(s, p):
    return A.activation_rate(S.activations(s, p))


@query("A19_accumulate", """select layer, feature, sum(case when abs(value)>0.1 then 1 else 0 end) as activation_count,
 sum(abs(value)) as magnitude_sum, count(*) as samples from act group by all""", "act", d="magnitude_sum", i="activation_count")
def _(s, p):
    return A.accumulate(S.activations(s, p))


@query("A20_pool_mean", "select protein_id, layer, feature, avg(value) as pooled from act group by all", "act", d="pooled")
def _(s, p):
    return A.pool(S.activations(s, p))


@query("A20_pool_max", "select protein_id, layer, feature, max(value) as pooled from act group by all", "act", d="pooled")
def _(s, p):
    return A.pool(S.activations(s, p), "max")


@query("A20_pool_regions", """select a.protein_id, domain_id, layer, feature, avg(value) as pooled from act a join tdom d
 on a.protein_id=d.protein_id and pos>="start" and pos<"end" group by all""", "act tdom", d="pooled")
def _(s, p):
    return A.pool_regions(S.activations(s, p), S.token_domains(s, p))


@query("A50_trajectories", "select protein_id, layer, feature, avg(value) as mean, stddev_pop(value) as std from act group by all", "act", d="mean std")
def _(s, p):
    return A.trajectories(S.activations(s, p))


@query("A50_position_profile", "select pos, feature, avg(value) as mean_value from act group by all", "act", d="mean_value")
def _(s, p):
    return A.position_profile(S.activations(s, p))


@query("A51_mean_metrics", "select epoch, metric, avg(value) as mean_value, count(*) as n from log group by all", "log", d="mean_value")
def _(s, p):
    return A.mean_metrics(S.metric_log(s, p))


@query("T1_top_features", f"""select feature, frequency, mean_abs, std, frequency*mean_abs as score from (select feature, {ON} as frequency,
 avg(abs(value)) as mean_abs, stddev_samp(value) as std from act group by feature) order by score desc, feature limit 10""", "act",
       d="frequency mean_abs std score")
def _(s, p):
    return A.top_features(A.feature_stats(S.activations(s, p)), 10)


@query("T4_top_active", """select *, row_number() over (partition by protein_id, layer order by magnitude desc, feature) as "rank" from st
 qualify "rank" <= 10""", "act", d="magnitude frequency", extra=STATE)
def _(s, p):
    return A.top_active(A.layer_state(S.activations(s, p)))


@query("J2_adjacent_layers", "select * from adj", "act", d="value next_value", extra=ADJ)
def _(s, p):
    return E.adjacent_layers(S.activations_vec(s, p))


@query("J12_emerged", "select st.* from st where layer>0 and not exists (select 1 from st b where b.protein_id=st.protein_id and b.feature=st.feature and b.layer=st.layer-1)",
       "act", d="magnitude frequency", extra=STATE)
def _(s, p):
    return E.emerged(A.layer_state(S.activations(s, p)))


@query("J12_preserved", "select st.* from st where exists (select 1 from st b where b.protein_id=st.protein_id and b.feature=st.feature and b.layer=st.layer-1)",
       "act", d="magnitude frequency", extra=STATE)
def _(s, p):
    return E.preserved(A.layer_state(S.activations(s, p)))


@query("J12_vanished", "select st.* from st where layer<3 and not exists (select 1 from st b where b.protein_id=st.protein_id and b.feature=st.feature and b.layer=st.layer+1)",
       "act", d="magnitude frequency", extra=STATE)
def _(s, p):
    return E.vanished(A.layer_state(S.activations(s, p)))


@query("SO6_active_intersect", "select protein_id, layer, feature from st where layer>0 intersect select protein_id, layer+1, feature from st", "act", extra=STATE)
def _(s, p):
    return E.active_set_ops(A.layer_state(S.activations(s, p)), "intersect")


@query("SO6_active_except", "select protein_id, layer, feature from st where layer>0 except all select protein_id, layer+1, feature from st", "act", extra=STATE)
def _(s, p):
    return E.active_set_ops(A.layer_state(S.activations(s, p)), "except")


SUMMARY = """summ as (select a.protein_id, a.layer, cur-kept as n_emerged, kept, (cur-kept)::double/greatest(cur,1) as emergence_rate,
 kept::double/greatest(coalesce(prev,0),1) as preservation_rate from
 (select s.protein_id, s.layer, count(*) as cur, count(b.feature) as kept from st s left join st b on b.protein_id=s.protein_id and b.feature=s.feature and b.layer=s.layer-1 group by all) a
 left join (select protein_id, layer+1 as layer, count(*) as prev from st group by all) q on a.protein_id=q.protein_id and a.layer=q.layer where a.layer>0)"""


@query("A16_layer_summary", "select * from summ", "act", d="emergence_rate preservation_rate", extra=STATE + "," + SUMMARY)
def _(s, p):
    return E.layer_summary(A.layer_state(S.activations(s, p)))


@query("SO3_layer_jaccard", """select g.protein_id, g.la, g.lb, coalesce(k,0)::double/(na+nb-coalesce(k,0)) as jaccard from
 (select a.protein_id, a.layer as la, b.layer as lb, a.n as na, b.n as nb from (select protein_id, layer, count(*) as n from st group by all) a
  join (select protein_id, layer, count(*) as n from st group by all) b on a.protein_id=b.protein_id and a.layer<b.layer) g
 left join (select a.protein_id, a.layer as la, b.layer as lb, count(*) as k from st a join st b on a.protein_id=b.protein_id and a.feature=b.feature and a.layer<b.layer group by all) c
 on g.protein_id=c.protein_id and g.la=c.la and g.lb=c.lb""", "act", d="jaccard", extra=STATE)
def _(s, p):
    return E.layer_jaccard(A.layer_state(S.activations(s, p)))


EMERG = """em as (select layer, feature, delta, case when delta>0 then 'emerging' else 'decaying' end as pattern from (select layer, feature,
 importance-lag(importance) over (partition by feature order by layer) as delta from (select layer, feature, avg(abs(value)) as importance from act group by all))
 where abs(delta)>0.03)"""


@query("W1_emergence", "select * from em", "act", d="delta", extra=EMERG)
def _(s, p):
    return E.emergence(A.feature_importance(S.activations(s, p)), 0.03)


SIM = """sim as (select layer as la, layer+1 as lb, avg(c) as similarity from (select layer, protein_id, pos,
 sum(value*next_value)/(sqrt(sum(value*value))*sqrt(sum(next_value*next_value))) as c from adj group by all) group by all),
resid as (select lb, avg(c) as residual_strength from (select b.layer as lb, a.protein_id, a.pos, sum(a.value*b.value)/(sqrt(sum(a.value*a.value))*sqrt(sum(b.value*b.value))) as c
 from act a join act b on a.protein_id=b.protein_id and a.pos=b.pos and a.feature=b.feature and a.layer=0 and b.layer>0 group by all) group by lb)"""


@query("Q15_layer_similarity", "select * from sim", "act", d="similarity", extra=ADJ + "," + SIM)
def _(s, p):
    return E.layer_similarity(S.activations_vec(s, p))


@query("Q15_residual_strength", "select * from resid", "act", d="residual_strength", extra=ADJ + "," + SIM)
def _(s, p):
    return E.residual_strength(S.activations_vec(s, p))


TMC = "select la, la+1 as lb, i, j, sxy/(greatest(sqrt(sxx),1e-12)*greatest(sqrt(syy),1e-12)) as weight from tm"


@query("Q16_transition_cosine", TMC, "act", d="weight", extra=XADJ)
def _(s, p):
    return E.transition_matrix(S.activations_vec(s, p))


@query("Q16_transition_moment", "select la, la+1 as lb, i, j, sxy/n as weight from tm", "act", d="weight", extra=XADJ)
def _(s, p):
    return E.transition_matrix(S.activations_vec(s, p), "moment")


@query("Q16_transition_mean_cosine", """select a.layer as la, b.layer as lb, a.feature as i, b.feature as j,
 sum(a.v*b.v)/(greatest(sqrt(sum(a.v*a.v)),1e-12)*greatest(sqrt(sum(b.v*b.v)),1e-12)) as weight from pm a join pm b on a.pos=b.pos and b.layer=a.layer+1 group by all""", "act", d="weight",
       extra="pm as materialized (select layer, pos, feature, avg(value) as v from act group by all)")
def _(s, p):
    return E.transition_matrix(S.activations_vec(s, p), "mean_cosine")


@query("Q17_transition_entropy", """select la, i as feature, -sum(p*ln(p+1e-8)) as entropy from (select la, i, exp(abs(w))/sum(exp(abs(w))) over (partition by la, i) as p
 from (select la, i, j, sxy/n as w from tm)) group by all""", "act", d="entropy", extra=XADJ)
def _(s, p):
    return E.transition_entropy(E.transition_matrix(S.activations_vec(s, p), "moment"))


TRF = """select la, 'preserved' as kind, i as feature, 1::bigint as partners from tc where i=j and weight>0.8
union all select la, 'split', i, count(*) from tc where weight>0.5 group by all having count(*)>1
union all select la, 'merged', j, count(*) from tc where weight>0.5 group by all having count(*)>1"""


@query("Q18_transformations", TRF, "act", extra=XADJ + f", tc as ({TMC})")
def _(s, p):
    return E.transformations(E.transition_matrix(S.activations_vec(s, p)))


@query("Q19_stable_features", "select feature, min(c) as min_corr from (select layer, feature, corr(value,next_value) as c from adj group by all) group by feature having min(c)>=0.8",
       "act", d="min_corr", extra=ADJ)
def _(s, p):
    return E.stable_features(S.activations_vec(s, p))


@query("Q19_stable_by_moment", "select i as feature, min(sxy/n) as min_moment from tm where i=j group by i having min(sxy/n)>0.005", "act", d="min_moment", extra=XADJ)
def _(s, p):
    return E.stable_by_moment(E.transition_matrix(S.activations_vec(s, p), "moment"), 0.005)


@query("Q20_classify_transitions", "select * from tr", "act", d="magnitude_change correlation", extra=TRANS)
def _(s, p):
    return E.classify_transitions(S.activations_vec(s, p))


@query("A15_transition_counts", "select transformation_type, count(*) as n from tr group by all", "act", extra=TRANS)
def _(s, p):
    return E.transition_counts(E.classify_transitions(S.activations_vec(s, p)))


@query("T2_critical_transitions", """select *, abs(magnitude_change) as abs_change from tr order by abs_change desc, protein_id, source_layer, feature limit 10""",
       "act", d="magnitude_change correlation abs_change", extra=TRANS)
def _(s, p):
    return E.critical_transitions(E.classify_transitions(S.activations_vec(s, p)))


RANKSQL = {
    "persistence": "select feature, count(distinct layer)/4.0::double as score from st group by feature",
    "magnitude": "select feature, max(magnitude) as score from st group by feature",
    "emergence": "select feature, 1-min(layer)/4.0::double as score from st group by feature",
    "influence": "select feature, sum(abs(correlation)) as score from tr where transformation_type in ('amplified','preserved') group by feature",
}
for _crit, _sql in RANKSQL.items():
    @query(f"T3_rank_{_crit}", _sql, "act", d="score", extra=STATE + "," + TRANS)
    def _(s, p, crit=_crit):
        act = S.activations(s, p)
        return E.rank_features(A.layer_state(act), E.classify_transitions(S.activations_vec(s, p)), crit, 4)


@query("Q21_evolution_by_position", """select layer, pos, avg(c) as stability, avg((b-a)/64.0::double) as emergence, avg((a-b)/64.0::double) as decay from
 (select layer, pos, protein_id, sum(value*next_value)/(sqrt(sum(value*value))*sqrt(sum(next_value*next_value))) as c,
  sum(case when value>0.1 then 1 else 0 end) as a, sum(case when next_value>0.1 then 1 else 0 end) as b from adj group by all) group by all""",
       "act", d="stability emergence decay", extra=ADJ)
def _(s, p):
    return E.evolution_by_position(S.activations_vec(s, p))


@query("Q22_feature_lineage", f"""select a.feature, a.layer, {ON.replace('value', 'a.value')} as activation_rate, avg(abs(a.value)) as magnitude,
 case when isnan(corr(z.value,a.value)) then 0 else corr(z.value,a.value) end as corr_first, avg(abs(a.value-q.value)) as contribution from act a
 join act z on z.protein_id=a.protein_id and z.pos=a.pos and z.feature=a.feature and z.layer=0
 left join act q on q.protein_id=a.protein_id and q.pos=a.pos and q.feature=a.feature and q.layer=a.layer-1 group by all""", "act",
       d="activation_rate magnitude corr_first contribution")
def _(s, p):
    return E.feature_lineage(S.activations(s, p))


@query("G14_lineages", """select protein_id, feature, max(len) as length from lin group by all having max(len)>1""", "act", i="length",
       extra=STATE + "," + TRANS + """, lin as (select protein_id, feature, 1 as len from st where layer=0 union all
 select l.protein_id, l.feature, l.len+1 from lin l join tr t on t.protein_id=l.protein_id and t.feature=l.feature and t.source_layer=l.len-1 and t.correlation>0.7
 join st on st.protein_id=l.protein_id and st.feature=l.feature and st.layer=l.len)""")
def _(s, p):
    act = S.activations(s, p)
    return E.lineages(E.classify_transitions(S.activations_vec(s, p)), A.layer_state(act), 4)


@query("Q23_monosemanticity", f"""select avg(1-(-p*ln(p)-(1-p)*ln(1-p))/ln(2)) as monosemanticity from (select {ON} as p, max(abs(value)) as m from act group by feature)
 where m>=0.01 and p>0 and p<1""", "act", d="monosemanticity")
def _(s, p):
    return A.monosemanticity(S.activations(s, p))


COS = """cs as materialized (select a.feature as i, b.feature as j, sum(a.value*b.value)/(sqrt(sum(a.value*a.value))*sqrt(sum(b.value*b.value))) as cos
 from act a join act b using (protein_id, pos, layer) where a.feature<b.feature group by all)"""


@query("Q24_orthogonality", "select 1-avg(abs(cos)) as orthogonality from cs", "act", d="orthogonality", extra=COS)
def _(s, p):
    return A.orthogonality(A.feature_cosines(S.activations_vec(s, p)))


CONS = """(select 1/(1+avg(r)) from (select var_samp(value)/(avg(abs(value))+1e-8) as r from act group by layer, pos, feature))"""


@query("Q25_consistency", f"select {CONS} as consistency", "act", d="consistency")
def _(s, p):
    return A.consistency(S.activations(s, p))


@query("Q25_coverage", f"select {ON} as coverage from act", "act", d="coverage")
def _(s, p):
    return A.coverage(S.activations(s, p))


@query("Q26_human_alignment", """select greatest(0, least(1, (avg(case when i%8=j%8 then cos end)-avg(case when i%8<>j%8 then cos end)+1)/2)) as human_alignment from cs""",
       "act", d="human_alignment", extra=COS)
def _(s, p):
    vec = S.activations_vec(s, p)
    cs = A.feature_cosines(vec)
    groups = cs.select(F.col("i").alias("feature")).distinct().withColumn("label", F.col("feature") % 8)
    return A.human_alignment(cs, groups)


@query("Q27_interpretability_score", f"""select name, value from c union all select 'interpretability', avg(value) from c""", "act", d="value",
       extra=COACT + "," + COS + f""", c as (select 'monosemanticity' as name, (select avg(1-(-p*ln(p)-(1-p)*ln(1-p))/ln(2)) from (select {ON} as p, max(abs(value)) as m from act group by feature)
 where m>=0.01 and p>0 and p<1) as value union all select 'orthogonality', (select 1-avg(abs(cos)) from cs) union all select 'consistency', {CONS}
 union all select 'coverage', (select {ON} from act) union all select 'concept_purity', ({PURITY}))""")
def _(s, p):
    vec, act = S.activations_vec(s, p), S.activations(s, p)
    return A.interpretability_score(vec, act, A.coactivation(vec), A.feature_cosines(vec))


@query("Q28_layer_coherence", "select layer as la, corr(value, next_value) as coherence from adj group by layer", "act", d="coherence", extra=ADJ)
def _(s, p):
    return E.layer_coherence(S.activations_vec(s, p))


@query("Q28_best_cosine", """select layer, -avg(best) as coherence_loss from (select layer, protein_id, pos, max(c) as best from
 (select a.layer, a.protein_id, a.pos, b.pos as pb, sum(a.value*b.value)/(sqrt(sum(a.value*a.value))*sqrt(sum(b.value*b.value))) as c
 from act a join act b on a.protein_id=b.protein_id and b.layer=a.layer+1 and a.feature=b.feature group by all) group by all) group by layer""", "act", d="coherence_loss")
def _(s, p):
    return E.best_cosine_coherence(S.activations_vec(s, p))


@query("T6_top_connections", f"""select la, lb, i, j, weight, row_number() over (partition by la order by round(abs(weight),9) desc, i, j) as "rank" from ({TMC}) qualify "rank"<=20""",
       "act", d="weight", extra=XADJ)
def _(s, p):
    return E.top_connections(E.transition_matrix(S.activations_vec(s, p)))


@query("Q41_flow_links", "select la, i, j, abs(corr) as weight from tm where abs(corr)>0.3", "act", d="weight", extra=XADJ)
def _(s, p):
    return E.flow_links(S.activations_vec(s, p))


@query("C1_evolution_report", """select m.layer, magnitude, diversity, similarity, residual_strength, coalesce(ne,0) as n_emerging, coalesce(nd,0) as n_decaying
 from mag m left join sim on sim.la=m.layer left join resid on resid.lb=m.layer left join (select layer, sum(case when pattern='emerging' then 1 else 0 end) as ne,
 sum(case when pattern='decaying' then 1 else 0 end) as nd from em group by layer) e on e.layer=m.layer""", "act",
       d="magnitude diversity similarity residual_strength", i="n_emerging n_decaying", extra=",".join([ADJ, SIM, MAG, EMERG]))
def _(s, p):
    return E.evolution_report(S.activations_vec(s, p), S.activations(s, p), 0.03)


@query("C3_layer_tracker", "select s.*, " + ", ".join(f"(select count(*) from tr where target_layer=s.layer and transformation_type='{k}') as {k}" for k in
       ("emerged", "vanished", "amplified", "diminished", "preserved", "transformed")) +
       " from (select layer, avg(emergence_rate) as emergence_rate, avg(preservation_rate) as preservation_rate from summ group by layer) s", "act",
       d="emergence_rate preservation_rate", extra=",".join([STATE, SUMMARY, TRANS]))
def _(s, p):
    return E.tracker_report(S.activations_vec(s, p))


@query("Q29_kurtosis_score", """select layer, feature, kurtosis_pop(value) as kurtosis, case when kurtosis_pop(value)>3 then least(kurtosis_pop(value)/10,1) else 0 end as heavy_tail_score
 from act group by all""", "act", d="kurtosis heavy_tail_score")
def _(s, p):
    return A.kurtosis_score(S.activations(s, p))


SPEC = """(select a.layer, a.feature, least(1, va/(vb+1e-8)) as specificity from (select layer, feature, avg(v) as va from (select layer, feature, pos, var_samp(value) as v from act group by all) group by all) a
 join (select layer, feature, avg(v) as vb from (select layer, feature, protein_id, var_samp(value) as v from act group by all) group by all) b on a.layer=b.layer and a.feature=b.feature)"""


@query("Q31_positional_specificity", f"select * from {SPEC}", "act", d="specificity")
def _(s, p):
    return A.positional_specificity(S.activations(s, p))


COENT = """(select i as feature, least(1, -sum(q*ln(q+1e-10))/ln(count(*)+1)) as score, count(*) as partners from (select c.i, c.p/d.p as q from co c join co d on d.i=c.i and d.j=c.i where c.i<>c.j)
 where q>0.1 and q<0.9 group by i)"""


@query("Q32_coactivation_entropy", f"select * from {COENT}", "act", d="score", extra=COACT)
def _(s, p):
    return A.coactivation_entropy(A.coactivation(S.activations_vec(s, p)))


ACONS = """(select layer, feature, avg(c) as conservation from (select layer, feature, pos, 1-stddev_samp(value)/(avg(abs(value))+1e-10) as c from act group by all) group by all)"""


@query("Q34_activation_conservation", f"select * from {ACONS}", "act", d="conservation")
def _(s, p):
    return A.activation_conservation(S.activations(s, p))
