"""Queries: interaction graph, motifs, validation, graph algorithms."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import circuits as C
from ..operators import graph as G
from ..operators.gram import cross_moments, lag_pairs, pair_moments, with_corr
from ..session import cut_lineage
from ..sources import views as S
from .q_pairs import CAUSAL, DIGI, mi_sql
from .registry import ORACLES, QUERIES, query

THR = 0.55
#: Circuits are sought among stronger edges: at 0.55 the derived data has some three million connected sets of eight nodes.
STRONG = 0.565
ED = f"""ge as materialized (select la*1000000+i as src, lb*1000000+j as dst, causal_strength as weight from cz where causal_strength>{THR} and (la<>lb or i<>j))"""
NB = "nb as materialized (select src as nd, dst as nb from ge union select dst, src from ge)"
SETS = """cs as (select [nd, nb] as nodes from nb where nd<nb union select list_sort(list_append(q.nodes, nb.nb)) from (select nodes, unnest(nodes) as nd from cs where len(nodes)<8) q join nb on nb.nd=q.nd where not list_contains(q.nodes, nb.nb)),
alls as materialized (select distinct nodes from cs where len(nodes)>=3),
cell as (select nodes, len(nodes) as size, r.k, nodes[(r.k//len(nodes))+1] as src, nodes[(r.k%len(nodes))+1] as dst from alls, range(64) r(k) where r.k<len(nodes)*len(nodes)),
mi0 as materialized (select nodes, size, string_agg(case when ge.src is null then '0' else '1' end, '' order by k) as structure, count(ge.src) as n_edges, sum(ge.weight) as weight_sum
 from cell left join ge on ge.src=cell.src and ge.dst=cell.dst group by nodes, size),
circ as materialized (select structure, size, count(*) as frequency, sum(weight_sum)/sum(n_edges) as avg_weight, count(*)*0.4::double+sum(weight_sum)/sum(n_edges)*0.6::double as importance
 from mi0 group by structure, size having count(*)>=2),
inst as materialized (select m.structure, m.size, m.nodes from mi0 m join circ using (structure)),
nm as (select nodes, string_agg('L'||(n//1000000)||'_F'||(n%1000000), ',' order by n) as instance from (select nodes, unnest(nodes) as n from alls) group by nodes),
cn as materialized (select structure, instance, size, n as node, (n//1000000) as layer, n%1000000 as feature from (select inst.structure, nm.instance, inst.size, unnest(inst.nodes) as n from inst join nm on nm.nodes=inst.nodes))"""
BASE = ",".join([CAUSAL, ED.replace(str(THR), str(STRONG)), NB, SETS])


def edges_of(s, p):
    return C.causal_strength(S.activations_vec(s, p)).filter(F.col("causal_strength") > THR).select(
        C.node_key("la", "i").alias("src"), C.node_key("lb", "j").alias("dst"), F.col("causal_strength").alias("weight")).filter("src <> dst")


def motifs_of(s, p):
    """Circuits of 3 to 8 nodes and their instances."""
    return C.find_motifs(edges_of(s, p).filter(F.col("weight") > STRONG))


@query("J3_feature_pairs", """select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, count(*) as n, sum(a.value*b.value) as sxy from act a join act b
 on a.protein_id=b.protein_id and a.pos=b.pos and (a.layer<b.layer or (a.layer=b.layer and a.feature<b.feature)) group by all""", "act", d="sxy", i="n")
def _(s, p):
    return pair_moments(S.activations_vec(s, p), "upper").select("la", "lb", "i", "j", F.col("n").cast("long").alias("n"), "sxy")


@query("G1_interaction_graph", f"""select ge.src, ge.dst, ge.weight, c.corr as correlation, m.mutual_info from ge join (select a.layer*1000000+a.feature as src, b.layer*1000000+b.feature as dst,
 case when not isnan(corr(a.value,b.value)) then corr(a.value,b.value) end as corr from act a join act b on a.protein_id=b.protein_id and a.pos=b.pos and a.layer<=b.layer group by all) c using (src,dst)
 join {mi_sql('''(select 0 as z, src as i, dst as j, a.code as bx, b.code as "by", count(*) as n from ge join dg a on a.layer*1000000+a.feature=ge.src join dg b on b.layer*1000000+b.feature=ge.dst
 and b.protein_id=a.protein_id and b.pos=a.pos group by all)''', 'z')} m on m.i=ge.src and m.j=ge.dst""", "act", d="weight correlation mutual_info", extra=",".join([CAUSAL, ED, DIGI]))
def _(s, p):
    return C.interaction_graph(S.activations_vec(s, p), THR)[1]


@query("P17_node_ids", "select layer, feature, 'L'||layer||'_F'||feature as node, layer as parsed_layer, feature as parsed_feature from (select distinct layer, feature from act)", "act")
def _(s, p):
    a = S.activations(s, p).select("layer", "feature").distinct().withColumn("node", C.node_id("layer", "feature"))
    q = C.parse_node("node")
    return a.select("layer", "feature", "node", q.layer.alias("parsed_layer"), q.feature.alias("parsed_feature"))


@query("G6_motif_circuits", "select structure, size, frequency, avg_weight from circ", "act", d="avg_weight", i="size", extra=BASE)
def _(s, p):
    return motifs_of(s, p)[0].drop("importance")


WIDE = 0.575
@query("G6_motif_circuits_to_eight", "select structure, size, count(*) as frequency, sum(weight_sum)/sum(n_edges) as avg_weight from mi0 group by structure, size having count(*)>=2", "act", d="avg_weight", i="size",
       extra=",".join([CAUSAL, ED.replace(str(THR), str(WIDE)), NB, SETS]))
def _(s, p):
    return C.find_motifs(edges_of(s, p).filter(F.col("weight") > WIDE))[0].drop("importance")


@query("T5_motif_ranking", "select * from circ", "act", d="avg_weight importance", i="size", extra=BASE)
def _(s, p):
    return motifs_of(s, p)[0].orderBy(F.desc("importance"), "structure")


@query("G6_motif_instances", "select inst.structure, nm.instance from inst join nm using (nodes)", "act", extra=BASE)
def _(s, p):
    return motifs_of(s, p)[1].select("structure", C.path_text("nodes").alias("instance"))


@query("J13_circuit_activations", "select cn.structure, cn.instance, cn.layer, cn.feature, count(*) as n, sum(value) as s from cn join act using (layer, feature) group by all", "act", d="s", extra=BASE)
def _(s, p):
    cn = C.circuit_nodes(motifs_of(s, p)[1])
    return C.circuit_activation_sums(cn, S.activations(s, p))


KNOWN = "kn as (select f as feature, case when f%5=0 then 1.0::double when f%5=1 then 0.8 when f%5=2 then 0.6 else 0 end as s from range(64) r(f))"
PLAUS = "pl as (select structure, instance, avg(coalesce(s,0)) as plausibility from cn left join kn using (feature) group by all)"


def known_features(s, p):
    f = S.activations(s, p).select("feature").distinct()
    k = F.col("feature") % 5
    return f.filter(k <= 2).withColumn("kind", F.when(k == 0, "functional").when(k == 1, "structural").otherwise("conserved"))


@query("J14_plausibility", "select * from pl", "act", d="plausibility", extra=",".join([BASE, KNOWN, PLAUS]))
def _(s, p):
    return C.plausibility(C.circuit_nodes(motifs_of(s, p)[1]), known_features(s, p))


VAL = """pc as materialized (select q.src, q.dst, case when not isnan(corr(a.value,b.value)) then corr(a.value,b.value) end as c from (select distinct x.node as src, y.node as dst from cn x join cn y
  on x.structure=y.structure and x.instance=y.instance and x.node<y.node) q join act a on a.layer*1000000+a.feature=q.src join act b on b.layer*1000000+b.feature=q.dst and b.protein_id=a.protein_id and b.pos=a.pos group by all),
coh as (select x.structure, x.instance, avg(c) as coherence, avg(abs(c)) as cohesion from cn x join cn y on x.structure=y.structure and x.instance=y.instance and x.node<y.node join pc on pc.src=x.node and pc.dst=y.node group by all),
stab as (select structure, instance, 1-avg(sd) as stability, avg(case when k=n then 1.0::double else 0 end) as joint_share from (select structure, instance, protein_id, pos,
  stddev_samp(case when value>0.1 then 1.0::double else 0 end) as sd, sum((value>0.1)::int) as k, count(*) as n from cn join act using (layer, feature) group by all) group by all),
lab as (select protein_id, avg(label) as label from tok group by protein_id),
taskr as (select structure, instance, abs(corr(v,label)) as task_relevance from (select structure, instance, protein_id, avg(v) as v from cn join (select protein_id, layer, feature, avg(value) as v from act group by all) using (layer, feature) group by all)
  join lab using (protein_id) group by all),
flw as (select structure, instance, avg(mutual_info) as information_flow from (select structure, instance, node as i, lead(node) over (partition by structure, instance order by node) as j from cn) st
 join """ + mi_sql("""(select 0 as z, q.i, q.j, a.code as bx, b.code as "by", count(*) as n from (select distinct i, j from (select node as i, lead(node) over (partition by structure, instance order by node) as j from cn) where j is not null) q
 join dg a on a.layer*1000000+a.feature=q.i join dg b on b.layer*1000000+b.feature=q.j and b.protein_id=a.protein_id and b.pos=a.pos group by all)""", "z").replace("+1e-10", "") + """ m
 on m.i=st.i and m.j=st.j group by all)"""


def labels_of(s, p):
    return S.token_residues(s, p).select("protein_id", "label")


VBASIC = """select structure, coherence, stability, task_relevance, (coherence+stability+task_relevance)/3 as overall_score from (select structure, avg(coherence) as coherence, avg(stability) as stability,
 coalesce(avg(task_relevance),0) as task_relevance from coh join stab using (structure, instance) join taskr using (structure, instance) group by structure)"""


@query("G9_validate_circuits", f"select * from ({VBASIC}) where overall_score>=0.3", "act tok", d="coherence stability task_relevance overall_score", extra=",".join([BASE, DIGI, VAL]))
def _(s, p):
    return C.validate_circuits(motifs_of(s, p)[1], S.activations_vec(s, p), labels_of(s, p), 0.3)


VADV = """select *, coherence*0.2::double+stability*0.2::double+task_relevance*0.2::double+biological_plausibility*0.2::double+information_flow*0.1::double+modularity*0.1::double as overall_score from (
 select structure, coalesce(avg(coherence),0) as coherence, coalesce(avg(case when joint_share>0 then joint_share end),0) as stability, coalesce(avg(task_relevance),0) as task_relevance,
 coalesce(avg(plausibility),0.5) as biological_plausibility, coalesce(avg(information_flow),0) as information_flow, coalesce(avg(cohesion*(1-cohesion*0.5::double)),0) as modularity
 from coh join stab using (structure, instance) join taskr using (structure, instance) join pl using (structure, instance) join flw using (structure, instance) group by structure)"""
DADV = "coherence stability task_relevance biological_plausibility information_flow modularity overall_score"


@query("G9b_validate_circuits_adv", f"select * from ({VADV}) where overall_score>=0.2", "act tok", d=DADV, extra=",".join([BASE, DIGI, KNOWN, PLAUS, VAL]))
def _(s, p):
    return C.validate_circuits_adv(motifs_of(s, p)[1], S.activations_vec(s, p), labels_of(s, p), known_features(s, p), 0.2)


@query("T12_rank_validated", f"select * from ({VADV}) where overall_score>=0.1", "act tok", d=DADV, extra=",".join([BASE, DIGI, KNOWN, PLAUS, VAL]))
def _(s, p):
    return C.validate_circuits_adv(motifs_of(s, p)[1], S.activations_vec(s, p), labels_of(s, p), known_features(s, p), 0.1)


@query("A17_circuit_summary", """select count(*) as num_circuits, avg(size) as avg_size, stddev_pop(size) as std_size, avg(importance) as avg_importance, stddev_pop(importance) as std_importance,
 max(importance) as max_importance from circ""", "act", d="avg_size std_size avg_importance std_importance max_importance", extra=BASE)
def _(s, p):
    return C.circuit_summary(motifs_of(s, p)[0])


JAC = """cf as (select distinct structure, feature from cn), jac as (select x.structure as a, y.structure as b, count(*) as k from cf x join cf y on x.feature=y.feature and x.structure<y.structure group by all),
cfn as (select structure, count(*) as n from cf group by structure)"""


@query("SO4_circuit_jaccard", "select a, b, k::double/(x.n+y.n-k) as jaccard from jac join cfn x on x.structure=a join cfn y on y.structure=b", "act", d="jaccard", extra=BASE + "," + JAC)
def _(s, p):
    return C.circuit_jaccard(C.circuit_nodes(motifs_of(s, p)[1]))


# Without two circuits, or without a shared feature, there is no overlap: 1.
MODU = """(select 1-coalesce(coalesce(sum(k::double/(x.n+y.n-k)),0)/nullif((select count(*)*(count(*)-1)/2 from circ),0),0) from jac join cfn x on x.structure=a join cfn y on y.structure=b)"""


@query("SO4_circuit_modularity", f"select {MODU} as modularity", "act", d="modularity", extra=",".join([BASE, JAC]))
def _(s, p):
    c, i = motifs_of(s, p)
    return C.circuit_modularity(c, C.circuit_nodes(i))


@query("SO5_circuit_coverage", "select count(distinct feature) as used, 64-count(distinct feature) as unused, count(distinct feature)/64.0::double as coverage from cn", "act", d="coverage", extra=BASE)
def _(s, p):
    return C.circuit_coverage(C.circuit_nodes(motifs_of(s, p)[1]), S.activations(s, p))


@query("A47_circuit_layer_usage", "select layer, count(*) as n_nodes, count(distinct feature) as n_features from cn group by layer", "act", extra=BASE)
def _(s, p):
    return C.circuit_layer_usage(C.circuit_nodes(motifs_of(s, p)[1]))


@query("A47_circuit_evolution", """select structure, protein_id, avg(v) as activation from (select distinct structure, feature from cn) join (select protein_id, feature, avg(abs(value)) as v from act group by all) using (feature) group by all""",
       "act", d="activation", extra=BASE)
def _(s, p):
    return C.circuit_evolution(C.circuit_nodes(motifs_of(s, p)[1]), S.activations(s, p))


@query("A48_circuit_profile", """select structure, pos, (v-avg(v) over w)/(stddev_pop(v) over w+1e-8) as z from (select structure, pos, avg(v) as v from (select layer, feature, pos, avg(value) as v from act group by all)
 join (select structure, layer, feature from cn) using (layer, feature) group by all)
 window w as (partition by structure)""", "act", d="z", extra=BASE)
def _(s, p):
    c, i = motifs_of(s, p)
    return C.circuit_profile(c, C.circuit_nodes(i), S.activations(s, p))


@query("Q37_circuit_novelty", "select *, least(1, size/10.0::double) as topology_score from circ where least(1, size/10.0::double)>0.6", "act", d="avg_weight importance topology_score", i="size", extra=BASE)
def _(s, p):
    return C.circuit_novelty(motifs_of(s, p)[0])


@query("Q42_circuit_interpretability", f"""select (select avg(coherence) from (select c.structure, v.coherence from ({VBASIC}) v join circ c using (structure))) as clarity, {MODU} as modularity,
 (select avg(importance) from circ) as specificity""", "act tok", d="clarity modularity specificity", extra=",".join([BASE, DIGI, VAL, JAC]))
def _(s, p):
    c, i = motifs_of(s, p)
    v = C.validate_circuits(i, S.activations_vec(s, p), labels_of(s, p), -1.0)
    return v.join(c.select("structure"), "structure").agg(F.avg("coherence").alias("clarity")).join(F.broadcast(C.circuit_modularity(c, C.circuit_nodes(i)))).join(F.broadcast(c.agg(F.avg("importance").alias("specificity"))))


@query("C8_discover_circuits", f"""select c.structure, c.size, c.frequency, c.avg_weight, c.importance, v.overall_score from circ c join ({VBASIC}) v using (structure) where overall_score>=0.3""", "act tok",
       d="avg_weight importance overall_score", i="size", extra=",".join([BASE, DIGI, VAL]))
def _(s, p):
    c, i = motifs_of(s, p)
    v = C.validate_circuits(i, S.activations_vec(s, p), labels_of(s, p), 0.3).select("structure", "overall_score")
    return c.join(v, "structure")


# directed graph inside a layer: every ordered pair with a strong lagged correlation
LED = """led as materialized (select layer, src, dst, weight from (select a.layer, a.feature as src, b.feature as dst, (corr(a.value,b.value)+1)/2 as weight from act a join act b
 on a.protein_id=b.protein_id and a.layer=b.layer and b.pos=a.pos+1 and a.feature<>b.feature group by all) where not isnan(weight) and weight>0.545)"""


def lag_graph(s, p, thr=0.545):
    m = with_corr(cross_moments(lag_pairs(S.activations_vec(s, p), cross_layers=False), ["la", "lb"])).filter("i <> j")
    return m.select(F.col("la").alias("layer"), F.col("i").alias("src"), F.col("j").alias("dst"), ((F.col("corr") + 1) / 2).alias("weight")).filter(F.col("weight") > thr)


CH = """ch as (select layer, [src, dst] as path, dst as last from led union all select ch.layer, list_append(ch.path, led.dst), led.dst from ch join led on led.layer=ch.layer and led.src=ch.last
 where not list_contains(ch.path, led.dst) and len(ch.path)<6)"""


@query("G11_causal_chains", "select layer, array_to_string(path, '>') as path, len(path) as n_nodes from ch where len(path)>=3", "act", extra=LED + "," + CH)
def _(s, p):
    c = G.chains(lag_graph(s, p), ["layer"], 5)
    return c.select("layer", F.array_join("path", ">").alias("path"), F.size("path").alias("n_nodes"))


@query("SO2_distinct_paths", """select distinct path[1] as start, path[-1] as "end", len(path) as n_nodes from ch where len(path)>=3""", "act", extra=LED + "," + CH)
def _(s, p):
    c = G.chains(lag_graph(s, p), ["layer"], 5)
    return G.distinct_paths(c.select(F.element_at("path", 1).alias("start"), F.element_at("path", -1).alias("end"), F.size("path").alias("n_nodes")))


LOOPS = LED + """,
lp as (select layer, src as start, [src, dst] as path, dst as last, false as closed from led where src<dst union all
 select lp.layer, lp.start, case when led.dst=lp.start then lp.path else list_append(lp.path, led.dst) end, led.dst, led.dst=lp.start from lp join led on led.layer=lp.layer and led.src=lp.last
 where not lp.closed and (led.dst=lp.start or (led.dst>lp.start and not list_contains(lp.path, led.dst))))"""


@query("G12_feedback_loops", "select layer, array_to_string(path, '>') as path from lp where closed", "act", extra=LOOPS)
def _(s, p):
    return G.feedback_loops(lag_graph(s, p), ["layer"]).select("layer", F.array_join("path", ">").alias("path"))


QUERIES["G12_feedback_loops_all_edges"], ORACLES["G12_feedback_loops_all_edges"] = QUERIES["G12_feedback_loops"], ORACLES["G12_feedback_loops"]  # its name of the last round


@query("G3_graph_components", """select layer, node, min(reach) as component from (select layer, src as node, src as reach from u union select layer, node, reach from rc) group by all""", "act", extra=LED + """,
u as materialized (select layer, src, dst from led union select layer, dst, src from led), rc as (select layer, src as node, dst as reach from u union select rc.layer, rc.node, u.dst from rc join u on u.layer=rc.layer and u.src=rc.reach)""")
def _(s, p):
    return G.components(lag_graph(s, p), ["layer"])


@query("G13_causal_importance")
def _(s, p):
    return G.causal_importance(lag_graph(s, p), ["layer"])


for _name, _sql in {
    "feed_forward": "select a.src as n0, a.dst as n1, b.dst as n2 from led a join led b on a.layer=b.layer and a.src=b.src and a.dst<>b.dst join led c on c.layer=a.layer and c.src=a.dst and c.dst=b.dst",
    "feedback_loop": "select a.src as n0, a.dst as n1, b.dst as n2 from led a join led b on a.layer=b.layer and a.dst=b.src and b.dst<>a.src join led c on c.layer=a.layer and c.src=b.dst and c.dst=a.src",
}.items():
    @query(f"G7_match_{_name}", _sql.replace("select ", "select a.layer, ", 1), "act", extra=LED)
    def _(s, p, name=_name):
        from ..functions.tables import MOTIF_LIBRARY
        e = lag_graph(s, p)
        e = e.select((F.col("layer") * 1000 + F.col("src")).alias("src"), (F.col("layer") * 1000 + F.col("dst")).alias("dst"))
        pat = next(m[1] for m in MOTIF_LIBRARY if m[0] == name)
        m = C.pattern_matches(e, pat)
        return m.select(F.floor(F.col("n0") / 1000).alias("layer"), *[(F.col(f"n{k}") % 1000).alias(f"n{k}") for k in range(3)])


@query("G7_match_motifs")
def _(s, p):
    return C.match_motifs(motifs_of(s, p)[0].select("structure", "size"), 0.8)


def instances_of(s, p):
    e = cut_lineage(edges_of(s, p))
    out = None
    for m in ("feed_forward", "cascade", "bi_fan", "feedback_loop"):
        i = C.motif_instances(e, m)
        out = i if out is None else out.unionByName(i)
    return out


@query("G7b_motif_instances", """select 'feed_forward' as motif, string_agg('L'||(n//1000000)||'_F'||(n%1000000), ',' order by n) as nodes, any_value(e) as num_edges, any_value(e)/6.0::double as density
 from (select nodes, unnest(nodes) as n, e from (select t.nodes, count(*) as e from (select distinct list_sort([a.src, a.dst, b.dst]) as nodes from ge a join ge b on a.src=b.src and a.dst<>b.dst join ge c on c.src=a.dst and c.dst=b.dst) t
 join ge x on list_contains(t.nodes, x.src) and list_contains(t.nodes, x.dst) group by t.nodes)) group by nodes""", "act", d="density", i="num_edges", extra=CAUSAL + "," + ED)
def _(s, p):
    return C.motif_instances(edges_of(s, p), "feed_forward").select("motif", "nodes", "num_edges", "density")


@query("G10_score_motifs")
def _(s, p):
    return C.score_motifs(instances_of(s, p), C.motif_library(s))


@query("T13_rank_instances")
def _(s, p):
    return C.rank_instances(C.score_motifs(instances_of(s, p), C.motif_library(s)))


@query("P19_combine_scores", """select feature, frequency*0.4::double+mean_abs*0.6::double as score from (select feature, avg(case when abs(value)>0.1 then 1.0::double else 0 end) as frequency, avg(abs(value)) as mean_abs from act group by feature)""",
       "act", d="score")
def _(s, p):
    return C.combine_scores(A.feature_stats(S.activations(s, p)), {"frequency": 0.4, "mean_abs": 0.6}, "score").select("feature", "score")
