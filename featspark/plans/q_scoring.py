"""Queries: biological scores, regions and levels, novelty, layout, probes."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as K
from ..functions import vec as V
from ..operators import aggregates as A
from ..operators import layout as L
from ..operators import ml
from ..operators import novelty as N
from ..operators import pairs as P
from ..operators import scoring as B
from ..operators import sequence as Q
from ..operators import structure as T
from ..sources import views as S
from .q_sequence import in_list, span_sql
from .q_stats import ACONS, COACT, COENT, SPEC
from .q_structure import CONT
from .registry import RAW, query

FEATS = "fs0 as (select distinct layer, feature from act)"
PM = "pmn as materialized (select protein_id, layer, feature, avg(value) as mean, stddev_samp(value) as std from act group by all)"
ELV = PM + ", elv as materialized (select a.*, mean, std from act a join pmn using (protein_id, layer, feature) where value>mean+std)"


def zero(sub, name):
    return f"select layer, feature, coalesce({name}, 0) as {name} from fs0 left join ({sub}) using (layer, feature)"


@query("W19_elevated", "select protein_id, pos, layer, feature, value from elv", "act", d="value", extra=ELV)
def _(s, p):
    return B.elevated(S.activations(s, p))


FLAGS = "flg as (select doc_id as protein_id, 'quality' as term, quality as flag from labels union all select doc_id, 'toxic', toxic from labels)"
GO = "select layer, feature, max(c) as go_correlation from (select layer, feature, term, abs(corr(mean, flag)) as c from pmn join flg using (protein_id) group by all having sum(flag)>0) where not isnan(c) group by all"


def flags(s, p):
    lab = S.table(s, p, "labels")
    return lab.select(F.col("doc_id").alias("protein_id"), F.lit("quality").alias("term"), F.col("quality").alias("flag")).unionByName(lab.select(F.col("doc_id").alias("protein_id"), F.lit("toxic").alias("term"), F.col("toxic").alias("flag")))


@query("B1_go_correlation", zero(GO, "go_correlation"), "act", d="go_correlation", extra=",".join([FEATS, PM, FLAGS]))
def _(s, p):
    return B.go_correlation(S.activations(s, p), flags(s, p))


CAT = f"select layer, feature, avg(sh/0.3::double) as catalytic_score from (select protein_id, layer, feature, avg((aa in ({in_list(K.CATALYTIC)}))::int) as sh from elv join tok using (protein_id, pos) group by all) where sh>0.45 group by all"


@query("B2_catalytic_score", zero(CAT, "catalytic_score"), "act tok", d="catalytic_score", extra=",".join([FEATS, ELV]))
def _(s, p):
    return B.catalytic_score(S.activations(s, p), S.token_residues(s, p))


def spans(pats):
    return "sp as materialized (" + " union all ".join(span_sql("tprot", n, x) for n, x in pats.items()) + """),
sm as materialized (select h.protein_id, h.pattern, h."start", a.layer, a.feature, avg(value) as v, any_value(mean) as mean from sp h join act a on a.protein_id=h.protein_id and pos>=h."start" and pos<h."end" join pmn on pmn.protein_id=a.protein_id and pmn.layer=a.layer and pmn.feature=a.feature group by all)"""


@query("B3_binding_score", zero("select layer, feature, avg(least(1, n/4.0::double)) as binding_score from (select protein_id, layer, feature, count(*) as n from sm where v>mean group by all) group by all", "binding_score"), "act tprot", d="binding_score",
       extra=",".join([FEATS, PM, spans(K.BINDING_PATTERNS)]))
def _(s, p):
    return B.binding_score(S.activations(s, p), S.token_proteins(s, p))


@query("B3_domain_score", zero("select layer, feature, least(1, avg(d/(mean+1e-10))) as domain_score from (select protein_id, layer, feature, pattern, avg(v) as d, any_value(mean) as mean from sm group by all) where d>mean*1.5 group by all", "domain_score"), "act tprot",
       d="domain_score", extra=",".join([FEATS, PM, spans(K.DOMAIN_PATTERNS)]))
def _(s, p):
    return B.domain_score(S.activations(s, p), S.token_proteins(s, p))


for _n, _pats, _k, _mult in (("structural_score", K.STRUCTURAL_PATTERNS, 1.0, 4), ("ptm_score", K.PTM_PATTERNS, 0.5, 3)):
    @query(f"B3_{_n}", zero(f"""select layer, feature, least(1, count(*)/(({_mult}*(select count(*) from tprot))::double)) as {_n} from sp h join (select act.*, mean, std from act join pmn using (protein_id, layer, feature)) a on a.protein_id=h.protein_id and a.pos=h."start" where value>mean+{_k}*std group by all""", _n),
           "act tprot", d=_n, extra=",".join([FEATS, PM, spans(_pats)]))
    def _(s, p, name=_n):
        return getattr(B, name)(S.activations(s, p), S.token_proteins(s, p))


SSP = "select layer, feature, least(1, avg(mx/(mn+1e-10))-1) as ss_preference from (select protein_id, layer, feature, max(v) as mx, avg(v) as mn from (select protein_id, layer, feature, ss, avg(value) as v from act join tok using (protein_id, pos) group by all) group by all having count(*)>1 and max(v)>avg(v)*1.5) group by all"


@query("B4_ss_preference", zero(SSP, "ss_preference"), "act tok", d="ss_preference", extra=FEATS)
def _(s, p):
    return B.ss_preference(S.activations(s, p), S.token_residues(s, p))


CCO = "select layer, feature, max(c) as conservation_corr from (select protein_id, layer, feature, abs(corr(value, conservation)) as c from act join tok using (protein_id, pos) group by all having sum(conservation)>0) where not isnan(c) group by all"


@query("B5_conservation_corr", zero(CCO, "conservation_corr"), "act tok", d="conservation_corr", extra=FEATS)
def _(s, p):
    return B.conservation_corr(S.activations(s, p), S.token_residues(s, p))


@query("B6_coevolution_enrichment", zero("""select layer, feature, least(1, avg(m/(bg+1e-10))-1) as coevolution_enrichment from (select x.protein_id, x.layer, x.feature, avg(c.d) as m from cx c join hot x on x.protein_id=c.protein_id and x.pos=c.i join hot y on y.protein_id=c.protein_id and y.pos=c.j and y.layer=x.layer and y.feature=x.feature group by all)
 join (select protein_id, avg(d) as bg from cx group by all) using (protein_id) where m>bg*1.5 group by all""", "coevolution_enrichment"), "act coords", d="coevolution_enrichment",
       extra=FEATS + "," + CONT + """, cx as (select protein_id, i, j, 1/(1+distance) as d from ct), hot as materialized (select a.* from act a join (select layer, feature, avg(value)+stddev_samp(value) as t from act group by all) using (layer, feature) where value>t)""")
def _(s, p):
    coevo = T.contacts(S.coords(s, p)).select("protein_id", "i", "j", (1 / (1 + F.col("distance"))).alias("score"))
    return B.coevolution_enrichment(S.activations(s, p), coevo)


GF = """select w.layer, w.feature, coalesce(least(1, b/w.w/10), 0) as group_f from (select layer, feature, avg(v) as w from (select layer, feature, pos, var_samp(value) as v from act group by all) group by all) w
 left join (select layer, feature, avg(b) as b from (select layer, feature, pos, var_samp(v) as b, count(*) as k from (select layer, feature, pos, cluster, avg(value) as v from act join cl using (protein_id) group by all) group by all) where k>1 group by all) b on b.layer=w.layer and b.feature=w.feature"""
CL = "cl as (select protein_id, mode_label as cluster from (select protein_id, (sum(label)%3)::int as mode_label from tok group by protein_id))"


def clusters(s, p):
    return S.token_residues(s, p).groupBy("protein_id").agg((F.sum("label") % 3).cast("int").alias("cluster"))


@query("B7_group_f", GF.replace("b/w.w/10", "case when w.w>0 then b/w.w/10 end"), "act tok", d="group_f", extra=CL)
def _(s, p):
    return B.group_f(S.activations(s, p), clusters(s, p))


VARS = [(3, "A", "V", "x", "pathogenic"), (7, "G", "D", "y", "pathogenic"), (12, "L", "P", None, "benign"), (10, "F", "S", "z", "pathogenic"), (15, "H", "Y", "z", "pathogenic"), (20, "K", "E", "z", "pathogenic")]
VE = "select layer, feature, least(1, (avg(e)-1)/2) as variant_enrichment from (select protein_id, layer, feature, avg(value)/any_value(mean) as e from act join tok using (protein_id, pos) join (values (3,'A'),(7,'G'),(10,'F'),(15,'H'),(20,'K')) v(vp, wt) on vp=pos and wt=aa join pmn using (protein_id, layer, feature) where mean>0 group by all) where e>1.5 group by all"


def variants(s):
    return s.createDataFrame(VARS, "pos int, wt string, mut string, disease string, class string")


@query("B8_variant_enrichment", zero(VE, "variant_enrichment"), "act tok", d="variant_enrichment", extra=",".join([FEATS, PM]))
def _(s, p):
    return B.variant_enrichment(S.activations(s, p), S.token_residues(s, p), variants(s))


def all_scores(s, p):
    act, res, prot = S.activations(s, p), S.token_residues(s, p), S.token_proteins(s, p)
    parts = [B.go_correlation(act, flags(s, p)), B.catalytic_score(act, res), B.binding_score(act, prot), B.domain_score(act, prot), B.ss_preference(act, res), B.structural_score(act, prot),
             B.conservation_corr(act, res), B.coevolution_enrichment(act, T.contacts(S.coords(s, p)).select("protein_id", "i", "j", (1 / (1 + F.col("distance"))).alias("score"))), B.group_f(act, clusters(s, p)), B.variant_enrichment(act, res, variants(s)), B.ptm_score(act, prot),
             B.disorder_score(act, Q.disorder_windows(prot), prot)]
    return B.relevance_scores(act, parts)


DISORDER = f"""select layer, feature, least(1, count(*)/(5*(select count(*) from tprot))::double) as disorder_score from (select w.protein_id, w.pos, a.layer, a.feature, avg(a.value) as v, any_value(mean) as mean from
 (select protein_id, pos, sum((aa in ({in_list(K.DISORDER)}))::int) over (partition by protein_id order by pos rows between current row and 19 following) as k, max(pos) over (partition by protein_id) as last from tok) w
 join act a on a.protein_id=w.protein_id and a.pos between w.pos and w.pos+19 join pmn on pmn.protein_id=a.protein_id and pmn.layer=a.layer and pmn.feature=a.feature where k>12 and w.pos+20<=last group by w.protein_id, w.pos, a.layer, a.feature) where v>mean group by layer, feature"""


@query("B10_disorder_score", zero(DISORDER, "disorder_score"), "act tok tprot", d="disorder_score", extra=",".join([FEATS, PM]))
def _(s, p):
    prot = S.token_proteins(s, p)
    return B.disorder_score(S.activations(s, p), Q.disorder_windows(prot), prot)


def relevance_sql():
    """All parts side by side, each the unrounded SQL of its own query, then the weights and gates of the definition."""
    source = {part: next(q for q in RAW if q.endswith("_" + part)) for w in B.PARTS.values() for part in w}
    joins = " ".join(f"left join ({RAW[q]}) {part} using (layer, feature)" for part, q in source.items())
    fired = {part: f"coalesce({part}, 0)>{B.GATES.get(part, 0.0)}" for part in source}
    comp = {k: "+".join(f"case when {fired[part]} then {part}*{x} else 0 end" for part, x in w.items()) for k, w in B.PARTS.items()}
    names = "concat_ws(';', " + ", ".join(f"case when {fired[part]} then '{part}' end" for part in sorted(fired)) + ")"
    return f"""select layer, feature, function, structure, evolution, disease, {'+'.join(f'{k}*{w}' for k, w in B.TOTAL.items())} as total, case when greatest(function, structure, evolution, disease)>0.3 then names else '' end as evidence
 from (select layer, feature, {', '.join(f'({x})::double as {k}' for k, x in comp.items())}, {names} as names from (select layer, feature from act group by all having max(abs(value))>=0.1) {joins})"""


@query("B9_relevance_scores", relevance_sql(), "act", d="function structure evolution disease total")
def _(s, p):
    return all_scores(s, p)


@query("T9_important_features", f"select * from ({relevance_sql()}) where total>0.3", "act", d="function structure evolution disease total")
def _(s, p):
    return B.important_features(all_scores(s, p), 0.3)


@query("A45_relevance_summary", f"""select count(*) as n_features, sum((total>0.7)::int) as high, sum((total>0.4 and total<=0.7)::int) as medium, sum((total<=0.4)::int) as low, avg(function) as avg_function, avg(structure) as avg_structure,
 avg(evolution) as avg_evolution, avg(disease) as avg_disease from ({relevance_sql()})""", "act", d="avg_function avg_structure avg_evolution avg_disease", i="high medium low")
def _(s, p):
    return B.relevance_summary(all_scores(s, p))


@query("A31_site_enrichment", """select kind, (sum(case when hit then s end)/sum(case when hit then n end))/((sum(case when not hit then s end)/sum(case when not hit then n end))+1e-8) as enrichment from (select kind, t.protein_id, t.pos, s, n, coalesce(k.probability,0)>0.5 as hit
 from (select protein_id, pos, sum(abs(value)) as s, count(*) as n from act group by all) t cross join (select unnest(['active','binding']) as kind) kk left join (select protein_id, pos, 'active' as k, conservation as probability from tok union all select protein_id, pos, 'binding', 1-conservation from tok) k
 on k.protein_id=t.protein_id and k.pos=t.pos and k.k=kk.kind) group by kind""", "act tok", d="enrichment")
def _(s, p):
    r = S.token_residues(s, p)
    sites = r.select("protein_id", "pos", F.lit("active").alias("kind"), F.col("conservation").alias("probability")).unionByName(r.select("protein_id", "pos", F.lit("binding").alias("kind"), (1 - F.col("conservation")).alias("probability")))
    return B.site_enrichment(S.activations(s, p), sites)


def sf(st):
    return f"avg(case when ss='{st}' and conservation>0.7 then abs(value) end)/(avg(case when ss='{st}' and conservation<=0.7 then abs(value) end)+1e-8)"


@query("A32_structure_function", f"select {sf('H')} as helix, {sf('E')} as sheet, greatest({sf('H')}, {sf('E')}) as structure_function from act join tok using (protein_id, pos)", "act tok", d="helix sheet structure_function")
def _(s, p):
    return B.structure_function(S.activations(s, p), S.token_residues(s, p))


def tmpl_sql():
    out = []
    for name, t in B.TEMPLATES.items():
        v = [f"lead(value,{k}) over w" if k else "value" for k in range(8)]
        sx, sxx, sxy, st = "+".join(v), "+".join(f"({x})*({x})" for x in v), "+".join(x for x, k in zip(v, t) if k), sum(t)
        out.append(f"""select layer, feature, avg((8*sxy-sx*{st})/(sqrt(8*sxx-sx*sx)*sqrt({8 * st - st * st}))) as enrichment, '{name}' as template from (select layer, feature, {sx} as sx, {sxx} as sxx, {sxy} as sxy from act
 window w as (partition by protein_id, layer, feature order by pos)) where sx>0 and 8*sxx-sx*sx>1e-15 group by all""")
    return " union all ".join(out)


@query("W7_template_enrichment", tmpl_sql(), "act", d="enrichment")
def _(s, p):
    return B.template_enrichment(S.activations(s, p), B.TEMPLATES)


@query("C11_simple_relevance", "select template, max(enrichment) as enrichment from (" + tmpl_sql() + ") group by template", "act", d="enrichment")
def _(s, p):
    return B.template_enrichment(S.activations(s, p), B.TEMPLATES).groupBy("template").agg(F.max("enrichment").alias("enrichment"))


PRED = "(select label, case when embedding[1]>0 then label else (label+1)%10 end as prediction from embeddings)"


def predictions(s, p):
    e = S.table(s, p, "embeddings")
    return e.select("label", F.when(F.element_at("embedding", 1) > 0, F.col("label")).otherwise((F.col("label") + 1) % 10).alias("prediction"))


@query("A44_class_accuracy", f"select label, avg((label=prediction)::int) as accuracy, count(*) as n from {PRED} group by label", d="accuracy")
def _(s, p):
    return B.class_accuracy(predictions(s, p))


@query("A44_class_accuracy_summary", f"select avg(accuracy) as mean_accuracy, stddev_pop(accuracy) as std_accuracy, sum(accuracy*n)/sum(n) as overall from (select label, avg((label=prediction)::int) as accuracy, count(*) as n from {PRED} group by label)", d="mean_accuracy std_accuracy overall")
def _(s, p):
    return B.class_accuracy_summary(B.class_accuracy(predictions(s, p)))


@query("B15_domain_property", """select t.protein_id, coalesce(m, 0.5) as domain_property from (select distinct protein_id from tok) t left join (select k.protein_id, avg(conservation) as m from tok k join tdom d on d.protein_id=k.protein_id and pos>=d."start" and pos<d."end" group by all) using (protein_id)""", "tok tdom", d="domain_property")
def _(s, p):
    return B.domain_property(S.token_residues(s, p), S.token_domains(s, p), "conservation")


@query("B16_domain_interactions", """select protein_id, layer, d1, d2, c as cosine, case when c>0.8 then 'homotypic' when c>0.5 then 'cooperative' else 'regulatory' end as kind from (select a.protein_id, a.layer, a.domain_id as d1, b.domain_id as d2, sum(a.v*b.v)/(sqrt(sum(a.v*a.v))*sqrt(sum(b.v*b.v))) as c from rv a join rv b on a.protein_id=b.protein_id and a.layer=b.layer and a.feature=b.feature and a.domain_id<b.domain_id group by all)""",
       "act tdom", d="cosine", extra="""rv as materialized (select a.protein_id, layer, domain_id, feature, avg(value) as v from act a join tdom d on d.protein_id=a.protein_id and pos>=d."start" and pos<d."end" group by all)""")
def _(s, p):
    return B.domain_interactions(S.activations(s, p), S.token_domains(s, p))


@query("B17_roll_levels", """select m.*, r.region_mean, d.domain_mean from (select protein_id, layer, feature, avg(value) as residue_mean from act group by all) m left join (select protein_id, layer, feature, avg(value) as region_mean from rg group by all) r using (protein_id, layer, feature)
 left join (select protein_id, layer, feature, avg(v) as domain_mean from (select rg.protein_id, layer, feature, domain_id, avg(value) as v from rg join tdom d on d.protein_id=rg.protein_id and s>=d."start" and s<d."end" group by all) group by all) d using (protein_id, layer, feature)""",
       "act tok tdom", d="residue_mean region_mean domain_mean", extra="""reg as (select protein_id, min(pos) as s, max(pos)+1 as e from (select protein_id, pos, ss, pos-row_number() over (partition by protein_id, ss order by pos) as g from tok) group by protein_id, ss, g),
rg as materialized (select a.protein_id, layer, feature, s, avg(value) as value from act a join reg on reg.protein_id=a.protein_id and pos>=s and pos<e group by all)""")
def _(s, p):
    return B.roll_levels(S.activations(s, p), ss_regions(s, p), S.token_domains(s, p))


def ss_regions(s, p):
    """Runs of one structure state, all states in one pass."""
    g = S.token_residues(s, p).withColumn("_g", F.col("pos") - F.row_number().over(Window.partitionBy("protein_id", "ss").orderBy("pos")))
    return g.groupBy("protein_id", "ss", "_g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count("*").alias("length")).drop("ss", "_g")


@query("B17_messages", """select protein_id, layer, feature, 'protein' as level, 'protein' as node, v as up, v as down from u3 union all select protein_id, layer, feature, 'domain', domain_id, v, m from d2
 union all select protein_id, layer, feature, 'region', s::varchar, value, m from d1 union all select protein_id, layer, feature, 'residue', pos::varchar, value, m from d0""",
       "act tok tdom", d="up down", extra="""reg as materialized (select protein_id, min(pos) as s, max(pos)+1 as e from (select protein_id, pos, ss, pos-row_number() over (partition by protein_id, ss order by pos) as g from tok) group by protein_id, ss, g),
rg as materialized (select a.protein_id, layer, feature, s, avg(value) as value from act a join reg on reg.protein_id=a.protein_id and pos>=s and pos<e group by all),
u2 as materialized (select rg.protein_id, layer, feature, domain_id, avg(value) as v from rg join tdom d on d.protein_id=rg.protein_id and s>=d."start" and s<d."end" group by all),
u3 as materialized (select protein_id, layer, feature, avg(v) as v from u2 group by all),
d2 as materialized (select u2.*, (u2.v+u3.v)/2 as m from u2 join u3 using (protein_id, layer, feature)),
d1 as materialized (select rg.protein_id, rg.layer, rg.feature, rg.s, rg.value, (rg.value+d2.m)/2 as m from rg join tdom d on d.protein_id=rg.protein_id and s>=d."start" and s<d."end" join d2 on d2.protein_id=rg.protein_id and d2.layer=rg.layer and d2.feature=rg.feature and d2.domain_id=d.domain_id),
d0 as (select a.protein_id, a.layer, a.feature, a.pos, a.value, (a.value+d1.m)/2 as m from act a join reg on reg.protein_id=a.protein_id and pos>=reg.s and pos<e join d1 on d1.protein_id=a.protein_id and d1.layer=a.layer and d1.feature=a.feature and d1.s=reg.s)""")
def _(s, p):
    vecs = S.activations_vec(s, p)
    return B.pass_messages_vec(vecs, B.level_links(S.token_residues(s, p), ss_regions(s, p), S.token_domains(s, p)), S.WIDTH)


@query("B19_resample", """select protein_id, layer, feature, t as pos, sum(value*w) as value from (select protein_id, t, lo as pos, 1-f as w from g union all select protein_id, t, least(lo+1, n-1), f from g) e join act using (protein_id, pos) group by all""", "act", d="value",
       extra="""g as (select protein_id, n, t, floor(x)::bigint as lo, x-floor(x) as f from (select protein_id, n, t, greatest(0, (t+0.5::double)*n/10-0.5::double) as x from (select protein_id, max(pos)+1 as n from act group by protein_id), range(10) r(t)))""")
def _(s, p):
    return B.resample(S.activations(s, p), 10)


@query("B19_repeat_protein", "select protein_id, layer, feature, r.pos, pooled from (select protein_id, layer, feature, avg(value) as pooled from act group by all) join (select protein_id, unnest(range(max(pos)+1)) as pos from act group by protein_id) r using (protein_id)", "act", d="pooled")
def _(s, p):
    act = S.activations(s, p)
    n = act.groupBy("protein_id").agg((F.max("pos") + 1).alias("length"))
    return B.repeat_protein(A.pool(act), n)


@query("P24_confident_sites", """select k.protein_id, domain_id, 'site' as kind, d."start"+k.pos%8 as pos, conservation as probability from tok k join tdom d on d.protein_id=k.protein_id and k.pos>=d."start" and k.pos<d."end" where conservation>0.7""", "tok tdom", d="probability")
def _(s, p):
    dom = S.token_domains(s, p)
    sites = Q.in_region(S.token_residues(s, p), dom).select("protein_id", "domain_id", F.lit("site").alias("kind"), (F.col("pos") % 8).alias("offset"), F.col("conservation").alias("probability"))
    return B.confident_sites(sites, dom)


@query("P25_reweight_regions", """select d.protein_id, d."start", d."end", d.domain_id, (d."end"-d."start")/25.0::double*(0.5+0.5::double*c) as confidence from tdom d join (select protein_id, avg(conservation) as c from tok group by all) using (protein_id)""", "tok tdom", d="confidence", i="start end")
def _(s, p):
    r = S.token_domains(s, p).withColumn("confidence", (F.col("end") - F.col("start")) / F.lit(25.0))
    return B.reweight_regions(r, S.token_residues(s, p).groupBy("protein_id").agg(F.avg("conservation").alias("context")))


SSPROB = "select protein_id, pos, " + ", ".join(f"(case when ss='{c}' then 0.65::double else 0.05::double end) as q{k}" for k, c in enumerate(K.SS8)) + " from tok"


@query("W8_ss_template_scores", f"select protein_id, pos, q0+q1+q2+q3 as helix, q4+q5 as sheet, q6 as turn, 1-greatest({', '.join(f'q{k}' for k in range(8))}) as disorder from ({SSPROB})", "tok", d="helix sheet turn disorder")
def _(s, p):
    r = S.token_residues(s, p).select("protein_id", "pos", F.array(*[F.when(F.col("ss") == c, 0.65).otherwise(0.05) for c in K.SS8]).alias("probs"))
    return B.ss_template_scores(r)


@query("W11_peaks", "select protein_id, pos, layer, feature, value from (select *, lag(value) over w as a, lead(value) over w as b from act window w as (partition by protein_id, layer, feature order by pos)) where value>0.2 and value>a and value>b", "act", d="value")
def _(s, p):
    return B.peaks(S.activations(s, p), ["protein_id", "layer", "feature"], 0.2)


@query("W12_boundary_regions")
def _(s, p):
    return B.boundary_regions(B.boundary_scores(S.activations_vec(s, p)), 5)


@query("W13_boundary_scores", """select a.protein_id, a.layer, a.pos, coalesce(sqrt(sum((a.value-b.value)*(a.value-b.value))),0) as score from act a left join act b on b.protein_id=a.protein_id and b.layer=a.layer and b.feature=a.feature and b.pos=a.pos+1 group by all""", "act", d="score")
def _(s, p):
    return B.boundary_scores(S.activations_vec(s, p))


@query("W14_start_end_regions", """select protein_id, s as "start", e as "end" from se where s>=0 and e>=0""", "coords", extra="""ev as (select protein_id, pos, row_number() over (partition by protein_id order by pos) as k, x>4 as ps, y>4 as pe from coords where x>4 or y>4),
se as (select protein_id, 0::bigint as k, -1::bigint as op, -1::bigint as s, -1::bigint as e from (select distinct protein_id from ev) union all
 select ev.protein_id, ev.k, case when se.op>=0 and pe then -1 when se.op<0 and ps then ev.pos else se.op end, case when se.op>=0 and pe then se.op else -1 end, case when se.op>=0 and pe then ev.pos else -1 end from se join ev on ev.protein_id=se.protein_id and ev.k=se.k+1)""")
def _(s, p):
    pr = S.coords(s, p).select("protein_id", "pos", F.when(F.col("x") > 4, 1.0).otherwise(0.0).alias("p_start"), F.when(F.col("y") > 4, 1.0).otherwise(0.0).alias("p_end"))
    return B.start_end_regions(pr)


@query("W23_peak_links", """select a.protein_id, a.feature, a.layer, a.pos, b.pos as pos_next, a.value*b.value as weight from pk a join pk b on a.protein_id=b.protein_id and a.feature=b.feature and b.layer=a.layer+1 where a.value*b.value>0.08""", "act", d="weight",
       extra="""pk as materialized (select * from (select *, row_number() over (partition by protein_id, layer, feature order by pos) as k from (select *, lag(value) over w as a, lead(value) over w as b from act window w as (partition by protein_id, layer, feature order by pos)) where value>0.2 and value>a and value>b))""")
def _(s, p):
    return B.peak_links(S.activations(s, p), 0.2, min_weight=0.08)


@query("G15_community_pool", """select protein_id, community, layer, feature, avg(value) as pooled from act join (select protein_id, n as pos, min(r) as community from rc group by all) using (protein_id, pos) group by all""", "act coords", d="pooled",
       extra=CONT + """, u as (select protein_id, i, j from ct union select protein_id, j, i from ct), rc as (select protein_id, i as n, i as r from u union select rc.protein_id, rc.n, u.j from rc join u on u.protein_id=rc.protein_id and u.i=rc.r)""")
def _(s, p):
    from ..operators.graph import components
    c = T.contacts(S.coords(s, p))
    comp = components(c.select("protein_id", F.col("i").alias("src"), F.col("j").alias("dst")), ["protein_id"])
    return B.community_pool(S.activations(s, p), comp.select("protein_id", F.col("node").alias("pos"), F.col("component").alias("community")))


# novelty -----------------------------------------------------------------------------------


@query("W18_gap_regularity", """select r.layer, r.feature, case when rate<0.3 then coalesce(g,0) else 0 end as regularity from (select layer, feature, avg((abs(value)>0.1)::int) as rate from act group by all) r left join (select layer, feature, 1-stddev_pop(gap)/(avg(gap)+1e-10) as g from
 (select layer, feature, pos-lag(pos) over (partition by protein_id, layer, feature order by pos) as gap from act where abs(value)>0.1) where gap is not null group by all) q on q.layer=r.layer and q.feature=r.feature""", "act", d="regularity")
def _(s, p):
    return N.gap_regularity(S.activations(s, p), 0.1, 0.3)


@query("W21_periodicity", """select f.layer, f.feature, coalesce(case when n>1 and cv<0.2 then least(1, first) end, 0) as periodicity from fs0 f left join (select layer, feature, count(*) as n, arg_min(acf, lag) as first, stddev_pop(step)/(avg(step)+1e-10) as cv from
 (select *, lag-lag(lag) over (partition by layer, feature order by lag) as step from (select *, lag(acf) over w as a, lead(acf) over w as b from acf window w as (partition by layer, feature order by lag)) where lag>=5 and acf>0.5 and acf>a and acf>b) group by all) q on q.layer=f.layer and q.feature=f.feature""", "act", d="periodicity",
       extra=FEATS + """, onn as materialized (select protein_id, layer, feature, pos from act where abs(value)>0.1), n0 as (select layer, feature, count(*) as n0 from onn group by all having count(*)>=5),
acf as materialized (select g.layer, g.feature, g.lag, coalesce(k,0)::double/n0 as acf from (select n0.*, l.lag from n0, range(1,13) l(lag)) g left join (select a.layer, a.feature, b.pos-a.pos as lag, count(*) as k from onn a join onn b on a.protein_id=b.protein_id and a.layer=b.layer and a.feature=b.feature and b.pos-a.pos between 1 and 12 group by all) c
 on c.layer=g.layer and c.feature=g.feature and c.lag=g.lag)""")
def _(s, p):
    return N.periodicity_of(N.active_places_of(S.activations_vec(s, p)))


@query("Q30_count_modes")
def _(s, p):
    return N.count_modes(S.activations(s, p))


def rec_sql(n):
    v = lambda a: "(" + "+".join(f"{a}.v{k}*b.v{k}" for k in range(n)) + ")"
    cols = ", ".join(f"lead(v,{k}) over w as v{k}" if k else "v as v0" for k in range(n))
    return f"""select layer, feature, case when max(c)>2 then max(c)/{26 - n}.0::double else 0 end as s from (select a.layer, a.feature, a.pos, sum(({v('a')}>0.8)::int) as c from (select layer, feature, pos, {cols} from mk window w as (partition by layer, feature order by pos)) a
 join (select layer, feature, pos, {cols} from mk window w as (partition by layer, feature order by pos)) b on a.layer=b.layer and a.feature=b.feature and a.v{n - 1} is not null and b.v{n - 1} is not null group by all) group by all"""


RECU = "(select layer, feature, max(s) as recurrence from (" + " union all ".join(rec_sql(n) for n in (3, 4, 5)) + ") group by all)"
MK = "mk as materialized (select layer, feature, pos, avg((abs(value)>0.1)::int) as v from act group by all)"


@query("Q33_recurring_patterns", f"select * from {RECU}", "act", d="recurrence", extra=MK)
def _(s, p):
    return N.recurring_patterns(S.activations(s, p))


@query("Q35_statistical_novelty")
def _(s, p):
    return N.statistical_novelty(S.activations(s, p)).drop("evidence")


PN = f"""pn as materialized (select layer, feature, (a+b+c+d)/(na+nb+nc+nd) as novelty_score, na+nb+nc+nd as k from (select q.layer, q.feature, case when specificity>0.7 then specificity else 0 end as a, (specificity>0.7)::int as na,
 case when w.score>0.6 then w.score else 0 end as b, coalesce((w.score>0.6)::int,0) as nb, case when recurrence>0.5 then recurrence else 0 end as c, (recurrence>0.5)::int as nc, case when conservation<0.3 or conservation>0.9 then abs(conservation-0.5)*2 else 0 end as d, (conservation<0.3 or conservation>0.9)::int as nd
 from {SPEC} q join (select layer, feature from act group by all having max(abs(value))>=0.1) using (layer, feature) left join {COENT} w on w.feature=q.feature join {RECU} r on r.layer=q.layer and r.feature=q.feature join {ACONS} c on c.layer=q.layer and c.feature=q.feature) where na+nb+nc+nd>0)"""


@query("Q36_pattern_novelty", "select layer, feature, novelty_score, 0.7::double as confidence from pn where novelty_score>0.4", "act", d="novelty_score confidence", extra=",".join([COACT, MK, PN]))
def _(s, p):
    act = S.activations(s, p)
    return N.pattern_novelty(act, A.coactivation_entropy(A.coactivation(S.activations_vec(s, p)))).select("layer", "feature", "novelty_score", "confidence")


@query("Q38_structural_novelty")
def _(s, p):
    return N.structural_novelty(S.activations(s, p), S.coords(s, p)).drop("evidence")


def known_motifs(s, p):
    return S.activations(s, p).select("feature").distinct().filter("feature % 16 = 3").withColumn("motif", F.lit("zinc_finger"))


def discoveries(s, p):
    act = S.activations(s, p)
    return N.pattern_novelty(act, A.coactivation_entropy(A.coactivation(S.activations_vec(s, p))))


Q39 = """vd as (select layer, feature, case when feature%16=3 then novelty_score*0.5 else novelty_score end as novelty_score, case when feature%16=3 then 0.7::double else 0.7::double*0.8::double*(0.5+0.5::double*novelty_score) end as confidence from pn where novelty_score>0.4)"""


@query("Q39_validate_discoveries", "select layer, feature, novelty_score, confidence from vd where novelty_score>0.3 and confidence>0.4", "act", d="novelty_score confidence", extra=",".join([COACT, MK, PN, Q39]))
def _(s, p):
    return N.validate_discoveries(discoveries(s, p), known_motifs(s, p)).select("layer", "feature", "novelty_score", "confidence")


@query("T10_rank_discoveries", "select layer, feature, novelty_score*0.7::double as combined from pn where novelty_score>0.4", "act", d="combined", extra=",".join([COACT, MK, PN]))
def _(s, p):
    return N.rank_discoveries(discoveries(s, p)).select("layer", "feature", "combined")


@query("P23_annotate_discoveries", """select layer, feature, case when novelty_score*0.7>0.7 then 'high' else 'medium' end as priority, 'position-dependent function' as hypothesis from pn where novelty_score>0.4 """, "act", extra=",".join([COACT, MK, PN]))
def _(s, p):
    return N.annotate_discoveries(discoveries(s, p)).select("layer", "feature", "priority", "hypothesis")


@query("A46_discovery_summary", """select discovery_type, count(*) as n, avg(novelty_score) as avg_novelty, avg(0.7::double) as avg_confidence, 0::bigint as n_confident, sum((novelty_score*0.7>0.8)::int) as n_combined from (select *, 'pattern' as discovery_type from pn where novelty_score>0.4) group by rollup(discovery_type)""",
       "act", d="avg_novelty avg_confidence", i="n_combined", extra=",".join([COACT, MK, PN]))
def _(s, p):
    return N.discovery_summary(discoveries(s, p))


@query("C12_evaluate_novelty")
def _(s, p):
    act = S.activations(s, p)
    co = A.coactivation_entropy(A.coactivation(S.activations_vec(s, p)))
    return N.evaluate_novelty(act, co, S.coords(s, p), known_motifs(s, p)).drop("evidence", "biological_context")


# layout ------------------------------------------------------------------------------------


@query("J1_assemble", """select a.protein_id, a.pos, a.layer, a.s, t.aa, t.ss, c.x, length(p.sequence) as length from (select protein_id, pos, layer, sum(value) as s from act group by all) a left join tok t using (protein_id, pos) left join coords c using (protein_id, pos) left join prot p using (protein_id)""", "act tok coords prot", d="s x")
def _(s, p):
    j = L.assemble(S.proteins(s, p).select("protein_id", "sequence"), S.activations_vec(s, p), S.coords(s, p), S.token_residues(s, p))
    return j.select("protein_id", "pos", "layer", V.asum("vec").alias("s"), "aa", "ss", "x", F.length("sequence").alias("length"))


@query("P10_fill_missing", """select p.protein_id, coalesce(c.x,0) as x, c.x is not null as has_structure from prot p left join (select protein_id, avg(x) as x from coords group by all) c using (protein_id)""", "prot coords", d="x")
def _(s, p):
    c = S.coords(s, p).groupBy("protein_id").agg(F.avg("x").alias("x"))
    return L.fill_missing(S.proteins(s, p).select("protein_id").join(c, "protein_id", "left"), ["x"])


@query("P12_pad_export", "select protein_id, layer, count(distinct pos) as length, 30 as padded, sum(value) as total from (select *, dense_rank() over (partition by protein_id, layer order by pos) as k from act) where k<=30 group by all", "act", d="total", i="length padded")
def _(s, p):
    e = L.pad_export(S.activations_vec(s, p), 30)
    return e.select("protein_id", "layer", "length", F.size("rows").alias("padded"), F.aggregate("rows", F.lit(0.0), lambda a, r: a + F.aggregate(r, F.lit(0.0), lambda b, v: b + v)).alias("total"))


@query("P13_active", "select * from act where abs(value)>0.1", "act", d="value")
def _(s, p):
    return A.active_rows(S.activations(s, p))


@query("P14_l2_normalize", "select protein_id, pos, layer, feature, value/greatest(sqrt(sum(value*value) over (partition by protein_id, pos, layer)), 1e-12) as value from act", "act", d="value")
def _(s, p):
    return S.to_long(L.l2_normalize(S.activations_vec(s, p)))


@query("P15_strip_special", "select protein_id, pos-1 as pos, layer, sum(value) as s from act where pos between 1 and 20 group by all", "act", d="s")
def _(s, p):
    v = S.activations_vec(s, p)
    n = v.select("protein_id").distinct().withColumn("length", F.lit(20))
    return L.strip_special(v, n).select("protein_id", "pos", "layer", V.asum("vec").alias("s"))


@query("P16_select_layers", "select protein_id, pos, layer, sum(value) as s from act where layer in (1,2,3,4,5,6) group by all", "act", d="s")
def _(s, p):
    return L.select_layers(S.activations_vec(s, p), preset="8M").select("protein_id", "pos", "layer", V.asum("vec").alias("s"))


@query("S8_complete_layers", "select t.protein_id, t.pos, l.layer, coalesce(a.s,0) as s from (select distinct protein_id, pos from act) t cross join range(6) l(layer) left join (select protein_id, pos, layer, sum(value) as s from act group by all) a on a.protein_id=t.protein_id and a.pos=t.pos and a.layer=l.layer", "act", d="s")
def _(s, p):
    return L.complete_layers(S.activations_vec(s, p), list(range(6)), S.WIDTH).select("protein_id", "pos", "layer", V.asum("vec").alias("s"))


@query("S9_head_proteins", "select protein_id, pos, layer, sum(value) as s from act where protein_id in (select distinct protein_id from act order by protein_id limit 5) group by all", "act", d="s")
def _(s, p):
    return L.head_proteins(S.activations_vec(s, p), 5).select("protein_id", "pos", "layer", V.asum("vec").alias("s"))


@query("S13_merge_embeddings", "select protein_id, layer, sum(value) as s, count(*) as n from act where layer=(case when protein_id in (select doc_id from labels) then 0 else 1 end) group by all", "act", d="s")
def _(s, p):
    a = S.activations(s, p)
    labelled = S.table(s, p, "labels").select(F.col("doc_id").alias("protein_id"))
    m = L.merge_embeddings([a.filter("layer = 0").join(labelled, "protein_id", "left_semi"), a.filter("layer = 1")])
    return m.groupBy("protein_id", "layer").agg(F.sum("value").alias("s"), F.count("*").alias("n"))


@query("S14_export_dictionary", "select vec_id as feature_id, " + ", ".join(f"embedding[{k + 1}]::double as dim_{k}" for k in range(64)) + " from embeddings", d=" ".join(f"dim_{k}" for k in range(64)))
def _(s, p):
    e = S.table(s, p, "embeddings").select(F.col("vec_id").alias("feature"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    return L.export_dictionary(e, 64)


DW = "dw as materialized (select label as feature, g.k, avg(embedding[g.k+1]::double) as w from embeddings, range(64) g(k) group by all)"
ENC = "enc as materialized (select protein_id, pos, layer, dw.feature, sum(value*w)-0.01::double as value from act join dw on dw.k=act.feature group by all having sum(value*w)-0.01::double>0)"


def dictionary(s, p):
    e = S.table(s, p, "embeddings").select(F.col("label").alias("feature"), F.posexplode("embedding").alias("k", "v"))
    m = e.groupBy("feature", "k").agg(F.avg(F.col("v").cast("double")).alias("w"))
    return m.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x.w).alias("row")).withColumn("bias", F.lit(-0.01))


@query("P22_dict_encode", "select * from enc", "act", d="value", extra=DW + "," + ENC)
def _(s, p):
    return L.dict_encode(S.activations_vec(s, p), dictionary(s, p))


@query("P22_dict_decode", "select protein_id, pos, layer, dw.k as feature, sum(value*w) as value from enc join dw on dw.feature=enc.feature group by all", "act", d="value", extra=DW + "," + ENC)
def _(s, p):
    w = dictionary(s, p)
    return S.to_long(L.dict_decode(L.dict_encode(S.activations_vec(s, p), w), w))


@query("S7_read_proteins", "select protein_id, length(sequence) as length, lang, source from prot", "prot")
def _(s, p):
    return S.proteins(s, p).select("protein_id", F.length("sequence").alias("length"), "lang", "source")


@query("S18_read_structures", """select p.protein_id, r.pos, coalesce(c.x,0) as x, c.x is not null as has_structure from (select protein_id, unnest(range(length(sequence))) as pos from tprot) r join tprot p using (protein_id) left join coords c on c.protein_id=p.protein_id and c.pos=r.pos""", "tprot coords", d="x")
def _(s, p):
    from ..sources.readers import structures_for
    prot = S.token_proteins(s, p)
    return structures_for(prot, S.coords(s, p)).select("protein_id", "pos", "x", "has_structure")


# probes ------------------------------------------------------------------------------------


def per_layer(s, p, fit):
    """``fit`` of the vectors of every layer, with the layer."""
    v = S.activations_vec(s, p)
    layers = [r.layer for r in v.select("layer").distinct().orderBy("layer").collect()]
    return reduce(DataFrame.unionByName, [fit(v.filter(F.col("layer") == k).drop("layer")).withColumn("layer", F.lit(k)) for k in layers])


@query("M1_linear_probe_class")
def _(s, p):
    lab = S.token_residues(s, p).select("protein_id", "pos", "label")
    return per_layer(s, p, lambda v: ml.linear_probe(ml.probe_input(v, lab, ["protein_id", "pos"])))


@query("M1_linear_probe_domain")
def _(s, p):
    lab = S.token_residues(s, p).select("protein_id", "pos", (F.col("conservation") > 0.5).cast("int").alias("label"))
    return per_layer(s, p, lambda v: ml.linear_probe(ml.probe_input(v, lab, ["protein_id", "pos"])))


@query("M2_pca")
def _(s, p):
    return per_layer(s, p, lambda v: ml.pca(v, 2).select("protein_id", "pos", F.abs(F.col("pc")[0]).alias("pc1"), F.abs(F.col("pc")[1]).alias("pc2")))


# composites --------------------------------------------------------------------------------


@query("C2_transition_report")
def _(s, p):
    v, a = S.activations_vec(s, p), S.activations(s, p)
    r = A.activation_rate(a).select(F.col("layer").alias("la"), F.col("feature").alias("i"), "activation_rate")
    return P.info_flow_median(v).join(r, "la").select("la", "i", "information_flow", "activation_rate")


@query("C9_infer_causality")
def _(s, p):
    v = S.activations_vec(s, p)
    direct = P.pairwise_causality(v)
    med = P.mediation(direct, P.covariances(v), 0.3)
    return P.causal_edges(P.union_relations(direct=direct, mediated=med, temporal=P.temporal_causality(v)))


@query("C10_all_metrics")
def _(s, p):
    v, a = S.activations_vec(s, p), S.activations(s, p)
    wide = A.sparsity_metrics(a).join(F.broadcast(A.feature_entropy(a))).join(F.broadcast(A.dead_ratio(a))).join(F.broadcast(P.mean_abs_correlation(v))).join(F.broadcast(P.conservation_correlation(v, S.token_residues(s, p)).select(F.col("value").alias("conservation_correlation"))))
    kv = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in wide.columns]))
    return wide.select(kv.alias("m")).select("m.*").unionByName(A.interpretability_score(v, a, A.coactivation(v), A.feature_cosines(v)))
