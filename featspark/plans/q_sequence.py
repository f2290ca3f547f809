"""Queries: sequences and residues, on whole document texts and on the activation tokens."""

from pyspark.sql import functions as F

from ..functions import tables as K
from ..operators import sequence as Q
from ..sources import views as S
from .registry import query

PROPS = "kd hopp_woods charge charge_coarse weight dalton volume helix sheet flexibility donors acceptors".split()
PT = "pt as (select * from (values " + ", ".join(
    f"('{a}', {K.KYTE_DOOLITTLE[a]}::double, {K.HOPP_WOODS[a]}::double, {K.CHARGE.get(a, 0.0)}::double, {K.CHARGE_COARSE.get(a, 0.0)}::double, {K.WEIGHT[a]}::double, {K.DALTON[a]}::double, "
    f"{K.VOLUME[a]}::double, {K.HELIX[a]}::double, {K.SHEET[a]}::double, {K.FLEXIBILITY[a]}::double, {K.DONOR_COUNT.get(a, 0)}, {K.ACCEPTOR_COUNT.get(a, 0)})" for a in K.AMINO) + f") t(aa, {', '.join(PROPS)}))"


def in_list(s):
    return ", ".join(f"'{x}'" for x in s)


@query("P1_filter_split", "select protein_id, lang as split, length(sequence) as length from prot where lang='en'", "prot")
def _(s, p):
    return Q.filter_split(S.proteins(s, p).withColumnRenamed("lang", "split"), "en").select("protein_id", "split", F.length("sequence").alias("length"))


@query("P2_truncate", "select protein_id, length(substr(sequence,1,1022)) as length, md5(substr(sequence,1,1022)) as digest from prot", "prot")
def _(s, p):
    return Q.truncate_seq(S.proteins(s, p)).select("protein_id", F.length("sequence").alias("length"), F.md5("sequence").alias("digest"))


@query("P3_filter_len", "select protein_id, length(sequence) as length from prot where length(sequence)<=1022", "prot")
def _(s, p):
    return Q.filter_len(S.proteins(s, p)).select("protein_id", F.length("sequence").alias("length"))


@query("P4_valid_sequence", "select doc_id, regexp_matches(upper(text), '^[ACDEFGHIKLMNPQRSTVWY]*$') as valid_text, true as valid_clean from documents where doc_id in (select protein_id from prot)", "prot")
def _(s, p):
    d = S.table(s, p, "documents").select("doc_id", Q.valid_sequence("text").alias("valid_text"))
    c = S.proteins(s, p).select(F.col("protein_id").alias("doc_id"), Q.valid_sequence("sequence").alias("valid_clean"))
    return d.join(c, "doc_id")


@query("P5_residues", "select protein_id, aa, count(*) as n, sum(pos) as pos_sum from res group by all", "res", i="pos_sum")
def _(s, p):
    return Q.residues(S.proteins(s, p)).groupBy("protein_id", "aa").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


PSQL = ", ".join(f"avg({c}) as {c}" for c in PROPS) + ", avg(kd/5.0::double) as kd_signed, avg((kd+5)/10.0::double) as kd_unit, avg(dalton/200.0::double) as size_dalton, avg(volume/250.0::double) as size_volume"
PCOLS = PROPS + ["kd_signed", "kd_unit", "size_dalton", "size_volume"]


@query("P6_residue_properties", f"select protein_id, {PSQL} from res join pt using (aa) group by protein_id", "res", d=" ".join(PCOLS), extra=PT)
def _(s, p):
    return Q.residue_properties(S.residues(s, p)).groupBy("protein_id").agg(*[F.avg(c).alias(c) for c in PCOLS])


@query("P7_charge_class", "select protein_id, sum((charge>0)::int) as positive, sum((charge<0)::int) as negative, sum((charge=0)::int) as neutral from res join pt using (aa) group by protein_id",
       "res", i="positive negative neutral", extra=PT)
def _(s, p):
    return Q.charge_class(S.residues(s, p)).groupBy("protein_id").agg(*[F.sum(c).alias(c) for c in ("positive", "negative", "neutral")])


@query("P8_encode_ss", "select protein_id, pos, " + ", ".join(f"(ss='{c}')::int as s{k}" for k, c in enumerate(K.SS8)) + " from tok", "tok", i=" ".join(f"s{k}" for k in range(8)))
def _(s, p):
    e = S.token_residues(s, p).select("protein_id", "pos", Q.encode_ss("ss").alias("e"))
    return e.select("protein_id", "pos", *[F.col("e")[k].alias(f"s{k}") for k in range(8)])


TERMS = """terms as (select doc_id as protein_id, 'lang' as kind, lang as term from documents union all select doc_id, 'source', source from documents union all
 select doc_id, 'flag', 'quality' from labels where quality=1 union all select doc_id, 'flag', 'toxic' from labels where toxic=1),
vocab as (select kind, term, row_number() over (partition by kind order by term)-1 as idx from (select distinct kind, term from terms))"""


def terms_of(s, p):
    d, lab = S.table(s, p, "documents"), S.table(s, p, "labels")
    one = lambda df, kind, col: df.select(F.col("doc_id").alias("protein_id"), F.lit(kind).alias("kind"), col.alias("term"))
    return (one(d, "lang", F.col("lang")).unionByName(one(d, "source", F.col("source"))).unionByName(one(lab.filter("quality = 1"), "flag", F.lit("quality")))
            .unionByName(one(lab.filter("toxic = 1"), "flag", F.lit("toxic"))))


@query("A18_build_vocab", "select * from vocab", extra=TERMS, i="idx")
def _(s, p):
    return Q.build_vocab(terms_of(s, p))


@query("P9_encode_terms", """select protein_id, coalesce(array_to_string(list_sort(list(idx)), ','), '') as indices from (select distinct t.protein_id, v.idx from terms t left join (select term, idx from vocab where kind='source') v on v.term=t.term)
 group by protein_id""", extra=TERMS)
def _(s, p):
    t = terms_of(s, p)
    v = Q.build_vocab(t).filter("kind = 'source'").select("term", "idx")
    return Q.encode_terms(t, v).select("protein_id", F.array_join("indices", ",").alias("indices"))


@query("P11_parse_domains", """select protein_id, "start", "end", domain_id from domains where "end">"start" """, "domains")
def _(s, p):
    d = S.domains(s, p).select("protein_id", F.format_string("%d-%d:%s;junk", "start", "end", "domain_id").alias("txt"))
    x = d.select("protein_id", F.explode(Q.parse_domains("txt")).alias("d")).select("protein_id", "d.*")
    return x.filter("end > start")


@query("P18_hbond_sites", f"""select protein_id, sum((aa in ({in_list(K.DONOR_SIDE)}) or pos>0)::int) as donors, sum((aa in ({in_list(K.ACCEPTOR_SIDE)}) or pos<last)::int) as acceptors
 from (select *, max(pos) over (partition by protein_id) as last from res) group by protein_id""", "res", i="donors acceptors")
def _(s, p):
    h = Q.hbond_sites_of(S.proteins(s, p))
    return h.groupBy("protein_id").agg(F.sum(F.col("donor").cast("int")).alias("donors"), F.sum(F.col("acceptor").cast("int")).alias("acceptors"))


@query("W20_assign_split", """select protein_id, case when rn<=floor(n*0.8) then 'train' when rn<=floor(n*0.8)+floor(n*0.1) then 'val' else 'test' end as split
 from (select protein_id, row_number() over (order by md5(protein_id||'-42'), protein_id) as rn, count(*) over () as n from prot)""", "prot")
def _(s, p):
    return Q.assign_split(S.proteins(s, p).select("protein_id"))


@query("J5_in_domain", """select r.protein_id, d.domain_id, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from res r join domains d on d.protein_id=r.protein_id and pos>=d."start" and pos<d."end" group by all""",
       "res domains")
def _(s, p):
    d = S.domains(s, p).filter("end > start")
    return Q.in_region_of(S.proteins(s, p), d).groupBy("protein_id", "domain_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


RUNS = """(select protein_id, min(pos) as "start", max(pos)+1 as "end", count(*) as length{x} from (select *, pos-row_number() over (partition by protein_id order by pos) as g from {src} where {cond}) group by protein_id, g having count(*)>={n})"""


@query("W2_runs", "select * from " + RUNS.format(x="", src="res", cond="ss in ('H','G','I')", n=3), "res")
def _(s, p):
    return Q.runs_of(S.states(s, p), "HGI", 3)


@query("W2_hydrophobic_clusters", "select c.* from " + RUNS.format(x=", avg(kd_unit) as score", src="(select r.*, (kd+5)/10.0::double as kd_unit from res r join pt using (aa))", cond="kd_unit>0.6", n=3)
       + """ c join (select protein_id, max(pos) as last from res group by protein_id) l using (protein_id) where c."end"<=l.last""", "res", d="score", extra=PT)
def _(s, p):
    return Q.hydrophobic_runs_of(S.proteins(s, p))


@query("W3_transitions", "select protein_id, from_state, ss as to_state, count(*) as n from (select protein_id, ss, lag(ss) over (partition by protein_id order by pos) as from_state from res) where from_state<>ss group by all", "res")
def _(s, p):
    return Q.transition_counts_of(S.states(s, p))


@query("W5_disorder_windows", f"""select protein_id, count(*) as n_windows, min(pos) as first_start, sum(k) as k_sum from (select protein_id, pos, sum((aa in ({in_list(K.DISORDER)}))::int) over (partition by protein_id order by pos rows between current row and 19 following) as k,
 max(pos) over (partition by protein_id) as last from res) where k>12 and pos+20<=last group by protein_id""", "res", i="k_sum")
def _(s, p):
    return Q.disorder_windows(S.proteins(s, p)).groupBy("protein_id").agg(F.count("*").alias("n_windows"), F.min("start").alias("first_start"), F.sum("k").alias("k_sum"))


@query("W6_hydrophobic_moment", """select protein_id, count(*) as n_windows, avg(m) as avg_moment, max(m) as max_moment from (select protein_id, pos, sqrt(x*x+y*y)/11 as m from (select protein_id, pos, """ +
       "+".join(f"lead(kd,{j}) over w*cos(radians({j}*100))" for j in range(11)) + " as x, " + "+".join(f"lead(kd,{j}) over w*sin(radians({j}*100))" for j in range(11)) +
       " as y from res join pt using (aa) window w as (partition by protein_id order by pos)) where x is not null) group by protein_id", "res", d="avg_moment max_moment", extra=PT)
def _(s, p):
    return Q.hydrophobic_moment(S.proteins(s, p)).groupBy("protein_id").agg(F.count("*").alias("n_windows"), F.avg("moment").alias("avg_moment"), F.max("moment").alias("max_moment"))


def span_sql(src, name, pat):
    return f"""select protein_id, '{name}' as pattern, e-length(h) as "start", e as "end" from (select protein_id, h, sum(length(g)+length(h)) over (partition by protein_id order by k) as e from
 (select protein_id, unnest(string_split_regex(sequence, '{pat}')[:-2]) as g, unnest(regexp_extract_all(sequence, '{pat}')) as h, unnest(range(len(regexp_extract_all(sequence, '{pat}')))) as k from {src}))"""


ALLPAT = {**K.BINDING_PATTERNS, **K.DOMAIN_PATTERNS, **K.STRUCTURAL_PATTERNS, **{f"ptm_{k}": v for k, v in K.PTM_PATTERNS.items()}}
for _group, _pats in {"binding": K.BINDING_PATTERNS, "domain": K.DOMAIN_PATTERNS, "structural": K.STRUCTURAL_PATTERNS, "ptm": K.PTM_PATTERNS}.items():
    @query(f"F3_regex_spans_{_group}", "select protein_id, pattern, count(*) as n, sum(\"start\") as start_sum, sum(\"end\") as end_sum from (" + " union all ".join(span_sql("prot", n, x) for n, x in _pats.items()) + ") group by all",
           "prot", i="start_sum end_sum")
    def _(s, p, pats=_pats):
        r = Q.regex_spans(S.proteins(s, p).select("protein_id", "sequence"), pats)
        return r.groupBy("protein_id", "pattern").agg(F.count("*").alias("n"), F.sum("start").alias("start_sum"), F.sum("end").alias("end_sum"))


@query("A42_charge_distribution", """select protein_id, p as positive_fraction, n as negative_fraction, p-n as net_charge from (select protein_id, avg((charge>0)::int) as p, avg((charge<0)::int) as n from res join pt using (aa) group by protein_id)""",
       "res", d="positive_fraction negative_fraction net_charge", extra=PT)
def _(s, p):
    return Q.charge_distribution(S.residues(s, p))


SSQ = """with c as (select *, instr('HBEGITS-', ss)-1 as code from res), r as (select protein_id, kind, count(*) as length from (select protein_id, kind, pos-row_number() over (partition by protein_id, kind order by pos) as g from
 (select protein_id, pos, case when code in (0,3,4) then 'h' when code in (1,2) then 's' end as kind from c) where kind is not null) group by protein_id, kind, g),
 v as (select protein_id, avg(case when kind='h' then (length>=4)::int end) as hv, avg(case when kind='s' then (length>=3)::int end) as sv from r group by protein_id),
 b as (select protein_id, count(*) as length, avg((code=0)::int) as helix_fraction, avg((code=2)::int) as sheet_fraction, avg((code=7)::int) as coil_fraction, count(distinct code) as kinds, sum(chg) as changes from
 (select *, coalesce((lag(code) over (partition by protein_id order by pos)<>code)::int,0) as chg from c) group by protein_id)
select b.protein_id, b.length, helix_fraction, sheet_fraction, coil_fraction, coalesce(hv,0) as valid_helix, coalesce(sv,0) as valid_sheet, kinds/8.0::double*changes/b.length as complexity,
 coalesce(changes::double/nullif(b.length-1,0),0) as transition_rate from b left join v using (protein_id)"""


@query("A43_ss_quality", SSQ, "res", d="helix_fraction sheet_fraction coil_fraction valid_helix valid_sheet complexity transition_rate")
def _(s, p):
    return Q.ss_quality_of(S.states(s, p))


@query("B10_sequence_motifs", """select protein_id, motif, count(*) as n, sum(pos) as pos_sum from (select protein_id, pos, 'zinc_finger' as motif from l where aa='C' and a3='C' union all
 select protein_id, pos, 'phosphorylation_site' from l where aa in ('S','T') and a2 in ('D','E','K','R')) group by all""", "res", i="pos_sum",
       extra="l as (select protein_id, pos, aa, lead(aa,2) over w as a2, lead(aa,3) over w as a3 from res window w as (partition by protein_id order by pos))")
def _(s, p):
    return Q.sequence_motifs(S.proteins(s, p)).groupBy("protein_id", "motif").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("B10_property_motifs", """select protein_id, count(*) as n, sum(pos) as pos_sum, avg(conf) as confidence from (select protein_id, pos, ((abs(c0)>=1)::int+(v1<100)::int+(abs(c2)>=1)::int)/3.0::double as conf from
 (select protein_id, pos, charge as c0, lead(volume,1) over w as v1, lead(charge,2) over w as c2 from res join pt using (aa) window w as (partition by protein_id order by pos)) where c2 is not null) where conf>0.7 group by protein_id""",
       "res", d="confidence", i="pos_sum", extra=PT)
def _(s, p):
    return Q.property_motifs(S.proteins(s, p)).groupBy("protein_id").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.avg("confidence").alias("confidence"))


def ssm_sql(src):
    out = []
    for name, pat in K.SS_MOTIFS.items():
        ok = " and ".join(f"s{k} in ({in_list(Q.GROUPS[ch])})" for k, ch in enumerate(pat))
        conf = "(" + "+".join(f"(s{k}='{ch}')::int" for k, ch in enumerate(pat)) + f")/{len(pat)}.0::double"
        out.append(f"""select protein_id, '{name}' as motif, pos as "start", pos+{len(pat)} as "end", {conf} as confidence from l where {ok} and {conf}>=0.7""")
    return " union all ".join(out)


LEADS = "l as (select protein_id, pos, ss as s0, " + ", ".join(f"lead(ss,{k}) over w as s{k}" for k in range(1, 6)) + " from {src} window w as (partition by protein_id order by pos))"


@query("B11_ss_motifs", ssm_sql("res"), "res", d="confidence", extra=LEADS.format(src="res"))
def _(s, p):
    return Q.ss_motifs_of(S.states(s, p))


@query("W22_remove_overlaps")
def _(s, p):
    return Q.ss_motifs_of(S.states(s, p), overlaps=False)


@query("J6_variant_sites", """select r.protein_id, pos, aa, v.mut, v.cls as class from res r join (values (53,'R','H','pathogenic'),(175,'R','H','pathogenic'),(72,'P','R','benign')) v(vpos, wt, mut, cls) on v.vpos=r.pos and v.wt=r.aa""", "res")
def _(s, p):
    v = s.createDataFrame(K.VARIANTS, "pos int, wt string, mut string, disease string, class string")
    return Q.variant_sites_of(S.proteins(s, p), v).select("protein_id", "pos", "aa", "mut", "class")


@query("B18_property_correlation", "select layer, feature, corr(value, (kd+5)/10) as corr, count(*) as n from act join tok using (protein_id, pos) join pt using (aa) where kd<>-5 group by all having count(*)>10".replace("corr(value, (kd+5)/10)", "case when not isnan(corr(value, (kd+5)/10)) then corr(value, (kd+5)/10) end"),
       "act tok", d="corr", extra=PT)
def _(s, p):
    return Q.property_correlation(S.activations(s, p), S.token_residues(s, p).select("protein_id", "pos", "aa"))


@query("C7_property_patterns", """select a.protein_id, a.positive_fraction, a.negative_fraction, a.net_charge, coalesce(n_clusters,0) as n_clusters, avg_cluster, avg_score, coalesce(h.n,0) as helix_regions, coalesce(e.n,0) as sheet_regions, coalesce(t.n,0) as n_transitions
 from (select protein_id, avg((charge>0)::int) as positive_fraction, avg((charge<0)::int) as negative_fraction, avg((charge>0)::int)-avg((charge<0)::int) as net_charge from res join pt using (aa) group by protein_id) a
 left join (select c.protein_id, count(*) as n_clusters, avg(length) as avg_cluster, avg(score) as avg_score from """ + RUNS.format(x=", avg(kd_unit) as score", src="(select r.*, (kd+5)/10.0::double as kd_unit from res r join pt using (aa))", cond="kd_unit>0.6", n=3) +
       """ c join (select protein_id, max(pos) as last from res group by protein_id) l using (protein_id) where c."end"<=l.last group by c.protein_id) k using (protein_id)
 left join (select protein_id, count(*) as n from """ + RUNS.format(x="", src="res", cond="ss='H'", n=3) + """ group by protein_id) h using (protein_id)
 left join (select protein_id, count(*) as n from """ + RUNS.format(x="", src="res", cond="ss='E'", n=3) + """ group by protein_id) e using (protein_id)
 left join (select protein_id, count(*) as n from (select protein_id, ss, lag(ss) over (partition by protein_id order by pos) as f from res) where f<>ss group by protein_id) t using (protein_id)""", "res",
       d="positive_fraction negative_fraction net_charge avg_cluster avg_score", extra=PT)
def _(s, p):
    return Q.property_patterns_of(S.states(s, p))


@query("A49_level_summary", """select a.protein_id, property_share, structure_share, domain_share from (select protein_id, avg((m>0.1)::int) as property_share from (select protein_id, feature, avg(abs(value)) as m from act group by all) group by protein_id) a
 join (select protein_id, count(distinct ss)/8.0::double as structure_share from tok group by protein_id) b using (protein_id) join (select protein_id, least(1, count(*)/5.0::double) as domain_share from tdom group by protein_id) c using (protein_id)""",
       "act tok tdom", d="property_share structure_share domain_share")
def _(s, p):
    return Q.level_summary(S.activations(s, p), S.token_residues(s, p), S.token_domains(s, p))
