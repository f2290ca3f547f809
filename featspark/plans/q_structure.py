"""Queries: alignments and 3-D structure."""

import math

from pyspark.sql import functions as F

from ..functions import tables as K
from ..operators import alignment as M
from ..operators import structure as T
from ..sources import views as S
from .q_sequence import PT
from .registry import query

CNT = "cnt as materialized (select family_id, col, aa, count(*) as n from cells group by all)"
WT = CNT + """, sh as materialized (select family_id, col, aa, case when count(*) over (partition by family_id, col)>1 then 1.0::double/(count(*) over (partition by family_id, col)*n) else 0 end as s from cnt),
sw as materialized (select family_id, seq_idx, w/sum(w) over (partition by family_id) as weight from (select family_id, seq_idx, sum(s) as w from cells join sh using (family_id, col, aa) group by all))"""
WC = WT + ", wc as materialized (select family_id, col, aa, sum(weight) as w from cells join sw using (family_id, seq_idx) group by all)"
CONS = WC + ", cons as materialized (select family_id, col, 1+sum(p*ln(p))/ln(20) as conservation from (select family_id, col, w/sum(w) over (partition by family_id, col) as p from wc) group by all)"
GAPS = "gaps as (select family_id, col, avg((aa='-')::int) as gap_freq, sum((aa<>'-')::int) as depth from cells group by all)"


def weights(s, p):
    return M.sequence_weights(S.msa_cells(s, p))


@query("A21_msa_profile", "select family_id, col, aa, n::double/sum(n) over (partition by family_id, col) as frequency from cnt", "cells", d="frequency", extra=CNT)
def _(s, p):
    return M.msa_profile(S.msa_cells(s, p))


@query("A22_sequence_weights", "select * from sw", "cells", d="weight", extra=WT)
def _(s, p):
    return weights(s, p)


PSSM = WC + """, ps as materialized (select family_id, col, aa, case when aa='-' then 0 else log2(v/sum(v) over (partition by family_id, col)/0.05) end as score from (select g.family_id, g.col, g.aa, coalesce(w,0)+0.01::double as v
 from (select * from (select distinct family_id, col from cells), (select unnest(string_split('ACDEFGHIKLMNPQRSTVWY-','')) as aa)) g left join wc using (family_id, col, aa)))"""


@query("A23_pssm", "select * from ps", "cells", d="score", extra=PSSM)
def _(s, p):
    return M.pssm(S.msa_cells(s, p), weights(s, p))


@query("A24_gap_stats", "select * from gaps", "cells", d="gap_freq", i="depth", extra=GAPS)
def _(s, p):
    return M.gap_stats(S.msa_cells(s, p))


@query("A25_conservation", "select * from cons", "cells", d="conservation", extra=CONS)
def _(s, p):
    return M.conservation(S.msa_cells(s, p), weights(s, p))


@query("A26_neff", "select family_id, exp(-sum(weight*ln(weight+1e-10))) as neff from sw group by family_id", "cells", d="neff", extra=WT)
def _(s, p):
    return M.neff(weights(s, p))


@query("A27_diversity", """select family_id, 1-avg(m/l) as diversity from (select a.family_id, a.seq_idx, b.seq_idx, sum((a.aa=b.aa and a.aa<>'-')::int)::double as m, sum((a.aa<>'-' or b.aa<>'-')::int) as l
 from cells a join cells b on a.family_id=b.family_id and a.col=b.col and a.seq_idx<b.seq_idx group by all) where l>0 group by family_id""", "cells", d="diversity")
def _(s, p):
    return M.diversity(S.msa_cells(s, p))


VC = """vc as materialized (select family_id, col, conservation, row_number() over (partition by family_id order by round(conservation,9), col) as "rank" from cons where conservation<0.9 qualify "rank"<=100)"""


@query("T11_variable_columns", "select * from vc", "cells", d="conservation", extra=CONS + "," + VC)
def _(s, p):
    return M.variable_columns(M.conservation(S.msa_cells(s, p), weights(s, p)))


JP = """jp as materialized (select a.family_id, a.col as c1, b.col as c2, a.aa as a1, b.aa as a2, sum(weight) as w, count(*) as n from cells a join vc va on va.family_id=a.family_id and va.col=a.col join cells b on a.family_id=b.family_id and a.seq_idx=b.seq_idx and a.col<b.col
 join vc vb on vb.family_id=b.family_id and vb.col=b.col join sw on sw.family_id=a.family_id and sw.seq_idx=a.seq_idx group by all)"""
MI = JP + """, mi as materialized (select family_id, c1, c2, sum(p*ln(p/(p1*p2))) as mi from (select family_id, c1, c2, w/sum(w) over (partition by family_id,c1,c2) as p, sum(w) over (partition by family_id,c1,c2,a1)/sum(w) over (partition by family_id,c1,c2) as p1,
 sum(w) over (partition by family_id,c1,c2,a2)/sum(w) over (partition by family_id,c1,c2) as p2 from jp) where p>0 group by all)"""
APC = MI + """, both_c as (select family_id, c1 as c, mi from mi union all select family_id, c2, mi from mi), rs as (select family_id, c, sum(mi)/64 as r from both_c group by all), ts as (select family_id, sum(mi)/4096 as t from both_c group by all),
sc as materialized (select mi.family_id, c1, c2, mi, greatest(0, mi-a.r*b.r/t) as score from mi join rs a on a.family_id=mi.family_id and a.c=c1 join rs b on b.family_id=mi.family_id and b.c=c2 join ts on ts.family_id=mi.family_id)"""
COEV = ",".join([CONS, VC, APC])


@query("J10_column_pairs", "select family_id, c1, c2, a1, a2, n from jp", "cells", extra=",".join([CONS, VC, JP]))
def _(s, p):
    c = S.msa_cells(s, p)
    return M.column_pairs(c, M.variable_columns(M.conservation(c, M.sequence_weights(c))))


def scores(s, p):
    c = S.msa_cells(s, p)
    return M.coevolution(c, M.sequence_weights(c))


def n_cols(s, p):
    return S.msa_cells(s, p).groupBy("family_id").agg((F.max("col") + 1).alias("n"))


@query("A28_coevolution", "select family_id, c1, c2, mi from sc", "cells", d="mi", extra=COEV)
def _(s, p):
    return scores(s, p).drop("score")


@query("A29_apc", "select family_id, c1, c2, score from sc", "cells", d="score", extra=COEV)
def _(s, p):
    return scores(s, p).drop("mi")


@query("P20_filter_alignment", """select c.family_id, c.seq_idx, k.nc as col, c.aa from cells c join (select family_id, col, row_number() over (partition by family_id order by col)-1 as nc from cells join (select family_id, min(seq_idx) as seq_idx from cells group by family_id)
 using (family_id, seq_idx) where aa<>'-') k using (family_id, col)""", "cells")
def _(s, p):
    c = S.msa_cells(s, p)
    return M.filter_alignment(c, c.groupBy("family_id").agg(F.min("seq_idx").alias("seq_idx")))


@query("P21_filter_gappy", "select c.* from cells c join gaps using (family_id, col) where gap_freq<=0.02", "cells", extra=GAPS)
def _(s, p):
    return M.filter_gappy(S.msa_cells(s, p), 0.02)


ATT = """att as materialized (select a.protein_id, a.layer, a.pos as i, b.pos as j, exp(sum(a.value*b.value)) as w from act a join act b on a.protein_id=b.protein_id and a.layer=b.layer and a.feature=b.feature group by all)"""


@query("A30_attention_contacts", """select s.protein_id, s.i, s.j, w-a.r*b.r/t as score from (select a.protein_id, a.i, a.j, (a.w+b.w)/2 as w from m a join m b on a.protein_id=b.protein_id and a.i=b.j and a.j=b.i) s
 join r a on a.protein_id=s.protein_id and a.i=s.i join r b on b.protein_id=s.protein_id and b.i=s.j join (select protein_id, sum(r) as t from r group by all) t on t.protein_id=s.protein_id where s.j-s.i>=6""", "act", d="score",
       extra=ATT + ", m as materialized (select protein_id, i, j, avg(w) as w from att group by all), r as (select protein_id, i, sum(w) as r from m group by all)")
def _(s, p):
    from ..functions import vec as V
    v = S.activations_vec(s, p)
    a = v.select("protein_id", "layer", F.col("pos").alias("i"), F.col("vec").alias("x"))
    b = v.select("protein_id", "layer", F.col("pos").alias("j"), F.col("vec").alias("y"))
    att = a.join(b, ["protein_id", "layer"]).select("protein_id", "layer", F.lit(0).alias("head"), "i", "j", F.exp(V.dot("x", "y")).alias("w"))
    return M.attention_contacts(att)


NET = """ne as materialized (select family_id, c1 as s, c2 as d from sc where score>0.1), nu as materialized (select family_id, s, d from ne union select family_id, d, s from ne),
ndeg as (select family_id, s as col, count(*) as degree from nu group by all), ntri as (select a.family_id, a.s as col, count(*)/2 as t from nu a join nu b on a.family_id=b.family_id and a.d=b.s join nu c on c.family_id=a.family_id and c.s=b.d and c.d=a.s group by all)"""


@query("G2_coevolution_network", """select d.family_id, d.col, degree, coalesce(2*t::double/nullif(degree*(degree-1),0),0) as clustering, degree/63.0::double as centrality from ndeg d left join ntri using (family_id, col)""", "cells",
       d="clustering centrality", extra=COEV + "," + NET)
def _(s, p):
    return M.coevolution_network(scores(s, p), n_cols(s, p), 0.1)


@query("G2_contact_enrichment", """select e.family_id, coalesce(h,0)/(ne*nc/(64*63/2.0::double)+1e-10) as enrichment from (select family_id, count(*) as ne from ne group by all) e
 join (select family_id, count(*) as nc from ct group by all) c using (family_id) left join (select ne.family_id, count(*) as h from ne join ct on ct.family_id=ne.family_id and i=s and j=d group by all) q using (family_id)""", "cells", d="enrichment",
       extra=COEV + "," + NET + ", ct as (select distinct a.family_id, a.col as i, b.col as j from (select distinct family_id, col from cells) a join (select distinct family_id, col from cells) b on a.family_id=b.family_id and b.col-a.col between 3 and 6)")
def _(s, p):
    n = n_cols(s, p)
    sep = F.explode(F.sequence(F.lit(3), F.lit(6)))
    ct = n.select("family_id", "n", F.explode(F.expr("sequence(0, n - 1)")).alias("i")).select("family_id", "n", "i", sep.alias("o")).select("family_id", "n", "i", (F.col("i") + F.col("o")).alias("j")).filter("j < n").select("family_id", "i", "j")
    return M.contact_enrichment(scores(s, p), ct, n, 0.1)


@query("G3_modules", """select family_id, component, count(*) as size from (select family_id, n, min(r) as component from (select family_id, s as n, s as r from nu union select family_id, n, r from rc) group by all) group by all having count(*)>=3""",
       "cells", extra=COEV + "," + NET + ", rc as (select family_id, s as n, d as r from nu union select rc.family_id, rc.n, nu.d from rc join nu on nu.family_id=rc.family_id and nu.s=rc.r)")
def _(s, p):
    return M.modules(scores(s, p), 0.1, 3)


@query("C4_msa_features", """select c.family_id, c.col, conservation, gap_freq, depth, max_score, neff from cons c join gaps using (family_id, col) join (select family_id, col, max(score) as max_score from ps group by all) using (family_id, col)
 join (select family_id, exp(-sum(weight*ln(weight+1e-10))) as neff from sw group by family_id) using (family_id)""", "cells", d="conservation gap_freq max_score neff", i="depth",
       extra=PSSM + CONS[len(WC):] + "," + GAPS)
def _(s, p):
    return M.msa_features(S.msa_cells(s, p))


# structure ---------------------------------------------------------------------------------

DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
PAIRS = f"pr as materialized (select a.protein_id, a.pos as i, b.pos as j, {DIST} as distance from coords a join coords b on a.protein_id=b.protein_id and a.pos<b.pos)"
CONT = PAIRS + ", ct as materialized (select * from pr where distance<8 and j-i>=3)"
RQ = PT + ", rq as materialized (select protein_id, pos, aa, ss, charge as q, kd from tok join pt using (aa))"


@query("J4_contacts", "select * from ct", "coords", d="distance", extra=CONT)
def _(s, p):
    return T.contacts(S.coords(s, p))


@query("J4_distance_pairs", "select * from pr where distance<8", "coords", d="distance", extra=PAIRS)
def _(s, p):
    return T.contacts(S.coords(s, p), 8.0, 1)


@query("J9_salt_bridges", """select pr.protein_id, case when a.q>0 then i else j end as positive, case when a.q>0 then j else i end as negative, distance from pr join rq a on a.protein_id=pr.protein_id and a.pos=i join rq b on b.protein_id=pr.protein_id and b.pos=j
 where distance<4 and abs(a.q)>0.5 and abs(b.q)>0.5 and a.q*b.q<0""", "coords tok", d="distance", extra=PAIRS + "," + RQ)
def _(s, p):
    return T.salt_bridges(S.token_residues(s, p), S.coords(s, p))


def inl(x):
    return ", ".join(f"'{k}'" for k in x)


HB = PAIRS + f""", site as materialized (select protein_id, pos, aa in ({inl(K.DONOR_SIDE)}) or pos>0 as dn, aa in ({inl(K.ACCEPTOR_SIDE)}) or pos<24 as ac from tok),
hb as materialized (select pr.protein_id, i as donor, j as acceptor, distance from pr join site a on a.protein_id=pr.protein_id and a.pos=i join site b on b.protein_id=pr.protein_id and b.pos=j where distance>=2.5 and distance<=3.5 and j-i>=2 and a.dn and b.ac
 union all select pr.protein_id, j, i, distance from pr join site a on a.protein_id=pr.protein_id and a.pos=i join site b on b.protein_id=pr.protein_id and b.pos=j where distance>=2.5 and distance<=3.5 and j-i>=2 and b.dn and a.ac)"""


def hbonds(s, p):
    return T.hbond_pairs(S.token_residues(s, p), S.coords(s, p))


@query("J8_hbond_pairs", "select * from hb", "coords tok", d="distance", extra=HB)
def _(s, p):
    return hbonds(s, p)


@query("B14_hbond_geometry", "select *, exp(-distance/3.5::double) as dist_feat, 1.0::double as angle_feat, abs(acceptor-donor)/10.0::double as sep_feat from hb", "coords tok", d="distance dist_feat angle_feat sep_feat", extra=HB)
def _(s, p):
    return T.hbond_geometry(hbonds(s, p))


@query("A41_hbond_energy", "select protein_id, sum(exp(-distance/3.5::double))*-5 as energy, count(*) as n_bonds from hb group by all", "coords tok", d="energy", extra=HB)
def _(s, p):
    return T.hbond_energy(hbonds(s, p))


@query("B13_hbond_motifs", """select protein_id, case when h>=2 then h else 0 end as alpha_helix, case when s>=2 then s else 0 end as beta_sheet, t as beta_turn, coalesce(c,0) as helix_cap from (select protein_id, sum((acceptor-donor=4)::int) as h, sum((acceptor-donor>=5)::int) as s,
 sum((acceptor-donor=3)::int) as t from hb group by all) left join (select a.protein_id, count(*) as c from hb a join hb b on a.protein_id=b.protein_id and a.acceptor-a.donor=4 and a.donor>0 and b.donor=a.donor-1 and b.acceptor=a.donor+2 group by all) using (protein_id)""",
       "coords tok", i="alpha_helix beta_sheet beta_turn helix_cap", extra=HB)
def _(s, p):
    return T.hbond_motifs(hbonds(s, p))


@query("G5_network_properties")
def _(s, p):
    return T.hbond_network(hbonds(s, p), S.token_residues(s, p))


@query("A40_electrostatic_energy", """select t.protein_id, coalesce(e,0) as energy from (select distinct protein_id from tok) t left join (select pr.protein_id, sum(332.0::double*a.q*b.q/(80.0::double*distance/4*distance)) as e from pr
 join rq a on a.protein_id=pr.protein_id and a.pos=i join rq b on b.protein_id=pr.protein_id and b.pos=j where distance<15 and distance>0 group by all) using (protein_id)""", "coords tok", d="energy", extra=PAIRS + "," + RQ)
def _(s, p):
    return T.electrostatic_energy(S.token_residues(s, p), S.coords(s, p))


@query("A40_dipole", """select protein_id, t as net_charge, sqrt(dx*dx+dy*dy+dz*dz) as magnitude, dx/(sqrt(dx*dx+dy*dy+dz*dz)+1e-8) as dir_x, dy/(sqrt(dx*dx+dy*dy+dz*dz)+1e-8) as dir_y, dz/(sqrt(dx*dx+dy*dy+dz*dz)+1e-8) as dir_z from (select protein_id, t,
 qx-t*case when abs(t)>1e-6 then qx/t else mx end as dx, qy-t*case when abs(t)>1e-6 then qy/t else my end as dy, qz-t*case when abs(t)>1e-6 then qz/t else mz end as dz from (select protein_id, sum(q) as t, sum(q*x) as qx, sum(q*y) as qy, sum(q*z) as qz,
 avg(x) as mx, avg(y) as my, avg(z) as mz from coords join rq using (protein_id, pos) group by all))""", "coords tok", d="net_charge magnitude dir_x dir_y dir_z", extra=RQ)
def _(s, p):
    return T.dipole(S.token_residues(s, p), S.coords(s, p))


def clampacos(e):
    return f"acos(greatest(-1, least(1, {e})))"


BB = """nb as (select protein_id, pos, x-lag(x) over w as ax, y-lag(y) over w as ay, z-lag(z) over w as az, lead(x) over w-x as bx, lead(y) over w-y as by_, lead(z) over w-z as bz from coords window w as (partition by protein_id order by pos)),
nl as (select *, sqrt(ax*ax+ay*ay+az*az) as la, sqrt(bx*bx+by_*by_+bz*bz) as lb, ax*bx+ay*by_+az*bz as d from nb),
bb as materialized (select protein_id, pos, lb as bond_length, coalesce(""" + clampacos("d/((la+1e-8)*(lb+1e-8))").replace("acos(greatest(-1, least(1, d", "case when la is not null and lb is not null then acos(greatest(-1, least(1, d") + """ end, 0) as curvature,
 case when la is not null and lb is not null then """ + clampacos("d/(la*lb+1e-8)") + """ end as bond_angle from nl)"""


@query("W9_backbone", "select * from bb", "coords", d="bond_length curvature bond_angle", extra=BB)
def _(s, p):
    return T.backbone(S.coords(s, p))


@query("W10_dihedrals", f"""select protein_id, pos, case when (n1y*n2z-n1z*n2y)*bx+(n1z*n2x-n1x*n2z)*by_+(n1x*n2y-n1y*n2x)*bz<0 then -a else a end as dihedral, a as unsigned from (select *, {clampacos("(n1x*n2x+n1y*n2y+n1z*n2z)/((sqrt(n1x*n1x+n1y*n1y+n1z*n1z)+1e-8)*(sqrt(n2x*n2x+n2y*n2y+n2z*n2z)+1e-8))")} as a from
 (select *, ay*bz-az*by_ as n1x, az*bx-ax*bz as n1y, ax*by_-ay*bx as n1z, by_*cz-bz*cy as n2x, bz*cx-bx*cz as n2y, bx*cy-by_*cx as n2z from (select protein_id, pos, lead(x,1) over w-x as ax, lead(y,1) over w-y as ay, lead(z,1) over w-z as az, lead(x,2) over w-lead(x,1) over w as bx,
 lead(y,2) over w-lead(y,1) over w as by_, lead(z,2) over w-lead(z,1) over w as bz, lead(x,3) over w-lead(x,2) over w as cx, lead(y,3) over w-lead(y,2) over w as cy, lead(z,3) over w-lead(z,2) over w as cz from coords window w as (partition by protein_id order by pos)) where cx is not null))""",
       "coords", d="dihedral unsigned")
def _(s, p):
    return T.dihedrals(S.coords(s, p))


@query("W15_ss_consistency", """select protein_id, avg(sc) as consistency, count(*) as n from (select protein_id, exp(-((d-5.4)/2)*((d-5.4)/2)) as sc from (select k.protein_id, distance as d from (select protein_id, pos, row_number() over (partition by protein_id order by pos) as rn, count(*) over (partition by protein_id) as n from tok where ss in ('H','G')) k
  join pr on pr.protein_id=k.protein_id and pr.i=k.pos and pr.j=k.pos+4 where rn<=n-4)
 union all select protein_id, case when d>6 then 1 else d/6 end from (select k.protein_id, distance as d from (select protein_id, pos, row_number() over (partition by protein_id order by pos) as rn, count(*) over (partition by protein_id) as n from tok where ss='E') k
  join pr on pr.protein_id=k.protein_id and pr.i=k.pos and pr.j=k.pos+2 where rn<=n-2)) group by all""", "coords tok", d="consistency", extra=PAIRS)
def _(s, p):
    return T.ss_consistency(S.token_residues(s, p), S.coords(s, p))


@query("A38_local_geometry", """select g.protein_id, g.pos, n-1 as density, case when n>1 then 1/(1+rg) else 0 end as compactness, 1-d/max(d) over (partition by g.protein_id) as depth from (select protein_id, pos, count(*) as n, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) as rg from
 (select a.protein_id, a.pos, b.x, b.y, b.z from coords a join coords b on a.protein_id=b.protein_id and """ + DIST + """<10) group by all) g join (select protein_id, pos, sqrt((x-avg(x) over w)*(x-avg(x) over w)+(y-avg(y) over w)*(y-avg(y) over w)+(z-avg(z) over w)*(z-avg(z) over w)) as d
 from coords window w as (partition by protein_id)) c on c.protein_id=g.protein_id and c.pos=g.pos""", "coords", d="compactness depth")
def _(s, p):
    return T.local_geometry(S.coords(s, p))


@query("A39_exposure", f"""select protein_id, pos, avg((n<10)::int) as exposure from (select a.protein_id, a.pos, a.atom, count(*) as n from atoms a join atoms b on a.protein_id=b.protein_id and {DIST}<=5 group by all) group by all""", "atoms", d="exposure")
def _(s, p):
    return T.exposure(S.atoms(s, p))


SHAPE = """(select protein_id, n, end_to_end, radius_of_gyration, 1.5::double*(hi*hi-q*q)/(q*q) as asphericity, 3*q-hi-lo-lo as acylindricity from (select *, q+2*p*cos(phi) as hi, q+2*p*cos(phi+2*pi()/3) as lo from (select *, acos(greatest(-1, least(1,
 (b0*(b1*b2-c12*c12)-c01*(c01*b2-c12*c02)+c02*(c01*c12-b1*c02))/2)))/3 as phi from (select *, (i0-q)/p as b0, (i1-q)/p as b1, (i2-q)/p as b2, -xy/p as c01, -xz/p as c02, -yz/p as c12 from (select *, sqrt(((i0-q)*(i0-q)+(i1-q)*(i1-q)+(i2-q)*(i2-q)+2*(xy*xy+xz*xz+yz*yz))/6) as p from
 (select *, yy+zz as i0, xx+zz as i1, xx+yy as i2, 2*(xx+yy+zz)/3 as q, sqrt(xx+yy+zz) as radius_of_gyration from (select protein_id, count(*) as n, var_pop(x) as xx, var_pop(y) as yy, var_pop(z) as zz, covar_pop(x,y) as xy, covar_pop(x,z) as xz, covar_pop(y,z) as yz,
 sqrt((arg_max(x,pos)-arg_min(x,pos))*(arg_max(x,pos)-arg_min(x,pos))+(arg_max(y,pos)-arg_min(y,pos))*(arg_max(y,pos)-arg_min(y,pos))+(arg_max(z,pos)-arg_min(z,pos))*(arg_max(z,pos)-arg_min(z,pos))) as end_to_end from coords group by protein_id)))))))"""
DSHAPE = "end_to_end radius_of_gyration asphericity acylindricity"


@query("A33_shape_metrics", f"select * from {SHAPE}", "coords", d=DSHAPE)
def _(s, p):
    return T.shape_metrics(S.coords(s, p))


@query("A34_moments", "select protein_id, " + ", ".join("avg(" + "*".join(["1.0::double"] + ["x"] * i + ["y"] * j + ["z"] * k) + f") as m{i}{j}{k}" for i, j, k in T.MOMENTS) +
       " from (select protein_id, x-avg(x) over w as x, y-avg(y) over w as y, z-avg(z) over w as z from coords window w as (partition by protein_id)) group by protein_id", "coords", d=" ".join(f"m{i}{j}{k}" for i, j, k in T.MOMENTS))
def _(s, p):
    return T.moments(S.coords(s, p))


@query("A35_rdf", f"""select protein_id, bin, v/sum(v) over (partition by protein_id) as rdf from (select protein_id, bin, n/(4*{math.pi!r}::double*(bin+1)*(bin+1)) as v from (select protein_id, least(19, floor(distance))::int as bin, count(*) as n from pr where distance<=20 group by all))""", "coords", d="rdf", extra=PAIRS)
def _(s, p):
    return T.rdf(S.coords(s, p))


@query("A36_adf", f"""select protein_id, bin, n::double/sum(n) over (partition by protein_id) as adf from (select protein_id, least(17, floor(a/{math.pi!r}::double*18))::int as bin, count(*) as n from (select j.protein_id, {clampacos("((i.x-j.x)*(k.x-j.x)+(i.y-j.y)*(k.y-j.y)+(i.z-j.z)*(k.z-j.z))/(sqrt((i.x-j.x)*(i.x-j.x)+(i.y-j.y)*(i.y-j.y)+(i.z-j.z)*(i.z-j.z))*sqrt((k.x-j.x)*(k.x-j.x)+(k.y-j.y)*(k.y-j.y)+(k.z-j.z)*(k.z-j.z))+1e-8)")} as a
 from coords j join coords i on i.protein_id=j.protein_id and j.pos-i.pos between 1 and 9 join coords k on k.protein_id=j.protein_id and k.pos-j.pos between 1 and 9) group by all)""", "coords", d="adf")
def _(s, p):
    return T.adf(S.coords(s, p))


CO = "(select n.protein_id, coalesce(s/n,0) as contact_order from (select protein_id, count(*) as n from coords group by all) n left join (select protein_id, avg(j-i) as s from ct where j-i>=3 group by all) using (protein_id))"


@query("A37_contact_order", f"select * from {CO}", "coords", d="contact_order", extra=CONT)
def _(s, p):
    return T.contact_order(T.contacts(S.coords(s, p)), S.coords(s, p))


def reg_sql(state, n=1):
    return f"""(select protein_id, min(pos) as s, max(pos)+1 as e, count(*) as length from (select protein_id, pos, pos-row_number() over (partition by protein_id order by pos) as g from tok where ss='{state}') group by protein_id, g having count(*)>={n})"""


@query("J7_region_contacts", f"""select distinct a.protein_id, a.s as start1, b.s as start2 from {reg_sql('E')} a join {reg_sql('E')} b on a.protein_id=b.protein_id and a.s<b.s join ct on ct.protein_id=a.protein_id and i>=a.s and i<a.e and j>=b.s and j<b.e""", "coords tok", extra=CONT)
def _(s, p):
    r = T.runs(S.token_residues(s, p), F.col("ss") == "E")
    return T.region_contacts(r, T.contacts(S.coords(s, p)))


B12 = f"""(select t.protein_id, coalesce(hp,0) as hairpins, coalesce(hx,0) as helix_pairs, coalesce(lo,0) as loops from (select distinct protein_id from tok) t left join (select l.protein_id, count(*) as hp from (select protein_id, pos, ss, lead(ss,1) over w as s1, lead(ss,2) over w as s2, lead(ss,3) over w as s3, lead(ss,5) over w as s5
 from tok window w as (partition by protein_id order by pos)) l join ct on ct.protein_id=l.protein_id and ct.i=l.pos and ct.j=l.pos+3 where ss='E' and s3='E' and s5 is not null and (s1 in ('T','S','-') or s2 in ('T','S','-')) group by all) a using (protein_id)
 left join (select protein_id, count(*) as hx from (select distinct a.protein_id, a.s, b.s from {reg_sql('H')} a join {reg_sql('H')} b on a.protein_id=b.protein_id and a.s<b.s join ct on ct.protein_id=a.protein_id and i>=a.s and i<a.e and j>=b.s and j<b.e) group by all) b using (protein_id)
 left join (select protein_id, count(*) as lo from {reg_sql('-', 3)} where length<=12 group by all) c using (protein_id))"""


@query("B12_structural_motifs", f"select * from {B12}", "coords tok", extra=CONT)
def _(s, p):
    return T.structural_motifs(S.token_residues(s, p), T.contacts(S.coords(s, p))).drop("sheets")


@query("B12_beta_sheets")
def _(s, p):
    return T.structural_motifs(S.token_residues(s, p), T.contacts(S.coords(s, p))).select("protein_id", "sheets")


def dbscan_sql(src, eps):
    return f"""pp as materialized (select a.protein_id, a.pos as i, b.pos as j from {src} a join {src} b on a.protein_id=b.protein_id and a.pos<>b.pos and {DIST}<={eps}),
core as materialized (select s.protein_id, s.pos, count(pp.j)+1>=3 as core from {src} s left join pp on pp.protein_id=s.protein_id and pp.i=s.pos group by all),
ce as materialized (select pp.* from pp join core a on a.protein_id=pp.protein_id and a.pos=i and a.core join core b on b.protein_id=pp.protein_id and b.pos=j and b.core),
rc as (select protein_id, pos as n, pos as r from core where core union select rc.protein_id, rc.n, ce.j from rc join ce on ce.protein_id=rc.protein_id and ce.i=rc.r),
lab as materialized (select protein_id, n as pos, min(r) as cluster from rc group by all),
db as materialized (select c.protein_id, c.pos, c.core, coalesce(l.cluster, (select min(l2.cluster) from pp join lab l2 on l2.protein_id=pp.protein_id and l2.pos=pp.j where pp.protein_id=c.protein_id and pp.i=c.pos)) as cluster
 from core c left join lab l on l.protein_id=c.protein_id and l.pos=c.pos)"""


@query("G4_dbscan", "select protein_id, pos, core, coalesce(cluster, -1) as cluster from db", "coords", extra=dbscan_sql("coords", 5))
def _(s, p):
    return T.dbscan3d(S.coords(s, p), 5.0, 3).fillna(-1, ["cluster"])


HYD = "hyd as materialized (select c.* from coords c join rq using (protein_id, pos) where kd/5>0.3)"


@query("G4_hydrophobic_cores", "select protein_id, count(*) as n_points, count(distinct cluster) as n_clusters, avg((cluster is not null)::int) as core_score from db group by all", "coords tok", d="core_score", extra=",".join([RQ, HYD, dbscan_sql("hyd", 8)]))
def _(s, p):
    return T.core_scores(T.dbscan3d(T.hydrophobic_points(S.token_residues(s, p), S.coords(s, p)), 8.0, 3))


@query("G3_hydrophobic_clusters", """select f.protein_id, f.hydrophobic_fraction, coalesce(n,0) as n_clusters, coalesce(a,0) as avg_size, coalesce(m,0) as max_size from (select protein_id, avg((aa in ('A','I','L','M','F','V','W','Y'))::int) as hydrophobic_fraction from tok group by all) f
 left join (select protein_id, count(*) as n, avg(size) as a, max(size) as m from (select protein_id, c, count(*) as size from (select protein_id, n, min(r) as c from rc group by all) group by all) group by all) q using (protein_id)""", "coords tok",
       d="hydrophobic_fraction avg_size", extra=f"""hh as materialized (select c.* from coords c join tok using (protein_id, pos) where aa in ('A','I','L','M','F','V','W','Y')),
hc as materialized (select a.protein_id, a.pos as i, b.pos as j from hh a join hh b on a.protein_id=b.protein_id and a.pos<>b.pos and {DIST}<8 and {DIST}>0),
rc as (select protein_id, pos as n, pos as r from hh union select rc.protein_id, rc.n, hc.j from rc join hc on hc.protein_id=rc.protein_id and hc.i=rc.r)""")
def _(s, p):
    return T.hydrophobic_cluster_stats(S.token_residues(s, p), S.coords(s, p))


@query("C5_structure_features", f"""select s.*, contact_order, avg_density, avg_compactness, avg_curvature, avg_bond_length, hairpins, helix_pairs, loops from {SHAPE} s join {CO} c using (protein_id)
 join (select protein_id, avg(n-1) as avg_density, avg(case when n>1 then 1/(1+rg) else 0 end) as avg_compactness from (select protein_id, pos, count(*) as n, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) as rg from
 (select a.protein_id, a.pos, b.x, b.y, b.z from coords a join coords b on a.protein_id=b.protein_id and {DIST}<10) group by all) group by all) l using (protein_id)
 join (select protein_id, avg(curvature) as avg_curvature, avg(bond_length) as avg_bond_length from bb group by all) k using (protein_id) join {B12} m using (protein_id)""", "coords tok",
       d=DSHAPE + " contact_order avg_density avg_compactness avg_curvature avg_bond_length", extra=CONT + "," + BB)
def _(s, p):
    return T.structure_features(S.token_residues(s, p), S.coords(s, p)).drop("sheets")


@query("C6_biophysics")
def _(s, p):
    return T.biophysics(S.token_residues(s, p), S.coords(s, p))
