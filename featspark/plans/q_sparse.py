"""Queries: pair statistics on sparse activations, as the dictionary encoder emits them, and sequence clusters."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import clusters as K
from ..operators import pairs as P
from ..operators.gram import pair_moments
from ..operators.layout import dict_encode
from ..sources import views as S
from .q_scoring import DW, ENC, dictionary
from .registry import query

#: The encoded activations with their zeros: ten features a layer.
FULL = DW + "," + ENC + """,
full0 as materialized (select t.protein_id, t.pos, t.layer, r.f as feature, coalesce(e.value, 0) as value from (select distinct protein_id, pos, layer from act) t cross join range(10) r(f)
 left join enc e on e.protein_id=t.protein_id and e.pos=t.pos and e.layer=t.layer and e.feature=r.f)"""
CORR = "case when not isnan(corr(a.value,b.value)) then corr(a.value,b.value) end"


def encoded(s, p):
    """(sparse activations, all tokens)."""
    v = S.activations_vec(s, p)
    return dict_encode(v, dictionary(s, p)), v.select("protein_id", "pos")


@query("J3_sparse_pairs", """select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, (select count(*) from (select distinct protein_id, pos from act)) as n, sum(a.value*b.value) as sxy from enc a join enc b
 on a.protein_id=b.protein_id and a.pos=b.pos and (a.layer<b.layer or (a.layer=b.layer and a.feature<b.feature)) group by all""", "act", d="sxy", i="n", extra=DW + "," + ENC)
def _(s, p):
    act, tokens = encoded(s, p)
    return pair_moments(act, "upper", tokens, all_pairs=False).select("la", "lb", "i", "j", F.col("n").cast("long").alias("n"), "sxy")


@query("Q1_sparse_pearson", f"select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, {CORR} as corr from full0 a join full0 b on a.protein_id=b.protein_id and a.pos=b.pos and a.layer=b.layer and a.feature<b.feature group by all", "act", d="corr", extra=FULL)
def _(s, p):
    act, tokens = encoded(s, p)
    return P.pearson_matrix(act, "same", tokens, 10)


@query("Q6_sparse_causal_strength", f"""select a.layer as la, b.layer as lb, a.feature as i, b.feature as j, ({CORR}+1)/2 as causal_strength from full0 a join full0 b on a.protein_id=b.protein_id and b.pos=a.pos+1
 and (a.layer<b.layer or (a.layer=b.layer and a.feature<b.feature)) group by all""", "act", d="causal_strength", extra=FULL)
def _(s, p):
    act, tokens = encoded(s, p)
    return P.causal_strength(act, tokens, 10)


@query("A9_sparse_coactivation", "select a.feature as i, b.feature as j, avg((abs(a.value)>0.1 and abs(b.value)>0.1)::int) as p from full0 a join full0 b using (protein_id, pos, layer) group by all", "act", d="p", extra=FULL)
def _(s, p):
    act, _ = encoded(s, p)
    return A.coactivation(act, 0.1, S.activations_vec(s, p), 10)


# the greedy rule goes row by row, which SQL cannot say; tests hold it against the loop
@query("G8_cluster_sequences")
def _(s, p):
    return K.cluster_sequences(S.proteins(s, p))
