"""Multiple-alignment analytics on cells ``family_id, seq_idx, col, aa``.

A family may hold any number of sequences: everything is partial aggregation on
(family, column, letter), and pairs of sequences meet only inside hashed tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import count_if, ratio
from ..functions.tables import ALIGN
from ..session import broadcast_if_small, cut_lineage
from . import blocks
from .graph import clustering, component_summary, components

FAM = ["family_id"]
PSEUDO, BACKGROUND = 0.01, 0.05


def msa_cells(msa: DataFrame) -> DataFrame:
    return msa.select("family_id", "seq_idx", F.posexplode(F.split("aligned", "")).alias("col", "aa"))


def filter_alignment(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Keep the columns where the family's target has no gap, renumbered; families without the target stay whole.

    ``targets``: (family_id, seq_idx). The column map has one row per family column.
    """
    t = cells.join(broadcast_if_small(targets), ["family_id", "seq_idx"], "left_semi").filter("aa <> '-'").select("family_id", "col")
    new = t.withColumn("new_col", F.row_number().over(Window.partitionBy("family_id").orderBy("col")) - 1)
    has = t.select("family_id").distinct().withColumn("has", F.lit(True))
    j = cells.join(broadcast_if_small(has), "family_id", "left").join(broadcast_if_small(new), ["family_id", "col"], "left")
    return j.filter("has is null or new_col is not null").select("family_id", "seq_idx", F.coalesce("new_col", "col").alias("col"), "aa")


def filter_gappy(cells: DataFrame, cutoff: float = 0.5) -> DataFrame:
    keep = gap_stats(cells).filter(F.col("gap_freq") <= cutoff).select("family_id", "col")
    return cells.join(broadcast_if_small(keep), ["family_id", "col"], "left_semi")


def msa_profile(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("family_id", "col", "aa").agg(F.count("*").alias("n"))
    return n.select("family_id", "col", "aa", (F.col("n") / F.sum("n").over(Window.partitionBy("family_id", "col"))).alias("frequency"))


def sequence_weights(cells: DataFrame) -> DataFrame:
    """Henikoff weights: sum over columns with several letters of 1 / (letters x count), normalised per family."""
    n = cells.groupBy("family_id", "col", "aa").agg(F.count("*").alias("n"))
    t = n.withColumn("types", F.count("*").over(Window.partitionBy("family_id", "col")))
    share = t.select("family_id", "col", "aa", F.when(F.col("types") > 1, 1 / (F.col("types") * F.col("n"))).otherwise(0.0).alias("s"))
    w = cells.join(broadcast_if_small(share), ["family_id", "col", "aa"]).groupBy("family_id", "seq_idx").agg(F.sum("s").alias("w"))
    tot = w.groupBy("family_id").agg(F.sum("w").alias("t"))
    return w.join(broadcast_if_small(tot), "family_id").select("family_id", "seq_idx", ratio("w", "t").alias("weight"))


def weighted_counts(cells: DataFrame, weights: DataFrame) -> DataFrame:
    return cells.join(weights, ["family_id", "seq_idx"]).groupBy("family_id", "col", "aa").agg(F.sum("weight").alias("w"))


def pssm(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """log2 odds against 1/20 on the full 21-letter grid with pseudocount 0.01; the gap row is 0."""
    cnt = weighted_counts(cells, weights)
    grid = cnt.select("family_id", "col").distinct().select("family_id", "col", F.explode(F.array(*[F.lit(a) for a in ALIGN])).alias("aa"))
    g = grid.join(cnt, ["family_id", "col", "aa"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)) + PSEUDO)
    p = F.col("w") / F.sum("w").over(Window.partitionBy("family_id", "col"))
    return g.select("family_id", "col", "aa", F.when(F.col("aa") == "-", 0.0).otherwise(F.log2(p / BACKGROUND)).alias("score"))


def gap_stats(cells: DataFrame) -> DataFrame:
    gap = F.col("aa") == "-"
    return cells.groupBy("family_id", "col").agg(F.avg(F.when(gap, 1.0).otherwise(0.0)).alias("gap_freq"), count_if(~gap).alias("depth"))


def conservation(cells: DataFrame, weights: DataFrame) -> DataFrame:
    cnt = weighted_counts(cells, weights)
    p = cnt.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("family_id", "col")))
    h = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))
    return p.groupBy("family_id", "col").agg((1 - h / F.log(F.lit(20.0))).alias("conservation"))


def neff(weights: DataFrame) -> DataFrame:
    return weights.groupBy("family_id").agg(F.exp(-F.sum(F.col("weight") * F.log(F.col("weight") + 1e-10))).alias("neff"))


def diversity(cells: DataFrame, tile: int = 512) -> DataFrame:
    """1 - mean pairwise identity per family over all pairs of sequences.

    Sequences are hashed into tiles; each pair of tiles is one numpy product that returns a single
    partial sum, so no sequence pair becomes a row and a large family spreads over many tasks.
    """
    code = F.instr(F.lit(ALIGN), F.col("aa"))
    seqs = cells.groupBy("family_id", "seq_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", code.alias("c")))), lambda s: s.c).alias("codes"))
    size = cells.groupBy("family_id").agg(F.countDistinct("seq_idx").alias("n")).select("family_id", F.ceil(F.col("n") / tile).cast("int").alias("nt"))
    s = seqs.join(broadcast_if_small(size), "family_id").withColumn("t", F.pmod(F.xxhash64("seq_idx"), F.col("nt")).cast("int"))
    # tile pair (a, b) with a <= b sees tile a as left side and tile b as right side
    left = s.select("family_id", F.col("t").alias("ta"), F.explode(F.expr("sequence(t, nt - 1)")).alias("tb"), "seq_idx", "codes")
    right = s.select(F.col("family_id").alias("f2"), F.explode(F.expr("sequence(0, t)")).alias("ta2"), F.col("t").alias("tb2"), F.col("seq_idx").alias("seq2"), F.col("codes").alias("codes2"))

    def fold(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"family_id": [], "s": [], "n": []})
        x, y = np.stack(a.codes.to_numpy()), np.stack(b.codes2.to_numpy())
        gap = len(ALIGN)
        hot = lambda m: np.concatenate([(m == k) for k in range(1, gap)], axis=1).astype(np.float32)
        match = hot(x) @ hot(y).T
        length = x.shape[1] - (x == gap).astype(np.float32) @ (y == gap).astype(np.float32).T
        ok = length > 0
        if key[1] == key[2]:
            ok &= a.seq_idx.to_numpy()[:, None] < b.seq2.to_numpy()[None, :]
        return pd.DataFrame({"family_id": [key[0]], "s": [float((match[ok].astype(float) / length[ok]).sum())], "n": [int(ok.sum())]})

    parts = left.groupBy("family_id", "ta", "tb").cogroup(right.groupBy("f2", "ta2", "tb2")).applyInPandas(fold, "family_id long, s double, n long")
    return parts.groupBy("family_id").agg(F.coalesce(1 - ratio(F.sum("s"), F.sum("n")), F.lit(0.0)).alias("diversity"))


def variable_columns(cons: DataFrame, k: int | None = 100, below: float = 0.9) -> DataFrame:
    """At most ``k`` columns (None: all) per family with conservation < ``below``, most variable first (the reported feature set)."""
    w = Window.partitionBy("family_id").orderBy(F.round("conservation", 9), "col")
    return cons.filter(F.col("conservation") < below).withColumn("rank", F.row_number().over(w)).filter(F.lit(True) if k is None else F.col("rank") <= k)


def _column_codes(cells: DataFrame, cols: DataFrame) -> DataFrame:
    """(family_id, seq_idx, x, y): the letters of the chosen columns of a sequence as codes, in column order."""
    kept = cells.join(cols.select("family_id", "col"), ["family_id", "col"], "left_semi")
    code = (F.instr(F.lit(ALIGN), F.col("aa")) - 1).alias("c")
    rows = kept.groupBy("family_id", "seq_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", code))), lambda s: s.c).alias("x"))
    return rows.withColumn("y", F.col("x"))


def _named_columns(pairs: DataFrame, cols: DataFrame) -> DataFrame:
    """Replace the positions i, j among the chosen columns by the columns c1, c2."""
    at = cols.groupBy("family_id").agg(F.array_sort(F.collect_list(F.col("col"))).alias("at"))
    p = pairs.join(at, "family_id").withColumn("c1", F.element_at("at", F.col("i") + 1)).withColumn("c2", F.element_at("at", F.col("j") + 1))
    return p.drop("i", "j", "at")


def column_pairs(cells: DataFrame, cols: DataFrame) -> DataFrame:
    """(family_id, c1, c2, a1, a2, n), c1 < c2: how often letters of two chosen columns meet, counted in tiles of columns."""
    n = blocks.joint_cells(_column_codes(cells, cols), ["family_id"], len(ALIGN), len(ALIGN), half=lambda key: True)
    letter = lambda k: F.substring(F.lit(ALIGN), F.col(k) + 1, F.lit(1))
    return _named_columns(n, cols).select("family_id", "c1", "c2", letter("bx").alias("a1"), letter("by").alias("a2"), "n")


def column_mi(cells: DataFrame, weights: DataFrame, cols: DataFrame) -> DataFrame:
    """Weighted mutual information of column pairs, scored where a tile of columns has been merged."""
    rows = _column_codes(cells, cols).join(weights, ["family_id", "seq_idx"])
    mi = blocks.joint_scores(rows, ["family_id"], len(ALIGN), len(ALIGN), blocks.information, "mi", weight="weight", half=lambda key: True)
    return _named_columns(mi, cols).select("family_id", "c1", "c2", "mi")


def apc(mi: DataFrame, n_cols: DataFrame) -> DataFrame:
    """Average-product correction, floor 0; means run over the full n x n matrix, absent cells being 0."""
    both = mi.select("family_id", F.col("c1").alias("c"), "mi").unionByName(mi.select("family_id", F.col("c2").alias("c"), "mi"))
    rows = both.groupBy("family_id", "c").agg(F.sum("mi").alias("rs"))
    tot = both.groupBy("family_id").agg(F.sum("mi").alias("ts"))
    j = (mi.join(n_cols, "family_id").join(tot, "family_id").join(rows.select("family_id", F.col("c").alias("c1"), F.col("rs").alias("r1")), ["family_id", "c1"])
         .join(rows.select("family_id", F.col("c").alias("c2"), F.col("rs").alias("r2")), ["family_id", "c2"]))
    corr = F.coalesce(F.try_divide(F.col("r1") / F.col("n") * (F.col("r2") / F.col("n")), F.col("ts") / (F.col("n") * F.col("n"))), F.lit(0.0))
    return j.select("family_id", "c1", "c2", "mi", F.greatest(F.lit(0.0), F.col("mi") - corr).alias("score"))


def coevolution(cells: DataFrame, weights: DataFrame, k: int | None = None) -> DataFrame:
    """Corrected mutual information of all variable column pairs, or of the ``k`` most variable columns."""
    cols = variable_columns(conservation(cells, weights), k)
    n = cells.groupBy("family_id").agg((F.max("col") + 1).alias("n"))
    return apc(cut_lineage(column_mi(cells, weights, cols)), n)  # pair table: read four times, columns^2 per family


def attention_contacts(attn: DataFrame, min_separation: int = 6) -> DataFrame:
    """Mean over layers and heads, symmetrise, subtract row x column / total, drop |i - j| < ``min_separation``."""
    a = attn.groupBy("protein_id", "i", "j").agg(F.avg("w").alias("w"))
    sym = a.unionByName(a.select("protein_id", F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("protein_id", "i", "j").agg((F.sum("w") / 2).alias("w"))
    rows = sym.groupBy("protein_id", "i").agg(F.sum("w").alias("ri"))
    tot = rows.groupBy("protein_id").agg(F.sum("ri").alias("t"))
    j = sym.filter((F.abs(F.col("i") - F.col("j")) >= min_separation) & (F.col("i") < F.col("j"))).join(rows, ["protein_id", "i"]) \
        .join(rows.select("protein_id", F.col("i").alias("j"), F.col("ri").alias("rj")), ["protein_id", "j"]).join(tot, "protein_id")
    return j.select("protein_id", "i", "j", (F.col("w") - F.col("ri") * F.col("rj") / F.col("t")).alias("score"))


def network_edges(scores: DataFrame, thr: float = 0.5) -> DataFrame:
    return scores.filter(F.col("score") > thr).select("family_id", F.col("c1").alias("src"), F.col("c2").alias("dst"))


def coevolution_network(scores: DataFrame, n_cols: DataFrame, thr: float = 0.5) -> DataFrame:
    """Per family column with an edge: degree, clustering, degree centrality."""
    cl = clustering(network_edges(scores, thr), FAM)
    return cl.join(broadcast_if_small(n_cols), "family_id").select("family_id", F.col("node").alias("col"), "degree", "clustering", (F.col("degree") / (F.col("n") - 1)).alias("centrality"))


def contact_enrichment(scores: DataFrame, contacts: DataFrame, n_cols: DataFrame, thr: float = 0.5) -> DataFrame:
    """Observed overlap of edges and contacts over the overlap expected by chance (undirected counts)."""
    e = network_edges(scores, thr)
    hit = e.join(contacts.select("family_id", F.col("i").alias("src"), F.col("j").alias("dst")), ["family_id", "src", "dst"], "left_semi").groupBy("family_id").agg(F.count("*").alias("hits"))
    ne, nc = e.groupBy("family_id").agg(F.count("*").alias("ne")), contacts.groupBy("family_id").agg(F.count("*").alias("nc"))
    j = ne.join(nc, "family_id").join(hit, "family_id", "left").join(n_cols, "family_id")
    expected = F.col("ne") * F.col("nc") / (F.col("n") * (F.col("n") - 1) / 2)
    return j.select("family_id", (F.coalesce("hits", F.lit(0)) / (expected + 1e-10)).alias("enrichment"))


def modules(scores: DataFrame, thr: float = 0.5, min_size: int = 3) -> DataFrame:
    return component_summary(components(network_edges(scores, thr), FAM), FAM, min_size)


def msa_features(cells: DataFrame) -> DataFrame:
    """Composite per family and column: conservation, gap frequency, depth, best PSSM letter score; plus Neff of the family."""
    w = sequence_weights(cells)
    best = pssm(cells, w).groupBy("family_id", "col").agg(F.max("score").alias("max_score"))
    return (conservation(cells, w).join(gap_stats(cells), ["family_id", "col"]).join(best, ["family_id", "col"]).join(broadcast_if_small(neff(w)), "family_id"))
