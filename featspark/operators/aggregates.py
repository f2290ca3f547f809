"""Single-pass activation statistics (all partial aggregation, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.num import c, count_if, ratio, share
from . import blocks
from .gram import cross_moments, is_sparse
from .quantiles import percentile_table

ACTIVE, DEAD = 0.1, 0.01


def active(v="value", thr: float = ACTIVE) -> Column:
    return F.abs(c(v)) > thr


def active_rows(act: DataFrame, thr: float = ACTIVE) -> DataFrame:
    return act.filter(active("value", thr))


def feature_stats(act: DataFrame, by=("feature",)) -> DataFrame:
    return act.groupBy(*by).agg(share(active()).alias("frequency"), F.avg(F.abs("value")).alias("mean_abs"),
                                F.stddev_samp("value").alias("std"))


def layer_stats(act: DataFrame) -> DataFrame:
    return act.groupBy("layer").agg(share(active()).alias("active_frac"), F.avg(F.abs("value")).alias("mean_abs"),
                                    F.max(F.abs("value")).alias("max_abs"))


PCTS = (25, 50, 75, 90, 95, 99)


def describe(act: DataFrame, by: list[str]) -> DataFrame:
    basic = act.groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.avg(F.abs("value")).alias("l1_mean"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("l2_norm"), share(active("value", DEAD)).alias("active_frac_001"))
    p = percentile_table(act, by, "value", [q / 100 for q in PCTS])
    return basic.join(p.select(*by, *[F.col("edges")[k].alias(f"p{q}") for k, q in enumerate(PCTS)]), by)


def layer_state(act: DataFrame, thr: float = ACTIVE, by=("protein_id", "layer")) -> DataFrame:
    """Features with any activation above the threshold, with mean |v| and frequency."""
    s = act.groupBy(*by, "feature").agg(F.avg(F.abs("value")).alias("magnitude"), share(active("value", thr)).alias("frequency"))
    return s.filter(F.col("frequency") > 0)


def layer_totals(act: DataFrame, thr: float = ACTIVE) -> DataFrame:
    f = act.groupBy("protein_id", "layer", "feature").agg(F.sum(F.abs("value")).alias("s"), F.max(active("value", thr)).alias("on"))
    return f.groupBy("protein_id", "layer").agg(F.sum("s").alias("total_activation"), count_if(F.col("on")).alias("n_active"),
                                                share(F.col("on")).alias("active_feature_frac"))


def sequence_stats(vec: DataFrame) -> DataFrame:
    """Per protein length, mean, population std and share of |v| < 0.01, from whole vectors."""
    r = vec.select("protein_id", "pos", F.size("vec").alias("k"), V.asum("vec").alias("s"), V.sq_norm("vec").alias("q"),
                   F.size(F.filter("vec", lambda v: F.abs(v) < DEAD)).alias("z"))
    g = r.groupBy("protein_id").agg((F.max("pos") + 1).alias("length"), F.sum("k").alias("k"), F.sum("s").alias("s"),
                                    F.sum("q").alias("q"), F.sum("z").alias("z"))
    m = F.col("s") / F.col("k")
    return g.select("protein_id", "length", m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("k") - m * m)).alias("std"),
                    (F.col("z") / F.col("k")).alias("inactive_frac_001"))


def sequence_averages(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_sequences"), F.avg("length").alias("avg_length"), F.avg("mean").alias("avg_mean"),
                     F.avg("std").alias("avg_std"), F.avg("inactive_frac_001").alias("avg_inactive"))


def feature_importance(act: DataFrame) -> DataFrame:
    return act.groupBy("layer", "feature").agg(F.avg(F.abs("value")).alias("importance"))


def layer_magnitude(vec: DataFrame) -> DataFrame:
    n, s, q = F.size("vec"), V.asum("vec"), V.sq_norm("vec")
    spread = F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))
    return vec.groupBy("layer").agg(F.avg(V.norm("vec")).alias("magnitude"), F.avg(spread).alias("diversity"))


def node_stats(act: DataFrame) -> DataFrame:
    return act.groupBy("layer", "feature").agg(F.avg("value").alias("activation_mean"), F.stddev_samp("value").alias("activation_std"))


def coactivation(vec: DataFrame, thr: float = ACTIVE, every: DataFrame | None = None, width: int | None = None, all_pairs: bool = True) -> DataFrame:
    """P(i active and j active) over all tokens and layers, dense in (i, j).

    From sparse long activations too; ``every`` (protein_id, pos, layer) then names all token rows.
    """
    if is_sparse(vec):
        on = active_rows(vec, thr).select("protein_id", "pos", F.col("layer").alias("of"), F.lit(0).alias("layer"), "feature", F.lit(1.0).alias("value"))
        codes = blocks.Codes.of(vec.withColumn("layer", F.lit(0)), width)
        rows = (every if every is not None else vec).select("protein_id", "pos", F.col("layer").alias("of"))
        r = blocks.sparse_rows(on, codes, ("protein_id", "pos", "of"), rows).select(F.col("code").alias("xi"), F.col("value").alias("xv"), F.col("code").alias("yi"), F.col("value").alias("yv"))
        return blocks.sparse_moments(r, codes, "same", all_pairs, half=False).select("i", "j", (F.col("sxy") / F.col("n")).alias("p"))
    on = F.transform("vec", lambda v: F.when(F.abs(v) > thr, 1.0).otherwise(0.0))
    m = cross_moments(vec.select(on.alias("x"), on.alias("y")), [])
    return m.select("i", "j", (F.col("sxy") / F.col("n")).alias("p"))


def concept_purity(coact: DataFrame) -> DataFrame:
    diag = F.col("i") == F.col("j")
    m = coact.agg(F.avg(F.when(diag, F.col("p"))).alias("d"), F.avg(F.when(diag, 0.0).otherwise(F.abs("p"))).alias("o"))
    return m.select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d") / (F.col("o") + 1e-8))).alias("concept_purity"))


def dead_features(act: DataFrame, thr: float = DEAD, min_samples: int = 10, by=("feature",)) -> DataFrame:
    """Features never above ``thr``; nothing when the sample is too small to tell."""
    g = act.groupBy(*by).agg(F.max(F.abs("value")).alias("max_abs"), F.count("*").alias("n"))
    return g.filter((F.col("max_abs") <= thr) & (F.col("n") >= min_samples)).drop("n")


def dead_ratio(act: DataFrame) -> DataFrame:
    return act.groupBy("feature").agg(F.max(F.abs("value")).alias("m")).agg(share(F.col("m") < DEAD).alias("dead_ratio"))


def sparsity_metrics(act: DataFrame) -> DataFrame:
    f = act.groupBy("feature").agg(F.count("*").alias("n"), count_if(active("value", DEAD)).alias("l0"), F.sum(F.abs("value")).alias("l1"),
                                   share(active()).alias("freq"))
    return f.agg(ratio(F.sum("l0"), F.sum("n")).alias("l0_sparsity"), ratio(F.sum("l1"), F.sum("n")).alias("l1_sparsity"),
                 F.avg("freq").alias("freq_mean"), F.stddev_samp("freq").alias("freq_std"))


def feature_entropy(act: DataFrame) -> DataFrame:
    """Softmax over features of mean |v| per position, entropy summed over positions."""
    m = act.groupBy("pos", "feature").agg(F.exp(F.avg(F.abs("value"))).alias("e"))
    p = F.col("e") / F.sum("e").over(Window.partitionBy("pos"))
    return m.withColumn("p", p).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-8))).alias("feature_entropy"))


def reconstruction_metrics(orig: DataFrame, recon: DataFrame, keys=("protein_id", "pos", "layer")) -> DataFrame:
    """Reconstruction quality of vectors joined on their token key; no padding exists to mask."""
    j = orig.select(*keys, F.col("vec").alias("o")).join(recon.select(*keys, F.col("vec").alias("r")), list(keys))
    err = F.zip_with("o", "r", lambda a, b: a - b)
    r = j.select(F.size("o").alias("k"), V.asum("o").alias("so"), V.sq_norm("o").alias("qo"), V.asum(err).alias("se"), V.sq_norm(err).alias("qe"),
                 V.asum(F.transform(err, lambda e: F.abs(e))).alias("ae"), V.cosine("o", "r").alias("cos"))
    r = r.withColumn("ne", F.sqrt("qe") / (F.sqrt("qo") + 1e-8))
    n = F.sum("k")
    var_o = (F.sum("qo") - F.sum("so") * F.sum("so") / n) / (n - 1)
    var_e = (F.sum("qe") - F.sum("se") * F.sum("se") / n) / (n - 1)
    return r.agg((F.sum("qe") / n).alias("mse"), (F.sum("ae") / n).alias("mae"), F.avg("ne").alias("normalized_error"),
                 F.stddev_samp("ne").alias("normalized_error_std"), F.avg("cos").alias("cosine_similarity"),
                 (1 - var_e / var_o).alias("variance_explained"), (1 - F.sum("qe") / (var_o * (n - 1))).alias("r2"))


def activation_rate(act: DataFrame) -> DataFrame:
    return act.groupBy("layer", "feature").agg(share(active()).alias("activation_rate"))


def accumulate(act: DataFrame) -> DataFrame:
    return act.groupBy("layer", "feature").agg(count_if(active()).alias("activation_count"), F.sum(F.abs("value")).alias("magnitude_sum"),
                                               F.count("*").alias("samples"))


def pool(act: DataFrame, how: str = "mean") -> DataFrame:
    """Protein-level vector from its positions: ``mean`` or ``max`` per (layer, feature)."""
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling {how!r}")
    agg = F.avg("value") if how == "mean" else F.max("value")
    return act.groupBy("protein_id", "layer", "feature").agg(agg.alias("pooled"))


def pool_regions(act: DataFrame, regions: DataFrame) -> DataFrame:
    from .sequence import in_region
    return in_region(act, regions).groupBy("protein_id", "domain_id", "layer", "feature").agg(F.avg("value").alias("pooled"))


def mean_metrics(log: DataFrame) -> DataFrame:
    return log.groupBy("epoch", "metric").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


def trajectories(act: DataFrame) -> DataFrame:
    return act.groupBy("protein_id", "layer", "feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def position_profile(act: DataFrame) -> DataFrame:
    return act.groupBy("pos", "feature").agg(F.avg("value").alias("mean_value"))


def top_features(stats: DataFrame, k: int) -> DataFrame:
    s = stats.withColumn("score", F.col("frequency") * F.col("mean_abs"))
    return s.orderBy(F.desc("score"), "feature").limit(k)


def top_active(state: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("protein_id", "layer").orderBy(F.desc("magnitude"), "feature")
    return state.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# interpretability scores over activations

def monosemanticity(act: DataFrame) -> DataFrame:
    s = act.groupBy("feature").agg(F.max(F.abs("value")).alias("m"), share(active()).alias("p"))
    p = F.col("p")
    h = -p * F.log(p) - (1 - p) * F.log(1 - p)
    return (s.filter((F.col("m") >= DEAD) & (p > 0) & (p < 1))
            .agg(F.coalesce(F.avg(1 - h / F.log(F.lit(2.0))), F.lit(0.0)).alias("monosemanticity")))


def feature_cosines(vec: DataFrame) -> DataFrame:
    """Cosine of every feature pair over all tokens and layers."""
    m = cross_moments(vec.select(F.col("vec").alias("x"), F.col("vec").alias("y")), [])
    return m.select("i", "j", "n", "sx", "sxx", F.try_divide("sxy", F.sqrt("sxx") * F.sqrt("syy")).alias("cos"))


def orthogonality(cosines: DataFrame) -> DataFrame:
    return cosines.filter("i != j").agg((1 - F.avg(F.abs("cos"))).alias("orthogonality"))


def human_alignment(cosines: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: (feature, label). Within- minus between-label cosine, scaled to [0, 1]."""
    a = groups.select(F.col("feature").alias("i"), F.col("label").alias("li"))
    b = groups.select(F.col("feature").alias("j"), F.col("label").alias("lj"))
    p = cosines.filter("i < j").join(a, "i").join(b, "j")
    same = F.col("li") == F.col("lj")
    m = p.agg(F.avg(F.when(same, F.col("cos"))).alias("w"), F.avg(F.when(~same, F.col("cos"))).alias("b"))
    v = (F.col("w") - F.col("b") + 1) / 2
    return m.select(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(0.5)).alias("human_alignment"))


def consistency(act: DataFrame) -> DataFrame:
    """1 / (1 + mean of variance over proteins / mean |v|), per layer, position and feature."""
    g = act.groupBy("layer", "pos", "feature").agg((F.var_samp("value") / (F.avg(F.abs("value")) + 1e-8)).alias("r"))
    return g.agg((1 / (1 + F.avg("r"))).alias("consistency"))


def coverage(act: DataFrame) -> DataFrame:
    return act.agg(share(active()).alias("coverage"))


def interpretability_score(vec: DataFrame, act: DataFrame, coact: DataFrame, cosines: DataFrame) -> DataFrame:
    """Components and their mean, one row each (constant placeholders are left out)."""
    parts = [monosemanticity(act), orthogonality(cosines), consistency(act), coverage(act), concept_purity(coact)]
    rows = [p.select(F.lit(p.columns[0]).alias("name"), F.col(p.columns[0]).alias("value")) for p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    mean = out.agg(F.avg("value").alias("value")).select(F.lit("interpretability").alias("name"), "value")
    return out.unionByName(mean)


# activation patterns over samples

def kurtosis_score(act: DataFrame) -> DataFrame:
    k = act.groupBy("layer", "feature").agg(F.kurtosis("value").alias("kurtosis"))
    return k.withColumn("heavy_tail_score", F.when(F.col("kurtosis") > 3, F.least(F.col("kurtosis") / 10, F.lit(1.0))).otherwise(0.0))


def positional_specificity(act: DataFrame) -> DataFrame:
    """min(1, mean over positions of variance across proteins / mean over proteins of variance across positions)."""
    a = act.groupBy("layer", "feature", "pos").agg(F.var_samp("value").alias("v")).groupBy("layer", "feature").agg(F.avg("v").alias("va"))
    b = act.groupBy("layer", "feature", "protein_id").agg(F.var_samp("value").alias("v")).groupBy("layer", "feature").agg(F.avg("v").alias("vb"))
    return a.join(b, ["layer", "feature"]).select("layer", "feature", F.least(F.lit(1.0), ratio("va", F.col("vb") + 1e-8)).alias("specificity"))


def activation_conservation(act: DataFrame) -> DataFrame:
    """Mean over positions of 1 - std / mean |v| across proteins."""
    m = act.groupBy("layer", "feature", "pos").agg((1 - F.stddev_samp("value") / (F.avg(F.abs("value")) + 1e-10)).alias("c"))
    return m.groupBy("layer", "feature").agg(F.avg("c").alias("conservation"))


def coactivation_entropy(coact: DataFrame) -> DataFrame:
    """Entropy-like score of P(j | i) inside (0.1, 0.9), normalised by ln(k + 1), at most 1."""
    d = coact.filter("i = j").select("i", F.col("p").alias("pi"))
    q = coact.filter("i != j").join(d, "i").withColumn("q", ratio("p", "pi")).filter("q > 0.1 and q < 0.9")
    s = q.groupBy("i").agg((-F.sum(F.col("q") * F.log(F.col("q") + 1e-10))).alias("h"), F.count("*").alias("k"))
    return s.select(F.col("i").alias("feature"), F.least(F.lit(1.0), F.col("h") / F.log(F.col("k") + 1.0)).alias("score"), F.col("k").alias("partners"))
