"""Layer-to-layer analytics: similarity, emergence, transitions, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.num import count_if, pearson_agg, ratio, share
from ..sources.views import to_long
from .aggregates import ACTIVE, active, feature_importance, layer_state
from .gram import layer_pairs, pair_moments, with_corr


def adjacent_layers(act: DataFrame) -> DataFrame:
    """Same token and feature in layer l and l + 1.

    Vectors are paired before they unfold, so the shuffle moves one row per token and layer; long
    (possibly sparse) activations use a window over the layers of one token.
    """
    if "vec" in act.columns:
        p = layer_pairs(act, "adjacent").select("protein_id", "pos", F.col("la").alias("layer"), F.posexplode(F.arrays_zip("x", "y")).alias("feature", "c"))
        return p.select("protein_id", "pos", "layer", "feature", F.col("c.x").alias("value"), F.col("c.y").alias("next_value"))
    w = Window.partitionBy("protein_id", "pos", "feature").orderBy("layer")
    nxt = act.withColumn("next_layer", F.lead("layer").over(w)).withColumn("next_value", F.lead("value").over(w))
    return nxt.filter(F.col("next_layer") == F.col("layer") + 1).drop("next_layer")


def emergence(importance: DataFrame, thr: float = 0.3) -> DataFrame:
    w = Window.partitionBy("feature").orderBy("layer")
    d = importance.withColumn("delta", F.col("importance") - F.lag("importance").over(w))
    return (d.filter(F.abs("delta") > thr)
            .select("layer", "feature", "delta", F.when(F.col("delta") > 0, "emerging").otherwise("decaying").alias("pattern")))


def layer_similarity(vec: DataFrame) -> DataFrame:
    p = layer_pairs(vec, "adjacent")
    return p.groupBy("la", "lb").agg(F.avg(V.cosine("x", "y")).alias("similarity"))


def residual_strength(vec: DataFrame) -> DataFrame:
    p = layer_pairs(vec, "cross").filter("la = 0")
    return p.groupBy("lb").agg(F.avg(V.cosine("x", "y")).alias("residual_strength"))


def transition_matrix(vec: DataFrame, mode: str = "cosine") -> DataFrame:
    """(la, lb, i, j, weight) for consecutive layers.

    ``cosine``: column-normalised dot product; ``moment``: raw cross moment / n;
    ``mean_cosine``: cosine of the position profiles averaged over proteins.
    """
    if mode == "mean_cosine":
        prof = to_long(vec).groupBy("layer", "pos", "feature").agg(F.avg("value").alias("v"))
        rows = prof.groupBy("layer", "pos").agg(F.array_sort(F.collect_list(F.struct("feature", "v"))).alias("s"))
        vec = rows.select(F.lit(0).alias("protein_id"), "pos", "layer", F.transform("s", lambda e: e.v).alias("vec"))
    m = pair_moments(vec, "adjacent")
    if mode == "moment":
        w = F.col("sxy") / F.col("n")
    elif mode in ("cosine", "mean_cosine"):
        w = F.try_divide("sxy", F.greatest(F.sqrt("sxx"), F.lit(1e-12)) * F.greatest(F.sqrt("syy"), F.lit(1e-12)))
    else:
        raise ValueError(f"unknown transition mode {mode!r}")
    return m.select("la", "lb", "i", "j", w.alias("weight"))


def transition_entropy(tm: DataFrame) -> DataFrame:
    e = tm.withColumn("e", F.exp(F.abs("weight")))
    p = e.withColumn("p", F.col("e") / F.sum("e").over(Window.partitionBy("la", "i")))
    return p.groupBy("la", F.col("i").alias("feature")).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-8))).alias("entropy"))


def transformations(tm: DataFrame, keep: float = 0.8, link: float = 0.5) -> DataFrame:
    """preserved (diagonal > keep), split (several targets > link), merged (several sources > link)."""
    pres = tm.filter((F.col("i") == F.col("j")) & (F.col("weight") > keep)).select("la", F.lit("preserved").alias("kind"), F.col("i").alias("feature"), F.lit(1).cast("long").alias("partners"))
    strong = tm.filter(F.col("weight") > link)
    split = strong.groupBy("la", F.col("i").alias("feature")).agg(F.count("*").alias("partners")).filter("partners > 1").select("la", F.lit("split").alias("kind"), "feature", "partners")
    merged = strong.groupBy("la", F.col("j").alias("feature")).agg(F.count("*").alias("partners")).filter("partners > 1").select("la", F.lit("merged").alias("kind"), "feature", "partners")
    return pres.unionByName(split).unionByName(merged)


def same_feature_corr(act: DataFrame) -> DataFrame:
    return adjacent_layers(act).groupBy("layer", "feature").agg(pearson_agg("value", "next_value").alias("corr"))


def stable_features(act: DataFrame, thr: float = 0.8) -> DataFrame:
    """Correlated at least ``thr`` over every consecutive pair that has variance."""
    s = same_feature_corr(act).groupBy("feature").agg(F.min("corr").alias("min_corr"))
    return s.filter(F.col("min_corr").isNull() | (F.col("min_corr") >= thr))


def stable_by_moment(tm: DataFrame, thr: float) -> DataFrame:
    """Second form: accumulated raw cross-moment on the diagonal above ``thr`` for every layer."""
    s = tm.filter("i = j").groupBy(F.col("i").alias("feature")).agg(F.min("weight").alias("min_moment"))
    return s.filter(F.col("min_moment") > thr)


def transition_type(src_on: Column, dst_on: Column, corr: Column, src: Column, dst: Column, corr_thr: float) -> Column:
    return (F.when(~src_on & dst_on, "emerged").when(src_on & ~dst_on, "vanished")
            .when(corr > corr_thr, F.when(dst > src * 1.2, "amplified").when(dst < src * 0.8, "diminished").otherwise("preserved"))
            .otherwise("transformed"))


def classify_transitions(act: DataFrame, thr: float = ACTIVE, corr_thr: float = 0.7) -> DataFrame:
    """Per protein, consecutive layers and feature: what happened to the feature."""
    g = adjacent_layers(act).groupBy("protein_id", "layer", "feature").agg(
        F.max(active("value", thr)).alias("src_on"), F.max(active("next_value", thr)).alias("dst_on"),
        F.avg(F.abs("value")).alias("src"), F.avg(F.abs("next_value")).alias("dst"),
        F.coalesce(pearson_agg("value", "next_value"), F.lit(0.0)).alias("correlation"))
    kind = transition_type(F.col("src_on"), F.col("dst_on"), F.col("correlation"), F.col("src"), F.col("dst"), corr_thr)
    return g.filter("src_on or dst_on").select(
        "protein_id", "feature", F.col("layer").alias("source_layer"), (F.col("layer") + 1).alias("target_layer"),
        (F.col("dst") - F.col("src")).alias("magnitude_change"), "correlation", kind.alias("transformation_type"))


def transition_counts(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("transformation_type").agg(F.count("*").alias("n"))


def critical_transitions(transitions: DataFrame, k: int = 10) -> DataFrame:
    return (transitions.withColumn("abs_change", F.abs("magnitude_change"))
            .orderBy(F.desc("abs_change"), "protein_id", "source_layer", "feature").limit(k))


def _shifted(state: DataFrame) -> DataFrame:
    return state.select("protein_id", (F.col("layer") + 1).alias("layer"), "feature")


def emerged(state: DataFrame) -> DataFrame:
    """Active here, not active one layer before (layer 0 has no predecessor)."""
    return state.filter("layer > 0").join(_shifted(state), ["protein_id", "layer", "feature"], "left_anti")


def preserved(state: DataFrame) -> DataFrame:
    return state.join(_shifted(state), ["protein_id", "layer", "feature"], "left_semi")


def vanished(state: DataFrame) -> DataFrame:
    nxt = state.select("protein_id", (F.col("layer") - 1).alias("layer"), "feature")
    top = state.agg(F.max("layer").alias("top"))
    return state.join(nxt, ["protein_id", "layer", "feature"], "left_anti").join(F.broadcast(top), F.col("layer") < F.col("top")).drop("top")


def active_set_ops(state: DataFrame, op: str) -> DataFrame:
    """Set algebra on (protein, feature) between consecutive layers: ``intersect`` or ``except``."""
    cur, prev = state.filter("layer > 0").select("protein_id", "layer", "feature"), _shifted(state)
    return cur.intersect(prev) if op == "intersect" else cur.exceptAll(prev)


def layer_summary(state: DataFrame) -> DataFrame:
    """Emergence and preservation rate of each layer against the one before it, in one pass."""
    w = Window.partitionBy("protein_id", "feature").orderBy("layer")
    s = state.select("protein_id", "layer", "feature").withColumn("was_on", F.coalesce(F.lag("layer").over(w) == F.col("layer") - 1, F.lit(False)))
    g = s.groupBy("protein_id", "layer").agg(F.count("*").alias("cur"), count_if(F.col("was_on")).alias("kept"))
    prev = g.select("protein_id", (F.col("layer") + 1).alias("layer"), F.col("cur").alias("prev"))
    j = g.filter("layer > 0").join(prev, ["protein_id", "layer"], "left")
    return j.select("protein_id", "layer", (F.col("cur") - F.col("kept")).alias("n_emerged"), "kept",
                    ((F.col("cur") - F.col("kept")) / F.greatest("cur", F.lit(1))).alias("emergence_rate"),
                    (F.col("kept") / F.greatest(F.coalesce("prev", F.lit(0)), F.lit(1))).alias("preservation_rate"))


def layer_jaccard(state: DataFrame) -> DataFrame:
    """Jaccard of active sets of every two layers of a protein; the layer list per feature is bounded."""
    f = state.groupBy("protein_id", "feature").agg(F.sort_array(F.collect_set("layer")).alias("ls"))
    pairs = F.explode(F.flatten(F.transform("ls", lambda a: F.transform(F.filter("ls", lambda b: b > a), lambda b: F.struct(a.alias("la"), b.alias("lb"))))))
    both = f.select("protein_id", pairs.alias("p")).groupBy("protein_id", "p.la", "p.lb").agg(F.count("*").alias("both"))
    size = state.groupBy("protein_id", "layer").agg(F.count("*").alias("n"))
    ls = size.groupBy("protein_id").agg(F.sort_array(F.collect_list(F.struct("layer", "n"))).alias("ls"))
    grid = ls.select("protein_id", F.explode(F.flatten(F.transform("ls", lambda a: F.transform(
        F.filter("ls", lambda b: b.layer > a.layer), lambda b: F.struct(a.layer.alias("la"), b.layer.alias("lb"), (a.n + b.n).alias("s")))))).alias("g")).select("protein_id", "g.*")
    j = grid.join(both, ["protein_id", "la", "lb"], "left").fillna(0, ["both"])
    return j.select("protein_id", "la", "lb", ratio("both", F.col("s") - F.col("both")).alias("jaccard"))


def evolution_by_position(vec: DataFrame) -> DataFrame:
    """Stability (cosine), net emergence and decay per layer step and position; active means v > 0.1."""
    on = lambda a: F.size(F.filter(a, lambda v: v > ACTIVE))
    p = layer_pairs(vec, "adjacent").select("la", "pos", V.cosine("x", "y").alias("c"), (on("y") - on("x")).alias("d"), F.size("x").alias("k"))
    return p.groupBy(F.col("la").alias("layer"), "pos").agg(F.avg("c").alias("stability"), F.avg(F.col("d") / F.col("k")).alias("emergence"),
                                                           F.avg(-F.col("d") / F.col("k")).alias("decay"))


def feature_lineage(act: DataFrame) -> DataFrame:
    """Per feature and layer: rate, mean |v|, correlation with layer 0 (0 when constant), mean |change|."""
    w = Window.partitionBy("protein_id", "pos", "feature").orderBy("layer")
    a = act.withColumn("v0", F.first("value").over(w)).withColumn("prev", F.lag("value").over(w))
    g = a.groupBy("feature", "layer").agg(share(active()).alias("activation_rate"), F.avg(F.abs("value")).alias("magnitude"),
                                          F.coalesce(pearson_agg("v0", "value"), F.lit(0.0)).alias("corr_first"),
                                          F.avg(F.abs(F.col("value") - F.col("prev"))).alias("contribution"))
    return g


def lineages(transitions: DataFrame, state: DataFrame, n_layers: int, thr: float = 0.7) -> DataFrame:
    """Follow a layer-0 feature upward while its step correlation stays above ``thr``.

    The followed feature keeps its id, so the lineage length is the first broken step.
    """
    start = state.filter("layer = 0").select("protein_id", "feature")
    ok = transitions.filter(F.col("correlation") > thr).join(
        state.select("protein_id", F.col("layer").alias("target_layer"), "feature"), ["protein_id", "target_layer", "feature"], "left_semi")
    steps = ok.groupBy("protein_id", "feature").agg(F.collect_set("source_layer").alias("s"))
    reach = F.aggregate(F.sequence(F.lit(0), F.lit(n_layers - 2)), F.lit(0),
                        lambda acc, l: F.when((acc == l) & F.array_contains("s", l), acc + 1).otherwise(acc))  # noqa: E741
    j = start.join(steps, ["protein_id", "feature"])
    return j.select("protein_id", "feature", (reach + 1).alias("length")).filter("length > 1")


def rank_features(state: DataFrame, transitions: DataFrame, criterion: str, n_layers: int) -> DataFrame:
    """Score per feature by persistence, magnitude, emergence or influence, best first."""
    if criterion == "persistence":
        s = state.groupBy("feature").agg((F.countDistinct("layer") / F.lit(float(n_layers))).alias("score"))
    elif criterion == "magnitude":
        s = state.groupBy("feature").agg(F.max("magnitude").alias("score"))
    elif criterion == "emergence":
        s = state.groupBy("feature").agg((1 - F.min("layer") / F.lit(float(n_layers))).alias("score"))
    elif criterion == "influence":
        s = (transitions.filter(F.col("transformation_type").isin("amplified", "preserved"))
             .groupBy("feature").agg(F.sum(F.abs("correlation")).alias("score")))
    else:
        raise ValueError(f"unknown criterion {criterion!r}")
    return s.orderBy(F.desc("score"), "feature")


def layer_coherence(vec: DataFrame) -> DataFrame:
    """Correlation of all values of consecutive layers, then their mean."""
    p = layer_pairs(vec, "adjacent").select("la", F.size("x").alias("n"), V.asum("x").alias("sx"), V.asum("y").alias("sy"),
                                            V.sq_norm("x").alias("sxx"), V.sq_norm("y").alias("syy"), V.dot("x", "y").alias("sxy"))
    from ..functions.num import pearson
    m = p.groupBy("la").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    return m.select("la", pearson("n", "sx", "sy", "sxx", "syy", "sxy").alias("coherence"))


def best_cosine_coherence(vec: DataFrame) -> DataFrame:
    """Loss form: minus the mean over positions of the best cosine with any next-layer position of the protein."""
    a = vec.select("protein_id", "pos", "layer", V.normalize("vec").alias("x"))
    b = a.select("protein_id", F.col("pos").alias("pos_b"), (F.col("layer") - 1).alias("layer"), F.col("x").alias("y"))
    best = a.join(b, ["protein_id", "layer"]).groupBy("protein_id", "layer", "pos").agg(F.max(V.dot("x", "y")).alias("best"))
    return best.groupBy("layer").agg((-F.avg("best")).alias("coherence_loss"))


def top_connections(tm: DataFrame, k: int = 20) -> DataFrame:
    w = Window.partitionBy("la").orderBy(F.desc(F.round(F.abs("weight"), 9)), "i", "j")  # ties closer than float noise go by id
    return tm.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def flow_links(vec: DataFrame, thr: float = 0.3) -> DataFrame:
    m = with_corr(pair_moments(vec, "adjacent"))
    return m.filter(F.abs("corr") > thr).select("la", "i", "j", F.abs("corr").alias("weight"))


def evolution_report(vec: DataFrame, act: DataFrame, thr: float = 0.3) -> DataFrame:
    """One row per layer: magnitude, diversity, similarity to the next layer, residual, emerging and decaying counts."""
    from .aggregates import layer_magnitude
    out = layer_magnitude(vec)
    sim = layer_similarity(vec).select(F.col("la").alias("layer"), "similarity")
    res = residual_strength(vec).select(F.col("lb").alias("layer"), "residual_strength")
    em = emergence(feature_importance(act), thr).groupBy("layer").agg(count_if(F.col("pattern") == "emerging").alias("n_emerging"),
                                                                      count_if(F.col("pattern") == "decaying").alias("n_decaying"))
    return out.join(sim, "layer", "left").join(res, "layer", "left").join(em, "layer", "left").fillna(0, ["n_emerging", "n_decaying"])


def tracker_report(vec: DataFrame) -> DataFrame:
    """Layer tracker: mean rates per layer over proteins, plus step counts of every transition type."""
    state = layer_state(to_long(vec))
    summ = layer_summary(state).groupBy("layer").agg(F.avg("emergence_rate").alias("emergence_rate"), F.avg("preservation_rate").alias("preservation_rate"))
    tr = classify_transitions(vec)
    kinds = ["emerged", "vanished", "amplified", "diminished", "preserved", "transformed"]
    cnt = tr.groupBy(F.col("target_layer").alias("layer")).agg(*[count_if(F.col("transformation_type") == k).alias(k) for k in kinds])
    return summ.join(cnt, "layer", "left")
