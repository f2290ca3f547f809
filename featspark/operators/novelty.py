"""Novelty of features: distribution, pattern, circuit and spatial tests, ranking and annotation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.num import count_if, lookup, share
from ..session import broadcast_if_small, cut_lineage
from .structure import radius_pairs

FEAT = ["layer", "feature"]


def count_modes(act: DataFrame, grid: int = 100, cells: int = 2048) -> DataFrame:
    """Local maxima of a Gaussian density (Scott bandwidth) on ``grid`` points between min and max.

    Values are first counted in ``cells`` equal cells per feature, so the kernel sum costs
    cells x grid per feature whatever the row count; the cell width is far below the bandwidth.
    """
    st = act.groupBy(*FEAT).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.stddev_samp("value").alias("sd"))
    b = F.least(F.lit(cells - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells)).cast("int")
    flat = (F.col("hi") <= F.col("lo")) | (F.col("n") < 10)
    h = act.join(broadcast_if_small(st.filter(~flat)), FEAT).groupBy(*FEAT, b.alias("b"), "n", "lo", "hi", "sd").agg(F.count("*").alias("k"), F.avg("value").alias("m"))
    x = h.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    z = (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("t") / (grid - 1.0) - F.col("m")) / (F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    d = x.groupBy(*FEAT, "t").agg(F.sum(F.col("k") * F.exp(-z * z / 2)).alias("d"))
    w = Window.partitionBy(*FEAT).orderBy("t")
    pk = d.withColumn("a", F.lag("d").over(w)).withColumn("c", F.lead("d").over(w)).groupBy(*FEAT).agg(count_if((F.col("d") > F.col("a")) & (F.col("d") > F.col("c"))).alias("n_modes"))
    return st.select(*FEAT, flat.alias("flat")).join(pk, FEAT, "left").select(*FEAT, F.when(F.col("flat"), 1).otherwise(F.coalesce("n_modes", F.lit(1))).cast("long").alias("n_modes"))


def gap_regularity(act: DataFrame, thr: float = 0.1, sparse: float = 0.05) -> DataFrame:
    """1 - std / mean of the gaps between active positions of a protein, for features active below ``sparse``; else 0.

    Gaps are taken inside proteins and pooled per feature, so windows stay bounded.
    """
    on = F.abs("value") > thr
    rate = act.groupBy(*FEAT).agg(share(on).alias("rate"))
    w = Window.partitionBy("protein_id", *FEAT).orderBy("pos")
    gaps = act.filter(on).select(*FEAT, (F.col("pos") - F.lag("pos").over(w)).alias("gap")).filter("gap is not null")
    g = gaps.groupBy(*FEAT).agg((1 - F.stddev_pop("gap") / (F.avg("gap") + 1e-10)).alias("g"))
    return rate.join(g, FEAT, "left").select(*FEAT, F.when(F.col("rate") < sparse, F.coalesce("g", F.lit(0.0))).otherwise(0.0).alias("regularity"))


def active_places(act: DataFrame, thr: float = 0.1) -> DataFrame:
    """Of each feature of a protein the ascending positions above ``thr`` and the last position."""
    on = F.sort_array(F.collect_list(F.when(F.abs("value") > thr, F.struct("pos"))))
    return act.groupBy("protein_id", *FEAT).agg(F.transform(on, lambda r: r.pos).alias("places"), F.max("pos").alias("last"))


def active_places_of(vecs: DataFrame, thr: float = 0.1) -> DataFrame:
    """:func:`active_places` for one vector per (protein_id, pos, layer)."""
    rows = F.sort_array(F.collect_list(F.struct("pos", F.transform("vec", lambda v: F.abs(v) > thr).alias("on"))))
    g = vecs.groupBy("protein_id", "layer").agg(rows.alias("rows"), F.max("pos").alias("last"), F.max(F.size("vec")).alias("width")).filter("width > 0")
    g = g.select("protein_id", "layer", "rows", "last", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("feature"))
    places = F.transform(F.filter("rows", lambda r: F.get(r.on, F.col("feature"))), lambda r: r.pos)
    return g.select("protein_id", *FEAT, places.alias("places"), "last")


def periodicity(act: DataFrame, max_lag: int | None = None, thr: float = 0.1) -> DataFrame:
    """Regular spacing of autocorrelation peaks of the active mask: value of the first peak, else 0.

    Lags run inside a protein; peaks are lags >= 5 with correlation > 0.5 above both neighbours, and at
    least two of them with spacing cv < 0.2. ``max_lag`` defaults to half of the longest protein.
    """
    return periodicity_of(active_places(act, thr), max_lag)


def periodicity_of(places: DataFrame, max_lag: int | None = None) -> DataFrame:
    """:func:`periodicity` from :func:`active_places`, which are found once and kept."""
    places = cut_lineage(places)
    n0 = places.groupBy(*FEAT).agg(F.sum(F.size("places")).alias("n0")).filter("n0 >= 5")
    span = places.agg(F.floor((F.max("last") + 1) / 2).cast("int").alias("max_lag")) if max_lag is None else places.sparkSession.range(1).select(F.lit(max_lag).alias("max_lag"))
    span = F.broadcast(span.filter("max_lag >= 1"))  # one row
    # Pairs arise inside a row and leave the task as counts.
    lags = F.explode(F.sequence(F.lit(1), F.col("max_lag"))).alias("lag")
    pairs = places.filter("protein_id is not null").select(*FEAT, "places", F.posexplode("places").alias("k", "pos"))
    pairs = pairs.select(*FEAT, "pos", F.explode(F.slice("places", F.col("k") + 2, F.size("places"))).alias("later"))
    pairs = pairs.select(*FEAT, (F.col("later") - F.col("pos")).cast("int").alias("lag")).filter("lag >= 1")
    c = pairs.join(span, F.col("lag") <= F.col("max_lag")).groupBy(*FEAT, "lag").agg(F.count("*").alias("k"))
    grid = n0.crossJoin(span).select(*FEAT, "n0", lags)
    r = grid.join(c, [*FEAT, "lag"], "left").select(*FEAT, "lag", (F.coalesce("k", F.lit(0)) / F.col("n0")).alias("acf"))
    w = Window.partitionBy(*FEAT).orderBy("lag")
    pk = (r.withColumn("a", F.lag("acf").over(w)).withColumn("b", F.lead("acf").over(w)).filter("lag >= 5 and acf > 0.5 and acf > a and acf > b")
          .withColumn("step", F.col("lag") - F.lag("lag").over(w)))
    s = pk.groupBy(*FEAT).agg(F.count("*").alias("n"), F.min_by("acf", "lag").alias("first"), (F.stddev_pop("step") / (F.avg("step") + 1e-10)).alias("cv"))
    score = F.when((F.col("n") > 1) & (F.col("cv") < 0.2), F.least(F.lit(1.0), F.col("first"))).otherwise(0.0)
    return places.select(*FEAT).distinct().join(s, FEAT, "left").select(*FEAT, F.coalesce(score, F.lit(0.0)).alias("periodicity"))


def recurring_patterns(act: DataFrame, lengths=(3, 4, 5), thr: float = 0.1, similar: float = 0.8) -> DataFrame:
    """Best share of windows of the mean active mask whose dot product with some window exceeds ``similar``."""
    m = act.groupBy(*FEAT, "pos").agg(share(F.abs("value") > thr).alias("v"))
    a = m.groupBy(*FEAT).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s.v).alias("v"))
    best = F.lit(0.0)
    for n in lengths:
        wins = F.transform(F.sequence(F.lit(1), F.size("v") - n + 1), lambda i: F.slice("v", i, n))
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        count = F.array_max(F.transform(wins, lambda x: F.size(F.filter(wins, lambda y: dot(x, y) > similar))))
        k = F.size("v") - n + 1
        ok = (F.size("v") >= 2 * n) & (k > 5) & (count > 2)
        best = F.greatest(best, F.when(ok, count / k).otherwise(0.0))
    return a.select(*FEAT, best.alias("recurrence"))


def _combine(df: DataFrame, tests: dict) -> DataFrame:
    """Mean of the tests that fired plus the evidence map; tests: name -> (condition, score)."""
    kv = F.array(*[F.when(cond, F.struct(F.lit(k).alias("key"), v.cast("double").alias("value"))) for k, (cond, v) in tests.items()])
    ev = F.filter(kv, lambda e: e.isNotNull())
    total = F.aggregate(ev, F.lit(0.0), lambda s, e: s + e.value)
    return df.withColumn("evidence", F.map_from_entries(ev)).withColumn("novelty_score", F.when(F.size(ev) > 0, total / F.size(ev)).otherwise(0.0))


def statistical_novelty(act: DataFrame) -> DataFrame:
    on = share(F.abs("value") > 0.1)
    st = act.groupBy(*FEAT).agg(F.count("*").alias("n"), on.alias("rate"), F.kurtosis("value").alias("kurt"), F.stddev_pop("value").alias("sd"), F.avg(F.abs("value")).alias("ma"))
    j = st.filter("rate >= 0.01").join(count_modes(act), FEAT).join(gap_regularity(act), FEAT).join(periodicity(act), FEAT)
    c = _combine(j, {"multimodal": (F.col("n_modes") > 1, F.col("n_modes") / 10.0), "heavy_tailed": (F.col("kurt") > 3, F.least(F.col("kurt") / 10, F.lit(1.0))),
                     "sparse_pattern": (F.col("regularity") > 0.5, F.col("regularity")), "periodic": (F.col("periodicity") > 0.5, F.col("periodicity"))})
    conf = F.least(F.lit(1.0), F.col("n") / 1000) * F.least(F.lit(1.0), F.col("sd") / (F.col("ma") + 1e-10))
    return c.filter("novelty_score > 0.3").select(*FEAT, "novelty_score", conf.alias("confidence"), F.lit("statistical").alias("discovery_type"), "evidence")


def pattern_novelty(act: DataFrame, coact_score: DataFrame) -> DataFrame:
    from .aggregates import activation_conservation, positional_specificity
    live = act.groupBy(*FEAT).agg(F.max(F.abs("value")).alias("m")).filter("m >= 0.1").drop("m")
    j = (live.join(positional_specificity(act), FEAT).join(broadcast_if_small(coact_score.select("feature", F.col("score").alias("coact"))), "feature", "left")
         .join(recurring_patterns(act), FEAT).join(activation_conservation(act), FEAT))
    c = F.col("conservation")
    k = _combine(j, {"position_specific": (F.col("specificity") > 0.7, F.col("specificity")), "unique_coactivation": (F.col("coact") > 0.6, F.col("coact")),
                     "sequence_motif": (F.col("recurrence") > 0.5, F.col("recurrence")), "unusual_conservation": ((c < 0.3) | (c > 0.9), F.abs(c - 0.5) * 2)})
    return k.filter("novelty_score > 0.4").select(*FEAT, "novelty_score", F.lit(0.7).alias("confidence"), F.lit("pattern").alias("discovery_type"), "evidence")


#: Features of one group of :func:`spatial_clusters`, and cells (features x pairs) it looks at in one step.
BLOCK, STEP = 64, 1 << 21


def _components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of the component of each of ``n`` nodes; edges a - b."""
    label = np.arange(n)
    while True:
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = lo != hi
        if not open_.any():
            return label
        a, b = a[open_], b[open_]
        np.minimum.at(label, hi[open_], lo[open_])
        while (label != (up := label[label])).any():
            label = up


def _cluster_counts(min_pts: int):
    """Points and clusters of every feature of one protein, layer and block; a place is paired with itself too."""

    def count(active: pa.Table, pairs: pa.Table) -> pa.Table:
        i, j = pairs["i"].to_numpy(), pairs["j"].to_numpy()
        places, apart = np.unique(i[i == j]), i != j
        a, b = np.searchsorted(places, i[apart]), np.searchsorted(places, j[apart])
        known = np.isin(active["pos"].to_numpy(), places)
        feats, row = np.unique(active["feature"].to_numpy()[known], return_inverse=True)
        live = np.zeros((len(feats), len(places)), bool)
        live[row, np.searchsorted(places, active["pos"].to_numpy()[known])] = True
        clusters = []
        step = max(1, STEP // max(1, len(a), len(places)))
        for s in range(0, len(feats), step):
            on = live[s:s + step]
            f, k = np.nonzero(on[:, a] & on[:, b])
            u, v = f * len(places) + a[k], f * len(places) + b[k]
            core = on.ravel() & (np.bincount(u, minlength=on.size) + np.bincount(v, minlength=on.size) + 1 >= min_pts)
            both = core[u] & core[v]
            first = _components(u[both], v[both], on.size) == np.arange(on.size)
            clusters.append((core & first).reshape(on.shape).sum(axis=1))
        schema = active.schema
        return pa.table({"layer": pa.array(np.full(len(feats), active["layer"][0].as_py() if len(feats) else 0), schema.field("layer").type), "feature": pa.array(feats, schema.field("feature").type),
                         "n": pa.array(np.bincount(row, minlength=len(feats)), pa.int64()), "k": pa.array(np.concatenate(clusters or [[]]), pa.int64())})

    return count


def spatial_clusters(on: DataFrame, coords: DataFrame, eps: float = 8.0, min_pts: int = 3) -> DataFrame:
    """(layer, feature, n, k) per protein: active places that have coordinates and their clusters, as :func:`dbscan3d` finds them.

    Neighbours depend on the protein alone, so they are joined once per protein and not once per feature; the tasks
    look up which of them are active. A group is one protein, layer and block of features.
    """
    keys = ["protein_id", "layer", "block"]
    on = on.select("protein_id", *FEAT, "pos", F.floor(F.col("feature") / BLOCK).alias("block"))
    near = radius_pairs(coords, eps, inclusive=True).select("protein_id", "i", "j").unionByName(coords.select("protein_id", F.col("pos").alias("i"), F.col("pos").alias("j")))
    near = on.select(*keys).distinct().join(near, "protein_id").toDF("protein", "at_layer", "at_block", "i", "j")
    kind = on.schema
    out = T.StructType([kind["layer"], kind["feature"], T.StructField("n", T.LongType()), T.StructField("k", T.LongType())])
    return on.groupBy(*keys).cogroup(near.groupBy("protein", "at_layer", "at_block")).applyInArrow(_cluster_counts(min_pts), out)


def structural_novelty(act: DataFrame, coords: DataFrame) -> DataFrame:
    """Spatial clusters of a feature's active residues, per protein, averaged: min(1, clusters / (active / 5))."""
    cl = spatial_clusters(act.filter(F.abs("value") > 0.1), coords).filter("n >= 3")
    s = cl.select(F.col("layer").cast("int").alias("layer"), F.col("feature").cast("int").alias("feature"), F.least(F.lit(1.0), F.col("k") / (F.col("n") / 5)).alias("s"))
    g = s.groupBy(*FEAT).agg(F.avg("s").alias("spatial"))
    k = _combine(g, {"spatial_cluster": (F.col("spatial") > 0.7, F.col("spatial"))})
    return k.filter("novelty_score > 0.4").select(*FEAT, "novelty_score", F.lit(0.6).alias("confidence"), F.lit("structural").alias("discovery_type"), "evidence")


PLAUSIBLE = {"statistical": 0.7, "pattern": 0.8, "circuit": 0.6, "structural": 0.9}


def validate_discoveries(d: DataFrame, known: DataFrame) -> DataFrame:
    """Known features (``feature``, ``motif``) halve their novelty; others scale confidence by plausibility and evidence."""
    j = d.join(broadcast_if_small(known), "feature", "left")
    vals = F.map_values("evidence")
    strength = F.coalesce(F.aggregate(vals, F.lit(0.0), lambda s, v: s + v) / F.size(vals), F.lit(0.0))
    p = lookup("discovery_type", PLAUSIBLE, 0.5)
    is_known = F.col("motif").isNotNull()
    out = (j.withColumn("novelty_score", F.when(is_known, F.col("novelty_score") * 0.5).otherwise(F.col("novelty_score")))
           .withColumn("confidence", F.when(is_known, F.col("confidence")).otherwise(F.col("confidence") * p * (0.5 + 0.5 * strength)))
           .withColumn("biological_context", F.when(is_known, F.concat(F.lit("Rediscovered: "), F.col("motif")))))
    return out.filter("novelty_score > 0.3 and confidence > 0.4").drop("motif")


def rank_discoveries(d: DataFrame) -> DataFrame:
    return d.withColumn("combined", F.col("novelty_score") * F.col("confidence")).orderBy(F.desc("combined"), "discovery_type", *FEAT)


# Hypothesis and test by kind of discovery and the evidence they need (none for circuits), and experiments.
HYPOTHESES = [
    ("statistical", "multimodal", "Feature %d represents multiple distinct functional states", "Cluster proteins by this feature and test functional differences"),
    ("pattern", "position_specific", "Feature %d encodes position-specific functional information", "Mutate residues at high-activation positions and measure functional impact"),
    ("circuit", None, "Circuit %d represents a coordinated functional module", "Perturb circuit components simultaneously and measure synergistic effects"),
    ("structural", "spatial_cluster", "Feature %d identifies a structural-functional hotspot", "Design mutations in the spatial cluster and test for loss of function"),
]
EXPERIMENTS = {
    "statistical": [("mutagenesis", "Systematic mutation of high-activation residues"), ("biochemical", "Activity assays under different conditions")],
    "pattern": [("deletion", "Domain deletion to test necessity"), ("chimera", "Domain swapping with homologs")],
    "circuit": [("double_mutant", "Test epistatic interactions"), ("coevolution", "Analyze coevolution in protein family")],
    "structural": [("crystallography", "Structural determination of variants"), ("dynamics", "MD simulations or NMR dynamics")],
}
#: Ids of circuits among the features: below this number.
FIRST_CIRCUIT = -1000


def circuit_discoveries(circuits: DataFrame, thr: float = 0.6) -> DataFrame:
    """Circuits of novel topology as discoveries with the ids -1000, -1001, ... in order of importance (layer -1), and their structure.

    The ids need one order over all structures; these are few beside their instances.
    """
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("importance", 9)), "structure"))
    c = circuits.withColumn("feature", (FIRST_CIRCUIT + 1 - rank).cast("int")).withColumn("topology", F.least(F.lit(1.0), F.col("size") / 10))
    k = _combine(c, {"novel_topology": (F.col("topology") > thr, F.col("topology"))}).filter("novelty_score > 0.4")
    return k.select(F.lit(-1).alias("layer"), "feature", "structure", "novelty_score", F.lit(0.6).alias("confidence"), F.lit("circuit").alias("discovery_type"), "evidence",
                    F.format_string("Circuit with %d components", "size").alias("biological_context"))


def hypotheses(d: DataFrame) -> DataFrame:
    """Testable hypothesis of each discovery by its kind and evidence; empty texts where the evidence is of another kind."""
    name = F.when(F.col("discovery_type") == "circuit", F.abs(F.col("feature") - FIRST_CIRCUIT)).otherwise(F.col("feature"))
    text, test = F.lit(""), F.lit("")
    for kind, key, claim, suggestion in HYPOTHESES:
        fits = F.col("discovery_type") == kind
        if key is not None:
            fits = fits & F.array_contains(F.map_keys("evidence"), key)
        text, test = F.when(fits, F.format_string(claim, name)).otherwise(text), F.when(fits, suggestion).otherwise(test)
    return d.select(*FEAT, "discovery_type", text.alias("hypothesis"), test.alias("test_suggestion"))


def experiments(d: DataFrame) -> DataFrame:
    """Suggested experiments of each discovery: one row each, with the priority (high above 0.7 combined)."""
    listed = F.lit(None).cast("array<struct<type:string,description:string>>")
    for kind, rows in EXPERIMENTS.items():
        listed = F.when(F.col("discovery_type") == kind, F.array(*[F.struct(F.lit(t).alias("type"), F.lit(x).alias("description")) for t, x in rows])).otherwise(listed)
    priority = F.when(F.col("novelty_score") * F.col("confidence") > 0.7, "high").otherwise("medium")
    return d.select(*FEAT, "discovery_type", priority.alias("priority"), F.explode(listed).alias("e")).select(*FEAT, "discovery_type", "priority", "e.type", "e.description")


def annotate_discoveries(d: DataFrame, top: int | None = None) -> DataFrame:
    """Priority of the discoveries (of the ``top`` ones if given): high above 0.7 combined, else medium; hypothesis by discovery type."""
    text = {"statistical": "distinct activation regime", "pattern": "position-dependent function", "circuit": "coordinated computation", "structural": "spatially localised function"}
    r = rank_discoveries(d) if top is None else rank_discoveries(d).limit(top)
    return r.withColumn("priority", F.when(F.col("combined") > 0.7, "high").otherwise("medium")).withColumn("hypothesis", lookup("discovery_type", text, "unknown role"))


def discovery_summary(d: DataFrame) -> DataFrame:
    c = F.col("novelty_score") * F.col("confidence")
    return d.rollup("discovery_type").agg(F.count("*").alias("n"), F.avg("novelty_score").alias("avg_novelty"), F.avg("confidence").alias("avg_confidence"),
                                          count_if(F.col("confidence") > 0.7).alias("n_confident"), count_if(c > 0.8).alias("n_combined"))


def evaluate_novelty(act: DataFrame, coact_score: DataFrame, coords: DataFrame, known: DataFrame) -> DataFrame:
    cols = [*FEAT, "novelty_score", "confidence", "discovery_type", "evidence"]
    d = statistical_novelty(act).select(*cols).unionByName(pattern_novelty(act, coact_score).select(*cols)).unionByName(structural_novelty(act, coords).select(*cols))
    return rank_discoveries(validate_discoveries(d, known))
