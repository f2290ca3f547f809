"""Biological relevance of features: sites, patterns, conservation, combined scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as K
from ..functions import vec as V
from ..functions.num import count_if, pearson_agg, ratio, share
from ..session import broadcast_if_small, cut_lineage
from .sequence import in_region, regex_spans, variant_sites

FEAT = ["layer", "feature"]
PF = ["protein_id", *FEAT]


def protein_moments(act: DataFrame) -> DataFrame:
    return act.groupBy(*PF).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def elevated(act: DataFrame, k: float = 1.0) -> DataFrame:
    """Positions above mean + k std of their protein; the window holds one protein's positions of one feature."""
    w = Window.partitionBy(*PF)
    return act.withColumn("_t", F.avg("value").over(w) + k * F.stddev_samp("value").over(w)).filter("value > _t").drop("_t")


def _score(df: DataFrame, expr, name: str, act: DataFrame) -> DataFrame:
    """Feature scores with 0 for features without a hit."""
    s = df.groupBy(*FEAT).agg(expr.alias(name))
    return act.select(*FEAT).distinct().join(s, FEAT, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def go_correlation(act: DataFrame, terms: DataFrame) -> DataFrame:
    """max |corr| of the protein-mean activation with every term that has a positive (``protein_id``, ``term``, ``flag`` 0/1)."""
    pooled = act.groupBy(*PF).agg(F.avg("value").alias("v"))
    g = pooled.join(terms, "protein_id").groupBy(*FEAT, "term").agg(F.abs(pearson_agg("v", "flag")).alias("c"), F.sum("flag").alias("pos")).filter("pos > 0")
    return _score(g.filter("c is not null"), F.max("c"), "go_correlation", act)


def catalytic_score(act: DataFrame, res: DataFrame) -> DataFrame:
    """Mean enrichment of catalytic residues among elevated positions, over proteins above 1.5 x chance (6/20)."""
    expected = len(K.CATALYTIC) / 20
    e = elevated(act).join(res.select("protein_id", "pos", "aa"), ["protein_id", "pos"])
    s = e.groupBy(*PF).agg(share(F.col("aa").isin(list(K.CATALYTIC))).alias("s")).filter(F.col("s") > expected * 1.5)
    return _score(s, F.avg(F.col("s") / expected), "catalytic_score", act)


def _span_means(act: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean activation of each hit region with the protein mean beside it."""
    at = spans.select("protein_id", "pattern", "start", F.explode(F.expr("sequence(start, end - 1)")).alias("pos"))
    m = at.join(act, ["protein_id", "pos"]).groupBy(*PF, "pattern", "start").agg(F.avg("value").alias("v"))
    return m.join(protein_moments(act), PF)


def binding_score(act: DataFrame, proteins: DataFrame) -> DataFrame:
    hits = _span_means(act, regex_spans(proteins, K.BINDING_PATTERNS)).filter("v > mean")
    n = hits.groupBy(*PF).agg(F.count("*").alias("n"))
    return _score(n, F.avg(F.least(F.lit(1.0), F.col("n") / float(len(K.BINDING_PATTERNS)))), "binding_score", act)


def domain_score(act: DataFrame, proteins: DataFrame) -> DataFrame:
    m = _span_means(act, regex_spans(proteins, K.DOMAIN_PATTERNS)).groupBy(*PF, "pattern").agg(F.avg("v").alias("d"), F.first("mean").alias("mean"))
    hit = m.filter(F.col("d") > F.col("mean") * 1.5)
    return _score(hit, F.least(F.lit(1.0), F.avg(F.col("d") / (F.col("mean") + 1e-10))), "domain_score", act)


def _start_hits(act: DataFrame, spans: DataFrame, k: float) -> DataFrame:
    s = spans.select("protein_id", F.col("start").alias("pos"), "pattern")
    return elevated(act, k).join(s, ["protein_id", "pos"])


def structural_score(act: DataFrame, proteins: DataFrame) -> DataFrame:
    h = _start_hits(act, regex_spans(proteins, K.STRUCTURAL_PATTERNS), 1.0)
    n = proteins.agg((F.count("*") * len(K.STRUCTURAL_PATTERNS)).alias("_n"))
    return _score(h.join(F.broadcast(n)), F.least(F.lit(1.0), F.count("*") / F.max("_n")), "structural_score", act)


def ptm_score(act: DataFrame, proteins: DataFrame) -> DataFrame:
    h = _start_hits(act, regex_spans(proteins, K.PTM_PATTERNS), 0.5)
    n = proteins.agg((F.count("*") * 3).alias("_n"))
    return _score(h.join(F.broadcast(n)), F.least(F.lit(1.0), F.count("*") / F.max("_n")), "ptm_score", act)


def ss_preference(act: DataFrame, res: DataFrame) -> DataFrame:
    m = act.join(res.select("protein_id", "pos", "ss"), ["protein_id", "pos"]).groupBy(*PF, "ss").agg(F.avg("value").alias("v"))
    p = m.groupBy(*PF).agg(F.max("v").alias("mx"), F.avg("v").alias("mn"), F.count("*").alias("k")).filter((F.col("k") > 1) & (F.col("mx") > F.col("mn") * 1.5))
    return _score(p, F.least(F.lit(1.0), F.avg(F.col("mx") / (F.col("mn") + 1e-10)) - 1), "ss_preference", act)


def conservation_corr(act: DataFrame, res: DataFrame) -> DataFrame:
    j = act.join(res.select("protein_id", "pos", "conservation"), ["protein_id", "pos"])
    p = j.groupBy(*PF).agg(F.abs(pearson_agg("value", "conservation")).alias("c"), F.sum("conservation").alias("s")).filter("s > 0 and c is not null")
    return _score(p, F.max("c"), "conservation_corr", act)


def coevolution_enrichment(act: DataFrame, coevo: DataFrame) -> DataFrame:
    """Mean coevolution of elevated pairs (above the feature's global mean + std) against the protein's mean, over 1.5."""
    t = act.groupBy(*FEAT).agg((F.avg("value") + F.stddev_samp("value")).alias("_t"))
    hot = act.join(broadcast_if_small(t), FEAT).filter("value > _t").select(*PF, "pos")
    pairs = coevo.join(hot.withColumnRenamed("pos", "i"), ["protein_id", "i"]).join(hot.withColumnRenamed("pos", "j"), [*PF, "j"])
    back = coevo.groupBy("protein_id").agg(F.avg("score").alias("bg"))
    m = pairs.groupBy(*PF).agg(F.avg("score").alias("m")).join(back, "protein_id").filter(F.col("m") > F.col("bg") * 1.5)
    return _score(m, F.least(F.lit(1.0), F.avg(F.col("m") / (F.col("bg") + 1e-10)) - 1), "coevolution_enrichment", act)


def group_f(act: DataFrame, clusters: DataFrame) -> DataFrame:
    """Between-group over within variance of activations by position, / 10, at most 1; 0 with fewer than two groups."""
    g = act.join(clusters, "protein_id").groupBy(*FEAT, "pos", "cluster").agg(F.avg("value").alias("v"))
    between = g.groupBy(*FEAT, "pos").agg(F.var_samp("v").alias("b"), F.count("*").alias("k")).filter("k > 1").groupBy(*FEAT).agg(F.avg("b").alias("b"))
    within = act.groupBy(*FEAT, "pos").agg(F.var_samp("value").alias("w")).groupBy(*FEAT).agg(F.avg("w").alias("w"))
    j = within.join(between, FEAT, "left")
    return j.select(*FEAT, F.coalesce(F.least(F.lit(1.0), ratio("b", "w") / 10), F.lit(0.0)).alias("group_f"))


def variant_enrichment(act: DataFrame, res: DataFrame, variants: DataFrame) -> DataFrame:
    sites = variant_sites(res.select("protein_id", "pos", "aa"), variants.filter("class = 'pathogenic'")).select("protein_id", "pos").distinct()
    v = act.join(sites, ["protein_id", "pos"]).groupBy(*PF).agg(F.avg("value").alias("v")).join(protein_moments(act), PF).filter("mean > 0")
    e = v.withColumn("e", F.col("v") / F.col("mean")).filter("e > 1.5")
    return _score(e, F.least(F.lit(1.0), (F.avg("e") - 1) / 2), "variant_enrichment", act)


def disorder_score(act: DataFrame, windows: DataFrame, proteins: DataFrame, width: int = 20) -> DataFrame:
    """Disorder-rich windows whose mean activation exceeds the protein mean, per protein x 5, at most 1."""
    at = windows.select("protein_id", "start", F.explode(F.expr(f"sequence(start, start + {width - 1})")).alias("pos"))
    m = at.join(act, ["protein_id", "pos"]).groupBy(*PF, "start").agg(F.avg("value").alias("v")).join(protein_moments(act), PF).filter("v > mean")
    n = proteins.agg((F.count("*") * 5).alias("_n"))
    return _score(m.join(F.broadcast(n)), F.least(F.lit(1.0), F.count("*") / F.max("_n")), "disorder_score", act)


def site_enrichment(act: DataFrame, sites: DataFrame) -> DataFrame:
    """Mean |v| at sites of each kind (``protein_id``, ``pos``, ``kind``, ``probability`` > 0.5) over the background."""
    a = act.groupBy("protein_id", "pos").agg(F.sum(F.abs("value")).alias("s"), F.count("*").alias("n"))
    tot = a.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    hit = sites.filter("probability > 0.5").select("protein_id", "pos", "kind").distinct().join(a, ["protein_id", "pos"]).groupBy("kind").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    bg = ratio(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))
    return hit.join(F.broadcast(tot)).select("kind", (F.col("s") / F.col("n") / (bg + 1e-8)).alias("enrichment"))


def structure_function(act: DataFrame, res: DataFrame) -> DataFrame:
    a = act.groupBy("protein_id", "pos").agg(F.sum(F.abs("value")).alias("s"), F.count("*").alias("n")).join(res.select("protein_id", "pos", "ss", "conservation"), ["protein_id", "pos"])
    cons = F.col("conservation") > 0.7

    def rel(state):
        part = lambda cond: ratio(F.sum(F.when(cond, F.col("s"))), F.sum(F.when(cond, F.col("n"))))
        return part((F.col("ss") == state) & cons) / (part((F.col("ss") == state) & ~cons) + 1e-8)

    return a.agg(rel("H").alias("helix"), rel("E").alias("sheet")).select("helix", "sheet", F.greatest("helix", "sheet").alias("structure_function"))


def template_enrichment(act: DataFrame, templates: dict[str, list[int]]) -> DataFrame:
    """Mean correlation of every activation window (positive sum) with a 0/1 template, per template and feature."""
    w = Window.partitionBy(*PF).orderBy("pos")
    out = None
    for name, t in templates.items():
        n = len(t)
        win = act.select(*PF, F.collect_list("value").over(w.rowsBetween(0, n - 1)).alias("v")).filter(F.size("v") == n)
        st = float(sum(t))
        sx, sxx = V.asum("v"), V.sq_norm("v")
        sxy = V.dot("v", F.array(*[F.lit(float(k)) for k in t]))
        vx, vy = n * sxx - sx * sx, n * st - st * st
        m = win.filter(sx > 0).select(*FEAT, F.when((vx > 1e-15) & F.lit(vy > 0), (n * sxy - sx * st) / (F.sqrt(vx) * vy ** 0.5)).alias("c"))
        part = m.groupBy(*FEAT).agg(F.avg("c").alias("enrichment")).withColumn("template", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def class_accuracy(pred: DataFrame) -> DataFrame:
    return pred.groupBy("label").agg(share(F.col("label") == F.col("prediction")).alias("accuracy"), F.count("*").alias("n"))


def class_accuracy_summary(per: DataFrame) -> DataFrame:
    return per.agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"), (F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("overall"))


# weights of the four components and of their parts
PARTS = {
    "function": {"go_correlation": 0.4, "catalytic_score": 0.3, "binding_score": 0.3},
    "structure": {"domain_score": 0.4, "ss_preference": 0.3, "structural_score": 0.3},
    "evolution": {"conservation_corr": 0.5, "coevolution_enrichment": 0.3, "group_f": 0.2},
    "disease": {"variant_enrichment": 0.5, "ptm_score": 0.3, "disorder_score": 0.2},
}
TOTAL = {"function": 0.3, "structure": 0.25, "evolution": 0.25, "disease": 0.2}
GATES = {"go_correlation": 0.5, "conservation_corr": 0.5}


def relevance_scores(act: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Component and total scores per feature; features never above 0.1 are skipped, evidence names the parts that fired."""
    j = act.groupBy(*FEAT).agg(F.max(F.abs("value")).alias("_m")).filter("_m >= 0.1").drop("_m")
    for p in parts:
        j = j.join(p, FEAT, "left")
    missing = sorted({k for w in PARTS.values() for k in w} - set(j.columns))
    if missing:
        raise ValueError(f"scores need all their parts; missing: {missing}")
    evidence = []
    for comp, w in PARTS.items():
        total = F.lit(0.0)
        for k, x in w.items():
            v = F.coalesce(F.col(k), F.lit(0.0))
            fired = v > GATES.get(k, 0.0)
            total = total + F.when(fired, v * x).otherwise(0.0)
            evidence.append(F.when(fired, F.lit(k)))
        j = j.withColumn(comp, total)
    j = j.withColumn("total", sum((F.col(k) * w for k, w in TOTAL.items()), F.lit(0.0)))
    names = F.array_sort(F.filter(F.array(*evidence), lambda e: e.isNotNull()))
    strong = F.greatest(*[F.col(k) for k in PARTS]) > 0.3
    return j.select(*FEAT, *PARTS, "total", F.when(strong, F.array_join(names, ";")).otherwise("").alias("evidence"))


def important_features(scores: DataFrame, thr: float = 0.6) -> DataFrame:
    return scores.filter(F.col("total") > thr).orderBy(F.desc("total"), *FEAT)


def relevance_summary(scores: DataFrame) -> DataFrame:
    t = F.col("total")
    return scores.agg(F.count("*").alias("n_features"), count_if(t > 0.7).alias("high"), count_if((t > 0.4) & (t <= 0.7)).alias("medium"), count_if(t <= 0.4).alias("low"),
                      *[F.avg(k).alias(f"avg_{k}") for k in PARTS])


# regions and levels ------------------------------------------------------------------------


def domain_property(values: DataFrame, domains: DataFrame, col: str) -> DataFrame:
    """Mean of a property inside a protein's domains, 0.5 when it has none."""
    m = in_region(values, domains).groupBy("protein_id").agg(F.avg(col).alias("m"))
    return values.select("protein_id").distinct().join(m, "protein_id", "left").select("protein_id", F.coalesce("m", F.lit(0.5)).alias("domain_property"))


def region_vectors(act: DataFrame, regions: DataFrame) -> DataFrame:
    g = in_region(act, regions).groupBy("protein_id", "layer", "domain_id", "feature").agg(F.avg("value").alias("v"))
    return g.groupBy("protein_id", "layer", "domain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("feature", "v"))), lambda s: s.v).alias("vec"))


def domain_interactions(act: DataFrame, domains: DataFrame) -> DataFrame:
    """Class of every two domains of a protein by the cosine of their mean vectors; pairs unfold inside the protein's row."""
    r = region_vectors(act, domains).groupBy("protein_id", "layer").agg(F.array_sort(F.collect_list(F.struct("domain_id", "vec"))).alias("ds"))
    pr = F.explode(F.flatten(F.transform("ds", lambda a: F.transform(F.filter("ds", lambda b: b.domain_id > a.domain_id), lambda b: F.struct(
        a.domain_id.alias("d1"), b.domain_id.alias("d2"), V.cosine(a.vec, b.vec).alias("cosine"))))))
    p = r.select("protein_id", "layer", pr.alias("p")).select("protein_id", "layer", "p.*")
    return p.withColumn("kind", F.when(F.col("cosine") > 0.8, "homotypic").when(F.col("cosine") > 0.5, "cooperative").otherwise("regulatory"))


def roll_levels(act: DataFrame, regions: DataFrame, domains: DataFrame) -> DataFrame:
    """Means up the hierarchy: residue -> structure region -> domain (by the region's start) -> protein, and the level's spread."""
    reg = regions.select("protein_id", "start", "end", F.col("start").alias("domain_id"))
    r = in_region(act, reg).groupBy("protein_id", "layer", "feature", F.col("domain_id").alias("pos")).agg(F.avg("value").alias("value"))
    d = in_region(r, domains).groupBy("protein_id", "layer", "feature", "domain_id").agg(F.avg("value").alias("value"))
    one = lambda df, k: df.groupBy("protein_id", "layer", "feature").agg(F.avg("value").alias(k))
    return one(act, "residue_mean").join(one(r, "region_mean"), PF, "left").join(one(d, "domain_mean"), PF, "left")


LEVELS = ("residue", "region", "domain", "protein")


def level_links(residues: DataFrame, regions: DataFrame, domains: DataFrame) -> DataFrame:
    """The hierarchy as parent links: (protein_id, level, child, parent), level 1 .. 3 of the parent, node names as text.

    Residues lie in regions by position, regions in domains by their start, all domains in their protein. A child may
    have several parents (overlapping regions) or none.
    """
    name = lambda c: F.col(c).cast("string")
    at = residues.select("protein_id", "pos").distinct()
    reg = regions.select("protein_id", "start", "end", F.col("start").alias("domain_id"))
    first = in_region(at, reg).select("protein_id", F.lit(1).alias("level"), name("pos").alias("child"), name("domain_id").alias("parent"))
    starts = reg.select("protein_id", F.col("start").alias("pos")).distinct()
    second = in_region(starts, domains).select("protein_id", F.lit(2).alias("level"), name("pos").alias("child"), name("domain_id").alias("parent"))
    third = domains.select("protein_id", F.lit(3).alias("level"), name("domain_id").alias("child"), F.lit("protein").alias("parent")).distinct()
    return first.unionByName(second).unionByName(third).distinct()


def pass_messages(act: DataFrame, links: DataFrame, own: float = 0.5) -> DataFrame:
    """(protein_id, layer, feature, level, node, up, down): both directions over the hierarchy.

    Upwards a node takes the mean of its children. Downwards, from the protein, a node takes ``own`` times its upward
    value plus the rest times the mean of its parents' downward values; without a parent it keeps its own. Every step
    is one join with the links of one level.
    """
    links = cut_lineage(links)
    key = ["protein_id", "layer", "feature"]
    ups = [act.select(*key, F.col("pos").cast("string").alias("node"), F.col("value").alias("up"))]
    for level in (1, 2, 3):
        step = links.filter(F.col("level") == level).select("protein_id", F.col("child").alias("node"), "parent")
        ups.append(cut_lineage(ups[-1].join(step, ["protein_id", "node"]).groupBy(*key, F.col("parent").alias("node")).agg(F.avg("up").alias("up"))))
    down = ups[3].withColumn("down", F.col("up"))
    out = down.withColumn("level", F.lit(LEVELS[3]))
    for level in (3, 2, 1):
        step = links.filter(F.col("level") == level).select("protein_id", F.col("child").alias("node"), "parent")
        message = down.select(*key, F.col("node").alias("parent"), "down").join(step, ["protein_id", "parent"]).groupBy(*key, "node").agg(F.avg("down").alias("m"))
        down = ups[level - 1].join(message, [*key, "node"], "left").select(*key, "node", "up", F.coalesce(own * F.col("up") + (1 - own) * F.col("m"), F.col("up")).alias("down"))
        down = cut_lineage(down)
        out = out.unionByName(down.withColumn("level", F.lit(LEVELS[level - 1])))
    return out.select(*key, "level", "node", "up", "down")


def pass_messages_vec(vecs: DataFrame, links: DataFrame, width: int, own: float = 0.5) -> DataFrame:
    """:func:`pass_messages` for one vector of ``width`` features per (protein_id, pos, layer), and the same rows as result.

    Means are taken element by element, so joins and groups move a vector per node in place of a row per feature.
    """
    links = cut_lineage(links)
    key = ["protein_id", "layer"]
    mean = lambda c: F.array(*[F.avg(F.get(c, F.lit(i))) for i in range(width)])
    ups = [vecs.select(*key, F.col("pos").cast("string").alias("node"), F.col("vec").alias("up"))]
    for level in (1, 2, 3):
        step = links.filter(F.col("level") == level).select("protein_id", F.col("child").alias("node"), "parent")
        ups.append(cut_lineage(ups[-1].join(step, ["protein_id", "node"]).groupBy(*key, F.col("parent").alias("node")).agg(mean("up").alias("up"))))
    down = ups[3].withColumn("down", F.col("up"))
    out = down.withColumn("level", F.lit(LEVELS[3]))
    for level in (3, 2, 1):
        step = links.filter(F.col("level") == level).select("protein_id", F.col("child").alias("node"), "parent")
        message = down.select(*key, F.col("node").alias("parent"), "down").join(step, ["protein_id", "parent"]).groupBy(*key, "node").agg(mean("down").alias("m"))
        taken = F.zip_with("up", "m", lambda u, m: F.coalesce(own * u + (1 - own) * m, u))
        down = ups[level - 1].join(message, [*key, "node"], "left").select(*key, "node", "up", F.coalesce(taken, F.col("up")).alias("down"))
        if level > 1:  # read twice
            down = cut_lineage(down)
        out = out.unionByName(down.withColumn("level", F.lit(LEVELS[level - 1])))
    pair = F.posexplode(F.arrays_zip("up", "down")).alias("feature", "v")
    return out.select(*key, "level", "node", pair).select(*key, "feature", "level", "node", "v.up", "v.down")


def resample(act: DataFrame, target: int) -> DataFrame:
    """Linear interpolation of a feature along positions to ``target`` points (half-pixel centres, clamped ends)."""
    n = act.groupBy("protein_id", "layer").agg((F.max("pos") + 1).alias("n"))
    g = n.select("protein_id", "layer", "n", F.explode(F.sequence(F.lit(0), F.lit(target - 1))).alias("t"))
    x = F.greatest(F.lit(0.0), (F.col("t") + 0.5) * F.col("n") / F.lit(float(target)) - 0.5)
    g = g.withColumn("x", x).withColumn("lo", F.floor("x")).withColumn("frac", F.col("x") - F.col("lo"))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("pos"), (1 - F.col("frac")).alias("w")), F.struct(F.least(F.col("lo") + 1, F.col("n") - 1).alias("pos"), F.col("frac").alias("w"))))
    e = g.select("protein_id", "layer", "t", ends.alias("e")).select("protein_id", "layer", "t", "e.pos", "e.w")
    return act.join(e, ["protein_id", "layer", "pos"]).groupBy("protein_id", "layer", "feature", F.col("t").alias("pos")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def repeat_protein(pooled: DataFrame, lengths: DataFrame) -> DataFrame:
    """A protein-level value repeated at each of its positions."""
    return pooled.join(lengths.filter("length > 0").select("protein_id", F.explode(F.expr("sequence(0, length - 1)")).alias("pos")), "protein_id")


def confident_sites(sites: DataFrame, regions: DataFrame, thr: float = 0.7) -> DataFrame:
    """Site predictions above ``thr``; absolute position = region start + offset."""
    j = sites.filter(F.col("probability") > thr).join(regions.select("protein_id", "domain_id", "start"), ["protein_id", "domain_id"])
    return j.select("protein_id", "domain_id", "kind", (F.col("start") + F.col("offset")).alias("pos"), "probability")


def reweight_regions(regions: DataFrame, context: DataFrame) -> DataFrame:
    j = regions.join(context, "protein_id", "left")
    return j.withColumn("confidence", F.col("confidence") * (0.5 + 0.5 * F.coalesce("context", F.lit(1.0)))).drop("context")


def community_pool(act: DataFrame, communities: DataFrame) -> DataFrame:
    """Mean vector per community of positions (``protein_id``, ``pos``, ``community``)."""
    return act.join(communities, ["protein_id", "pos"]).groupBy("protein_id", "community", "layer", "feature").agg(F.avg("value").alias("pooled"))


# 0/1 activation templates (fixed values)
TEMPLATES = {"helix_cap": [1, 0, 0, 0, 1, 1, 1, 1], "beta_turn": [0, 1, 1, 0, 0, 1, 1, 0], "zinc_finger": [1, 0, 0, 1, 0, 0, 1, 0]}

# structure predictions from scores ---------------------------------------------------------

# eight-state probability templates (fixed values) for helix, sheet and turn over H B E G I T S -
SS_TEMPLATES = {"helix": [1, 1, 1, 1, 0, 0, 0, 0], "sheet": [0, 0, 0, 0, 1, 1, 0, 0], "turn": [0, 0, 0, 0, 0, 0, 1, 0]}


def ss_template_scores(probs: DataFrame) -> DataFrame:
    """Dot product of each residue's state probabilities with the templates; disorder = 1 - max probability."""
    cols = [V.dot("probs", F.array(*[F.lit(float(x)) for x in t])).alias(k) for k, t in SS_TEMPLATES.items()]
    return probs.select("protein_id", "pos", *cols, (1 - F.array_max("probs")).alias("disorder"))


def boundary_scores(vec: DataFrame) -> DataFrame:
    nxt = F.lead("vec").over(Window.partitionBy("protein_id", "layer").orderBy("pos"))
    return vec.withColumn("n", nxt).select("protein_id", "layer", "pos", F.coalesce(V.diff_norm("vec", "n"), F.lit(0.0)).alias("score"))


def peaks(series: DataFrame, keys: list[str], thr: float = 0.5, col: str = "value") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("pos")
    p = series.withColumn("_a", F.lag(col).over(w)).withColumn("_b", F.lead(col).over(w))
    return p.filter((F.col(col) > thr) & (F.col(col) > F.col("_a")) & (F.col(col) > F.col("_b"))).drop("_a", "_b")


def boundary_regions(scores: DataFrame, min_dist: int = 30) -> DataFrame:
    """Domain regions between boundary peaks: height >= the protein's 75th percentile, strongest first, ``min_dist`` apart.

    Suppression depends on order, so each protein's peaks (bounded by its length) are walked in one call.
    """
    import pandas as pd
    keys = ["protein_id", "layer"]
    q = scores.groupBy(*keys).agg(F.expr("percentile(score, 0.75)").alias("q"), (F.max("pos") + 1).alias("n"))
    pk = peaks(scores, keys, -1.0, "score").join(q, keys).filter("score >= q").select(*keys, "pos", "score", "n")
    base = q.select(*keys, F.lit(None).cast("long").alias("pos"), F.lit(None).cast("double").alias("score"), "n")
    rows = pk.select(*keys, F.col("pos").cast("long").alias("pos"), "score", "n").unionByName(base)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        cand = pdf.dropna(subset=["pos"]).sort_values(["score", "pos"], ascending=[False, True])
        kept: list[int] = []
        for p in cand["pos"].astype(int):
            if all(abs(p - k) >= min_dist for k in kept):
                kept.append(p)
        n, kept = int(pdf["n"].iloc[0]), sorted(kept)
        cuts = ([0] if not kept or kept[0] > min_dist else []) + kept + ([n] if not kept or n - kept[-1] > min_dist else [])
        out = list(zip(cuts, cuts[1:]))
        return pd.DataFrame({"protein_id": pdf.protein_id.iloc[0], "layer": pdf.layer.iloc[0], "start": [a for a, _ in out], "end": [b for _, b in out]})

    return rows.groupBy(*keys).applyInPandas(walk, "protein_id long, layer int, start long, end long")


def start_end_regions(probs: DataFrame, thr: float = 0.5) -> DataFrame:
    """Open at the first p_start > thr, close at the next p_end > thr; each region is [start, end]."""
    r = probs.filter((F.col("p_start") > thr) | (F.col("p_end") > thr))
    seq = r.groupBy("protein_id").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("p_start") > thr).alias("s"), (F.col("p_end") > thr).alias("e")))).alias("ev"))
    init = F.struct(F.lit(-1).cast("long").alias("open"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc, e):
        opened = acc.open >= 0
        close = opened & e.e
        out = F.when(close, F.array_append(acc.out, F.struct(acc.open.alias("start"), e.pos.cast("long").alias("end")))).otherwise(acc.out)
        nxt = F.when(close, F.lit(-1).cast("long")).when(~opened & e.s, e.pos.cast("long")).otherwise(acc.open)
        return F.struct(nxt.alias("open"), out.alias("out"))

    return seq.select("protein_id", F.explode(F.aggregate("ev", init, step).out).alias("r")).select("protein_id", "r.start", "r.end")


def peak_links(series: DataFrame, thr: float = 0.5, first: int | None = None, min_weight: float = 0.2) -> DataFrame:
    """Links between the peaks of consecutive layers, weight = product of their values; ``first`` keeps that many per layer."""
    keys = ["protein_id", "feature", "layer"]
    p = peaks(series, keys, thr)
    k = p if first is None else p.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).filter(F.col("_k") <= first).drop("_k")
    nxt = k.select("protein_id", "feature", (F.col("layer") - 1).alias("layer"), F.col("pos").alias("pos_next"), F.col("value").alias("v2"))
    j = k.join(nxt, keys).withColumn("weight", F.col("value") * F.col("v2"))
    return j.filter(F.col("weight") > min_weight).select(*keys, "pos", "pos_next", "weight")
