"""Feature-interaction graph, recurring circuits and their validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import c, ratio
from ..functions.tables import MOTIF_LIBRARY
from ..session import broadcast_if_small, cut_lineage
from ..sources.views import to_long
from .aggregates import node_stats
from .gram import is_sparse, pair_moments, with_corr
from .pairs import binary_information, binned_mutual_info, causal_strength

WIDE = 1_000_000


def node_key(layer, feature) -> Column:
    return (c(layer).cast("long") * WIDE + c(feature)).cast("long")


def key_layer(node) -> Column:
    return F.floor(c(node) / WIDE).cast("int")


def key_feature(node) -> Column:
    return (c(node) % WIDE).cast("int")


def node_id(layer, feature) -> Column:
    return F.format_string("L%d_F%d", c(layer).cast("int"), c(feature).cast("int"))


def parse_node(name) -> Column:
    """STRUCT<layer, feature> of ``L3_F17``; anything else is an error."""
    name = c(name)
    ok = name.rlike(r"^L\d+_F\d+$")
    part = lambda k: F.regexp_extract(name, r"^L(\d+)_F(\d+)$", k).cast("int")
    bad = F.raise_error(F.concat(F.lit("invalid node id: "), name)).cast("struct<layer:int,feature:int>")
    return F.when(ok, F.struct(part(1).alias("layer"), part(2).alias("feature"))).otherwise(bad)


def path_text(path) -> Column:
    return F.array_join(F.transform(c(path), lambda n: F.concat(F.lit("L"), key_layer(n).cast("string"), F.lit("_F"), key_feature(n).cast("string"))), ",")


# graph construction ------------------------------------------------------------------------


def pair_mutual_info(act: DataFrame, pairs: DataFrame, bins: int = 10, tokens: DataFrame | None = None, eps: float = 1e-10) -> DataFrame:
    """MI of selected node pairs (``src``, ``dst`` node keys).

    Dense vectors: of quantile codes, scored in tiles of features. Sparse activations: of the two states active and
    not active, since quantiles of values that are mostly zero coincide; pairs that are never active together count too.
    """
    if is_sparse(act):
        m = pair_moments(act.filter("value != 0").withColumn("value", F.lit(1.0)), "upper", tokens)
        mi = m.select("la", "lb", "i", "j", binary_information("n", "sx", "sy", "sxy").alias("mutual_info"))
    else:
        mi = binned_mutual_info(act, "upper", bins, eps)
    mi = mi.select(node_key("la", "i").alias("src"), node_key("lb", "j").alias("dst"), "mutual_info")
    return pairs.select("src", "dst").join(mi, ["src", "dst"])


def interaction_graph(vec: DataFrame, thr: float = 0.3, min_mutual_info: float | None = None, tokens: DataFrame | None = None):
    """(nodes, edges): an edge where the causal strength exceeds ``thr``, with correlation and mutual information.

    From dense vectors or sparse activations. The latter need at least one activation of both nodes in neighbouring
    tokens for an edge; node statistics then cover active tokens.
    """
    sparse = is_sparse(vec)
    nodes = node_stats(vec if sparse else to_long(vec))
    e = causal_strength(vec, tokens, all_pairs=not sparse).filter(F.col("causal_strength") > thr).select(
        node_key("la", "i").alias("src"), node_key("lb", "j").alias("dst"), F.col("causal_strength").alias("weight"))
    corr = with_corr(pair_moments(vec, "upper", tokens)).select(node_key("la", "i").alias("src"), node_key("lb", "j").alias("dst"), F.col("corr").alias("correlation"))
    e = e.filter("src <> dst").join(corr, ["src", "dst"]).join(pair_mutual_info(vec, e, tokens=tokens), ["src", "dst"])
    if min_mutual_info is not None:
        e = e.filter(F.col("mutual_info") >= min_mutual_info)
    return nodes, e


# motif enumeration -------------------------------------------------------------------------


#: Bytes of a graph's adjacency up to which the enumerating tasks get it as a whole.
SHARED_GRAPH = 256 << 20


def _adjacency(edges: DataFrame) -> DataFrame:
    """at, nbs: the sorted neighbours of every node, directions ignored."""
    e = edges.select("src", "dst").filter("src <> dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy(F.col("src").alias("at")).agg(F.array_sort(F.collect_set("dst")).alias("nbs"))


def connected_sets(edges: DataFrame, size: int) -> DataFrame:
    """Every connected node set of ``size`` as a sorted array, each arising once, by joins alone.

    A set is rooted at its smallest node. A step takes one node of the extension and leaves the earlier ones out for
    good; the new extension gains only the taken node's exclusive neighbours, those not seen from the set before. So no
    set comes twice and nothing has to be made distinct. The form for graphs too large to share with every task.
    """
    adj = cut_lineage(_adjacency(edges))
    cur = adj.select(F.array("at").alias("nodes"), F.filter("nbs", lambda u: u > F.col("at")).alias("ext"), F.array_union(F.array("at"), "nbs").alias("near"))
    for _ in range(1, size):
        step = cur.select("nodes", "near", "ext", F.posexplode("ext").alias("k", "w"))
        j = step.join(adj.withColumnsRenamed({"at": "w", "nbs": "wn"}), "w")
        new = F.filter(F.array_except("wn", "near"), lambda u: u > F.element_at("nodes", 1))
        cur = j.select(F.array_append("nodes", F.col("w")).alias("nodes"), F.concat(F.slice("ext", F.col("k") + 2, F.size("ext")), new).alias("ext"), F.array_union("near", "wn").alias("near"))
    return cur.select(F.array_sort("nodes").alias("nodes"))


def _structured(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, structure, n_edges, weight_sum, size) of node sets; structure is the adjacency bits in node order."""
    n = F.size("nodes")
    cells = sets.select("nodes", F.explode(F.sequence(F.lit(0), n * n - 1)).alias("k")).select(
        "nodes", "k", F.element_at("nodes", F.floor(F.col("k") / n).cast("int") + 1).alias("src"), F.element_at("nodes", F.col("k") % n + 1).alias("dst"))
    g = cells.filter("src <> dst").join(edges.select("src", "dst", "weight"), ["src", "dst"]).groupBy("nodes").agg(F.collect_set("k").alias("ks"), F.count("*").alias("n_edges"), F.sum("weight").alias("weight_sum"))
    bits = F.array_join(F.transform(F.sequence(F.lit(0), n * n - 1), lambda k: F.when(F.array_contains("ks", k), "1").otherwise("0")), "")
    return g.select("nodes", bits.alias("structure"), "n_edges", "weight_sum", n.alias("size"))


class _Graph:
    """Adjacency of a shared graph: neighbours in both directions and weights by (src, dst)."""

    def __init__(self, src, dst, weight):
        self.near: dict[int, set] = {}
        self.weight = dict(zip(zip(src, dst), weight))
        for a, b in self.weight:
            self.near.setdefault(a, set()).add(b)
            self.near.setdefault(b, set()).add(a)

    def from_edge(self, v: int, w: int, most: int):
        """All connected sets of 2 to ``most`` nodes whose smallest node is v and whose second node taken is w."""
        near = self.near
        first = sorted(u for u in near[v] if u > v)
        seen = near[v] | {v}
        stack = [((v, w), [u for u in first if u > w] + [u for u in near[w] if u > v and u not in seen], seen | near[w])]
        while stack:
            nodes, ext, known = stack.pop()
            yield nodes
            if len(nodes) < most:
                for k, u in enumerate(ext):
                    stack.append(((*nodes, u), ext[k + 1:] + [x for x in near[u] if x > v and x not in known], known | near[u]))

    def structure(self, nodes) -> tuple[str, int, float]:
        found = [self.weight.get((a, b)) for a in nodes for b in nodes]
        there = [x for x in found if x is not None]
        return "".join("0" if x is None else "1" for x in found), len(there), sum(there)


def _enumerated(edges: DataFrame, sizes: tuple[int, ...], folded: bool) -> DataFrame:
    """Connected sets enumerated inside the tasks, one seed per undirected edge, so that a hub spreads over its edges.

    ``folded``: counts per structure (structure, size, frequency, n_edges, weight_sum), a few rows per task; otherwise
    the instances themselves. The graph is shared with the tasks; :func:`motifs` checks its size.
    """
    rows = edges.select("src", "dst", "weight").filter("src <> dst").toPandas()
    shared = edges.sparkSession.sparkContext.broadcast((rows["src"].tolist(), rows["dst"].tolist(), rows["weight"].tolist()))
    seeds = edges.select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("w")).filter("v < w").distinct()
    seeds = seeds.repartition(max(2, 4 * edges.sparkSession.sparkContext.defaultParallelism), "v", "w")
    wanted, most = set(sizes), max(sizes)

    def run(batches):
        graph, folds = None, {}
        for b in batches:
            graph = graph or _Graph(*shared.value)
            out = []
            for v, w in zip(b.column("v").to_pylist(), b.column("w").to_pylist()):
                for nodes in graph.from_edge(v, w, most):
                    if len(nodes) in wanted:
                        nodes = sorted(nodes)
                        bits, n_edges, weight = graph.structure(nodes)
                        if folded:
                            f = folds.setdefault(bits, [len(nodes), 0, 0, 0.0])
                            f[1], f[2], f[3] = f[1] + 1, f[2] + n_edges, f[3] + weight
                        else:
                            out.append((nodes, bits, n_edges, weight, len(nodes)))
                            if len(out) == 10_000:
                                yield lines(out)
                                out = []
            if out:
                yield lines(out)
        if folds:
            cols = list(zip(*[(k, *f) for k, f in folds.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))], names=["structure", "size", "frequency", "n_edges", "weight_sum"])

    def lines(out):
        cols = zip(zip(*out), (pa.list_(pa.int64()), pa.string(), pa.int64(), pa.float64(), pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["nodes", "structure", "n_edges", "weight_sum", "size"])

    if folded:
        return seeds.mapInArrow(run, "structure string, size int, frequency long, n_edges long, weight_sum double")
    return seeds.mapInArrow(run, "nodes array<long>, structure string, n_edges long, weight_sum double, size int")


def motif_subgraphs(edges: DataFrame, sizes=(3, 4, 5, 6, 7, 8), share: int = SHARED_GRAPH) -> tuple[DataFrame, DataFrame]:
    """(folded, instances) of all connected sets of these sizes.

    Up to ``share`` bytes of adjacency (about 200 an edge in a worker, counted first) the sets are enumerated inside
    the tasks; beyond, they grow by joins. Both give every set once.
    """
    sizes = tuple(sizes)
    if edges.count() * 200 <= share:
        return _enumerated(edges, sizes, True), _enumerated(edges, sizes, False)
    inst = None
    for k in sizes:
        part = _structured(connected_sets(edges, k), edges)
        inst = part if inst is None else inst.unionByName(part)
    return inst.groupBy("structure", "size").agg(F.count("*").alias("frequency"), F.sum("n_edges").alias("n_edges"), F.sum("weight_sum").alias("weight_sum")), inst


def find_motifs(edges: DataFrame, sizes=(3, 4, 5, 6, 7, 8), min_freq: int = 2, share: int = SHARED_GRAPH):
    """(circuits, instances) of recurring structures, ranked by 0.4 frequency + 0.6 mean weight.

    Circuits come from folded counts, so the sets themselves are written only for structures that recur.
    """
    edges = cut_lineage(edges)
    folded, inst = motif_subgraphs(edges, sizes, share)
    circ = folded.groupBy("structure", "size").agg(F.sum("frequency").alias("frequency"), F.sum("weight_sum").alias("w"), F.sum("n_edges").alias("e"))
    circ = cut_lineage(rank_motifs(circ.select("structure", "size", "frequency", (F.col("w") / F.col("e")).alias("avg_weight")).filter(F.col("frequency") >= min_freq)))
    return circ, cut_lineage(inst.join(circ.select("structure"), "structure", "left_semi"))  # every validation score reads the instances


def rank_motifs(circuits: DataFrame) -> DataFrame:
    return circuits.withColumn("importance", F.col("frequency") * 0.4 + F.col("avg_weight") * 0.6)


def circuit_nodes(instances: DataFrame) -> DataFrame:
    """One row per (structure, instance, node)."""
    inst = path_text("nodes")
    return instances.select("structure", inst.alias("instance"), F.size("nodes").alias("size"), F.explode("nodes").alias("node")).select(
        "structure", "instance", "size", "node", key_layer("node").alias("layer"), key_feature("node").alias("feature"))


# validation --------------------------------------------------------------------------------


def circuit_activations(cnodes: DataFrame, act: DataFrame) -> DataFrame:
    """Activations of the nodes of every instance: tokens x instances rows by definition; for sums use the next function."""
    return act.join(broadcast_if_small(cnodes), ["layer", "feature"])


def circuit_activation_sums(cnodes: DataFrame, act: DataFrame) -> DataFrame:
    """n, s per (structure, instance, layer, feature): summed per feature first, so only sums meet the instances."""
    sums = act.groupBy("layer", "feature").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return cnodes.select("structure", "instance", "layer", "feature").join(sums, ["layer", "feature"])


def _instance_pairs(cnodes: DataFrame) -> DataFrame:
    g = cnodes.groupBy("structure", "instance").agg(F.array_sort(F.collect_list("node")).alias("ns"))
    pr = F.explode(F.flatten(F.transform("ns", lambda a: F.transform(F.filter("ns", lambda b: b > a), lambda b: F.struct(a.alias("src"), b.alias("dst"))))))
    return g.select("structure", "instance", pr.alias("p")).select("structure", "instance", "p.src", "p.dst")


def _pair_corr(vec: DataFrame) -> DataFrame:
    return with_corr(pair_moments(vec, "upper")).select(node_key("la", "i").alias("src"), node_key("lb", "j").alias("dst"), "corr")


def coherence(cnodes: DataFrame, corr: DataFrame) -> DataFrame:
    """Mean over instances of the mean correlation (strict upper triangle) of their nodes."""
    p = _instance_pairs(cnodes).join(corr, ["src", "dst"])
    i = p.groupBy("structure", "instance").agg(F.avg("corr").alias("coherence"), F.avg(F.abs("corr")).alias("cohesion"))
    return i


#: Tokens and instances of one block of the activity counts.
TOKEN_BLOCK, INSTANCE_BLOCK = 16_384, 4_096


def active_counts(cnodes: DataFrame, act: DataFrame, thr: float = 0.1, token_block: int = TOKEN_BLOCK, instance_block: int = INSTANCE_BLOCK) -> DataFrame:
    """(structure, instance, size, counts): at how many tokens exactly k = 1, 2, ... nodes of an instance are active (v > thr).

    Tokens and instances are dealt into blocks by hashes; a pair of blocks is one task's work: a bitmap of tokens per
    node, summed over the nodes of each instance. It returns one short histogram per instance, never tokens x instances.
    """
    inst = cnodes.groupBy("structure", "instance", "size").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    inst = inst.withColumn("id", F.xxhash64("structure", "instance"))
    on = act.filter(F.col("value") > thr).select("protein_id", "pos", node_key("layer", "feature").alias("node")).join(cnodes.select("node").distinct(), "node", "left_semi")
    size = on.agg(F.approx_count_distinct(F.struct("protein_id", "pos")).alias("n")).first()["n"]  # the number of blocks need not be exact
    nt, ni = max(1, -(-size // token_block)), max(1, -(-inst.count() // instance_block))
    tokens = on.select(F.pmod(F.xxhash64("protein_id", "pos"), F.lit(nt)).cast("int").alias("bt"), F.explode(F.sequence(F.lit(0), F.lit(ni - 1))).alias("bi"), "protein_id", "pos", "node")
    blocks = inst.select(F.explode(F.sequence(F.lit(0), F.lit(nt - 1))).alias("bt"), F.pmod("id", F.lit(ni)).cast("int").alias("bi"), "structure", "instance", "size", "nodes")

    def count(active: pd.DataFrame, insts: pd.DataFrame) -> pd.DataFrame:
        if active.empty or insts.empty:
            return pd.DataFrame({k: pd.Series([], dtype=object) for k in ("structure", "instance", "size", "counts")})
        token = pd.MultiIndex.from_arrays([active["protein_id"], active["pos"]]).factorize()[0]
        node, names = pd.factorize(active["node"])
        bits = np.zeros((len(names) + 1, token.max() + 1), np.uint8)  # the last row: nodes without any active token here
        bits[node, token] = 1
        at = {int(n): k for k, n in enumerate(names)}
        out = []
        for nodes in insts["nodes"]:
            k = bits[[at.get(int(n), len(names)) for n in nodes]].sum(0, dtype=np.uint8)
            out.append(np.bincount(k, minlength=len(nodes) + 1)[1:].tolist())
        return insts[["structure", "instance", "size"]].assign(counts=out)

    parts = tokens.groupBy("bt", "bi").cogroup(blocks.groupBy("bt", "bi")).applyInPandas(count, "structure string, instance string, size int, counts array<long>")
    one = parts.select("structure", "instance", "size", F.posexplode("counts").alias("k", "n")).groupBy("structure", "instance", "size", "k").agg(F.sum("n").alias("n"))
    return one.withColumn("k", F.col("k") + 1).filter("n > 0")


def stability(cnodes: DataFrame, act: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per instance: 1 - mean over tokens of the sample std of node masks, and the share of tokens with all nodes active.

    Both follow from the numbers of tokens with k active nodes; where none is, the std is 0.
    """
    k, n = F.col("k"), F.col("size")
    sd = F.sqrt((k - k * k / n) / (n - 1))
    g = active_counts(cnodes, act).groupBy("structure", "instance").agg(F.sum(sd * F.col("n")).alias("s"), F.sum(F.when(k == n, F.col("n")).otherwise(0)).alias("all_on"))
    every = cnodes.select("structure", "instance").distinct()
    j = every.join(g, ["structure", "instance"], "left").join(F.broadcast(tokens.agg(F.count("*").alias("n"))))
    return j.select("structure", "instance", (1 - F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("stability"),
                    (F.coalesce("all_on", F.lit(0)) / F.col("n")).alias("joint_share"))


def task_relevance(cnodes: DataFrame, act: DataFrame, labels: DataFrame) -> DataFrame:
    """|corr| over proteins of the instance's mean activation with the protein label (``protein_id``, ``label``).

    The moments of all node pairs over the proteins, the label as one more node, are folded once; an instance only
    sums the covariances of its own nodes, so no row per protein and instance arises.
    """
    lab = labels.groupBy("protein_id").agg(F.avg("label").alias("label"))
    pooled = act.groupBy("protein_id", "layer", "feature").agg(F.avg("value").alias("value")).join(lab, "protein_id")
    top = act.agg(F.max("layer").alias("top"))
    target = lab.join(act.select("protein_id").distinct(), "protein_id", "left_semi").join(F.broadcast(top)).select("protein_id", (F.col("top") + 1).cast("int").alias("layer"), F.lit(0).alias("feature"), F.col("label").cast("double").alias("value"))
    rows = cut_lineage(pooled.select("protein_id", "layer", "feature", "value").unionByName(target).filter("value is not null").withColumn("pos", F.lit(0)))
    m = pair_moments(rows, "upper").select(node_key("la", "i").alias("src"), node_key("lb", "j").alias("dst"), "n", "sx", "sxx", "sy", "syy", "sxy")
    goal = F.broadcast(top.select(node_key(F.col("top") + 1, F.lit(0)).alias("goal")))
    pairs = _instance_pairs(cnodes.select("structure", "instance", "node").unionByName(cnodes.select("structure", "instance").distinct().join(goal).select("structure", "instance", F.col("goal").alias("node"))))
    j = pairs.join(m, ["src", "dst"]).join(goal)
    to_goal = F.col("dst") == F.col("goal")
    cov, var_x, var_y = (F.col("n") * F.col(a) - F.col(b) * F.col(c) for a, b, c in (("sxy", "sx", "sy"), ("sxx", "sx", "sx"), ("syy", "sy", "sy")))
    s = j.groupBy("structure", "instance").agg(F.sum(F.when(to_goal, cov)).alias("c"), F.sum(F.when(to_goal, var_x).otherwise(2 * cov)).alias("v"), F.max(F.when(to_goal, var_y)).alias("y"))
    return s.select("structure", "instance", F.abs(F.try_divide("c", F.sqrt(F.col("v") * F.col("y")))).alias("task_relevance"))


def validate_circuits(instances: DataFrame, vec: DataFrame, labels: DataFrame, thr: float = 0.7) -> DataFrame:
    cn = cut_lineage(circuit_nodes(instances))
    act = to_long(vec)
    tokens = vec.select("protein_id", "pos").distinct()
    key = ["structure", "instance"]
    j = coherence(cn, _pair_corr(vec)).join(stability(cn, act, tokens), key).join(task_relevance(cn, act, labels), key)
    s = j.groupBy("structure").agg(F.avg("coherence").alias("coherence"), F.avg("stability").alias("stability"), F.coalesce(F.avg("task_relevance"), F.lit(0.0)).alias("task_relevance"))
    return s.withColumn("overall_score", (F.col("coherence") + F.col("stability") + F.col("task_relevance")) / 3).filter(F.col("overall_score") >= thr)


def plausibility(cnodes: DataFrame, known: DataFrame) -> DataFrame:
    """Mean over nodes of 1.0 functional, else 0.8 structural, else 0.6 conserved (``feature``, ``kind``)."""
    score = F.when(F.col("kind") == "functional", 1.0).when(F.col("kind") == "structural", 0.8).when(F.col("kind") == "conserved", 0.6).otherwise(0.0)
    k = known.withColumn("s", score).groupBy("feature").agg(F.max("s").alias("s"))
    return (cnodes.join(broadcast_if_small(k), "feature", "left").groupBy("structure", "instance").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("plausibility")))


def information_flow(cnodes: DataFrame, vec: DataFrame) -> DataFrame:
    """Mean MI of consecutive nodes of an instance ordered by layer."""
    w = Window.partitionBy("structure", "instance").orderBy("node")
    steps = cnodes.withColumn("dst", F.lead("node").over(w)).filter("dst is not null").select("structure", "instance", F.col("node").alias("src"), "dst")
    mi = pair_mutual_info(vec, steps.select("src", "dst").distinct(), eps=0.0)
    return steps.join(mi, ["src", "dst"]).groupBy("structure", "instance").agg(F.avg("mutual_info").alias("information_flow"))


WEIGHTS = {"coherence": 0.2, "stability": 0.2, "task_relevance": 0.2, "biological_plausibility": 0.2, "information_flow": 0.1, "modularity": 0.1}


def combine_scores(df: DataFrame, weights: dict, out: str = "overall_score") -> DataFrame:
    total = None
    for k, w in weights.items():
        total = F.col(k) * w if total is None else total + F.col(k) * w
    return df.withColumn(out, total)


def validate_circuits_adv(instances: DataFrame, vec: DataFrame, labels: DataFrame, known: DataFrame, thr: float = 0.6, lo: int = 3, hi: int = 20) -> DataFrame:
    inst = instances.filter((F.size("nodes") >= lo) & (F.size("nodes") <= hi))
    cn = cut_lineage(circuit_nodes(inst))
    act, tokens = to_long(vec), vec.select("protein_id", "pos").distinct()
    key = ["structure", "instance"]
    j = (coherence(cn, _pair_corr(vec)).join(stability(cn, act, tokens), key).join(task_relevance(cn, act, labels), key)
         .join(plausibility(cn, known), key).join(information_flow(cn, vec), key))
    z = lambda e, d=0.0: F.coalesce(e, F.lit(d))
    m = F.col("cohesion") * (1 - F.col("cohesion") * 0.5)
    s = j.groupBy("structure").agg(z(F.avg("coherence")).alias("coherence"), z(F.avg(F.when(F.col("joint_share") > 0, F.col("joint_share")))).alias("stability"),
                                   z(F.avg("task_relevance")).alias("task_relevance"), z(F.avg("plausibility"), 0.5).alias("biological_plausibility"),
                                   z(F.avg("information_flow")).alias("information_flow"), z(F.avg(m)).alias("modularity"))
    return rank_validated(combine_scores(s, WEIGHTS), thr)


def rank_validated(scored: DataFrame, thr: float, k: int | None = None) -> DataFrame:
    out = scored.filter(F.col("overall_score") >= thr).orderBy(F.desc("overall_score"), "structure")
    return out.limit(k) if k else out


# summaries ---------------------------------------------------------------------------------


def circuit_summary(circuits: DataFrame, validated: DataFrame | None = None) -> DataFrame:
    s = circuits.agg(F.count("*").alias("num_circuits"), F.avg("size").alias("avg_size"), F.stddev_pop("size").alias("std_size"),
                     F.avg("importance").alias("avg_importance"), F.stddev_pop("importance").alias("std_importance"), F.max("importance").alias("max_importance"))
    if validated is None:
        return s
    known = validated.join(circuits.select("structure"), "structure")
    return s.join(F.broadcast(known.agg(F.avg("coherence").alias("avg_coherence"))))


def circuit_features(cnodes: DataFrame) -> DataFrame:
    return cnodes.select("structure", "feature").distinct()


def circuit_jaccard(cnodes: DataFrame) -> DataFrame:
    """Jaccard of the feature sets of every two circuits that share a feature (others are 0)."""
    f = circuit_features(cnodes)
    n = f.groupBy("structure").agg(F.count("*").alias("n"))
    a, b = f.select(F.col("structure").alias("a"), "feature"), f.select(F.col("structure").alias("b"), "feature")
    k = a.join(b, "feature").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("k"))
    j = k.join(n.select(F.col("structure").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("structure").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def _best(circuits: DataFrame, top: int | None) -> DataFrame:
    ranked = circuits if top is None else circuits.orderBy(F.desc("importance"), "structure").limit(top)
    return ranked.select("structure")


def circuit_modularity(circuits: DataFrame, cnodes: DataFrame, top: int | None = None) -> DataFrame:
    """1 - mean Jaccard over all pairs of circuits (of the ``top`` ones if given); absent pairs count as 0."""
    best = _best(circuits, top)
    cn = cnodes.join(best, "structure", "left_semi")
    n = best.agg(F.count("*").alias("n"))
    s = circuit_jaccard(cn).agg(F.coalesce(F.sum("jaccard"), F.lit(0.0)).alias("s"))
    return s.join(F.broadcast(n)).select((1 - F.coalesce(ratio("s", F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).alias("modularity"))


def circuit_coverage(cnodes: DataFrame, act: DataFrame) -> DataFrame:
    used = cnodes.agg(F.countDistinct("feature").alias("used"))
    allf = act.agg((F.max("feature") + 1).alias("n_features"))
    return used.join(F.broadcast(allf)).select("used", (F.col("n_features") - F.col("used")).alias("unused"), (F.col("used") / F.col("n_features")).alias("coverage"))


def circuit_layer_usage(cnodes: DataFrame) -> DataFrame:
    return cnodes.groupBy("layer").agg(F.count("*").alias("n_nodes"), F.countDistinct("feature").alias("n_features"))


def circuit_evolution(cnodes: DataFrame, act: DataFrame, snapshot: str = "protein_id") -> DataFrame:
    """Mean |v| of a circuit's features per snapshot: per feature first, then over the features."""
    f = act.groupBy(snapshot, "feature").agg(F.avg(F.abs("value")).alias("v"))
    return f.join(circuit_features(cnodes), "feature").groupBy("structure", snapshot).agg(F.avg("v").alias("activation"))


def circuit_profile(circuits: DataFrame, cnodes: DataFrame, act: DataFrame, top: int | None = None) -> DataFrame:
    """Mean position profile of the nodes of all instances of a circuit, z-scored per circuit."""
    cn = cnodes.join(_best(circuits, top), "structure", "left_semi").groupBy("structure", "layer", "feature").agg(F.count("*").alias("n"))
    prof = act.groupBy("layer", "feature", "pos").agg(F.avg("value").alias("v"))
    p = prof.join(cn, ["layer", "feature"]).groupBy("structure", "pos").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"))
    w = Window.partitionBy("structure")
    return p.select("structure", "pos", ((F.col("v") - F.avg("v").over(w)) / (F.stddev_pop("v").over(w) + 1e-8)).alias("z"))


def circuit_novelty(circuits: DataFrame, thr: float = 0.6) -> DataFrame:
    s = circuits.withColumn("topology_score", F.least(F.lit(1.0), F.col("size") / 10))
    return s.filter(F.col("topology_score") > thr)


# motif library -----------------------------------------------------------------------------


def motif_library(spark) -> DataFrame:
    from ..sources.readers import read_kb

    return read_kb(spark, "motif_library")


def pattern_matches(edges: DataFrame, pattern: list[tuple[int, int]]) -> DataFrame:
    """All injective embeddings of a pattern: one equi-join per pattern edge, columns n0, n1, ..."""
    e = edges.select("src", "dst").filter("src <> dst").distinct()
    seen: list[int] = []
    cur = None
    todo = list(pattern)
    while todo:
        u, v = next((p for p in todo if cur is None or p[0] in seen or p[1] in seen), todo[0])
        todo.remove((u, v))
        step = e.select(F.col("src").alias(f"n{u}"), F.col("dst").alias(f"n{v}"))
        if cur is None:
            cur, seen = step, [u, v]
            continue
        shared = [x for x in (u, v) if x in seen]
        cur = cur.join(step, [f"n{x}" for x in shared])
        for x in (u, v):
            if x not in seen:
                for y in seen:
                    cur = cur.filter(F.col(f"n{x}") != F.col(f"n{y}"))
                seen.append(x)
    return cur.select(*[f"n{x}" for x in sorted(seen)])


def motif_instances(edges: DataFrame, name: str) -> DataFrame:
    """Full-score instances of a library motif with their properties, one row per node set."""
    lib = {m[0]: m for m in MOTIF_LIBRARY}
    if name not in lib:
        raise ValueError(f"unknown motif {name!r}")
    _, pattern, _, _, _, _, prop = lib[name]
    size = max(max(p) for p in pattern) + 1
    m = pattern_matches(edges, pattern)
    sets = m.select(F.array_sort(F.array(*[F.col(f"n{k}") for k in range(size)])).alias("nodes")).distinct()
    cells = sets.select("nodes", F.explode("nodes").alias("src")).select("nodes", "src", F.explode("nodes").alias("dst")).filter("src <> dst")
    sub = cells.join(edges.select("src", "dst").distinct(), ["src", "dst"])
    per_out = sub.groupBy("nodes", F.col("src").alias("n")).agg(F.count("*").alias("o"))
    per_in = sub.groupBy("nodes", F.col("dst").alias("n")).agg(F.count("*").alias("i"))
    d = per_out.join(per_in, ["nodes", "n"], "full").fillna(0, ["o", "i"]).groupBy("nodes").agg(
        F.sum("o").alias("num_edges"), F.max("i").alias("max_in_degree"), F.max("o").alias("max_out_degree"), F.max(F.col("i") + F.col("o")).alias("max_degree"))
    d = d.join(sub.groupBy("nodes").agg(F.collect_set(F.struct("src", "dst")).alias("es")), "nodes")
    # Kahn peeling on at most a handful of nodes: drop nodes without incoming edges, size times
    peel = F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.col("es"), lambda es, _: F.filter(es, lambda e: F.exists(es, lambda q: q.dst == e.src)))
    is_dag = F.size(peel) == 0
    avg_degree = 2 * F.col("num_edges") / F.lit(float(size))
    d = d.withColumn("is_dag", is_dag).withColumn("density", F.col("num_edges") / F.lit(float(size * (size - 1))))
    rules = {"coherent": F.lit(True), "cyclic": ~F.col("is_dag"), "linear": (F.col("max_in_degree") <= 1) & (F.col("max_out_degree") <= 1),
             "central_node": F.col("max_degree") > avg_degree * 2, "bipartite": _bipartite(size)}
    return d.filter(rules[prop]).select(F.lit(name).alias("motif"), path_text("nodes").alias("nodes"), F.lit(size).alias("num_nodes"), "num_edges", "density", "is_dag", "max_in_degree", "max_out_degree", F.lit(1.0).alias("score"))


def _bipartite(size: int) -> Column:
    """True if some split of the (few) nodes puts every edge across it."""
    tests = None
    for mask in range(2 ** (size - 1)):
        side = F.array(*[F.lit((mask >> k) & 1) for k in range(size)])
        at = lambda n: F.element_at(side, F.array_position("nodes", n).cast("int"))
        ok = F.forall("es", lambda e: at(e.src) != at(e.dst))
        tests = ok if tests is None else tests | ok
    return tests


def pattern_share(structure: str, n: int, pattern: list[tuple[int, int]]) -> float:
    """Best share of a pattern's edges that a graph of ``n`` nodes (adjacency bits) preserves, over all injective mappings.

    Mappings grow node by node and stop where they cannot beat the best one.
    """
    have = {(k // n, k % n) for k, bit in enumerate(structure) if bit == "1"}
    k, best = max(max(e) for e in pattern) + 1, 0
    closing = [[e for e in pattern if max(e) == u] for u in range(k)]  # edges known once node u is placed
    rest = [sum(map(len, closing[u:])) for u in range(k + 1)]
    stack = [((), 0)]
    while stack:
        placed, kept = stack.pop()
        u = len(placed)
        if kept + rest[u] <= best:
            continue
        if u == k:
            best = kept
            continue
        for v in range(n):
            if v not in placed:
                at = (*placed, v)
                stack.append((at, kept + sum((at[a], at[b]) in have for a, b in closing[u])))
    return best / len(pattern)


def match_motifs(circuits: DataFrame, tolerance: float = 0.8) -> DataFrame:
    """Library motifs against circuit structures (adjacency bits) of every size a motif allows.

    Structures are few however many instances there are; each is compared once.
    """

    @F.pandas_udf("array<struct<motif:string,match_score:double>>")
    def matches(structure: pd.Series, size: pd.Series) -> pd.Series:
        def one(bits, n):
            out = []
            for name, pattern, _, _, lo, hi, _ in MOTIF_LIBRARY:
                if lo <= n <= hi and max(map(max, pattern)) < n and (share := pattern_share(bits, n, pattern)) >= tolerance:
                    out.append({"motif": name, "match_score": share})
            return out
        return pd.Series([one(b, int(n)) for b, n in zip(structure, size)])

    found = circuits.select("structure", "size").distinct().withColumn("m", F.explode(matches("structure", "size")))
    return found.select("structure", "m.motif", "m.match_score")


def score_motifs(instances: DataFrame, library: DataFrame, annotation: Column | None = None) -> DataFrame:
    """0.3 conservation + 0.3 function + 0.2 rarity + 0.2 size fit; function is 0.5 without an annotation."""
    per = instances.groupBy("motif").agg(F.count("*").alias("cnt"))
    tot = instances.agg(F.count("*").alias("tot"))
    lib = F.broadcast(library.select(F.col("name").alias("motif"), "conservation_score", "biological_function", "min_size", "max_size"))
    j = instances.join(lib, "motif").join(F.broadcast(per), "motif").join(F.broadcast(tot))
    bg = F.col("cnt") / (F.col("tot") + 1)
    best = (F.col("min_size") + F.col("max_size")) / 2
    fit = 1 - F.least(F.abs(F.col("num_nodes") - best) / best, F.lit(1.0))
    if annotation is None:
        fun = F.lit(0.5)
    else:
        a, b = F.split(F.lower(annotation), r"\s+"), F.split(F.lower(F.col("biological_function")), r"\s+")
        fun = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return j.select("motif", "nodes", (F.col("conservation_score") * 0.3 + fun * 0.3 + F.when(bg > 0, 1 - bg).otherwise(0.9) * 0.2 + fit * 0.2).alias("score"))


def rank_instances(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("score"), "motif", "nodes")
