"""Graph operators on edge tables ``keys..., src, dst[, weight]``.

``keys`` names independent graphs (a layer, a protein). All algorithms are joins and aggregations;
loops cut their lineage with a reliable checkpoint each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import ratio
from ..session import cut_lineage


def undirected(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Both directions of every edge, without duplicates or self-loops."""
    e = edges.select(*keys, "src", "dst").filter("src <> dst")
    return e.unionByName(e.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame, keys: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(keys, node, component): smallest node id reachable. Min-label exchange plus pointer jumping."""
    keys = keys or []
    und = cut_lineage(undirected(edges, keys))
    every = und.select(*keys, F.col("src").alias("node")).distinct()
    if nodes is not None:
        every = every.unionByName(nodes.select(*keys, "node")).distinct()
    labels = every.withColumn("label", F.col("node"))
    while True:
        nb = und.join(labels.withColumnRenamed("node", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(nb, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        step = cut_lineage(step)
        if step.filter("old <> label").isEmpty():
            return step.select(*keys, "node", F.col("label").alias("component"))
        up = step.select(*keys, F.col("node").alias("label"), F.col("label").alias("root"))
        labels = step.join(up, [*keys, "label"], "left").select(*keys, "node", F.coalesce("root", "label").alias("label"))


def component_summary(comp: DataFrame, keys: list[str], min_size: int = 3) -> DataFrame:
    return comp.groupBy(*keys, "component").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)


def degrees(und: DataFrame, keys: list[str]) -> DataFrame:
    return und.groupBy(*keys, F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def clustering(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, degree, triangles, clustering). Wedges start at the lower-degree end, so hubs stay cheap."""
    und = cut_lineage(undirected(edges, keys))
    deg = degrees(und, keys)
    ranked = und.join(deg.select(*keys, F.col("node").alias("src"), F.col("degree").alias("ds")), [*keys, "src"]) \
        .join(deg.select(*keys, F.col("node").alias("dst"), F.col("degree").alias("dd")), [*keys, "dst"])
    up = ranked.filter("ds < dd or (ds = dd and src < dst)").select(*keys, F.col("src").alias("a"), F.col("dst").alias("b"))
    wedge = up.join(up.select(*keys, "a", F.col("b").alias("c")), [*keys, "a"]).filter("b <> c")
    tri = wedge.join(up.select(*keys, F.col("a").alias("b"), F.col("b").alias("c")), [*keys, "b", "c"])
    per = tri.select(*keys, F.explode(F.array("a", "b", "c")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("triangles"))
    j = deg.join(per, [*keys, "node"], "left").fillna(0, ["triangles"])
    cc = F.coalesce(ratio(2 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0))
    return j.withColumn("clustering", cc)


def shortest_paths(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, node, dist) for all reachable pairs, by min-plus relaxation of the changed rows."""
    e = cut_lineage(edges.groupBy(*keys, "src", "dst").agg(F.min("weight").alias("weight")).filter("src <> dst"))
    ids = e.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    dist = cut_lineage(ids.select(*keys, F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")))
    front = dist
    while True:
        nxt = (front.withColumnRenamed("node", "src").join(e, [*keys, "src"]).select(*keys, "source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("cand"))
               .groupBy(*keys, "source", "node").agg(F.min("cand").alias("cand")))
        j = dist.join(nxt, [*keys, "source", "node"], "full")
        better = F.col("cand").isNotNull() & (F.col("dist").isNull() | (F.col("cand") < F.col("dist") - 1e-12))
        merged = cut_lineage(j.select(*keys, "source", "node", F.when(better, F.col("cand")).otherwise(F.col("dist")).alias("dist"), better.alias("moved")))
        front = merged.filter("moved").drop("moved")
        dist = merged.drop("moved")
        if front.isEmpty():
            return dist


def betweenness(edges: DataFrame, keys: list[str], directed: bool = True) -> DataFrame:
    """Normalised betweenness: path counts and dependencies accumulate over the shortest-path edges."""
    e = edges.groupBy(*keys, "src", "dst").agg(F.min("weight").alias("weight")).filter("src <> dst")
    dist = shortest_paths(e, keys)
    ds = dist.select(*keys, "source", F.col("node").alias("src"), F.col("dist").alias("d1"))
    dt = dist.select(*keys, "source", F.col("node").alias("dst"), F.col("dist").alias("d2"))
    dag = cut_lineage(ds.join(e, [*keys, "src"]).join(dt, [*keys, "source", "dst"]).filter(F.abs(F.col("d1") + F.col("weight") - F.col("d2")) < 1e-9)
                      .select(*keys, "source", "src", "dst"))
    cur = dist.filter("source = node").select(*keys, "source", "node", F.lit(1.0).alias("s"))
    total = cur
    while True:
        cur = cut_lineage(dag.join(cur.withColumnRenamed("node", "src"), [*keys, "source", "src"]).groupBy(*keys, "source", F.col("dst").alias("node")).agg(F.sum("s").alias("s")))
        if cur.isEmpty():
            break
        total = total.unionByName(cur)
    sigma = cut_lineage(total.groupBy(*keys, "source", "node").agg(F.sum("s").alias("sigma")))
    sa, sb = (sigma.select(*keys, "source", F.col("node").alias(n), F.col("sigma").alias(f"s_{n}")) for n in ("src", "dst"))
    flow = cut_lineage(dag.join(sa, [*keys, "source", "src"]).join(sb, [*keys, "source", "dst"]).select(*keys, "source", "src", "dst", (F.col("s_src") / F.col("s_dst")).alias("f")))
    cur = dist.filter("source <> node").select(*keys, "source", F.col("node").alias("dst"), F.lit(1.0).alias("c"))
    acc = None
    while True:
        nxt = cut_lineage(flow.join(cur, [*keys, "source", "dst"]).groupBy(*keys, "source", "src").agg(F.sum(F.col("f") * F.col("c")).alias("c")).filter("src <> source"))
        if nxt.isEmpty():
            break
        acc = nxt if acc is None else acc.unionByName(nxt)
        cur = nxt.withColumnRenamed("src", "dst")
    nodes = dist.select(*keys, "node").distinct()
    if acc is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    dep = acc.groupBy(*keys, F.col("src").alias("node")).agg(F.sum("c").alias("b"))
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n")) if keys else nodes.agg(F.count("*").alias("n"))
    j = nodes.join(dep, [*keys, "node"], "left")
    j = j.join(n, keys) if keys else j.join(F.broadcast(n))
    scale = (F.col("n") - 1) * (F.col("n") - 2)
    return j.select(*keys, "node", F.when(F.col("n") > 2, F.coalesce("b", F.lit(0.0)) / scale).otherwise(0.0).alias("betweenness"))


def pagerank(edges: DataFrame, keys: list[str], damping: float = 0.85, tol: float = 1e-6) -> DataFrame:
    """Weighted PageRank with dangling mass spread evenly; stops at an L1 change below n * tol.

    The change shrinks by ``damping`` each round, so the rounds it needs are known and it always converges.
    """
    from math import ceil, log
    e = edges.groupBy(*keys, "src", "dst").agg(F.sum("weight").alias("w"))
    out = e.groupBy(*keys, "src").agg(F.sum("w").alias("ws"))
    e = cut_lineage(e.join(out, [*keys, "src"]).select(*keys, "src", "dst", (F.col("w") / F.col("ws")).alias("p")))
    nodes = e.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    count = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    dangling = nodes.join(e.select(*keys, F.col("src").alias("node")).distinct().withColumn("has_out", F.lit(True)), [*keys, "node"], "left")
    rank = cut_lineage(dangling.join(count, keys).select(*keys, "node", "n", F.col("has_out").isNull().alias("sink"), (1 / F.col("n")).alias("r")))
    for _ in range(max(1, ceil(log(tol / 2) / log(damping)) + 1)):
        got = e.join(rank.select(*keys, F.col("node").alias("src"), "r"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("r")).alias("_in"))
        lost = rank.groupBy(*keys).agg(F.sum(F.when(F.col("sink"), F.col("r")).otherwise(0.0)).alias("lost"))
        new = rank.join(got, [*keys, "node"], "left").join(lost, keys)
        r = (1 - damping) / F.col("n") + damping * (F.coalesce("_in", F.lit(0.0)) + F.col("lost") / F.col("n"))
        rank = cut_lineage(new.select(*keys, "node", "n", "sink", r.alias("r"), F.abs(r - F.col("r")).alias("d")))
        if rank.groupBy(*keys).agg((F.sum("d") - F.max("n") * tol).alias("over")).filter("over >= 0").isEmpty():
            break
        rank = rank.drop("d")
    return rank.select(*keys, "node", F.col("r").alias("pagerank"))


def causal_importance(edges: DataFrame, keys: list[str]) -> DataFrame:
    """PageRank + betweenness + (weighted in + out degree) / 2, divided by the graph's maximum."""
    edges = cut_lineage(edges)
    pr, bw = pagerank(edges, keys), betweenness(edges, keys)
    deg = (edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy(*keys, "node").agg((F.sum("weight") / 2).alias("d")))
    j = pr.join(bw, [*keys, "node"]).join(deg, [*keys, "node"]).withColumn("raw", F.col("pagerank") + F.col("betweenness") + F.col("d"))
    top = j.groupBy(*keys).agg(F.max("raw").alias("top"))
    return j.join(top, keys).select(*keys, "node", "pagerank", "betweenness", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(F.col("raw")).alias("importance"))


def chains(edges: DataFrame, keys: list[str], max_edges: int = 5) -> DataFrame:
    """All simple paths of at least three nodes and at most ``max_edges`` edges, as ``path`` arrays.

    Growth joins on the last node; the result itself is what grows, so no path is dropped.
    """
    e = edges.select(*keys, "src", "dst").filter("src <> dst").distinct()
    step = e.select(*keys, F.col("src").alias("last"), F.col("dst").alias("next"))
    cur = e.select(*keys, F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    out = None
    for _ in range(2, max_edges + 1):
        cur = cur.join(step, [*keys, "last"]).filter(~F.array_contains("path", F.col("next"))).select(
            *keys, F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last"))
        part = cur.select(*keys, "path")
        out = part if out is None else out.unionByName(part)
    return out


def distinct_paths(paths: DataFrame) -> DataFrame:
    return paths.dropDuplicates()


def feedback_loops(edges: DataFrame, keys: list[str], max_len: int | None = None) -> DataFrame:
    """Simple cycles, each once, starting at its smallest node; of at most ``max_len`` nodes if that is given.

    Without a bound, growth ends when no path is open; the result has as many rows as the graph has cycles.
    """
    e = edges.select(*keys, "src", "dst").filter("src <> dst").distinct()
    step = e.select(*keys, F.col("src").alias("last"), F.col("dst").alias("next"))
    cur = e.filter("src < dst").select(*keys, F.col("src").alias("start"), F.array("src", "dst").alias("path"), F.col("dst").alias("last"))
    out, length = None, 2
    while max_len is None or length <= max_len:
        length += 1
        if max_len is None:
            cur = cut_lineage(cur)
            if out is not None and cur.isEmpty():
                break
        grown = cur.join(step, [*keys, "last"])
        done = grown.filter("next = start").select(*keys, "path")
        out = done if out is None else out.unionByName(done)
        cur = grown.filter((F.col("next") > F.col("start")) & ~F.array_contains("path", F.col("next"))).select(
            *keys, "start", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("last"))
    return out


def network_properties(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per graph: node and edge counts, density, mean degree, clustering, betweenness, average path
    length of the largest component (first by smallest label on ties)."""
    und = undirected(edges, keys)
    cl = clustering(edges, keys)
    w = und.withColumn("weight", F.lit(1.0))
    bw = betweenness(w, keys)
    size = nodes.groupBy(*keys).agg(F.count("*").alias("n"))
    deg = cl.groupBy(*keys).agg(F.sum("degree").alias("dsum"), F.sum("clustering").alias("csum"))
    bsum = bw.groupBy(*keys).agg(F.sum("betweenness").alias("bsum"), F.count("*").alias("m"))
    dist = shortest_paths(w, keys)
    comp = dist.groupBy(*keys, "source").agg(F.min("node").alias("component"), F.count("*").alias("size"), F.sum("dist").alias("ds"))
    per = comp.groupBy(*keys, "component").agg(F.max("size").alias("size"), F.sum("ds").alias("ds"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "component"))
    apl = per.withColumn("rn", best).filter("rn = 1").select(*keys, ratio("ds", F.col("size") * (F.col("size") - 1)).alias("avg_path_length"))
    j = size.join(deg, keys, "left").join(bsum, keys, "left").join(apl, keys, "left")
    n = F.col("n")
    # betweenness is normalised by the nodes that have edges; rescale to all nodes of the graph
    scale = F.coalesce(ratio((F.col("m") - 1) * (F.col("m") - 2), (n - 1) * (n - 2)), F.lit(0.0))
    z = lambda k: F.coalesce(F.col(k), F.lit(0.0))
    return j.select(*keys, n.alias("n_nodes"), (F.coalesce("dsum", F.lit(0)) / 2).cast("long").alias("n_edges"), (z("dsum") / n).alias("avg_degree"),
                    (z("csum") / n).alias("avg_clustering"), (z("bsum") * scale / n).alias("avg_betweenness"),
                    F.coalesce(ratio("dsum", n * (n - 1)), F.lit(0.0)).alias("density"), z("avg_path_length").alias("avg_path_length"))
