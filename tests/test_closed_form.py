"""Small inputs whose results are known by hand or by numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featspark.operators import aggregates as A
from featspark.operators import alignment as M
from featspark.operators import circuits as C
from featspark.operators import evolution as E
from featspark.operators import graph as G
from featspark.operators import pairs as P
from featspark.operators import quantiles as Qt
from featspark.operators import scoring as B
from featspark.operators import sequence as Q
from featspark.operators import structure as T
from featspark.sources.views import to_long

rng = np.random.default_rng(7)


def make_vec(spark, arr):
    """arr[protein, layer, pos, feature] -> activations_vec."""
    n, layers, s, _ = arr.shape
    rows = [(p, t, k, [float(x) for x in arr[p, k, t]]) for p in range(n) for k in range(layers) for t in range(s)]
    return spark.createDataFrame(rows, "protein_id long, pos long, layer int, vec array<double>")


def test_copy_layer_is_amplified(spark):
    a = rng.normal(size=(2, 1, 12, 6))
    vec = make_vec(spark, np.concatenate([a, 2 * a], axis=1))
    assert E.layer_similarity(vec).first()["similarity"] == pytest.approx(1.0)
    kinds = {r["transformation_type"] for r in E.classify_transitions(to_long(vec)).collect()}
    assert kinds == {"amplified"}
    assert all(r["min_corr"] == pytest.approx(1.0) for r in E.stable_features(to_long(vec)).collect())


def test_shifted_copy_has_causal_strength_one(spark):
    x = rng.normal(size=(1, 40))
    arr = np.zeros((1, 1, 40, 2))
    arr[0, 0, :, 0] = x
    arr[0, 0, 1:, 1] = x[0, :-1]
    r = P.causal_strength(make_vec(spark, arr)).collect()
    assert [(q["i"], q["j"]) for q in r] == [(0, 1)]
    assert r[0]["causal_strength"] == pytest.approx(1.0)


def test_constant_and_dead_features(spark):
    arr = rng.normal(size=(2, 2, 10, 3))
    arr[..., 1] = 5.0
    arr[..., 2] = 0.0
    vec = make_vec(spark, arr)
    m = {(r["i"], r["j"]): r["corr"] for r in P.pearson_matrix(vec, "same").filter("la = 0").collect()}
    assert m[(0, 1)] is None and m[(0, 2)] is None
    assert [r["feature"] for r in A.dead_features(to_long(vec)).collect()] == [2]
    assert A.dead_features(to_long(vec), min_samples=1000).count() == 0
    lin = E.feature_lineage(to_long(vec)).filter("feature = 1 and layer = 1").first()
    assert lin["corr_first"] == 0.0


def test_pair_moments_match_numpy_and_do_not_depend_on_partitions(spark):
    arr = rng.normal(size=(4, 2, 15, 5))
    flat = arr.transpose(1, 0, 2, 3).reshape(2, -1, 5)
    want = np.corrcoef(flat[0].T, flat[1].T)[:5, 5:]
    for parts in (1, 4, 16):
        got = np.zeros((5, 5))
        for r in P.pearson_matrix(make_vec(spark, arr).repartition(parts), "adjacent").collect():
            got[r["i"], r["j"]] = r["corr"]
        assert np.allclose(got, want)


def test_exact_percentiles_and_ranks(spark):
    v = np.concatenate([rng.normal(size=500), np.zeros(200), -np.exp(rng.normal(size=300) * 5)])
    df = spark.createDataFrame([(i % 2, i, float(x)) for i, x in enumerate(v)], "g int, id long, value double").repartition(7)
    fr = [0.0, 1 / 3, 0.5, 0.99, 1.0]
    got = {(r["g"], round(r["fraction"], 6)): r["percentile"] for r in Qt.percentiles(df, ["g"], "value", fr).collect()}
    for g in (0, 1):
        for f, w in zip(fr, np.percentile(v[g::2], [100 * f for f in fr])):
            assert got[(g, round(f, 6))] == pytest.approx(w, rel=1e-12, abs=1e-12)
    ordered = [r["id"] for r in Qt.ranks(df, ["g"], "value", "ordinal", ["id"]).filter("g = 0").orderBy("rank").collect()]
    assert ordered == sorted(range(0, 1000, 2), key=lambda i: (v[i], i))


def test_quantile_mutual_info_matches_numpy(spark):
    arr = rng.normal(size=(5, 2, 30, 3))
    arr[:, 1, :, 0] += arr[:, 0, :, 0]
    flat = arr.transpose(1, 0, 2, 3).reshape(2, -1, 3)

    def mi(x, y):
        d = lambda z: np.digitize(z, np.percentile(z, np.linspace(0, 100, 10)))
        h = np.histogram2d(d(x), d(y), bins=10)[0]
        p = h / h.sum()
        q = p.sum(1)[:, None] * p.sum(0)[None, :]
        return float((p[p > 0] * np.log(p[p > 0] / (q[p > 0] + 1e-10))).sum())

    got = {(r["i"], r["j"]): r["mutual_info"] for r in P.binned_mutual_info(make_vec(spark, arr)).collect()}
    for i in range(3):
        for j in range(3):
            assert got[(i, j)] == pytest.approx(mi(flat[0, :, i], flat[1, :, j]), abs=1e-9)
    assert min(got.values()) > -1e-9


def test_f_tail_known_values():
    # F(1, n) tail equals the two-sided t tail; t(10) = 2.2281 and t(1) = 12.7062 leave 5 %
    p = P.f_tail(np.array([2.228138852 ** 2, 12.70620474 ** 2, 0.0]), np.array([10.0, 1.0, 5.0]))
    assert p == pytest.approx([0.05, 0.05, 1.0], abs=1e-8)


def test_granger_finds_the_driver(spark):
    n = 200
    x = rng.normal(size=n)
    y = np.zeros(n)
    y[1:] = 0.9 * x[:-1] + 0.1 * rng.normal(size=n - 1)
    g = {(r["i"], r["j"]): r["granger"] for r in P.granger(make_vec(spark, np.stack([x, y], -1)[None, None])).collect()}
    assert g[(0, 1)] > 0.999 and g[(0, 1)] > g[(1, 0)]


def test_partial_correlation_matches_sequential_residuals(spark):
    z = rng.normal(size=(300, 4))
    z[:, 2] += z[:, 0] + z[:, 1]
    z[:, 3] += z[:, 0] - z[:, 1]
    c = z - z.mean(0)
    res = []
    for k in (2, 3):
        r = c[:, k]
        for m in (0, 1):
            r = r - (r @ c[:, m]) / (c[:, m] @ c[:, m]) * c[:, m]
        res.append(r)
    want = abs(np.corrcoef(*res)[0, 1])
    got = P.partial_corr(P.covariances(make_vec(spark, z[None, None])), zs=[0, 1]).filter("i = 2 and j = 3").first()["partial_corr"]
    assert got == pytest.approx(want, abs=1e-9)


def test_alignment_by_hand(spark):
    msa = spark.createDataFrame([(1, k, f"s{k}", s) for k, s in enumerate(["ACD-", "ACE-", "AGE-", "ACDA"])], "family_id long, seq_idx long, seq_id string, aligned string")
    cells = M.msa_cells(msa)
    w = M.sequence_weights(cells)
    cons = {r["col"]: r["conservation"] for r in M.conservation(cells, w).collect()}
    assert cons[0] == pytest.approx(1.0)
    gaps = {r["col"]: (r["gap_freq"], r["depth"]) for r in M.gap_stats(cells).collect()}
    assert gaps[3] == (0.75, 1)
    assert sum(r["weight"] for r in w.collect()) == pytest.approx(1.0)
    rows = ["ACD-", "ACE-", "AGE-", "ACDA"]
    ids = [sum(a == b != "-" for a, b in zip(p, q)) / sum(a != "-" or b != "-" for a, b in zip(p, q)) for i, p in enumerate(rows) for q in rows[i + 1:]]
    for tile in (1, 2, 512):
        assert M.diversity(cells, tile).first()["diversity"] == pytest.approx(1 - np.mean(ids), abs=1e-6)
    kept = M.filter_alignment(cells, spark.createDataFrame([(1, 0)], "family_id long, seq_idx long"))
    assert kept.agg(F.max("col")).first()[0] == 2


def test_collinear_points(spark):
    pts = spark.createDataFrame([(1, k, 3.8 * k, 0.0, 0.0) for k in range(3)], "protein_id long, pos long, x double, y double, z double")
    s = T.shape_metrics(pts).first()
    assert s["end_to_end"] == pytest.approx(7.6)
    assert s["radius_of_gyration"] == pytest.approx(3.8 * math.sqrt(2 / 3))
    assert all(r["curvature"] == pytest.approx(0.0, abs=1e-3) for r in T.backbone(pts).collect())
    square = spark.createDataFrame([(1, k, float(x), float(y), 0.0) for k, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])], pts.schema)
    assert abs(T.dihedrals(square).first()["dihedral"]) == pytest.approx(0.0, abs=1e-3)


def test_radius_pairs_equal_brute_force(spark):
    xyz = rng.normal(size=(60, 3)) * 8
    pts = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(xyz)], "protein_id long, pos long, x double, y double, z double")
    d = np.linalg.norm(xyz[:, None] - xyz[None], axis=-1)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] < 8}
    assert {(r["i"], r["j"]) for r in T.radius_pairs(pts, 8.0).collect()} == want


EDGES = [(0, 1_000_000, 0.8), (1_000_000, 2_000_000, 0.7), (0, 2_000_000, 0.6), (1, 1_000_001, 0.9), (1_000_001, 2_000_001, 0.8)]


def test_triangle_and_chain_graph(spark):
    e = spark.createDataFrame(EDGES, "src long, dst long, weight double")
    cl = {r["node"]: r["clustering"] for r in G.clustering(e, []).collect()}
    assert cl[0] == pytest.approx(1.0) and cl[1] == 0.0
    assert C.connected_sets(e, 3).count() == 2
    assert G.chains(e, []).count() == 2
    assert G.feedback_loops(e, []).count() == 0
    circ, inst = C.find_motifs(e, (3,), 1)
    rows = circ.collect()
    assert sorted(r["frequency"] for r in rows) == [1, 1]
    assert {round(r["avg_weight"], 6) for r in rows} == {0.7, 0.85}
    assert G.components(e).groupBy("component").count().count() == 2


def test_motif_importance(spark):
    d = spark.createDataFrame([(5, 0.8), (10, 0.6), (3, 0.9)], "frequency int, avg_weight double")
    got = [round(r["importance"], 2) for r in C.rank_motifs(d).orderBy(F.desc("importance")).collect()]
    assert got == [4.36, 2.48, 1.74]


def test_loop_and_centrality(spark):
    ring = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src long, dst long, weight double").withColumn("g", F.lit(1))
    assert [r["path"] for r in G.feedback_loops(ring, ["g"]).collect()] == [[0, 1, 2]]
    assert all(r["pagerank"] == pytest.approx(1 / 3) for r in G.pagerank(ring, ["g"]).collect())
    path = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "src long, dst long, weight double").withColumn("g", F.lit(1))
    b = {r["node"]: r["betweenness"] for r in G.betweenness(path, ["g"]).collect()}
    assert b[1] == pytest.approx(2 / 6) and b[2] == pytest.approx(2 / 6) and b[0] == 0.0


def test_bfs_betweenness_on_random_graph(spark):
    n = 12
    adj = np.triu(rng.random((n, n)) < 0.3, 1)
    es = [(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(adj | adj.T))]
    df = spark.createDataFrame(es, "src long, dst long, weight double").withColumn("g", F.lit(0))
    nodes = sorted({x for e in es for x in e[:2]})
    nb = {u: [v for a, v, _ in es if a == u] for u in nodes}
    want = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sig, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for v in nb[u]:
                if v not in dist:
                    dist[v], sig[v] = dist[u] + 1, 0.0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    sig[v] += sig[u]
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in nb[v]:
                if dist.get(u, -9) == dist[v] - 1:
                    dep[u] += sig[u] / sig[v] * (1 + dep[v])
            if v != s:
                want[v] += dep[v]
    k = len(nodes)
    got = {r["node"]: r["betweenness"] for r in G.betweenness(df, ["g"]).collect()}
    assert got == pytest.approx({u: w / ((k - 1) * (k - 2)) for u, w in want.items()}, abs=1e-9)


def test_node_ids(spark):
    df = spark.createDataFrame([("L3_F17",)], "n string")
    assert tuple(df.select(C.parse_node("n").alias("p")).first()["p"]) == (3, 17)
    with pytest.raises(Exception, match="invalid node id"):
        spark.createDataFrame([("x",)], "n string").select(C.parse_node("n")).collect()


def test_runs_overlaps_patterns(spark):
    seq = "HHHHCCEEE"
    res = spark.createDataFrame([(1, k, s) for k, s in enumerate(seq)], "protein_id long, pos long, ss string")
    assert [(r["start"], r["end"]) for r in Q.runs(res, F.col("ss") == "H").collect()] == [(0, 4)]
    assert [(r["start"], r["end"]) for r in Q.runs(res, F.col("ss") == "E").collect()] == [(6, 9)]
    assert Q.runs(res, F.col("ss") == "E", close_open=False).count() == 0
    hits = spark.createDataFrame([(1, "a", 0, 4, 0.9), (1, "b", 3, 6, 0.8), (1, "c", 6, 9, 0.7)], "protein_id long, motif string, start long, end long, confidence double")
    assert sorted(r["motif"] for r in Q.remove_overlaps(hits).collect()) == ["a", "c"]
    import re
    text = "GAGAAGPGCCKAAPPGTC"
    pr = spark.createDataFrame([(1, text)], "protein_id long, sequence string")
    pats = {"g": "G.G..G", "p": "PG", "k": "[RK]", "one": "G"}
    got = {(r["pattern"], r["start"], r["end"]) for r in Q.regex_spans(pr, pats).collect()}
    assert got == {(n, m.start(), m.end()) for n, p in pats.items() for m in re.finditer(p, text)}
    d = spark.createDataFrame([("10-50:PF00001;junk;60-120:PF00002",)], "d string").select(Q.parse_domains("d").alias("x"), Q.format_domains(Q.parse_domains("d")).alias("t")).first()
    assert [tuple(v) for v in d["x"]] == [(10, 50, "PF00001"), (60, 120, "PF00002")] and d["t"] == "10-50:PF00001;60-120:PF00002"


def test_exact_split(spark):
    df = spark.range(1003).withColumnRenamed("id", "protein_id")
    n = {r["split"]: r["count"] for r in Q.assign_split(df).groupBy("split").count().collect()}
    assert n == {"train": 802, "val": 100, "test": 101}


def test_boundary_regions_cover_without_peaks(spark):
    df = spark.createDataFrame([(1, 0, k, 1.0) for k in range(50)], "protein_id long, layer int, pos long, score double")
    assert [(r["start"], r["end"]) for r in B.boundary_regions(df).collect()] == [(0, 50)]


def test_bootstrap_is_stable_over_partitions(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.normal(3, 1, 2000))], "id long, v double")
    rows = [P.bootstrap_ci(df.repartition(n), "id", "v", 300).first() for n in (1, 9)]
    assert rows[0]["ci_low"] == pytest.approx(rows[1]["ci_low"]) and rows[0]["ci_low"] < 3.0 < rows[0]["ci_high"] + 0.1
    assert rows[0]["ci_high"] - rows[0]["ci_low"] == pytest.approx(2 * 1.96 / math.sqrt(2000), rel=0.25)


def test_spans_and_windows_of_long_sequences(spark):
    """Against plain Python; a text of 200,000 letters takes no more than its share, so nothing is quadratic in it."""
    import random
    import re
    import time

    from featspark.functions import tables as K
    from featspark.operators import sequence as Q

    rng = random.Random(3)
    texts = ["", None, "A" * 20, "P" * 21, "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYPESK") for _ in range(400)), "".join(rng.choice("PESKRQAG") for _ in range(200_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "protein_id long, sequence string")
    t = time.time()
    got = sorted(map(tuple, Q.disorder_windows(df).collect()))
    want = []
    for i, s in enumerate(texts):
        on = [x in K.DISORDER for x in s or ""]
        k = sum(on[:20])
        for start in range(len(on) - 20):
            if k > 12:
                want.append((i, start, k))
            k += on[start + 20] - on[start]
    assert got == want
    pats = {"a": "N[^P][ST][^P]", "b": "[ST].[RK]", "c": "P{2,5}"}
    spans = sorted(map(tuple, Q.regex_spans(df, pats).collect()))
    assert spans == sorted((i, n, *m.span()) for i, s in enumerate(texts) for n, p in pats.items() for m in re.finditer(p, s or ""))
    assert time.time() - t < 60
