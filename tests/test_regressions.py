"""Regression tests: degrees of freedom, empty regions, missing parts, motif sizes, unbounded rankings."""

import math
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from featspark.operators import alignment as M
from featspark.operators import circuits as C
from featspark.operators import graph as G
from featspark.operators import novelty as N
from featspark.operators import pairs as P
from featspark.operators import scoring as B
from featspark.operators import sequence as Q


def test_granger_counts_the_pairs_inside_proteins(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 25, 3))
    x[:, 1:, 1] += 0.8 * x[:, :-1, 0]
    vec = spark.createDataFrame([(p, 0, t, x[p, t].tolist()) for p in range(6) for t in range(25)], "protein_id long, layer int, pos int, vec array<double>")
    got = {(r.lag, r.i, r.j): r for r in P.granger_f(vec, 2).collect()}
    for lag in (1, 2):
        for i, j in permutations(range(3), 2):
            now, own, other = (np.concatenate([x[p, a:25 - lag + a, k] for p in range(6)]) for a, k in ((lag, j), (0, j), (0, i)))
            n = len(now)
            assert n == 6 * (25 - lag) and got[lag, i, j].dof == n - 2
            c = np.corrcoef(own, now)[0, 1]
            mse1 = ((now - c * own) ** 2).mean()
            b = np.linalg.lstsq(np.stack([own, other], 1), now, rcond=None)[0]
            mse2 = ((now - b[0] * own - b[1] * other) ** 2).mean()
            want = (mse1 - mse2) / mse2 * (n - 2) if mse2 < mse1 else None
            assert (got[lag, i, j].f_stat is None) == (want is None) and (want is None or math.isclose(got[lag, i, j].f_stat, want, rel_tol=1e-9))
    score = {(r.i, r.j): r.granger for r in P.granger(vec, 2).collect()}
    assert score[0, 1] > 0.99


def test_empty_regions_hold_no_position(spark):
    rows = spark.createDataFrame([("p", k, 1.0) for k in range(8)], "protein_id string, pos int, value double")
    regions = spark.createDataFrame([("p", "a", 5, 5), ("p", "b", 0, 0), ("p", "c", 6, 8), ("p", "d", 4, 2)], "protein_id string, domain_id string, start int, end int")
    assert sorted((r.domain_id, r.pos) for r in Q.in_region(rows, regions).collect()) == [("c", 6), ("c", 7)]
    pooled = spark.createDataFrame([("p", 1.0), ("q", 2.0)], "protein_id string, value double")
    lengths = spark.createDataFrame([("p", 0), ("q", 2)], "protein_id string, length int")
    assert B.repeat_protein(pooled, lengths).count() == 2


def test_scores_need_all_parts(spark):
    act = spark.createDataFrame([("p", 0, 0, 0, 1.0)], "protein_id string, layer int, pos int, feature int, value double")
    with pytest.raises(ValueError, match="coevolution_enrichment"):
        B.relevance_scores(act, [])


def test_motifs_match_at_every_allowed_size(spark):
    n = 6
    bits = "".join("1" if u < v else "0" for u in range(n) for v in range(n))
    got = {(r.motif, r.match_score) for r in C.match_motifs(spark.createDataFrame([(bits, n)], "structure string, size int")).collect()}
    assert got == {("cascade", 1.0), ("hub", 1.0), ("bi_fan", 1.0)}
    rng = np.random.default_rng(3)
    for _ in range(20):
        have = rng.random((5, 5)) < 0.4
        text = "".join("1" if b else "0" for b in have.ravel())
        for pattern in ([(0, 1), (0, 2), (1, 2)], [(0, 2), (0, 3), (1, 2), (1, 3)], [(0, 1), (1, 2), (2, 3)]):
            k = max(map(max, pattern)) + 1
            want = max(sum(have[m[a], m[b]] for a, b in pattern) for m in permutations(range(5), k)) / len(pattern)
            assert C.pattern_share(text, 5, pattern) == want


def test_motifs_of_five_nodes_by_default(spark):
    two_stars = [(c * 10, c * 10 + k, 0.5) for c in (1, 2) for k in range(1, 5)]
    circ, inst = C.find_motifs(spark.createDataFrame(two_stars, "src long, dst long, weight double"))
    by_size = {r["size"]: r.frequency for r in circ.collect()}
    assert by_size == {3: 12, 4: 8, 5: 2} and inst.count() == 22


def test_loops_of_any_length(spark):
    ring = spark.createDataFrame([(k, (k + 1) % 9) for k in range(9)], "src int, dst int")
    assert [len(r.path) for r in G.feedback_loops(ring, []).collect()] == [9]
    assert G.feedback_loops(ring, [], 5).count() == 0


def test_relations_carry_lag_and_mediators(spark):
    base = [(0, 1, 2, 0.5, 0.5)]
    direct = spark.createDataFrame(base, "layer int, cause int, effect int, strength double, confidence double")
    r = {x.mechanism: (x.lag, x.mediators) for x in P.union_relations(direct=direct, mediated=direct.withColumn("mediator", F.lit(7)), temporal=direct.withColumn("lag", F.lit(1))).collect()}
    assert r == {"direct": (0, []), "mediated": (0, [7]), "temporal": (1, [])}


def test_long_periods_and_whole_rankings(spark):
    rows = [("p", 0, t, 0, 1.0 if t % 30 == 0 else 0.0) for t in range(240)]
    act = spark.createDataFrame(rows, "protein_id string, layer int, pos int, feature int, value double")
    assert N.periodicity(act).first().periodicity > 0.5 and N.periodicity(act, 20).first().periodicity == 0
    d = spark.createDataFrame([(0, k, 0.5, 0.6, "pattern") for k in range(50)], "layer int, feature int, novelty_score double, confidence double, discovery_type string")
    assert N.annotate_discoveries(d).count() == 50 and N.annotate_discoveries(d, 3).count() == 3


def test_coevolution_reads_all_columns(spark):
    rng = np.random.default_rng(1)
    n = 104
    cells = [("f", s, c, "ACDE"[int(rng.integers(4))]) for s in range(6) for c in range(n)]
    m = spark.createDataFrame(cells, "family_id string, seq_idx int, col int, aa string")
    cols = M.variable_columns(M.conservation(m, M.sequence_weights(m)), None).count()
    assert cols > 100 and M.coevolution(m, M.sequence_weights(m)).count() == cols * (cols - 1) // 2


def test_partial_correlation_given_all_others(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8))
    x[:, 3] += x[:, 0] + 0.5 * x[:, 1]
    x[:, 7] = x[:, 6] + x[:, 5] + 0.3 * rng.normal(size=200)
    x = np.concatenate([x, np.ones((200, 1))], 1)  # a constant feature correlates with nothing
    vec = spark.createDataFrame([(k // 20, 0, k % 20, r.tolist()) for k, r in enumerate(x)], "protein_id long, layer int, pos int, vec array<double>")
    got = {(r.i, r.j): r.partial_corr for r in P.partial_corr(P.covariances(vec)).collect()}
    for i, j in permutations(range(8), 2):
        rest = np.concatenate([x[:, [k for k in range(8) if k not in (i, j)]], np.ones((200, 1))], 1)
        a, b = (x[:, k] - rest @ np.linalg.lstsq(rest, x[:, k], rcond=None)[0] for k in (i, j))
        assert math.isclose(got[i, j], abs(np.corrcoef(a, b)[0, 1]), abs_tol=1e-7)
    assert got[8, 0] == 0 and len(got) == 72


def test_probes_and_projection_cover_all_layers(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    from featspark.sources import views as S

    layers = {r.layer for r in S.activations_vec(spark, sf).select("layer").distinct().collect()}
    assert len(layers) > 1
    for name in ("M1_linear_probe_class", "M2_pca"):
        assert {r.layer for r in entry.queries()[name](spark, sf).select("layer").distinct().collect()} == layers


def test_feedback_loops_through_all_edges(spark):
    import duckdb

    import __spark_entry__ as entry
    from check_queries import TABLES

    sf, name = "/root/testdata/sf0.001", "G12_feedback_loops_all_edges"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = {tuple(r) for r in con.execute(f"select layer, path from ({entry.oracle_sql()[name]})").fetchall()}
    got = [(r.layer, r.path) for r in entry.queries()[name](spark, sf).collect()]
    assert len(got) == len(want) == 101 and set(got) == want


def test_bootstrap_query_uses_all_replicates(spark, monkeypatch):
    import inspect

    import __spark_entry__ as entry

    seen = []
    real = inspect.signature(P.bootstrap_ci)

    def spy(*args, **more):
        call = real.bind(*args, **more)
        call.apply_defaults()
        seen.append(call.arguments["replicates"])
        return spark.range(1)

    monkeypatch.setattr(P, "bootstrap_ci", spy)
    entry.queries()["Q40_bootstrap_ci"](spark, "/root/testdata/sf0.001")
    assert seen == [1000]


def test_messages_over_a_hand_made_hierarchy(spark):
    """Six residues, overlapping regions, one residue and one region without a parent."""
    from featspark.operators import scoring as B

    act = spark.createDataFrame([(1, p, 0, 7, float(v)) for p, v in enumerate([1, 3, 5, 7, 9, 11])], "protein_id long, pos long, layer int, feature int, value double")
    reg = spark.createDataFrame([(1, 0, 2), (1, 1, 4), (1, 4, 5)], "protein_id long, start int, end int")
    dom = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 3, "b")], "protein_id long, start int, end int, domain_id string")
    got = {(r.level, r.node): (r.up, r.down) for r in B.pass_messages(act, B.level_links(act, reg, dom)).collect()}
    r0, r1, r4 = 2.0, 5.0, 9.0
    a, b = (r0 + r1) / 2, r1
    top = (a + b) / 2
    da, db = (a + top) / 2, (b + top) / 2
    d0, d1 = (r0 + da) / 2, (r1 + (da + db) / 2) / 2
    want = {("protein", "protein"): (top, top), ("domain", "a"): (a, da), ("domain", "b"): (b, db), ("region", "0"): (r0, d0), ("region", "1"): (r1, d1), ("region", "4"): (r4, r4),
            ("residue", "0"): (1.0, (1 + d0) / 2), ("residue", "1"): (3.0, (3 + (d0 + d1) / 2) / 2), ("residue", "2"): (5.0, (5 + d1) / 2), ("residue", "3"): (7.0, (7 + d1) / 2),
            ("residue", "4"): (9.0, (9 + r4) / 2), ("residue", "5"): (11.0, 11.0)}
    assert got.keys() == want.keys() and all(abs(got[k][i] - want[k][i]) < 1e-12 for k in want for i in (0, 1))


@pytest.mark.parametrize("parts", [1, 7])
def test_bootstrap_of_any_statistic(spark, parts):
    """Mean, correlation and median against numpy with the same weights."""
    from featspark.operators import pairs as P

    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    y = x + rng.normal(size=500)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(999, None, 1.0)], "id long, x double, y double").repartition(parts)
    ids = np.array([r[0] for r in spark.range(500).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    w = P.poisson_weights(ids, 120, 5)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    corr = [np.cov(x, y, aweights=k)[0, 1] / np.sqrt(np.cov(x, aweights=k) * np.cov(y, aweights=k)) for k in w.T]
    order = np.argsort(x)
    median = [x[order][np.searchsorted(np.cumsum(k[order]), k.sum() / 2)] for k in w.T]
    for stat, cols, want, near in ((P.MeanOf(), ["x"], (x @ w) / w.sum(0), 1e-9), (P.CorrelationOf(), ["x", "y"], np.array(corr), 1e-9), (P.QuantileOf(0.5, float(x.min()), float(x.max())), ["x"], np.array(median), 0.02)):
        got = P.bootstrap(df, "id", cols, stat, 120, 0.9, 5, block=50).first()
        assert np.allclose([got.estimate, got.ci_low, got.ci_high], [want.mean(), np.quantile(want, 0.05), np.quantile(want, 0.95)], atol=near)


def test_statistical_novelty_fires(spark):
    """A heavy-tailed, a periodic and an inactive feature: the first two are discoveries with their evidence, the third is not."""
    rng = np.random.default_rng(4)
    rows = []
    for p in range(4):
        for t in range(72):
            rows.append((p, t, 0, 0, 30.0 if rng.random() < 0.03 else 0.2 + 0.01 * float(rng.random())))
            rows.append((p, t, 0, 1, 1.0 if t % 6 == 0 else 0.0))
            rows.append((p, t, 0, 2, 0.05 * float(rng.random())))
    act = spark.createDataFrame(rows, "protein_id long, pos long, layer int, feature int, value double")
    got = {r.feature: r for r in N.statistical_novelty(act).collect()}
    assert "heavy_tailed" in got[0].evidence and got[0].novelty_score > 0.3
    assert {"periodic", "sparse_pattern"} & set(got[1].evidence)
    assert 2 not in got
    h = {r.feature: r for r in N.hypotheses(N.statistical_novelty(act)).collect()}
    assert all((r.hypothesis != "") == ("multimodal" in got[f].evidence) for f, r in h.items())
    e = N.experiments(N.statistical_novelty(act)).filter("feature = 0").collect()
    assert [x.type for x in e] == ["mutagenesis", "biochemical"]
    circ = spark.createDataFrame([("a", 7, 3, 0.5, 1.5), ("b", 8, 2, 0.5, 1.1), ("c", 3, 9, 0.5, 3.9)], "structure string, size int, frequency long, avg_weight double, importance double")
    c = {r.structure: r for r in N.circuit_discoveries(circ).collect()}
    assert {k: r.feature for k, r in c.items()} == {"a": -1001, "b": -1002} and c["b"].novelty_score == 0.8
    assert N.hypotheses(N.circuit_discoveries(circ)).filter("feature = -1001").first().hypothesis == "Circuit 1 represents a coordinated functional module"
