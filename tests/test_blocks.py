"""Tiled pair sums: dense against numpy, sparse against dense, any number of partitions and any block size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featspark.operators import aggregates as A
from featspark.operators import blocks as B
from featspark.operators import circuits as C
from featspark.operators import layout as L
from featspark.operators import pairs as P
from featspark.operators.gram import lag_moments, pair_moments


def table(rows, cols):
    return {tuple(r[c] for c in cols): r for r in rows}


@pytest.fixture(scope="module")
def data(spark):
    """Three layers of 40 features, 30 tokens in five proteins, mostly zeros; two tokens without any activation."""
    rng = np.random.default_rng(3)
    v = np.where(rng.random((30, 3, 40)) < 0.15, rng.random((30, 3, 40)).round(3), 0.0)
    v[7] = v[19] = 0.0
    v[:, 1, 39] = 0.0
    rows = [(t // 6, t % 6, la, [float(x) for x in v[t, la]]) for t in range(30) for la in range(3)]
    vec = spark.createDataFrame(rows, "protein_id long, pos long, layer int, vec array<double>")
    act = spark.createDataFrame([(int(t) // 6, int(t) % 6, int(la), int(f), float(v[t, la, f])) for t, la, f in zip(*np.nonzero(v))], "protein_id long, pos long, layer int, feature int, value double")
    tokens = vec.select("protein_id", "pos").distinct()
    return v, vec.cache(), act.cache(), tokens.cache()


KEY = ["la", "lb", "i", "j"]
SUMS = ["n", "sx", "sxx", "sy", "syy", "sxy"]


def same(a, b, values=SUMS):
    a, b = table(a.collect(), KEY), table(b.collect(), KEY)
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(np.array([a[k][c] for c in values], float), np.array([b[k][c] for c in values], float), equal_nan=True), k


@pytest.mark.parametrize("parts,block", [(1, 8), (4, 16), (16, 256)])
def test_dense_moments(data, parts, block):
    v, vec, _, _ = data
    got = table(B.moments(vec.repartition(parts).select("layer", F.col("vec").alias("x"), F.col("vec").alias("y")), ["layer"], block).collect(), ["layer", "i", "j"])
    assert len(got) == 3 * 40 * 40
    for (la, i, j), r in got.items():
        x, y = v[:, la, i], v[:, la, j]
        assert np.allclose([r[c] for c in SUMS], [30, x.sum(), (x * x).sum(), y.sum(), (y * y).sum(), x @ y])


@pytest.mark.parametrize("parts,block", [(1, 8), (4, 16), (16, 256)])
@pytest.mark.parametrize("mode", ["same", "adjacent", "cross", "upper"])
def test_sparse_equals_dense(data, mode, parts, block):
    _, vec, act, tokens = data
    same(B.sparse_pair_moments(act.repartition(parts), mode, tokens, 40, block=block), pair_moments(vec, mode))


def test_sparse_lags_and_co_active_only(data):
    _, vec, act, tokens = data
    same(lag_moments(act, tokens, 40), lag_moments(vec))
    some = pair_moments(act, "upper", tokens, 40, all_pairs=False)
    same(some, pair_moments(vec, "upper").filter("sxy != 0"))
    same(P.causal_strength(act, tokens, 40), P.causal_strength(vec), ["causal_strength"])


def test_crowded_tiles_are_multiplied(data, monkeypatch):
    _, vec, act, tokens = data
    codes = B.Codes.of(act, 40, 16)
    parts = B._split, B._sparse_product
    rows = B.sparse_rows(act, codes, every=tokens).toArrow()
    split = parts[0](rows["code"].combine_chunks(), rows["value"].combine_chunks(), 16)
    for a in split.values():
        for b in split.values():
            thin = parts[1](a, b, 16)
            monkeypatch.setattr(B, "CROWDED", -1)
            thick = parts[1](a, b, 16)
            monkeypatch.undo()
            assert (thin is None and thick is None) or np.allclose(thin, thick)


def test_tiles_are_sent_when_too_many_are_held(data, monkeypatch):
    _, vec, _, _ = data
    monkeypatch.setattr(B, "HELD", 1000)  # local mode: the fold runs in this function's closure
    got = B.moments(vec.select(F.col("vec").alias("x"), F.col("vec").alias("y")), [], 8)
    assert got.agg(F.sum("n")).first()[0] == 90 * 40 * 40


def test_operators_on_encoded_activations(spark, data):
    """Q1, Q6, A9 and the interaction graph on what the dictionary encoder emits, against its dense form."""
    rng = np.random.default_rng(5)
    x = spark.createDataFrame([(p, t, la, rng.normal(size=6).tolist()) for p in range(4) for t in range(12) for la in range(2)], "protein_id long, pos long, layer int, vec array<double>")
    w = spark.createDataFrame([(f, rng.normal(size=6).tolist(), -0.8) for f in range(24)], "feature int, row array<double>, bias double")
    act = L.dict_encode(x, w).cache()
    tokens = x.select("protein_id", "pos")
    full = x.select("protein_id", "pos", "layer").join(act, ["protein_id", "pos", "layer"], "left").groupBy("protein_id", "pos", "layer").agg(F.map_from_entries(F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "value")))).alias("m"))
    vec = full.select("protein_id", "pos", "layer", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("vec")).cache()
    a, b = (table(P.pearson_matrix(d, "upper", tokens, 24).collect(), KEY) for d in (act, vec))
    assert a.keys() == b.keys() and all((a[k]["corr"] is None and b[k]["corr"] is None) or np.isclose(a[k]["corr"], b[k]["corr"]) for k in a)
    a, b = (table(d.collect(), ["i", "j"]) for d in (A.coactivation(act, 0.1, vec, 24), A.coactivation(vec, 0.1)))
    assert a.keys() == b.keys() and all(np.isclose(a[k]["p"], b[k]["p"]) for k in a)
    nodes, edges = C.interaction_graph(act, 0.6, tokens=tokens)
    on = vec.withColumn("vec", F.transform("vec", lambda v: F.when(v != 0, 1.0).otherwise(0.0)))
    want = table(P.causal_strength(vec).filter("causal_strength > 0.6").collect(), KEY)
    got = {(r.src // C.WIDE, r.dst // C.WIDE, r.src % C.WIDE, r.dst % C.WIDE): r for r in edges.collect()}
    assert got and set(got) <= set(want) and all(np.isclose(r.weight, want[k]["causal_strength"]) for k, r in got.items())
    m = table(pair_moments(on, "upper").collect(), KEY)
    for k, r in got.items():
        n, x1, y1, k11 = (m[k][c] for c in ("n", "sx", "sy", "sxy"))
        cells = np.array([[n - x1 - y1 + k11, y1 - k11], [x1 - k11, k11]]) / n
        outer = np.outer(cells.sum(1), cells.sum(0))
        assert np.isclose(r.mutual_info, (cells[cells > 0] * np.log(cells[cells > 0] / outer[cells > 0])).sum())


def test_wide_dictionary(spark):
    """2,048 features: the partial tiles of a task stay below its bound, sums agree with numpy on sampled pairs."""
    f, n = 2048, 60
    rng = np.random.default_rng(8)
    rows = [(t, int(k), float(v)) for t in range(n) for k, v in zip(rng.choice(f, 40, replace=False), rng.random(40))]
    dense = np.zeros((n, f))
    for t, k, v in rows:
        dense[t, k] = v
    act = spark.createDataFrame(rows, "pos long, feature int, value double").selectExpr("0L as protein_id", "pos", "0 as layer", "feature", "value")
    some = B.sparse_pair_moments(act, "same", width=f, all_pairs=False)
    total = dense.T @ dense
    got = {(r.i, r.j): r for r in some.collect()}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(total)) if i < j}
    assert set(got) == want
    assert all(np.isclose(r.sxy, total[k]) and np.isclose(r.sx, dense[:, k[0]].sum()) and np.isclose(r.syy, (dense[:, k[1]] ** 2).sum()) for k, r in got.items())
    # what a fold may hold: all tiles of one layer pair above the diagonal
    tiles = (f // B.BLOCK) * (f // B.BLOCK + 1) // 2
    assert tiles * B.BLOCK * B.BLOCK * 8 < B.HELD


@pytest.mark.parametrize("block", [2, 5, 32])
def test_joint_scores(spark, block):
    rng = np.random.default_rng(4)
    x, y, w = rng.integers(0, 3, (200, 7)), rng.integers(0, 4, (200, 6)), rng.random(200)
    df = spark.createDataFrame([(int(k % 2), a.tolist(), b.tolist(), float(c)) for k, (a, b, c) in enumerate(zip(x, y, w))], "k int, x array<int>, y array<int>, w double").repartition(5)
    got = table(B.joint_scores(df, ["k"], 3, 4, B.information, "mi", block, "w").collect(), ["k", "i", "j"])
    cells = {(r.k, r.i, r.j, r.bx, r.by): r.n for r in B.joint_cells(df, ["k"], 3, 4, block).collect()}
    assert len(got) == 2 * 7 * 6
    for (k, i, j), r in got.items():
        c, plain = np.zeros((3, 4)), np.zeros((3, 4), int)
        np.add.at(c, (x[k::2, i], y[k::2, j]), w[k::2])
        np.add.at(plain, (x[k::2, i], y[k::2, j]), 1)
        p = c / c.sum()
        q = np.outer(p.sum(1), p.sum(0))
        assert np.isclose(r.mi, (p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())
        assert {(a, b): cells[k, i, j, a, b] for a in range(3) for b in range(4) if (k, i, j, a, b) in cells} == {(int(a), int(b)): plain[a, b] for a, b in zip(*np.nonzero(plain))}


def test_counters_agree():
    rng = np.random.default_rng(6)
    x, y, w = rng.integers(0, 5, (90, 4)), rng.integers(0, 6, (90, 3)), rng.random(90)
    for weights in (None, w):
        hot = B._counter(5, 6)(x, y, weights)
        wide = B._counter(5, 600)(x, y, weights).reshape(4, 5, 3, 600)[..., :6]
        assert np.allclose(hot.reshape(4, 5, 3, 6), wide)


def test_empty(spark, data):
    _, vec, act, tokens = data
    assert B.moments(vec.limit(0).select(F.col("vec").alias("x"), F.col("vec").alias("y")), []).count() == 0
    assert B.sparse_pair_moments(act.limit(0), "upper").count() == 0


def test_dictionary_in_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 8))
    w, c, b = rng.normal(size=(200, 8)), rng.normal(size=200), rng.normal(size=8)
    vec = spark.createDataFrame([(k, 0, 1, x[k].tolist()) for k in range(30)], "protein_id long, pos long, layer int, vec array<double>")
    rows = spark.createDataFrame([(f, w[f].tolist(), float(c[f])) for f in range(200) if f != 70], "feature int, row array<double>, bias double")
    want = np.maximum(0, (x - b) @ w.T + c)
    want[:, 70] = 0
    for block in (None, 64, 7):
        got = L.dict_encode(vec, rows, b.tolist(), block).collect()
        assert len(got) == (want > 0).sum() and all(np.isclose(r.value, want[r.protein_id, r.feature]) for r in got)
    assert L.dict_encode(vec, rows.limit(0)).count() == 0
