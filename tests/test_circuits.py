"""Circuit enumeration against all node subsets, validation scores against numpy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featspark.operators import circuits as C
from featspark.sources.views import to_long


def graph(seed, nodes=11, n=16):
    rng = random.Random(seed)
    pairs = [(a, b) for a in range(nodes) for b in range(nodes) if a != b]
    return [(a, b, round(rng.random(), 3)) for a, b in rng.sample(pairs, n)]


def connected(nodes, near):
    seen, todo = {nodes[0]}, [nodes[0]]
    while todo:
        for u in near[todo.pop()]:
            if u in nodes and u not in seen:
                seen.add(u)
                todo.append(u)
    return len(seen) == len(nodes)


def all_sets(edges, sizes):
    """(nodes, adjacency bits, edges, weight) by testing every subset."""
    w = {(a, b): x for a, b, x in edges}
    names = sorted({x for e in w for x in e})
    near = {a: {b for b in names if (a, b) in w or (b, a) in w} for a in names}
    out = []
    for k in sizes:
        for nodes in itertools.combinations(names, k):
            if connected(nodes, near):
                cells = [w.get((a, b)) for a in nodes for b in nodes]
                out.append((nodes, "".join("0" if x is None else "1" for x in cells), sum(x is not None for x in cells), round(sum(x or 0 for x in cells), 6)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("share", [C.SHARED_GRAPH, 0])
def test_every_connected_set_once(spark, seed, share):
    edges, sizes = graph(seed), (3, 4, 5, 6, 7, 8) if share else (3, 4, 5)
    df = spark.createDataFrame(edges + [(4, 4, 1.0)], "src long, dst long, weight double")
    folded, inst = C.motif_subgraphs(df, sizes, share)
    want = all_sets(edges, sizes)
    got = sorted((tuple(r.nodes), r.structure, r.n_edges, round(r.weight_sum, 6)) for r in inst.collect())
    assert got == want  # equal lists: no set is missing, none comes twice
    counts = {}
    for _, bits, n, w in want:
        c = counts.setdefault(bits, [0, 0, 0.0])
        c[0], c[1], c[2] = c[0] + 1, c[1] + n, c[2] + w
    f = folded.groupBy("structure").agg(F.sum("frequency"), F.sum("n_edges"), F.sum("weight_sum")).collect()
    assert {r[0]: (r[1], r[2], round(r[3], 6)) for r in f} == {k: (a, b, round(c, 6)) for k, (a, b, c) in counts.items()}


def test_find_motifs_keeps_recurring_structures(spark):
    edges = graph(5)
    circ, inst = C.find_motifs(spark.createDataFrame(edges, "src long, dst long, weight double"), (3, 4))
    found = {r.structure: r.frequency for r in circ.collect()}
    want = {}
    for _, bits, _, _ in all_sets(edges, (3, 4)):
        want[bits] = want.get(bits, 0) + 1
    assert found == {k: n for k, n in want.items() if n >= 2} and inst.count() == sum(found.values())
    none = C.find_motifs(spark.createDataFrame([], "src long, dst long, weight double"))
    assert none[0].count() == none[1].count() == 0


@pytest.fixture(scope="module")
def circuit(spark):
    rng = np.random.default_rng(7)
    v = rng.random((40, 2, 6)).round(3) * (rng.random((40, 2, 6)) < 0.5)
    vec = spark.createDataFrame([(t // 5, t % 5, la, v[t, la].tolist()) for t in range(40) for la in range(2)], "protein_id long, pos long, layer int, vec array<double>")
    sets = [[0, 3, C.WIDE + 1], [1, 2, 4, C.WIDE], [C.WIDE + 2, C.WIDE + 3, C.WIDE + 5]]
    inst = spark.createDataFrame([("s%d" % k, n) for k, n in enumerate(sets)], "structure string, nodes array<long>")
    return v, vec, sets, C.circuit_nodes(inst).cache()


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (4, 1)])
def test_activity_histograms(circuit, blocks):
    v, vec, sets, cn = circuit
    got = {(r.structure, r.k): r.n for r in C.active_counts(cn, to_long(vec), 0.1, *blocks).collect()}
    for s, nodes in enumerate(sets):
        k = sum((v[:, n // C.WIDE, n % C.WIDE] > 0.1).astype(int) for n in nodes)
        assert {q: n for (name, q), n in got.items() if name == f"s{s}"} == {int(q): int((k == q).sum()) for q in set(k.tolist()) - {0}}
    out = {r.structure: r for r in C.stability(cn, to_long(vec), vec.select("protein_id", "pos").distinct()).collect()}
    for s, nodes in enumerate(sets):
        mask = np.stack([v[:, n // C.WIDE, n % C.WIDE] > 0.1 for n in nodes])
        assert np.isclose(out[f"s{s}"].stability, 1 - mask.std(0, ddof=1).mean()) and np.isclose(out[f"s{s}"].joint_share, mask.all(0).mean())


def test_task_relevance(spark, circuit):
    v, vec, sets, cn = circuit
    label = [(p, float(p % 3 + p / 10)) for p in range(7)]  # protein 7 has no label
    got = {r.structure: r.task_relevance for r in C.task_relevance(cn, to_long(vec), spark.createDataFrame(label, "protein_id long, label double")).collect()}
    pooled = v.reshape(8, 5, 2, 6).mean(1)[:7]
    for s, nodes in enumerate(sets):
        x = np.mean([pooled[:, n // C.WIDE, n % C.WIDE] for n in nodes], axis=0)
        assert np.isclose(got[f"s{s}"], abs(np.corrcoef(x, [q for _, q in label])[0, 1]))
    flat = spark.createDataFrame([(p, 1.0) for p in range(8)], "protein_id long, label double")
    assert {r.task_relevance for r in C.task_relevance(cn, to_long(vec), flat).collect()} == {None}
