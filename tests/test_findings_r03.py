"""Findings of the third review: work that grew with features x pairs, short proteins, tables that are folders, runs without circuits."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_queries import norm
from featspark.functions import tables as K
from featspark.operators import graph
from featspark.operators import novelty as N
from featspark.operators import sequence as Q
from featspark.operators import structure as ST


SF = "/root/testdata/sf0.001"


def refuse(*_):
    raise AssertionError("one row per feature and neighbour went through a join loop")


def test_spatial_clusters_join_neighbours_once_per_protein(spark, monkeypatch):
    rnd = random.Random(5)
    coords = spark.createDataFrame([(p, i, *(rnd.uniform(0, 26) for _ in range(3))) for p in range(4) for i in range(60)], "protein_id long, pos long, x double, y double, z double")
    act = spark.createDataFrame([(p, i, la, f, rnd.choice([0.0, 0.05, 0.2, -0.9])) for p in range(4) for i in range(62) for la in range(2) for f in (0, 1, 63, 64, 200)],
                                "protein_id long, pos long, layer int, feature int, value double")
    on = act.filter("abs(value) > 0.1")
    pts = on.join(coords, ["protein_id", "pos"]).withColumn("protein_id", F.concat_ws(":", "protein_id", "layer", "feature")).select("protein_id", "pos", "x", "y", "z")
    want = sorted(tuple(map(int, r.protein_id.split(":")[1:])) + (r.n, r.k) for r in
                  ST.dbscan3d(pts, 8.0, 3).groupBy("protein_id").agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("k")).collect())
    monkeypatch.setattr(graph, "cut_lineage", refuse)
    N.structural_novelty(act, coords).collect()
    got = sorted(tuple(r) for r in N.spatial_clusters(on, coords).collect())
    assert got == want and len({r[3] for r in want}) > 2


STREAMS = ["X1_stream_moments", "X3_stream_circuits", "X2_stream_last_batches", "X1_stream_accumulate"]


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Embeddings as a folder of three files whose last protein has six tokens only, as in the larger tables."""
    d = tmp_path_factory.mktemp("parts")
    spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 106").repartition(3, "vec_id").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


def check(spark, path, names):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet/*.parquet'")
    for name in names:
        got, want = entry.queries()[name](spark, path).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert len(want) and norm(got) == norm(want), name


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_tables_that_are_folders(spark, parts, name):
    check(spark, parts, [name])


@pytest.mark.parametrize("name", ["B19_repeat_protein", "B19_resample", "P12_pad_export", "S18_read_structures"])
def test_sql_takes_the_length_from_the_protein(spark, parts, name):
    check(spark, parts, [name])


@pytest.mark.parametrize("name", ["SO4_circuit_modularity", "Q42_circuit_interpretability", "C10_metrics_all"])
def test_modularity_without_circuits(spark, tmp_path, name):
    """Unrelated vectors, so no circuit: nothing overlaps and modularity is 1, in SQL too."""
    rows = [(v, [round(math.sin(12.9898 * (64 * v + k) ** 1.37) * 0.2, 4) for k in range(64)], v % 5) for v in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(spark, str(tmp_path), [name])
    got = entry.queries()[name](spark, str(tmp_path)).toPandas()
    assert name == "C10_metrics_all" or got["modularity"].tolist() == [1.0]


def test_whole_strings_give_the_results_of_the_rows(spark):
    rnd = random.Random(9)
    rows = [(1, "A"), (2, "AIL"), (3, "IIIIC"), (4, "CAACAAC"), (5, "SAKTAD"), (6, "K" * 9)] + [(10 + i, "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rnd.randrange(1, 400)))) for i in range(30)]
    ss = {a: K.SS8[ord(a) % 8] for a in K.AMINO}
    p = spark.createDataFrame([(i, s, "".join(ss[a] for a in s)) for i, s in rows], "protein_id long, sequence string, states string").cache()
    res = p.select("protein_id", F.posexplode(F.arrays_zip(F.split("sequence", "").alias("aa"), F.split("states", "").alias("ss"))).alias("pos", "z")).select("protein_id", "pos", "z.aa", "z.ss").cache()
    regions = spark.createDataFrame([(i, f"d{k}", a, b) for i, _ in rows for k, (a, b) in enumerate([(0, 4), (3, 900), (5, 5), (-2, 2)])], "protein_id long, domain_id string, start int, end int")
    variants = spark.createDataFrame([(0, "A"), (3, "C"), (53, "R"), (2, "L")], "pos int, wt string")
    both = [
        (Q.runs(res, F.col("ss").isin("H", "G", "I"), 3), Q.runs_of(p, "HGI", 3)),
        (Q.runs(Q.residue_properties(res), F.col("kd_unit") > 0.6, 3, "kd_unit", close_open=False), Q.hydrophobic_runs_of(p)),
        (Q.transitions_ss(res).groupBy("protein_id", "from_state", "to_state").agg(F.count("*").alias("n")), Q.transition_counts_of(p)),
        (Q.ss_motifs(res), Q.ss_motifs_of(p)), (Q.remove_overlaps(Q.ss_motifs(res)), Q.ss_motifs_of(p, overlaps=False)), (Q.ss_quality(res), Q.ss_quality_of(p)), (Q.property_patterns(res), Q.property_patterns_of(p)),
        (Q.in_region(res, regions).select("protein_id", "domain_id", "pos", "aa"), Q.in_region_of(p, regions)),
        (Q.hbond_sites(res).drop("ss"), Q.hbond_sites_of(p)), (Q.variant_sites(res.drop("ss"), variants), Q.variant_sites_of(p, variants)),
    ]
    for rowwise, whole in both:
        got = whole.toPandas()
        assert norm(got.round(9)) == norm(rowwise.toPandas()[got.columns].round(9)) and len(got)
    for name in ("W3_transitions", "B11_ss_motifs", "A43_ss_quality", "C7_property_patterns", "W2_runs", "P18_hbond_sites"):
        assert "Window" not in entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name


def test_messages_of_vectors_are_those_of_rows(spark):
    """Overlapping regions, a residue without a parent, a null element, two layers."""
    from featspark.operators import scoring as B

    value = lambda p, layer, f: None if (p, layer, f) == (2, 0, 1) else float((p * 7 + layer * 3 + f * 5) % 11)
    at = [(prot, p, layer) for prot in (1, 2) for p in range(6) for layer in (0, 1)]
    vecs = spark.createDataFrame([(prot, p, layer, [value(p, layer, f) for f in range(3)]) for prot, p, layer in at], "protein_id long, pos long, layer int, vec array<double>")
    act = spark.createDataFrame([(prot, p, layer, f, value(p, layer, f)) for prot, p, layer in at for f in range(3)], "protein_id long, pos long, layer int, feature int, value double")
    reg = spark.createDataFrame([(1, 0, 2), (1, 1, 4), (1, 2, 3), (1, 4, 5), (2, 0, 6)], "protein_id long, start int, end int")
    dom = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 3, "b"), (2, 3, 6, "a")], "protein_id long, start int, end int, domain_id string")
    links = B.level_links(act, reg, dom)
    got, want = ({tuple(r)[:5]: (r.up, r.down) for r in df.select("protein_id", "layer", "feature", "level", "node", "up", "down").collect()}
                 for df in (B.pass_messages_vec(vecs, links, 3), B.pass_messages(act, links)))
    same = lambda a, b: a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-12
    assert got.keys() == want.keys() and all(same(got[k][i], want[k][i]) for k in want for i in (0, 1))


def test_message_query_moves_no_row_per_feature(spark, monkeypatch):
    from featspark.operators import scoring as B

    monkeypatch.setattr(B, "pass_messages", None)
    got = entry.queries()["B17_messages"](spark, "/root/testdata/sf0.001")
    assert got.filter("level = 'residue'").count() == spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count() * 4 * 64


def test_periodicity_reads_the_activations_once(spark):
    """Of vectors as of rows; a null position, a protein without a name and a repeated row count as in a self join."""
    rnd = random.Random(9)
    rows = [(prot, p, layer, [0.9 if (p + (prot or 0)) % (6 + f) == 0 or rnd.random() < 0.02 else 0.01 for f in range(3)] + [None]) for prot in (1, 2, None) for layer in (0, 1) for p in range(60 if prot else 5)]
    rows += [(1, 6, 0, [0.5] * 4), (1, 61, 1, [-0.7] * 4), (2, None, 0, [0.8] * 4)]
    vecs = spark.createDataFrame(rows, "protein_id long, pos long, layer int, vec array<double>")
    act = vecs.select("protein_id", "pos", "layer", F.posexplode("vec").alias("feature", "value"))
    of, long = ({(r.layer, r.feature): r.periodicity for r in df.collect()} for df in (N.periodicity_of(N.active_places_of(vecs)), N.periodicity(act)))
    on = [(r.protein_id, r.pos, r.layer, r.feature) for r in act.filter("abs(value) > 0.1").collect()]
    top, want = 62, {}
    for layer in (0, 1):
        for f in range(4):
            at = [(q, p) for q, p, la, g in on if (la, g) == (layer, f)]
            acf = [sum(b[1] - a[1] == lag for a in at for b in at if a[0] == b[0] and None not in a + b) / len(at) if len(at) >= 5 else 0 for lag in range(top // 2 + 1)]
            peaks = [k for k in range(5, top // 2) if acf[k] > 0.5 and acf[k] > acf[k - 1] and acf[k] > acf[k + 1]]
            steps = [y - x for x, y in zip(peaks, peaks[1:])]
            mean = sum(steps) / len(steps) if steps else 0
            cv = math.sqrt(sum((x - mean) ** 2 for x in steps) / len(steps)) / (mean + 1e-10) if steps else 1
            want[layer, f] = min(1.0, acf[peaks[0]]) if len(peaks) > 1 and cv < 0.2 else 0.0
    assert any(want.values()) and of.keys() == long.keys() == want.keys()
    assert all(abs(of[k] - want[k]) < 1e-9 and abs(long[k] - want[k]) < 1e-9 for k in want)
