"""Readers, writers and streaming trackers on files made in a temporary folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featspark.operators.gram import pair_moments
from featspark.sources import readers as R
from featspark.sources import views as S
from featspark.sources import writers as W
from featspark.streaming import trackers as X

SF = "/root/testdata/sf0.001"


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_csv_idlist(spark, tmp_path):
    fa = put(tmp_path / "a.fasta", ">p1 first protein\nACDE\nFG\n>p2\nKK>K\n\n")
    got = {r["id"]: r["sequence"] for r in R.read_sequences(spark, fa).collect()}
    assert got["p1"] == "ACDEFG" and set(got) == {"p1", "p2"}
    csv = put(tmp_path / "a.csv", "id,sequence\nx,ACD\n")
    assert R.read_sequences(spark, csv).first()["sequence"] == "ACD"
    with pytest.raises(ValueError, match="missing columns"):
        R.read_sequences(spark, put(tmp_path / "b.csv", "id,seq\nx,ACD\n"))
    with pytest.raises(ValueError, match="unsupported"):
        R.read_sequences(spark, put(tmp_path / "b.xyz", ""))
    assert [r["id"] for r in R.read_id_list(spark, put(tmp_path / "ids.txt", " p1 \n\np2\n")).collect()] == ["p1", "p2"]


def test_alignment_formats(spark, tmp_path):
    put(tmp_path / "f1.fa", ">a\nAC-\nD\n>b\nACGD\n")
    put(tmp_path / "f2.sto", "# STOCKHOLM 1.0\n\na AC.\nb ACG\n\na D\nb D\n//\n")
    put(tmp_path / "f3.aln", "CLUSTAL W\n\na  AC-\nb  ACG\n   ** \n\na  D\nb  D\n")
    rows = R.read_msa(spark, str(tmp_path)).collect()
    put(tmp_path / "f4.sto", "# STOCKHOLM 1.0\n\na AC\nb AG\n//\n# STOCKHOLM 1.0\n\na TTT\nc TT-\n//\n")
    two = {(r["family_id"], r["seq_idx"], r["seq_id"], r["aligned"]) for r in R.read_msa(spark, str(tmp_path / "f4.sto")).collect()}
    assert two == {("f4", 0, "a", "AC"), ("f4", 1, "b", "AG"), ("f4_2", 0, "a", "TTT"), ("f4_2", 1, "c", "TT-")}
    for fam in ("f1", "f2", "f3"):
        assert [(r["seq_id"], r["aligned"]) for r in sorted(rows, key=lambda r: r["seq_idx"]) if r["family_id"] == fam] == [("a", "AC-D"), ("b", "ACGD")]


def test_pdb_and_flatfile(spark, tmp_path):
    line = lambda k, atom, res, ch, n, x: f"ATOM  {k:5d}  {atom:<3s} {res} {ch}{n:4d}    {x:8.3f}{0.0:8.3f}{1.0:8.3f}\n"
    pdb = put(tmp_path / "1abc.pdb", line(1, "N", "ALA", "A", 1, 0.0) + line(2, "CA", "ALA", "A", 1, 1.5) + line(3, "N", "GLY", "A", 2, 2.0) + line(4, "C", "GLY", "A", 2, 4.0) + line(5, "CA", "GLY", "B", 1, 9.0))
    assert [(r["pos"], r["x"]) for r in R.read_pdb_ca(spark, pdb).orderBy("pos").collect()] == [(0, 1.5), (1, 3.0)]
    assert R.read_pdb_ca(spark, pdb, "B").first()["x"] == 9.0
    good = "ID   X\nAC   P1;\nDE   EC=1.2.3.4;\nGN   Name=abc;\nOS   Homo sapiens.\nDR   GO; GO:0003824; F:x\nKW   Kinase; Membrane.\nFT   DOMAIN          2..3\nFT                   /note=\"SH3\"\nSQ   SEQUENCE   4 AA\n     ACDE\n"
    path = put(tmp_path / "p.dat", good + "//\n" + good.replace("P1", "P2").replace("ACDE", "A" * 50) + "//\nID broken\n//\n")
    ok, bad = R.read_flatfile(spark, path, 10)
    r = ok.collect()
    assert [x["protein_id"] for x in r] == ["P1"] and r[0]["keywords"] == ["Kinase", "Membrane"] and r[0]["go_terms"] == ["GO:0003824"]
    assert tuple(r[0]["domains"][0]) == (1, 3, "SH3") and r[0]["ec_number"] == "1.2.3.4"
    assert sorted(x["reason"] for x in bad.collect()) == ["malformed", "too long"]


def test_activation_round_trip_and_kb(spark, tmp_path):
    vec = S.activations_vec(spark, SF)
    out = str(tmp_path / "act")
    W.write_activations(vec, out, {"model": "8M"})
    back = R.read_activations(spark, out, [1], ["protein_id", "pos", "vec"])
    assert back.count() == vec.filter("layer = 1").count()
    assert R.read_kb(spark, "motif_library").count() == 5
    with pytest.raises(ValueError):
        R.read_kb(spark, "nope")
    W.write_graph(vec.select("layer").distinct(), vec.select("layer").distinct(), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "edges")).count() == 4
    p = spark.createDataFrame([("p", ["a", "b"], [(1, 5, "d")])], "protein_id string, go_terms array<string>, domains array<struct<start:int,end:int,domain_id:string>>")
    W.write_proteins(p, str(tmp_path / "m"))
    assert tuple(spark.read.option("header", True).csv(str(tmp_path / "m")).first()) == ("p", "a;b", "1-5:d")


def test_stream_equals_batch(spark, tmp_path):
    vec = S.activations_vec(spark, SF)
    src = tmp_path / "in"
    ids = sorted(r[0] for r in vec.select("protein_id").distinct().collect())[:4]
    for k in ids:  # one file per trigger batch
        vec.filter(F.col("protein_id") == k).coalesce(1).write.mode("append").parquet(str(src))
    batch = vec.filter(F.col("protein_id").isin(ids))
    stream = X.activation_stream(spark, str(src), vec.schema)
    got = {(r["layer"], r["feature"]): r for r in X.run_complete(X.running_sums(X.long_stream(stream))).collect()}
    want = X.running_sums(S.to_long(batch)).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[(r["layer"], r["feature"])]
        assert g["activation_count"] == r["activation_count"] and g["magnitude_sum"] == pytest.approx(r["magnitude_sum"])
    stats, found = X.run_batches(X.activation_stream(spark, str(src), vec.schema), every=2, analysis=X.strong_links)
    assert spark.read.parquet(stats).select("batch_id").distinct().count() == 4
    assert spark.read.parquet(found).select("batch_id").distinct().count() == 2
    a = X.merged(spark, stats).agg(F.sum("sxy"), F.sum("n")).first()
    b = pair_moments(batch, "adjacent").agg(F.sum("sxy"), F.sum("n")).first()
    assert np.allclose(list(a), list(b))
    last = X.merged(spark, stats, last=2).agg(F.max("n")).first()[0]
    assert last == 50


def test_sums_continue_after_a_restart(spark, tmp_path):
    """Seven files, one a batch, in three runs over one location; folds happen every third batch."""
    vec = S.activations_vec(spark, SF)
    src, home = tmp_path / "in", str(tmp_path / "state")
    ids = sorted(r[0] for r in vec.select("protein_id").distinct().collect())[:7]
    stream = lambda: X.long_stream(X.activation_stream(spark, str(src), vec.schema))
    keys = ["layer", "feature"]

    def same(got, upto):
        want = {(r["layer"], r["feature"]): r for r in X.running_sums(S.to_long(vec.filter(F.col("protein_id").isin(ids[:upto])))).collect()}
        got = {(r["layer"], r["feature"]): r for r in got.collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert got[k]["samples"] == r["samples"] and got[k]["activation_count"] == r["activation_count"] and got[k]["magnitude_sum"] == pytest.approx(r["magnitude_sum"])

    done = 0
    for upto in (2, 3, 7):
        for k in ids[done:upto]:
            vec.filter(F.col("protein_id") == k).coalesce(1).write.mode("append").parquet(str(src))
        done = upto
        same(X.run_sums(stream(), X.running_sums, keys, home, keep_batches=3), upto)
    same(X.run_sums(stream(), X.running_sums, keys, home, keep_batches=3), 7)  # nothing new arrives
    written = {d.name for d in (tmp_path / "state" / "sums").iterdir()}
    assert written == {f"batch_id={k}" for k in range(7)}
    again = spark.read.parquet(home + "/sums/batch_id=5").agg(F.sum("samples")).first()[0]
    assert again == vec.filter(F.col("protein_id") == ids[5]).count() * 64  # a batch holds its own rows only
    stats, _ = X.run_batches(X.activation_stream(spark, str(src), vec.schema), location=home + "2")
    assert X.run_batches(X.activation_stream(spark, str(src), vec.schema), location=home + "2")[0] == stats
    assert spark.read.parquet(stats).select("batch_id").distinct().count() == 7
