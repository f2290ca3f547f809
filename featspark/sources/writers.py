"""Sinks: metadata, activations, reports, graphs, structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequence import format_domains


def write_proteins(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Metadata with lists joined by ``;`` and domains as ``start-end:id`` text."""
    out = df
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t == "array<string>":
            out = out.withColumn(f.name, F.array_join(f.name, ";"))
        elif t.startswith("array<struct<start"):
            out = out.withColumn(f.name, format_domains(f.name))
    w = out.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def write_activations(vec: DataFrame, path: str, meta: dict | None = None, rows_per_file: int = 1_000_000) -> None:
    """Partitioned by layer, clustered by protein so that a protein's rows are adjacent.

    The number of protein buckets follows the rows of the largest layer, so files have about ``rows_per_file`` rows at any size.
    """
    largest = vec.groupBy("layer").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    buckets = max(1, -(-largest // rows_per_file))
    out = vec.repartition("layer", F.pmod(F.xxhash64("protein_id"), F.lit(buckets))).sortWithinPartitions("layer", "protein_id", "pos")
    out.write.mode("overwrite").partitionBy("layer").option("compression", "zstd").parquet(path)
    if meta is not None:
        rows = [(str(k), str(v)) for k, v in sorted(meta.items())]
        vec.sparkSession.createDataFrame(rows, "key string, value string").write.mode("overwrite").json(path.rstrip("/") + "_meta")


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_structures(coords: DataFrame, contacts: DataFrame, residues: DataFrame, path: str) -> None:
    for name, df in (("coords", coords), ("contacts", contacts), ("residues", residues)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_dictionary(weights: DataFrame, path: str, dims: int, fmt: str = "parquet") -> None:
    from ..operators.layout import export_dictionary as table
    write_report(table(weights, dims), path) if fmt == "csv" else table(weights, dims).write.mode("overwrite").parquet(path)
