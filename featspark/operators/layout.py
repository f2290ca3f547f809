"""Row layout: assembling modalities, filling gaps, padding for export, applying dictionaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.num import c
from ..functions.tables import DATASET_PRESETS, LAYER_PRESETS
from ..session import broadcast_if_small
from .blocks import matrix


def assemble(proteins: DataFrame, vec: DataFrame, coords: DataFrame, residues: DataFrame) -> DataFrame:
    """One row per activation token with its residue, coordinates and protein fields; missing modalities are NULL."""
    key = ["protein_id", "pos"]
    return vec.join(residues, key, "left").join(coords, key, "left").join(proteins, "protein_id", "left")


def fill_missing(df: DataFrame, cols: list[str], flag: str = "has_structure") -> DataFrame:
    """Zeros for a missing modality plus a flag that says whether it was there."""
    out = df.withColumn(flag, F.col(cols[0]).isNotNull())
    return out.fillna(0.0, cols)


def pad_export(vec: DataFrame, max_len: int | None = None) -> DataFrame:
    """(protein_id, layer, length, rows): vectors in position order, cut or zero-padded to a common length (for trainers)."""
    g = vec.groupBy("protein_id", "layer").agg(F.array_sort(F.collect_list(F.struct("pos", "vec"))).alias("s")).select(
        "protein_id", "layer", F.size("s").alias("length"), F.transform("s", lambda e: e.vec).alias("rows"))
    if max_len is None:
        g = g.join(F.broadcast(g.agg(F.max("length").alias("_m"))))
    else:
        g = g.withColumn("_m", F.lit(max_len))
    zero = F.transform(F.element_at("rows", 1), lambda _: F.lit(0.0))
    padded = F.concat(F.slice("rows", 1, F.col("_m")), F.array_repeat(zero, F.greatest(F.lit(0), F.col("_m") - F.col("length")).cast("int")))
    return g.select("protein_id", "layer", F.least("length", "_m").alias("length"), padded.alias("rows"))


def l2_normalize(vec: DataFrame) -> DataFrame:
    return vec.withColumn("vec", V.normalize("vec"))


def strip_special(vec: DataFrame, lengths: DataFrame) -> DataFrame:
    """Drop begin / end tokens: keep positions 1 .. length, renumbered from 0."""
    j = vec.join(lengths.select("protein_id", "length"), "protein_id").filter("pos between 1 and length")
    return j.withColumn("pos", F.col("pos") - 1).drop("length")


def select_layers(vec: DataFrame, layers: list[int] | None = None, preset: str | None = None, dataset: bool = False) -> DataFrame:
    """Explicit layers, or those of a model-size preset (default: layers 1-6). On partitioned data this prunes files."""
    if layers is None:
        layers = (DATASET_PRESETS if dataset else LAYER_PRESETS).get(preset or "", list(range(1, 7)))
    return vec.filter(F.col("layer").isin(layers))


def complete_layers(vec: DataFrame, layers: list[int], width: int) -> DataFrame:
    """A zero vector for every layer a token lacks."""
    toks = vec.select("protein_id", "pos").distinct().select("protein_id", "pos", F.explode(F.array(*[F.lit(k) for k in layers])).alias("layer"))
    return toks.join(vec, ["protein_id", "pos", "layer"], "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), width)))


def head_proteins(vec: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` proteins in key order (a sampling operator)."""
    ids = vec.select("protein_id").distinct().orderBy("protein_id").limit(n)
    return vec.join(broadcast_if_small(ids), "protein_id", "left_semi")


def merge_embeddings(dfs: list[DataFrame]) -> DataFrame:
    """Union of embedding sets; for an id in several sets the first set wins as a whole."""
    out = None
    for k, df in enumerate(dfs):
        part = df.withColumn("_src", F.lit(k))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("protein_id").agg(F.min("_src").alias("_src"))
    return out.join(first, ["protein_id", "_src"]).drop("_src")


#: Bytes of dictionary rows that one pass holds.
BLOCK_BYTES = 64 << 20


def dict_encode(vec: DataFrame, weights: DataFrame, pre_bias: list[float] | None = None, block: int | None = None) -> DataFrame:
    """Sparse feature activations relu((x - b) W^T + c), ``weights``: (feature, row ARRAY<DOUBLE>, bias DOUBLE).

    The dictionary is cut into blocks of ``block`` features (default: about 64 MB of rows). Every block is one pass
    over the vectors with that block alone in driver and tasks, so a dictionary of any size works in bounded memory,
    and a token's features simply meet in the result. Vectors are neither shuffled nor copied.
    """
    top = weights.agg(F.max("feature").alias("f"), F.max(F.size("row")).alias("d")).first()
    if top.f is None:
        return vec.sparkSession.createDataFrame([], ENCODED)
    width = top.d
    block = block or max(1, BLOCK_BYTES // (8 * width))
    out = None
    for at in range(0, top.f + 1, block):
        part = _encode_block(vec, weights.filter((F.col("feature") >= at) & (F.col("feature") < at + block)), np.zeros(width) if pre_bias is None else np.asarray(pre_bias, float))
        out = part if out is None else out.unionByName(part)
    return out


ENCODED = "protein_id long, pos long, layer int, feature int, value double"


def _encode_block(vec: DataFrame, weights: DataFrame, pre_bias: np.ndarray) -> DataFrame:
    t = weights.select(F.col("feature").cast("int").alias("feature"), F.col("row").cast("array<double>").alias("row"), F.col("bias").cast("double").alias("bias")).toArrow()
    w = t["row"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, len(pre_bias))
    shared = vec.sparkSession.sparkContext.broadcast((t["feature"].to_numpy().astype(np.int32), np.ascontiguousarray(w.T), t["bias"].to_numpy() - w @ pre_bias))

    def run(batches):
        names, w, bias = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows if len(names) else 0, 2048):
                b = whole.slice(at, 2048)
                a = np.maximum(0.0, matrix(b.column(3)) @ w + bias)
                r, f = np.nonzero(a)
                idx = pa.array(r)
                yield pa.RecordBatch.from_arrays([b.column(k).take(idx) for k in range(3)] + [pa.array(names[f]), pa.array(a[r, f])], names=["protein_id", "pos", "layer", "feature", "value"])

    src = vec.select(F.col("protein_id").cast("long").alias("protein_id"), F.col("pos").cast("long").alias("pos"), F.col("layer").cast("int").alias("layer"), "vec")
    return src.mapInArrow(run, ENCODED)


def dict_decode(act: DataFrame, weights: DataFrame, bias: Column | None = None) -> DataFrame:
    """Reconstructed vectors W_d f + b from sparse activations, ``weights``: (feature, row). Join on the feature, sum per dimension."""
    j = act.join(weights.select("feature", "row"), "feature").select("protein_id", "pos", "layer", "value", F.posexplode("row").alias("dim", "w"))
    s = j.groupBy("protein_id", "pos", "layer", "dim").agg(F.sum(F.col("value") * F.col("w")).alias("v"))
    out = s.groupBy("protein_id", "pos", "layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda e: e.v).alias("vec"))
    return out if bias is None else out.withColumn("vec", F.zip_with("vec", c(bias), lambda a, b: a + b))


def export_dictionary(weights: DataFrame, dims: int) -> DataFrame:
    return weights.select(F.col("feature").alias("feature_id"), *[F.col("vec")[k].alias(f"dim_{k}") for k in range(dims)])
