"""Second moments of all feature pairs, for dense vectors and for sparse activations.

The sums themselves are folded in tiles (``blocks``); this module pairs the vectors of layers and positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import pearson
from . import blocks


def cross_moments(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n, sx, syy, ... per (keys, i, j) for rows holding two dense vectors."""
    return blocks.moments(pairs, keys, x=x, y=y)


def is_sparse(act: DataFrame) -> bool:
    """Long activations (feature, value) instead of dense vectors (vec)."""
    return "vec" not in act.columns


def with_corr(moments: DataFrame) -> DataFrame:
    return moments.withColumn("corr", pearson("n", "sx", "sy", "sxx", "syy", "sxy"))


def layer_pairs(vec: DataFrame, mode: str = "adjacent") -> DataFrame:
    """(protein_id, pos, la, lb, x, y): vectors of two layers of the same token.

    ``adjacent``: la, la+1; ``upper``: la <= lb; ``same``: la = lb; ``cross``: la < lb.
    One shuffle on the token key; a token holds at most one row per layer.
    """
    if mode == "same":
        return vec.select("protein_id", "pos", F.col("layer").alias("la"), F.col("layer").alias("lb"), F.col("vec").alias("x"), F.col("vec").alias("y"))
    toks = vec.groupBy("protein_id", "pos").agg(F.collect_list(F.struct("layer", "vec")).alias("ls"))
    test = {"adjacent": lambda a, b: b.layer == a.layer + 1, "upper": lambda a, b: b.layer >= a.layer,
            "cross": lambda a, b: b.layer > a.layer}[mode]
    make = lambda a: F.transform(F.filter("ls", lambda b: test(a, b)),
                                 lambda b: F.struct(a.layer.alias("la"), b.layer.alias("lb"), a.vec.alias("x"), b.vec.alias("y")))
    return toks.select("protein_id", "pos", F.explode(F.flatten(F.transform("ls", make))).alias("p")).select("protein_id", "pos", "p.*")


def lag_pairs(vec: DataFrame, lag: int = 1, cross_layers: bool = True) -> DataFrame:
    """(la, lb, x, y) with x the vector ``lag`` positions earlier in the same protein, la <= lb."""
    prev = vec.select("protein_id", (F.col("pos") + lag).alias("pos"), F.col("layer").alias("la"), F.col("vec").alias("x"))
    cur = vec.select("protein_id", "pos", F.col("layer").alias("lb"), F.col("vec").alias("y"))
    cond = F.col("la") <= F.col("lb") if cross_layers else F.col("la") == F.col("lb")
    return prev.join(cur, ["protein_id", "pos"]).filter(cond)


def pair_moments(act: DataFrame, mode: str = "adjacent", tokens: DataFrame | None = None, width: int | None = None, all_pairs: bool = True) -> DataFrame:
    """Moments for feature pairs of two layers; in ``same``/``upper`` mode only i < j inside a layer.

    ``act`` has dense vectors, or sparse long activations; for these ``tokens`` names all tokens (default: those with
    any activation) and ``all_pairs=False`` leaves out pairs that are never active together.
    """
    if is_sparse(act):
        return blocks.sparse_pair_moments(act, mode, tokens, width, all_pairs)
    half = (lambda key: key[0] == key[1]) if mode in ("upper", "same") else None
    return blocks.moments(layer_pairs(act, mode), ["la", "lb"], half=half)


def lag_moments(act: DataFrame, tokens: DataFrame | None = None, width: int | None = None, all_pairs: bool = True) -> DataFrame:
    """Moments of x one position before y, la <= lb, all ordered pairs."""
    if is_sparse(act):
        return blocks.sparse_lag_moments(act, 1, tokens, width, all_pairs)
    return blocks.moments(lag_pairs(act), ["la", "lb"])
