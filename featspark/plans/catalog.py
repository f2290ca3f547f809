"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import evolution as E
from ..sources import views as S
from . import q_circuits, q_pairs, q_scoring, q_sequence, q_sparse, q_stats, q_streaming, q_structure  # noqa: F401
from . import q_reports  # noqa: F401  (after the queries whose SQL it joins)
from .registry import ORACLES, QUERIES, tidy

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark, path):
    """Top features by frequency x magnitude with the counts of their layer transitions."""
    vec = S.activations_vec(spark, path)
    top = A.top_features(A.feature_stats(S.to_long(vec)), 10)
    kinds = E.classify_transitions(vec).groupBy("feature", "transformation_type").agg(F.count("*").alias("n"))
    return tidy(top.join(kinds, "feature"))
