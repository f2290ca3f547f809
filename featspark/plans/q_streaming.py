"""Queries: streaming trackers over the driver files, compared with their batch results."""

from pyspark.sql import functions as F

from ..sources import views as S
from ..streaming import trackers as X
from .q_stats import XADJ
from .registry import query


def stream_of(s, p, name):
    """A table as a stream of its files; the pattern in the path stands for a single file as well as for a folder of parts."""
    return s.readStream.schema(s.read.parquet(f"{p}/{name}.parquet").schema).option("maxFilesPerTrigger", 1).parquet(f"{p}/{name}.parque[t]")


def vec_stream(s, p):
    e = stream_of(s, p, "embeddings").select(F.expr(f"vec_id div {S.TOKENS}").alias("protein_id"), (F.col("vec_id") % S.TOKENS).alias("pos"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(S.LAYERS - 1))).alias("layer"))
    return e.select("protein_id", "pos", "layer", S.drift_vector().alias("vec"))


@query("X1_stream_accumulate", """select layer, feature, sum((abs(value)>0.1)::int) as activation_count, sum(abs(value)) as magnitude_sum, count(*) as samples from act group by all""", "act", d="magnitude_sum", i="activation_count")
def _(s, p):
    return X.run_sums(X.long_stream(vec_stream(s, p)), X.running_sums, ["layer", "feature"])


@query("X1_stream_moments", "select la, i, j, n, sxy from tm", "act", d="sxy", i="n", extra=XADJ)
def _(s, p):
    stats, _f = X.run_batches(vec_stream(s, p))
    return X.merged(s, stats).select("la", "i", "j", F.col("n").cast("long").alias("n"), "sxy")


@query("X2_stream_last_batches", "select la, i, j, corr from tm where abs(corr)>0.5", "act", d="corr", extra=XADJ)
def _(s, p):
    stats, _f = X.run_batches(vec_stream(s, p))
    return X.strong_links(X.merged(s, stats, last=100))


@query("X3_stream_circuits", "select la, i, j, corr from tm where abs(corr)>0.5", "act", d="corr", extra=XADJ)
def _(s, p):
    _s, found = X.run_batches(vec_stream(s, p), every=1, analysis=X.strong_links)
    t = s.read.parquet(found)
    return t.join(F.broadcast(t.agg(F.max("batch_id").alias("batch_id"))), "batch_id").drop("batch_id")


@query("X4_stream_mean_metrics", "select epoch, metric, avg(value) as mean_value, count(*) as n from log group by all", "log", d="mean_value")
def _(s, p):
    e = stream_of(s, p, "events").select(F.col("user_id").alias("epoch"), F.col("event_type").alias("metric"), "value", "ts")
    t = X.run_sums(e, X.log_sums, ["epoch", "metric"])
    return t.select("epoch", "metric", (F.col("value_sum") / F.col("n_values")).alias("mean_value"), "n")
