"""Incremental trackers on Structured Streaming.

The batch trackers keep running sums over batches. Here the sums are either native streaming
aggregates or per-batch sufficient statistics written under ``batch_id=<n>``: rewriting the same
batch after a failure replaces its own folder, so replays change nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.num import count_if
from ..operators.aggregates import active
from ..operators.gram import cross_moments, layer_pairs
from ..session import checkpoint_dir
from ..sources.views import to_long


def new_location(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def running_sums(act: DataFrame) -> DataFrame:
    """Streaming form of the accumulated statistics: counts, magnitude sums, samples per (layer, feature)."""
    return act.groupBy("layer", "feature").agg(count_if(active()).alias("activation_count"), F.sum(F.abs("value")).alias("magnitude_sum"), F.count("*").alias("samples"))


def running_means(log: DataFrame, watermark: str | None = None) -> DataFrame:
    """Epoch averages of a metric log; with a watermark on ``ts`` duplicate events are dropped within it."""
    if watermark is not None:
        log = log.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["epoch", "metric", "ts"])
    return log.groupBy("epoch", "metric").agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


def drop_duplicate_proteins(stream: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["protein_id", "layer", "pos"])


def log_sums(log: DataFrame, watermark: str | None = None) -> DataFrame:
    """Sums behind the epoch averages of a metric log, for :func:`run_sums`."""
    if watermark is not None:
        log = log.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["epoch", "metric", "ts"])
    return log.groupBy("epoch", "metric").agg(F.sum("value").alias("value_sum"), F.count("value").alias("n_values"), F.count("*").alias("n"))


def run_sums(stream: DataFrame, partial, keys: list[str], location: str | None = None, keep_batches: int = 64) -> DataFrame:
    """Drain the available input; the sums of ``partial`` per ``keys`` over everything the location has seen.

    A batch writes its own sums under ``batch_id=<n>`` and nothing else: no state is carried or rewritten, and a batch
    that runs again after a failure replaces its own folder. Give the same ``location`` to go on where an earlier run
    ended; without one the tracker starts anew. Every ``keep_batches`` batches the finished ones are folded into one.
    """
    spark = stream.sparkSession
    base = location or new_location(spark, "stream-sums")
    schema = partial(spark.createDataFrame([], stream.schema)).schema

    def total(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in schema.names if c not in keys])

    def parts(upto: int) -> DataFrame:
        """Sums up to a batch: the last fold before it and the batches after that fold."""
        start = max([f for f in range(keep_batches - 1, upto + 1, keep_batches) if f < upto or _exists(spark, f"{base}/folded/upto={f}")], default=-1)
        paths = [f"{base}/folded/upto={start}"] * (start >= 0) + [f"{base}/sums/batch_id={k}" for k in range(start + 1, upto + 1)]
        return spark.read.schema(schema).parquet(*paths)

    def sink(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{base}/sums/batch_id={batch_id}")
        if batch_id % keep_batches == keep_batches - 1:
            paths = [f"{base}/folded/upto={batch_id - keep_batches}"] * (batch_id >= keep_batches) + [f"{base}/sums/batch_id={k}" for k in range(batch_id - keep_batches + 1, batch_id + 1)]
            total(spark.read.schema(schema).parquet(*paths)).write.mode("overwrite").parquet(f"{base}/folded/upto={batch_id}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = _batches_done(spark, base)
    return total(spark.createDataFrame([], schema) if last < 0 else parts(last))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _batches_done(spark: SparkSession, base: str) -> int:
    """Number of the last batch whose sums are written; batches are numbered without gaps."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/sums")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return -1
    return max((int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if f.getPath().getName().startswith("batch_id=")), default=-1)


def run_complete(result: DataFrame, reset: bool = True, checkpoint: str | None = None) -> DataFrame:
    """Drain the available input into a table holding the aggregate's latest state.

    ``reset`` starts from a new checkpoint; pass ``checkpoint`` to continue an earlier run.
    """
    spark = result.sparkSession
    ckpt = new_location(spark, "stream-state") if reset or checkpoint is None else checkpoint
    out = new_location(spark, "stream-out")

    last = []

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        last[:] = [batch_id]

    q = result.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/batch_id={last[0]}") if last else spark.createDataFrame([], result.schema)


def batch_statistics(vec: DataFrame) -> DataFrame:
    """Sufficient statistics of one batch: cross moments of consecutive layers per feature pair."""
    return cross_moments(layer_pairs(vec, "adjacent"), ["la", "lb"])


def run_batches(vec_stream: DataFrame, every: int | None = None, analysis=None, location: str | None = None):
    """Write each batch's statistics; every ``every``-th batch also write ``analysis(statistics so far)``.

    Returns (statistics path, analysis path). The same ``location`` continues an earlier run.
    """
    spark = vec_stream.sparkSession
    base = location or new_location(spark, "batches")
    stats, found = f"{base}/statistics", f"{base}/analysis"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch_statistics(batch).write.mode("overwrite").parquet(f"{stats}/batch_id={batch_id}")
        if every and analysis is not None and batch_id % every == 0:
            so_far = merged(batch.sparkSession, stats, upto=batch_id)
            analysis(so_far).write.mode("overwrite").parquet(f"{found}/batch_id={batch_id}")

    q = vec_stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stats, found


def merged(spark: SparkSession, stats: str, last: int | None = None, upto: int | None = None) -> DataFrame:
    """Sum of the batch statistics, over all batches or the ``last`` n; partition pruning skips the rest."""
    t = spark.read.parquet(stats)
    if upto is not None:
        t = t.filter(F.col("batch_id") <= upto)
    if last is not None:
        top = t.agg(F.max("batch_id").alias("top")).first()["top"]
        t = t.filter(F.col("batch_id") > top - last)
    return t.groupBy("la", "lb", "i", "j").agg(*[F.sum(k).alias(k) for k in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def strong_links(moments: DataFrame, thr: float = 0.5) -> DataFrame:
    """Periodic circuit view: strong feature links of consecutive layers from the statistics so far."""
    from ..operators.gram import with_corr
    return with_corr(moments).filter(F.abs("corr") > thr).select("la", "i", "j", "corr")


def activation_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Vectors from a folder that receives parquet files, one file per trigger batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def long_stream(vec_stream: DataFrame) -> DataFrame:
    return to_long(vec_stream)
