"""Exact percentiles, ranks and quantile codes over groups of any size.

``percentile`` keeps every distinct value of a group in one task. Here a group is cut into value
buckets by a monotone function of the value (a log-spaced grid), counted with map-side combine, and
only the buckets that hold a wanted rank are looked at value by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import c

STEPS_PER_OCTAVE = 64


def value_bucket(v) -> Column:
    """Monotone bucket number: equal-ratio cells on each side of zero."""
    v = c(v).cast("double")
    mag = F.floor((F.log2(F.abs(v)) + 1100) * STEPS_PER_OCTAVE).cast("long")
    return F.when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0).cast("long"))


def percentiles(df: DataFrame, by: list[str], value: str, fractions: list[float]) -> DataFrame:
    """Linear-interpolation percentiles: (by, fraction, percentile)."""
    v = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = v.groupBy(*by, value_bucket("_v").alias("_b")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    run = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = counts.select(*by, "_b", (F.sum("_n").over(run) - F.col("_n")).alias("_lo"), F.sum("_n").over(run).alias("_hi"),
                          F.sum("_n").over(w).alias("_t"))
    frac = F.explode(F.array(*[F.lit(float(f)) for f in fractions]))
    spans = spans.withColumn("fraction", frac).withColumn("_p", F.col("fraction") * (F.col("_t") - 1))
    ends = F.explode(F.array_distinct(F.array(F.floor("_p"), F.ceil("_p"))))
    wanted = spans.withColumn("_r", ends).filter((F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_hi")))
    cells = wanted.select(*by, "_b").distinct()
    inside = (v.withColumn("_b", value_bucket("_v")).join(cells, [*by, "_b"], "left_semi")
              .groupBy(*by, "_b", "_v").agg(F.count("*").alias("_n")))
    run2 = Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.select(*by, "_b", "_v", F.sum("_n").over(run2).alias("_c2"), (F.sum("_n").over(run2) - F.col("_n")).alias("_c1"))
    local = F.col("_r") - F.col("_lo")
    hit = wanted.join(ranked, [*by, "_b"]).filter((local >= F.col("_c1")) & (local < F.col("_c2")))
    frac_part = F.max(F.col("_p") - F.floor("_p"))
    lo, hi = F.min("_v"), F.max("_v")
    return hit.groupBy(*by, "fraction").agg((lo + (hi - lo) * frac_part).alias("percentile"))


def percentile_table(df, by, value, fractions) -> DataFrame:
    """One row per group with the percentiles as an array ordered by fraction."""
    p = percentiles(df, by, value, fractions)
    return p.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("fraction", "percentile"))), lambda s: s.percentile).alias("edges"))


def digitize(act: DataFrame, by: list[str], value: str = "value", edges: int = 10) -> DataFrame:
    """Add ``code`` = number of the group's ``edges`` linear percentiles that are <= value."""
    e = percentile_table(act, by, value, [k / (edges - 1) for k in range(edges)])
    return act.join(e, by).withColumn("code", F.size(F.filter("edges", lambda x: x <= F.col(value)))).drop("edges")


def ranks(df: DataFrame, by: list[str], value: str, method: str = "average", ties: list[str] | None = None) -> DataFrame:
    """Add ``rank`` (1-based) of ``value`` inside its group.

    ``average`` gives tied values their mean rank, ``ordinal`` breaks ties by ``ties``.
    """
    d = df.withColumn("_b", value_bucket(value))
    counts = d.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offs = counts.select(*by, "_b", (F.sum("_n").over(run) - F.col("_n")).alias("_off"))
    if method == "ordinal":
        w = Window.partitionBy(*by, "_b").orderBy(value, *(ties or []))
        return d.withColumn("_k", F.row_number().over(w)).join(offs, [*by, "_b"]).withColumn("rank", F.col("_off") + F.col("_k")).drop("_b", "_k", "_off")
    if method != "average":
        raise ValueError(f"unknown rank method {method!r}")
    vals = d.groupBy(*by, "_b", value).agg(F.count("*").alias("_n"))
    run2 = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vals = vals.withColumn("_c", F.sum("_n").over(run2) - F.col("_n")).join(offs, [*by, "_b"])
    vals = vals.select(*by, value, (F.col("_off") + F.col("_c") + (F.col("_n") + 1) / F.lit(2.0)).alias("rank"))
    return df.join(vals, [*by, value])
