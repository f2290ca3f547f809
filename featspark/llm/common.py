"""Shared helpers of the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: White space of the contracts: the space and the five control characters from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh one in local runs."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or checkpoint_dir(spark)


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, and the name of that column.

    It is the doc_id where that is complete and unique (checked over all rows, ids only). Otherwise the rows are
    numbered and written once: numbers given anew in a second scan could differ, since splits depend on the
    executors alive at the time.
    """
    name = "__row"
    while name in map(str.lower, docs.columns):
        name += "_"
    key = F.col("doc_id").cast("long")
    if docs.select(key.alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn(name, key), name
    return stash(docs.withColumn(name, F.monotonically_increasing_id())), name


def pick(base: DataFrame, chosen: DataFrame, row: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``base`` chosen by ``row``. Always a sort-merge join: it behaves alike at every size, while the
    chosen rows grow with the corpus and must not be broadcast."""
    return base.join(chosen.hint("merge"), row, how)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 1024) -> DataFrame:
    """Apply ``fn`` to slices of at most ``rows`` rows, so that a worker holds little beside one Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def ids_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns never reach it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
