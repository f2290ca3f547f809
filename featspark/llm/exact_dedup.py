"""Exact deduplication by a tree merge of sorted digest runs.

Every partition sorts its digests and merges equal neighbours into one entry: a *run*. Runs then move
through binomial rounds. There are ``2**k`` nodes, and round ``r`` exchanges entries between the two nodes
whose numbers differ in bit ``r``: each keeps the half of the digests that agrees with its own bit. The
runs that meet are merged in sorted order; an entry keeps the smallest identifier and the number of rows.
After ``k`` rounds all entries of a digest have met on one node and every node owns ``1/2**k`` of the
digests, so no task sees more than its share. Copies collapse inside the first run, before anything is
exchanged, hence a group holding a third of the corpus sends one entry per partition.

Two entries are equal only if the SHA-256, a second independent 64-bit hash and the byte length agree;
this is verified at every level.

Defined results: null text counts as empty; empty texts are equal to each other; rows that repeat with the
same identifier are copies of which exactly one stays; a null identifier counts as larger than all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ids_and_text, numbered, pick, stash

SCHEMA = pa.schema([("sha", pa.binary()), ("mix", pa.int64()), ("n_bytes", pa.int64()), ("no_id", pa.bool_()), ("doc_id", pa.int64()), ("row_id", pa.int64()), ("n", pa.int64()), ("node", pa.int32())])
RUN = "sha binary, mix long, n_bytes long, no_id boolean, doc_id long, row_id long, n long, node int"


def fingerprints(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, row_id (column ``row``, else numbered here) and the digests of the text after white space runs became single spaces."""
    d = ids_and_text(docs, (F.col(row) if row else F.monotonically_increasing_id()).alias("row_id"))
    d = d.withColumn("norm", F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    return d.select("doc_id", "row_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("mix"), F.octet_length("norm").cast("long").alias("n_bytes"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal neighbours of a sorted stream; the first of them has the smallest identifier."""
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=SCHEMA)
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        new = [pc.not_equal(t[c].slice(1), t[c].slice(0, t.num_rows - 1)) for c in ("sha", "mix", "n_bytes")]
        first = pa.concat_arrays([pa.array([True]), *pc.or_(pc.or_(new[0], new[1]), new[2]).chunks])
        starts = pc.indices_nonzero(first).to_numpy().astype(np.int64)
        sums = np.add.reduceat(t["n"].to_numpy(), starts)
        out = t.take(pa.array(starts)).set_column(t.schema.get_field_index("n"), "n", pa.array(sums, pa.int64())).combine_chunks().to_batches()[0]
        out = pa.RecordBatch.from_arrays(out.columns, schema=SCHEMA)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
        held = out.slice(out.num_rows - 1)
    if held is not None:
        yield held


def _sorted_run(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions("sha", "mix", "n_bytes", "no_id", "doc_id", "row_id").mapInArrow(_merge, RUN)


def merge_runs(prints: DataFrame, rounds: int | None = None) -> DataFrame:
    """One entry per distinct text: its digests, smallest doc_id, that row's row_id and the row count.

    ``rounds`` is the depth of the tree; by default there is a node for every shuffle partition.
    """
    if rounds is None:
        rounds = max(1, (int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    nodes = 1 << rounds
    runs = prints.select("sha", "mix", "n_bytes", F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", F.lit(1).cast("long").alias("n"), F.pmod(F.spark_partition_id(), F.lit(nodes)).alias("node"))
    runs = _sorted_run(runs)
    for r in range(rounds):
        bit = F.shiftright(F.col("mix"), r).bitwiseAND(F.lit(1)).cast("int")
        partner = F.col("node").bitwiseAND(F.lit(~(1 << r))).bitwiseOR(F.shiftleft(bit, r))
        runs = runs.withColumn("node", partner)
        runs = _sorted_run(runs.repartitionById(nodes, F.col("node")))
    return runs


def exact_duplicates(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """One row per input row: doc_id, row_id, keep_id, group_size, kept, text_sha256."""
    prints = stash(fingerprints(docs))
    best = merge_runs(prints, rounds).select("sha", "mix", "n_bytes", F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"), F.col("n").alias("group_size"))
    return prints.join(best, ["sha", "mix", "n_bytes"]).select(
        "doc_id", "row_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """``docs`` without its exact copies, all columns kept; the row with the smallest doc_id stays."""
    base, row = numbered(docs)
    stay = merge_runs(stash(fingerprints(base, row)), rounds).select(F.col("row_id").alias(row))
    return pick(base, stay, row).drop(row)
