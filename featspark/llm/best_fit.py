"""Best-fit packing of token sequences, certified by lower bounds and repacked where the bound is not met.

A document is its token ids and one closing id. Documents above the capacity are cut into full pieces and a rest; full
pieces are sequences of their own. All other pieces are dealt by a hash to nodes. A node reads its pieces longest first
(Spark sorts them, spilling if it must) and puts each into the sequence with the smallest gap that still takes it; only
open sequences are held. At its end the node knows the histogram of its lengths, from which dual feasible functions give
a lower bound of the number of sequences any packing needs. A node that meets its bound is certified; one above it, by
whole sequences or by a part of one, has a gap. The pieces of nodes with gaps are exchanged, that is dealt anew to fewer
nodes and packed again, and the new packing replaces the old one if it needs fewer sequences. When this gains nothing,
certified nodes with free places join in. All ends when the total equals the bound of the whole table (no packing is
better), or when no exchange gains anything, down to one node or to ``node_rows`` pieces a node; that limit bounds a
task, no piece is ever left out.

Bounds are exact integers. The functions are ``u_k`` (multiples of 1/(k+1) stay, others are rounded down to multiples of
1/k) applied after the threshold function that lifts lengths above ``capacity - e`` to a full sequence and drops those
below ``e``, for all ``e`` and small ``k``; the plain sum of lengths is among them.

Defined results: null text counts as empty; an empty text is one piece of length 1 (the closing id); rows that repeat
are packed as often as they occur; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepair import public_path
from .common import ids_and_text, map_rows, stash
from .word_ids import word_ids

CAPACITY = 2048
#: Fan-in of an exchange and the most pieces one node may hold after it.
MERGE, NODE_ROWS = 4, 4_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path, end = path or public_path("word_bpe_49k.json"), int(closing).to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, rows = word_ids(path), []
        texts = [t or "" for t in batch["text"].to_pylist()]
        for doc, ids in zip(batch["doc_id"].to_pylist(), coder.many(texts)):
            ids += end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_rows(ids_and_text(docs), cut, PIECE, rows=512)


@lru_cache(maxsize=2)
def _lifted(capacity: int) -> np.ndarray:
    """Row e: the threshold function of e at every length."""
    x, e = np.arange(capacity + 1), np.arange(capacity // 2 + 1)[:, None]
    return np.where(x > capacity - e, capacity, np.where(x < e, 0, x)).astype(np.int64)


def bounds(histogram: np.ndarray, capacity: int = CAPACITY, most_k: int = 8) -> Iterator[Fraction]:
    """Sequences that any packing needs, by one dual feasible function each; ``histogram[l]`` pieces have length l."""
    base = _lifted(capacity)
    yield Fraction(int((base @ histogram).max()), capacity)
    for k in range(1, most_k + 1):
        whole, rest = np.divmod((k + 1) * base, capacity)
        value = np.where(rest == 0, k * base, whole * capacity)  # k times u_k, in units of 1/capacity
        yield Fraction(int((value @ histogram).max()), k * capacity)


def lower_bound(histogram: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of these bounds in whole sequences."""
    return ceil(max(bounds(histogram, capacity)))


class _Node:
    """Open sequences of one node by gap; the smallest gap that fits is found from the bits of a mask."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.bins = capacity, 0, 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.histogram = np.zeros(capacity + 1, np.int64)

    def put(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            gap = length + (fits & -fits).bit_length() - 1
            stack = self.open[gap]
            at = stack.pop()
            if not stack:
                self.mask &= ~(1 << gap)
        else:
            gap, at = self.capacity, self.bins
            self.bins += 1
        left = gap - length
        if left:
            self.open[left].append(at)
            self.mask |= 1 << left
        return at, self.capacity - gap


def _packed(items: DataFrame, nodes: int, capacity: int) -> DataFrame:
    """``items`` (row, length) packed on ``nodes`` nodes: row, length, node, bin, offset; with row null one line per node: its pieces, sequences, the whole part of its bound and its free places."""
    fields = [("row", pa.int64()), ("length", pa.int64()), ("node", pa.int32()), ("bin", pa.int64()), ("offset", pa.int64()), ("free", pa.int64())]

    def closed(node: int, state: _Node) -> pa.RecordBatch:
        values = [None], [int(state.histogram.sum())], [node], [state.bins], [floor(max(bounds(state.histogram, capacity)))], [state.bins * capacity - int(state.histogram @ np.arange(capacity + 1))]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(values, fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            numbers, lengths = batch["node"].to_numpy(), batch["length"].to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if node != int(numbers[a]):
                    if state is not None:
                        yield closed(node, state)
                    node, state = int(numbers[a]), _Node(capacity)
                state.histogram += np.bincount(lengths[a:b], minlength=capacity + 1)
                places = [state.put(x) for x in lengths[a:b].tolist()]
                bins, offsets = zip(*places)
                yield pa.RecordBatch.from_arrays([batch["row"].slice(a, b - a), batch["length"].slice(a, b - a), batch["node"].slice(a, b - a), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64()), pa.nulls(b - a, pa.int64())], names=[n for n, _ in fields])
        if state is not None:
            yield closed(node, state)

    dealt = items.select("row", "length", F.pmod(F.xxhash64("row", F.lit(nodes)), F.lit(nodes)).cast("int").alias("node"))
    dealt = dealt.repartitionById(nodes, F.col("node")).sortWithinPartitions("node", F.desc("length"), "row")
    return dealt.mapInArrow(run, "row long, length long, node int, bin long, offset long, free long")


@dataclass
class Packing:
    """``sequences``: one row per piece with sequence_id and offset; the counts tell what was reached."""

    sequences: DataFrame
    n_sequences: int
    bound: int
    rounds: int


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, nodes: int | None = None, node_rows: int = NODE_ROWS) -> Packing:
    """Pack all documents; ``nodes`` is the number of partitions of the first round (default: the shuffle partitions)."""
    spark = docs.sparkSession
    cut = stash(pieces(docs, path, capacity).withColumn("row", F.monotonically_increasing_id()))
    lengths = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in lengths:
        histogram[length] = n
    full = int(histogram[capacity])
    histogram[capacity] = 0
    bound = lower_bound(histogram, capacity)

    def layer(packed: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int, int, int]]]:
        """The packing and per node, of which there are as many as partitions: pieces, sequences, whole part of the bound, free places."""
        packed = stash(packed)
        return packed, {r.node: (r.length, r.bin, r.offset, r.free) for r in packed.filter("row is null").collect()}

    def of(packed: DataFrame, chosen: list[int]) -> DataFrame:
        return packed.filter("row is not null").join(F.broadcast(spark.createDataFrame([(n,) for n in chosen], "node int")), "node", "left_semi")

    nodes, rounds = nodes or int(spark.conf.get("spark.sql.shuffle.partitions")), 0
    layers = [layer(_packed(cut.filter(F.col("length") < capacity).select("row", "length"), nodes, capacity))]
    # First the nodes above their own bound; once that gains nothing, all that have room: two certified nodes may still do better together.
    rules = [lambda node: node[1] > node[2], lambda node: node[3] > 0]
    while rules and sum(n[1] for _, stats in layers for n in stats.values()) > bound:
        chosen = [[k for k, n in stats.items() if rules[0](n)] for _, stats in layers]
        picked = [stats[k] for (_, stats), ks in zip(layers, chosen) for k in ks]
        used, least, fewer, gained = sum(n[1] for n in picked), max(1, -(-sum(n[0] for n in picked) // node_rows)), len(picked), False
        pending = None
        for (packed, _), ks in zip(layers, chosen):
            if ks:
                part = of(packed, ks).select("row", "length")
                pending = part if pending is None else pending.unionByName(part)
        while fewer > least and not gained:
            fewer = max(-(-fewer // MERGE), least)
            trial, stats = layer(_packed(pending, fewer, capacity))
            gained = sum(n[1] for n in stats.values()) < used
        if not gained:
            rules.pop(0)
            continue
        for (_, old), ks in zip(layers, chosen):
            for k in ks:
                del old[k]
        layers.append((trial, stats))
        rounds += 1
    places, total = None, 0
    for k, (packed, stats) in enumerate(layers):
        if not stats:
            continue
        total += sum(n[1] for n in stats.values())
        part = of(packed, sorted(stats)).select("row", (F.lit(k << 56) + F.shiftleft(F.col("node").cast("long"), 32) + F.col("bin")).alias("sequence_id"), "offset")
        places = part if places is None else places.unionByName(part)
    whole = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.filter(F.col("length") < capacity)
    rest = rest.join(places.hint("merge"), "row") if places is not None else rest.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    return Packing(whole.unionByName(rest).drop("row"), total + full, bound + full, rounds)
